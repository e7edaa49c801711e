"""Secrets in texts and in what their URL, Unicode, base64 and compressed layers hide.

A text is the first entry of a worklist. Every layer is scanned; its encoded parts are decoded to new layers, until
none is new. A layer knows for each of its characters which characters of the text it comes from, so a secret that
is found in any layer has a span in the text. Base64 is read over line breaks and from each of its four phases, as
characters of its alphabet may stand before and behind it; compressed data are looked for anywhere in decoded bytes,
and in their contents again.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

# Fixed values of the contract: kinds in order, their patterns and least lengths (of group 2, or of the match).
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = (8, 16, 32)

# What an assignment or a long hexadecimal run needs; texts without it are not searched further.
_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_LONG_HEX = re.compile(r"[0-9a-f]{32}")

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([Dd][89ABab][0-9A-Fa-f]{2})\\u([Dd][C-Fc-f][0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
# base64 lines that only line breaks part; one of less than 16 characters alone is none
_BREAK = r"[ \t]*(?:\r\n?|\n)[ \t]*"
_BASE64 = re.compile(rf"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{{16,}}+|[A-Za-z0-9+/_-]++(?={_BREAK}[A-Za-z0-9+/_-]))(?:{_BREAK}[A-Za-z0-9+/_-]++)*+")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+")
_QUOTED = re.compile(r"(?<![!-~])[!-~]*?%[0-9A-Fa-f]{2}[!-~]*")
_BYTE = re.compile(r"%[0-9A-Fa-f]{2}|.", re.DOTALL)
_URLSAFE = str.maketrans("-_", "+/")

# All patterns and all escapes are ASCII, and the shortest secret has 14 characters: shorter stretches hold none.
_STRETCH = re.compile(rb"[\t-\r -~]{14,}")
_MAGIC = re.compile(rb"(?=\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd|[\x08\x18\x28\x38\x48\x58\x68\x78])", re.DOTALL)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of a layer, leftmost and non-overlapping per kind; matches that are too short are dropped after matching."""
    found = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(n in low for n in _NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST[0]]
    if b"akia" in low:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST[1]]
    if _LONG_HEX.search(text):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST[2]]
    return sorted(found)


class Layer:
    """A decoded text; ``starts`` and ``ends`` say for each character where it lies in the first text."""

    __slots__ = ("text", "starts", "ends")

    def __init__(self, text: str, starts: np.ndarray, ends: np.ndarray):
        self.text, self.starts, self.ends = text, starts, ends

    def span(self, start: int, end: int) -> tuple[int, int]:
        return int(self.starts[start:end].min()), int(self.ends[start:end].max())


def _replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with every match that ``decode`` turns into ``(text, pieces)`` replaced; pieces are the matched characters of each new one."""
    texts, starts, ends, at, changed = [], [], [], 0, False
    for m in pattern.finditer(layer.text):
        if (got := decode(m)) is None:
            continue
        changed = True
        text, pieces = got
        texts += [layer.text[at : m.start()], text]
        lows = np.asarray([p[0] for p in pieces], dtype=np.int64) + m.start()
        highs = np.asarray([p[1] for p in pieces], dtype=np.int64) + m.start()
        starts += [layer.starts[at : m.start()], layer.starts[lows]]
        ends += [layer.ends[at : m.start()], layer.ends[highs - 1]]
        at = m.end()
    if not changed:
        return None
    return Layer("".join([*texts, layer.text[at:]]), np.concatenate([*starts, layer.starts[at:]]), np.concatenate([*ends, layer.ends[at:]]))


def _from_percent(m: re.Match) -> tuple[str, list[tuple[int, int]]]:
    # bytes that are no UTF-8 stand as single surrogates
    text = bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "surrogateescape")
    pieces, at = [], 0
    for c in text:
        width = 3 * len(c.encode("utf-8", "surrogateescape"))
        pieces.append((at, at + width))
        at += width
    return text, pieces


def _from_escape(m: re.Match) -> tuple[str, list[tuple[int, int]]] | None:
    brace, high, low, four, eight, two, dec, hexa = m.groups()
    if high:
        code = 0x10000 + ((int(high, 16) - 0xD800) << 10) + (int(low, 16) - 0xDC00)
    else:
        code = int(dec) if dec else int(brace or four or eight or two or hexa, 16)
    if code > 0x10FFFF or 0xD800 <= code <= 0xDFFF:
        return None
    return chr(code), [(0, m.end() - m.start())]


def _inflate(data: memoryview) -> tuple[bytes, int] | None:
    """Content and length of the gzip, zlib, bzip2, xz or Zstandard streams at the start of the data, None if there is none or it is damaged."""
    out, at = [], 0
    try:
        while True:
            head = bytes(data[at : at + 6])
            if head[:2] == b"\x1f\x8b":
                stream = zlib.decompressobj(31)
            elif head[:3] == b"BZh":
                stream = bz2.BZ2Decompressor()
            elif head == b"\xfd7zXZ\x00":
                stream = lzma.LZMADecompressor()
            elif head[:4] == b"\x28\xb5\x2f\xfd":
                stream = zstandard.ZstdDecompressor().decompressobj()
            elif not out and len(head) > 2 and head[0] & 15 == 8 and (head[0] << 8 | head[1]) % 31 == 0:
                stream = zlib.decompressobj()
            else:
                break
            content = stream.decompress(data[at:])
            # a Zstandard frame without its end counts as far as it goes
            if not stream.eof and not (head[:1] == b"\x28" and content):
                break
            out.append(content)
            at = len(data) - len(stream.unused_data)
    except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, zstandard.ZstdError):
        pass
    return (b"".join(out), at) if out else None


def _streams(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """``(start, end, content)`` of the compressed streams anywhere in the data."""
    done, view = 0, memoryview(data)
    for m in _MAGIC.finditer(data):
        if m.start() >= done and (got := _inflate(view[m.start() :])) is not None:
            done = m.start() + got[1]
            yield m.start(), done, got[0]


def _unpacked(data: bytes) -> Iterator[tuple[int, int, str]]:
    """``(start, end, text)`` of the texts in the compressed streams of the data, and in the streams inside them."""
    for start, end, content in _streams(data):
        seen, work = {content}, [content]
        while work:
            got = work.pop()
            if text := _text(got):
                yield start, end, text
                continue
            for m in _STRETCH.finditer(got):
                yield start, end, m[0].decode("ascii")
            for _, _, inner in _streams(got):
                if inner not in seen:
                    seen.add(inner)
                    work.append(inner)


def _text(data: bytes) -> str | None:
    """The text of UTF-8 data without control characters but white space; else None."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if text and not re.search(r"[\x00-\x08\x0e-\x1f\x7f]", text) else None


def _whole(layer: Layer, text: str, start: int, end: int) -> Layer:
    """Layer of compressed data: their bytes say nothing about single characters, so all come from the whole stream."""
    low, high = layer.span(start, end)
    return Layer(text, np.full(len(text), low), np.full(len(text), high))


def _from_base64(layer: Layer, at: np.ndarray, run: str, phase: int) -> Iterator[Layer]:
    """Layers of a base64 run without its first ``phase`` characters; ``at`` says where its characters lie in the layer."""
    run, at = run[phase:], at[phase:]
    # a single last character is less than a byte
    run = run[: len(run) - (len(run) % 4 == 1)]
    data = binascii.a2b_base64(run + "=" * (-len(run) % 4))
    if phase == 0 and (text := _text(data)):
        widths = np.array([len(c.encode("utf-8")) for c in text])
        high = np.cumsum(widths)
        low = high - widths
        yield Layer(text, layer.starts[at[low * 4 // 3]], layer.ends[at[-(-high * 4 // 3) - 1]])
        return
    for m in _STRETCH.finditer(data):
        low = np.arange(m.start(), m.end())
        yield Layer(m[0].decode("ascii"), layer.starts[at[low * 4 // 3]], layer.ends[at[-(-(low + 1) * 4 // 3) - 1]])
    for start, end, text in _unpacked(data):
        yield _whole(layer, text, int(at[start * 4 // 3]), int(at[-(-end * 4 // 3) - 1]) + 1)


def _from_quoted(layer: Layer, m: re.Match, plus: bytes) -> Iterator[Layer]:
    """Layers of compressed data in percent-encoded bytes, the others of which stand as characters."""
    parts = list(_BYTE.finditer(m[0]))
    data = b"".join(bytes([int(p[0][1:], 16)]) if len(p[0]) == 3 else plus if p[0] == "+" else p[0].encode("ascii") for p in parts)
    if _text(data) is None:
        for start, end, text in _unpacked(data):
            yield _whole(layer, text, m.start() + parts[start].start(), m.start() + parts[end - 1].end())


def _unwrapped(layer: Layer) -> Iterator[Layer]:
    """The layers one level down: the whole layer with URL or Unicode escapes resolved, and each base64 run by itself."""
    if "%" in layer.text and (new := _replaced(layer, _PERCENT, _from_percent)):
        yield new
        for m in _QUOTED.finditer(layer.text):
            for plus in (b"+", b" ") if "+" in m[0] else (b"+",):
                yield from _from_quoted(layer, m, plus)
    if ("\\" in layer.text or "&#" in layer.text) and (new := _replaced(layer, _ESCAPE, _from_escape)):
        yield new
    for m in _BASE64.finditer(layer.text):
        lines = [(x.start() + m.start(), x.end() + m.start()) for x in _LINE.finditer(m[0])]
        # lines may belong together or be runs of their own
        runs = [[x] for x in lines if x[1] - x[0] >= 16]
        if len(lines) > 1 and sum(end - start for start, end in lines) >= 16:
            runs.append(lines)
        for parts in runs:
            run = "".join(layer.text[start:end] for start, end in parts).translate(_URLSAFE)
            at = np.concatenate([np.arange(start, end) for start, end in parts])
            for phase in range(4):
                yield from _from_base64(layer, at, run, phase)


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
    """``(spans of the text itself, spans of all layers, number of decoded layers)``; spans are ``(start, kind, end)``, sorted.

    A layer that was seen before, with the same text from the same place, is not decoded again, so data that
    contain themselves end. Nothing limits depth or number of layers: all decoders but the compressed ones shorten.
    """
    base = base_spans(text)
    if not ("%" in text or "\\" in text or "&#" in text or _BASE64.search(text)):
        return base, base, 0
    first = Layer(text, np.arange(len(text)), np.arange(1, len(text) + 1))
    spans, seen, work, layers = set(base), {(text, 0, len(text))}, [first], 0
    while work:
        for new in _unwrapped(work.pop()):
            state = (new.text, int(new.starts[0]), int(new.ends[-1]))
            if state in seen:
                continue
            seen.add(state)
            layers += 1
            for start, kind, end in base_spans(new.text):
                low, high = new.span(start, end)
                spans.add((low, kind, high))
            work.append(new)
    return base, sorted(spans), layers


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find_secrets(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_assign, n_access, n_hex, base_sha256, spans, n_layers`` of every row.

    The counts and the digest are of the text itself, ``spans`` also has what decoded layers hide, in code points of
    the text. Null is the empty text: no spans, digest of nothing. Keys may be null and rows repeated; an empty
    table gives no rows; other columns are not read. Memory is a batch of texts and the layers of one text.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, all_spans, layers = ([], [], []), [], [], []
            for t in batch.column(1).to_pylist():
                base, spans, n = scan(t or "")
                for k in range(3):
                    counts[k].append(sum(s[1] == k for s in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                all_spans.append(joined(spans))
                layers.append(n)
            columns = [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(all_spans, pa.string()), pa.array(layers, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = [key, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers"]
    given = df.select(F.col(key), F.col(text).cast("string").alias("__text"))
    schema = f"`{key}` {given.dtypes[0][1]}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long"
    return given.mapInArrow(rows, schema)
