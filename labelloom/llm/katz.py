"""Katz backoff language model of order two over a corpus, and the score of every text under it.

``P(w | h)`` is the Good-Turing discounted share of ``h w`` among the continuations of ``h`` if training has the pair,
and ``alpha(h) P(w)`` if not, where ``P(w)`` is the discounted share of the word and, for words that training does not
have, the mass that the discounts leave. ``alpha(h)`` is the mass that the discounts of ``h`` leave over the mass that
``P(w)`` gives to words never seen behind ``h``; so the probabilities behind any history sum to one. A history that
training does not have backs off with weight one.

The n-grams lie in a stored table of buckets, each with the pairs of some words and the texts that have them, packed
column by column. Counting, backoff weights and scores are passes over that table; histories and texts meet in
shuffles of packed blocks. Words with a share of at least HOT of the tokens, at most ``1 / HOT`` of them, have their
pairs spread over buckets by the other word, and pairs of two such words over the chunks of the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import stored
from .wordhash import chunks, mixed, word_hashes

# Word numbers of the text's begin (a history only) and end (a word only); other words have 48 bits of their hash.
START, END = np.uint64(1), np.uint64(2)
WORD_BITS = 48

HOT = 1 / 512
CUTOFF = 5  # counts up to this have Turing's estimate where it is sound, the others the fitted line
BUCKET_TOKENS = 1_200_000
GROUP_TOKENS = 800_000  # of the texts that a task packs at once


def pack(*columns: np.ndarray) -> bytes:
    """Columns of non-negative integers or of floats as bytes: narrowest type, byte planes, Zstandard."""
    head, body = [len(columns)], []
    for c in columns:
        if c.dtype.kind == "f":
            c, kind = c.astype(np.float64), 0
        else:
            c = c.astype(np.uint64)
            kind = next(k for k in (1, 2, 4, 8) if not len(c) or int(c.max()) >> 8 * k == 0)
            c = c.astype(f"u{kind}")
        head += [kind, len(c)]
        body.append(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() if len(c) else b"")
    return zstandard.ZstdCompressor(level=3).compress(np.array(head, dtype=np.int64).tobytes() + b"".join(body))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, dtype=np.int64, count=1)[0])
    head = np.frombuffer(raw, dtype=np.int64, count=1 + 2 * n)[1:].reshape(n, 2)
    at, out = 8 * (1 + 2 * n), []
    for kind, size in head.tolist():
        width = kind or 8
        planes = np.frombuffer(raw, dtype=np.uint8, count=size * width, offset=at).reshape(width, size)
        values = np.ascontiguousarray(planes.T).view(f"u{kind}" if kind else np.float64).reshape(size)
        out.append(values if not kind else values.astype(np.int64))
        at += size * width
    return out


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins, in sorted columns."""
    if not len(keys[0]):
        return np.empty(0, dtype=np.int64)
    change = np.zeros(len(keys[0]), dtype=bool)
    change[0] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(change)


def _lengths(starts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(starts, n))


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(word, history, text)`` of every token of a chunk, each text's end included."""
    hashes, owner = word_hashes(raw, offsets, lower=True)
    texts = len(offsets) - 1
    per_text = np.bincount(owner, minlength=texts) + 1
    last = np.cumsum(per_text) - 1
    w = np.full(len(hashes) + texts, END, dtype=np.uint64)
    w[np.arange(len(hashes)) + owner] = np.maximum(hashes >> np.uint64(64 - WORD_BITS), np.uint64(3))
    h = np.empty_like(w)
    h[1:] = w[:-1]
    h[np.append(0, last[:-1] + 1)] = START
    return w, h, np.repeat(np.arange(texts), per_text)


def _token_groups(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(first, last, word, history, text)`` of runs of texts with about GROUP_TOKENS tokens; texts are hashed in smaller pieces."""
    start, held, size = 0, [], 0
    for first, last, raw, offsets in chunks(texts):
        w, h, text = tokens(raw, offsets)
        held.append((w, h, (text + (first - start)).astype(np.int32)))
        size += len(w)
        if size >= GROUP_TOKENS or last == len(texts):
            yield start, last, *(np.concatenate(c) for c in zip(*held))
            start, held, size = last, [], 0


def _isin(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), dtype=bool)
    return sorted_set[np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)] == values


def _looked_up(values: np.ndarray, keys: np.ndarray, numbers: np.ndarray, default: float = 0) -> np.ndarray:
    """Number of each value in a sorted table, the default where it has none."""
    if not len(keys):
        return np.full(len(values), default, dtype=numbers.dtype)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return np.where(keys[at] == values, numbers[at], numbers.dtype.type(default))


def _pair(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mixed(h * np.uint64(0x9E3779B97F4A7C15) + w)


@dataclass
class Postings:
    """A bucket's pairs in the order of word and history, and their entries: which text has the pair how often."""

    w: np.ndarray  # of each type
    h: np.ndarray
    first: np.ndarray  # first entry of each type
    sources: np.ndarray  # chunks
    source: np.ndarray  # of each entry, its number in sources
    text: np.ndarray
    times: np.ndarray
    train: np.ndarray

    def packed(self) -> bytes:
        words = _runs(self.w)
        histories, at = np.unique(self.h, return_inverse=True)
        return pack(
            np.diff(self.w[words], prepend=np.uint64(0)), _lengths(words, len(self.w)), np.diff(histories, prepend=np.uint64(0)), at,
            _lengths(self.first, len(self.text)), self.sources, self.source, self.text, self.times * 2 + self.train,
        )

    @classmethod
    def unpacked(cls, data: bytes) -> Postings:
        words, per_word, histories, at, per_type, sources, source, text, marked = unpack(data)
        w = np.repeat(np.cumsum(words).astype(np.uint64), per_word)
        first = np.cumsum(per_type) - per_type
        h = np.cumsum(histories).astype(np.uint64)[at]
        return cls(w, h, first, sources, source.astype(np.int32), text.astype(np.int32), (marked >> 1).astype(np.int32), (marked & 1).astype(bool))

    @classmethod
    def merged(cls, blocks: Sequence[tuple[int, bytes]]) -> Postings:
        """From the blocks of several chunks, in their order."""
        w, h, source, text, times, train = [], [], [], [], [], []
        for i, (_, data) in enumerate(blocks):
            p = cls.unpacked(data)
            per_type = _lengths(p.first, len(p.text))
            for column, values in zip((w, h, source, text, times, train), (np.repeat(p.w, per_type), np.repeat(p.h, per_type), np.full(len(p.text), i, dtype=np.int32), p.text, p.times, p.train)):
                column.append(values)
        w, h = np.concatenate(w), np.concatenate(h)
        order = np.lexsort((h, w)).astype(np.int32)
        w, h = w[order], h[order]
        source, text, times, train = (np.concatenate(c)[order] for c in (source, text, times, train))
        first = _runs(w, h)
        return cls(w[first], h[first], first, np.array([c for c, _ in blocks], dtype=np.int64), source, text, times, train)

    def type_of_entry(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.w), dtype=np.int32), _lengths(self.first, len(self.text)))


@dataclass
class Hot:
    """Words that have a share of HOT, sorted; once counted, their counts and those of their pairs."""

    words: np.ndarray
    counts: np.ndarray | None = None
    pairs: np.ndarray | None = None
    pair_counts: np.ndarray | None = None

    def both(self, p: Postings) -> np.ndarray:
        return _isin(p.w, self.words) & _isin(p.h, self.words)

    def counted(self, p: Postings) -> tuple[np.ndarray, np.ndarray]:
        """Training counts of each type's pair and word."""
        pair = np.add.reduceat(p.times * p.train, p.first) if len(p.first) else np.empty(0, dtype=np.int64)
        starts = _runs(p.w)
        word = np.repeat(np.add.reduceat(pair, starts), _lengths(starts, len(p.w))) if len(starts) else pair
        if self.counts is not None:
            both = self.both(p)
            pair[both] = _looked_up(_pair(p.h[both], p.w[both]), self.pairs, self.pair_counts)
            hot = _isin(p.w, self.words)
            word[hot] = _looked_up(p.w[hot], self.words, self.counts)
        return pair, word


@dataclass(frozen=True)
class Discount:
    """Good-Turing discounted counts: Turing's estimate for small counts, else a line fitted to log counts of counts."""

    turing: tuple[float, ...]  # discounted 1, 2, ...
    slope: float

    @classmethod
    def fitted(cls, counts_of_counts: dict[int, int]) -> Discount:
        n = [counts_of_counts.get(r, 0) for r in range(CUTOFF + 2)]
        points = [(math.log(r), math.log(n[r])) for r in range(1, CUTOFF + 2) if n[r] > 0]
        slope = -2.0
        if len(points) > 1:
            mx, my = (sum(p[i] for p in points) / len(points) for i in (0, 1))
            slope = sum((x - mx) * (y - my) for x, y in points) / sum((x - mx) ** 2 for x, _ in points)
        slope = min(slope, -1.05)  # keeps every discounted count below its count
        out = []
        for r in range(1, CUTOFF + 1):
            turing = (r + 1) * n[r + 1] / n[r] if n[r] else 0.0
            out.append(turing if 0 < turing < r else r * (1 + 1 / r) ** (slope + 1))
        return cls(tuple(out), slope)

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        c = np.maximum(counts, 1).astype(np.float64)
        line = c * (1 + 1 / c) ** (self.slope + 1)
        return np.where(counts <= CUTOFF, np.array([0.0, *self.turing])[np.minimum(counts, CUTOFF)], line)

    def column(self, count: str) -> str:
        """The same as a SQL expression of Spark or DuckDB."""
        whens = " ".join(f"WHEN {count} = {r} THEN {v!r}D" for r, v in enumerate(self.turing, 1))
        return f"CASE {whens} ELSE {count} * pow(1 + 1 / {count}, {self.slope + 1!r}D) END"


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Runs of rows with the same key; the input is sorted by it."""
    held: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if held and held[0][key] != r[key]:
                yield held[0][key], held
                held = []
            held.append(r)
    if held:
        yield held[0][key], held


def _hot_words(docs: DataFrame) -> tuple[np.ndarray, int]:
    """``(words that may have a share of HOT, number of tokens)``, both of all texts.

    A chunk reports the words with a quarter of that share in it, so a hot word loses less than a quarter of it.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raw, offsets in chunks(batch.column("__text")):
                w, _, _ = tokens(raw, offsets)
                words, counts = np.unique(w, return_counts=True)
                often = counts >= len(w) * HOT / 4
                found = np.append(words[often].astype(np.int64), 0), np.append(counts[often], len(w))
                yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["word", "n"])

    counted = stored(docs.select("__text").mapInArrow(rows, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm_frequent")
    total = counted.filter("word = 0").first()
    total = total["n"] if total else 0
    hot = [r["word"] for r in counted.filter((F.col("word") > 0) & (F.col("n") >= 0.75 * HOT * total)).collect()]
    return np.array(sorted({*hot, int(START), int(END)}), dtype=np.uint64), total


def _postings(docs: DataFrame, key_type: str, hot: np.ndarray, buckets: int) -> DataFrame:
    """The n-gram table: ``bucket, chunk, keys, payload``. A negative bucket is a chunk's list of texts."""
    key_arrow = to_arrow_type(docs.schema["__key"].dataType)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            keys, train = batch.column("__key"), batch.column("__train").to_numpy(zero_copy_only=False)
            for first, last, w, h, text in _token_groups(batch.column("__text")):
                chunk, number = task << 24 | number, number + 1
                hot_w, hot_h = _isin(w, hot), _isin(h, hot)
                name = np.where(hot_w, _pair(h, w), mixed(w))
                name = np.where(hot_w & hot_h, mixed(name + np.uint64(chunk)), name)
                bucket = (name % np.uint64(buckets)).astype(np.min_scalar_type(buckets))
                del name, hot_w, hot_h
                order = np.lexsort((h, w, bucket))
                w, h, text, bucket = w[order], h[order], text[order], bucket[order]
                kept = _runs(bucket, w, h, text)
                times = _lengths(kept, len(w))
                w, h, text, bucket = w[kept], h[kept], text[kept], bucket[kept]
                starts = _runs(bucket)
                out = [(-chunk - 1, keys.slice(first, last - first).to_pylist(), pack(np.bincount(np.repeat(text, times), minlength=last - first), train[first:last].astype(np.int64)))]
                for lo, hi in zip(starts, np.append(starts[1:], len(w))):
                    t = slice(lo, hi)
                    types = _runs(w[t], h[t])
                    p = Postings(w[t][types], h[t][types], types, np.array([chunk]), np.zeros(hi - lo, dtype=np.int32), text[t], times[t], train[first:last][text[t]])
                    out.append((int(bucket[lo]), None, p.packed()))
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int64()), pa.array([chunk] * len(out), pa.int64()), pa.array(columns[1], pa.list_(keys.type)), pa.array(columns[2], pa.binary())],
                    ["bucket", "chunk", "keys", "payload"],
                )

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(bucket, chunk, keys, payload) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([chunk], pa.int64()), pa.array([keys], pa.list_(key_arrow)), pa.array([payload], pa.binary())], ["bucket", "chunk", "keys", "payload"])

        for bucket, rows in _grouped(batches, "bucket"):
            if bucket < 0:
                yield row(bucket, rows[0]["chunk"], rows[0]["keys"], rows[0]["payload"])
                continue
            yield row(bucket, -1, None, Postings.merged([(r["chunk"], r["payload"]) for r in rows]).packed())

    schema = f"bucket long, chunk long, keys array<{key_type}>, payload binary"
    made = docs.mapInArrow(blocks, schema).repartition(buckets, "bucket").sortWithinPartitions("bucket", "chunk")
    return stored(made.mapInArrow(merged, schema), "lm_ngrams")


def _counts(ngrams: DataFrame, hot: Hot) -> DataFrame:
    """``kind, a, b, n``: counts of word counts (1) and pair counts (2) by ``a``, hot words ``a`` (3), hot pairs ``a b`` (4)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column("payload"):
                p = Postings.unpacked(payload.as_py())
                pair, word = hot.counted(p)
                both, hot_w = hot.both(p), _isin(p.w, hot.words)
                starts = _runs(p.w)
                found = []
                for kind, values in ((1, word[starts][~hot_w[starts]]), (2, pair[~both])):
                    r, n = np.unique(values[values > 0], return_counts=True)
                    found.append((np.full(len(r), kind), r, np.zeros(len(r), dtype=np.int64), n))
                hot_starts = starts[hot_w[starts]]
                found.append((np.full(len(hot_starts), 3), p.w[hot_starts].astype(np.int64), np.zeros(len(hot_starts), dtype=np.int64), word[hot_starts]))
                found.append((np.full(int(both.sum()), 4), p.h[both].astype(np.int64), p.w[both].astype(np.int64), pair[both]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found)], ["kind", "a", "b", "n"])

    found = ngrams.select("payload").mapInArrow(rows, "kind long, a long, b long, n long")
    summed = stored(found.groupBy("kind", "a", "b").agg(F.sum("n").alias("n")), "lm_hot_counts")
    plain = summed.filter("kind <= 2")
    hot_rows = summed.filter("kind > 2 AND n > 0").select((F.col("kind") - 2).alias("kind"), F.col("n").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(1).cast("long").alias("n"))
    of_counts = plain.union(hot_rows).groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
    return stored(summed.filter("kind > 2").union(of_counts), "lm_counts")


@dataclass
class Model:
    """What a scoring task needs of the model besides its bucket."""

    hot: Hot
    total: int  # training tokens
    distinct: int
    words: Discount
    pairs: Discount
    unknown: float  # probability of all unknown words together
    hot_sums: tuple[np.ndarray, ...] = ()  # of the pairs of two hot words, by history
    hot_backoff: tuple[np.ndarray, np.ndarray] = (np.empty(0, dtype=np.uint64), np.empty(0))

    def share(self, counts: np.ndarray) -> np.ndarray:
        """``P(w)`` of words with these counts."""
        return np.where(counts > 0, self.words(counts) / max(self.total, 1), self.unknown)


def _model(counts: DataFrame, hot: np.ndarray) -> Model:
    small = {1: {}, 2: {}}
    for r in counts.filter(f"kind <= 2 AND a <= {CUTOFF + 1}").collect():
        small[r["kind"]][r["a"]] = r["n"]
    words, pairs = Discount.fitted(small[1]), Discount.fitted(small[2])
    found = counts.filter("kind = 1").agg(F.sum(F.expr("a * n")).alias("total"), F.sum("n").alias("distinct"), F.sum(F.expr(f"n * ({words.column('a')})")).alias("kept")).first()
    total = found["total"] or 0
    # hot words are at most 4 / (3 HOT) + 2, their pairs the square of that
    hot_counts = {r["a"]: r["n"] for r in counts.filter("kind = 3").collect()}
    both = counts.filter("kind = 4").select("a", "b", "n").toPandas()
    names = _pair(both["a"].to_numpy(np.int64).astype(np.uint64), both["b"].to_numpy(np.int64).astype(np.uint64))
    order = np.argsort(names)
    held = Hot(hot, np.array([hot_counts.get(int(w), 0) for w in hot], dtype=np.int64), names[order], both["n"].to_numpy(np.int64)[order])
    model = Model(held, total, found["distinct"] or 0, words, pairs, 1 - (found["kept"] or 0) / total if total else 1.0)
    seen = both[both["n"] > 0]
    h, w, n = (seen[c].to_numpy(np.int64) for c in ("a", "b", "n"))
    model.hot_sums = _history_sums(h.astype(np.uint64), model.share(_looked_up(w.astype(np.uint64), hot, held.counts)), pairs(n), n)
    return model


def _history_sums(h: np.ndarray, share: np.ndarray, kept: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per history: the mass its words have without it, what the discounts keep of its pairs, and its count."""
    names, at = np.unique(h, return_inverse=True)
    sums = (np.bincount(at, weights=x, minlength=len(names)) for x in (share, kept, count))
    return names, *sums


def _backoff(ngrams: DataFrame, model: Model, buckets: int) -> DataFrame:
    """``bucket, chunk, payload``: the backoff table (chunk -1), weights of hot histories (chunk -2), and for each chunk what unseen pairs add to its texts."""
    hot = model.hot

    def split(h: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
        bucket = mixed(h) % np.uint64(buckets)
        order = np.lexsort((h, bucket))
        starts = _runs(bucket[order])
        for lo, hi in zip(starts, np.append(starts[1:], len(order))):
            yield int(bucket[order[lo]]), [c[order[lo:hi]] for c in (h, *columns)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column("payload"):
                p = Postings.unpacked(payload.as_py())
                pair, word = hot.counted(p)
                seen = (pair > 0) & ~hot.both(p)
                out = []
                # a history with one pair here sends its counts, which pack better than sums; so it sends one entry per bucket at most
                _, at, pairs_here = np.unique(np.where(seen, p.h, np.uint64(0)), return_inverse=True, return_counts=True)
                one, several = seen & (pairs_here[at] == 1), seen & (pairs_here[at] > 1)
                for b, (h, *sums) in split(*_history_sums(p.h[several], model.share(word[several]), model.pairs(pair[several]), pair[several])):
                    out.append((b, 0, pack(np.diff(h, prepend=np.uint64(0)), *sums)))
                for b, (h, *counts) in split(p.h[one], word[one], pair[one]):
                    out.append((b, 3, pack(np.diff(h, prepend=np.uint64(0)), *counts)))
                of = p.type_of_entry()
                asked = ~p.train & (pair == 0)[of] & ~_isin(p.h, hot.words)[of]
                for b, (h, source, text, times) in split(p.h[of[asked]], p.source[asked], p.text[asked], p.times[asked]):
                    used, source = np.unique(source, return_inverse=True)
                    out.append((b, 1, pack(np.diff(h, prepend=np.uint64(0)), p.sources[used], source, text, times)))
                columns = list(zip(*out)) if out else [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], ["bucket", "kind", "payload"])

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, group in _grouped(batches, "bucket"):
            sums = [unpack(r["payload"]) for r in group if r["kind"] == 0]
            sums = [[np.cumsum(s[0]).astype(np.uint64), *s[1:]] for s in sums]
            for gaps, word, pair in (unpack(r["payload"]) for r in group if r["kind"] == 3):
                sums.append([np.cumsum(gaps).astype(np.uint64), model.share(word), model.pairs(pair), pair])
            h0 = model.hot_sums[0]
            mine = mixed(h0) % np.uint64(buckets) == np.uint64(bucket)
            sums.append([x[mine] for x in model.hot_sums])
            h, at = np.unique(np.concatenate([s[0] for s in sums]), return_inverse=True)
            share, kept, count = (np.bincount(at, weights=np.concatenate([s[i] for s in sums]), minlength=len(h)) for i in (1, 2, 3))
            alpha = np.log10(1 - kept / count) - np.log10(1 - share)
            out = [(bucket, -1, pack(np.diff(h, prepend=np.uint64(0)), count.astype(np.int64), alpha))]
            is_hot = _isin(h, hot.words)
            out.append((bucket, -2, pack(h[is_hot], (alpha + np.log10(count))[is_hot])))
            asked = [unpack(r["payload"]) for r in group if r["kind"] == 1]
            if asked:
                names = np.concatenate([np.cumsum(a[0]).astype(np.uint64) for a in asked])
                chunk, text, times = np.concatenate([a[1][a[2]] for a in asked]), np.concatenate([a[3] for a in asked]), np.concatenate([a[4] for a in asked])
                # the count cancels the one that every token of a known history is divided by
                value = _looked_up(names, h, alpha + np.log10(count)) * times
                order = np.lexsort((text, chunk))
                out += [(bucket, c, pack(np.diff(t, prepend=0), _shortened(v))) for c, t, v in _by_chunk(chunk[order], text[order], value[order])]
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], ["bucket", "chunk", "payload"])

    # a bucket without rows would miss hot histories that have hot continuations only
    every = ngrams.sparkSession.range(buckets).select(F.col("id").alias("bucket"), F.lit(2).cast("long").alias("kind"), F.lit(None).cast("binary").alias("payload"))
    asked = ngrams.select("payload").mapInArrow(rows, "bucket long, kind long, payload binary").union(every)
    made = asked.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind")
    return stored(made.mapInArrow(weights, "bucket long, chunk long, payload binary"), "lm_backoff")


def _shortened(values: np.ndarray) -> np.ndarray:
    """Doubles with the last 12 of 52 bits cleared, which pack better; the error is below 1e-12 of the value."""
    return (values.astype(np.float64).view(np.uint64) & np.uint64(0xFFFFFFFFFFFFF000)).view(np.float64)


def _by_chunk(chunk: np.ndarray, text: np.ndarray, *values: np.ndarray) -> Iterator[tuple]:
    """``(chunk, texts, sums of the values)`` of entries sorted by chunk and text."""
    starts = _runs(chunk, text)
    if not len(starts):
        return
    chunk, text = chunk[starts], text[starts]
    sums = [np.add.reduceat(v, starts) for v in values]
    for lo, hi in zip(at := _runs(chunk), np.append(at[1:], len(chunk))):
        yield int(chunk[lo]), text[lo:hi], *(s[lo:hi] for s in sums)


def _parts(ngrams: DataFrame, model: Model) -> DataFrame:
    """``chunk, payload``: for each token of a chunk's texts what its score follows from, in the order of the texts.

    That is the number of times, the training counts of word and pair, and for an unseen pair the place of its history
    among the hot ones. Counts pack into a few bytes where sums per text and bucket would be floats of full length,
    one for almost every token once buckets are many.
    """
    hot = model.hot

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column("payload"):
                p = Postings.unpacked(payload.as_py())
                pair, word = hot.counted(p)
                names = model.hot_backoff[0]
                place = _looked_up(p.h, names, np.arange(1, len(names) + 1)) * (pair == 0)
                # the lowest bit marks ends
                code = place * 2 + (p.w == END)
                order = np.lexsort((p.text, p.source)).astype(np.int32)
                of, source = p.type_of_entry()[order], p.source[order]
                text, times = p.text[order], p.times[order]
                out = []
                for lo, hi in zip(at := _runs(source), np.append(at[1:], len(source))):
                    t = of[lo:hi]
                    out.append((int(p.sources[source[lo]]), pack(np.diff(text[lo:hi], prepend=0), times[lo:hi], word[t], pair[t], code[t])))
                columns = list(zip(*out)) if out else [(), ()]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary())], ["chunk", "payload"])

    return ngrams.select("payload").mapInArrow(rows, "chunk long, payload binary")


def _token_scores(model: Model, word: np.ndarray, pair: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each token adds to the score and to the base score of its text."""
    weights = np.append(0.0, model.hot_backoff[1])
    backoff = np.log10(model.share(word)) + weights[code >> 1]
    value = np.where(pair > 0, np.log10(np.maximum(model.pairs(pair), 1e-300)), backoff)
    # each word but the end is a history once: that divides the next token's count
    value -= np.where((word > 0) & (code & 1 == 0), np.log10(np.maximum(word, 1)), 0.0)
    return value, np.log10(word + 0.1)


def score_corpus(df: DataFrame, train: str, key: str = "doc_id", text: str = "text", bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    The model learns from the rows for which ``train``, a SQL condition, is true. Tokens are words with A-Z lower-cased
    and one end per text; a null or empty text is its end alone. ``base_score`` is the sum of the logarithms to base
    ten of the add-0.1 word probabilities, ``score`` that of the model. Without training rows every word is unknown and
    has probability one. Keys may be null and rows repeated; an empty table gives no rows; other columns are not read.

    Words are told apart by 48 bits of a hash. A task holds one bucket of about ``bucket_tokens`` tokens.
    """
    key_type = dict(df.dtypes)[key]
    docs = df.select(F.col(key).alias("__key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"), F.coalesce(F.expr(train), F.lit(False)).alias("__train"))
    names, total = _hot_words(docs)
    buckets = max(1, -(-total // bucket_tokens))
    table = _postings(docs, key_type, names, buckets)
    ngrams = table.filter("bucket >= 0")
    model = _model(_counts(ngrams, Hot(names)), names)
    backoff = _backoff(ngrams, model, buckets)
    found = [unpack(r["payload"]) for r in backoff.filter("chunk = -2").collect()]  # hot histories only
    h, f = (np.concatenate([x[i] for x in found]) if found else np.empty(0) for i in (0, 1))
    order = np.argsort(h)
    model.hot_backoff = h[order].astype(np.uint64), f[order].astype(np.float64)
    starts = int(model.hot.counts[np.searchsorted(names, END)])
    constant = math.log10(model.total + 0.1 * (model.distinct + 1))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _grouped(batches, "chunk"):
            # the chunk's own row comes first
            (size, trained), keys = unpack(group[0]["payload"]), group[0]["keys"]
            score, base, known = np.zeros(len(size)), np.zeros(len(size)), np.zeros(len(size), dtype=np.int64)
            for r in group[1:]:
                gaps, *columns = unpack(r["payload"])
                at = np.cumsum(gaps)
                if r["kind"] == 1:
                    score[at] += columns[0]
                    continue
                times, word, pair, code = columns
                value, word_value = _token_scores(model, word, pair, code)
                score += np.bincount(at, weights=value * times, minlength=len(size))
                base += np.bincount(at, weights=word_value * times, minlength=len(size))
                known += np.bincount(at[word > 0], weights=times[word > 0], minlength=len(size)).astype(np.int64)
            if starts:
                score -= math.log10(starts)
            base -= size * constant
            columns = [pa.array(keys, key_arrow), pa.array(trained == 0), pa.array(size), pa.array(known), pa.array(np.full(len(size), model.total)), pa.array(base), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, ["__key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    key_arrow = to_arrow_type(docs.schema["__key"].dataType)
    nothing = F.lit(None).cast(f"array<{key_type}>")
    parts = table.filter("bucket < 0").select("chunk", F.lit(0).alias("kind"), "keys", "payload")
    parts = parts.union(_parts(ngrams, model).select("chunk", F.lit(2), nothing, "payload"))
    parts = parts.union(backoff.filter("chunk >= 0").select("chunk", F.lit(1), nothing, "payload"))
    made = parts.repartition("chunk").sortWithinPartitions("chunk", "kind")
    schema = f"__key {key_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return made.mapInArrow(rows, schema).withColumnRenamed("__key", key)
