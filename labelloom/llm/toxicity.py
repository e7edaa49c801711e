"""Toxicity of texts by a support vector machine over a gapped subsequence kernel, learnt from labelled documents.

The label of a document holds for its sentences only as a whole: some word of some sentence is the insult. So
sentences stand for their suspicious words (their witnesses): at first by how much more documents of class 1 have the
word, then by the machine learnt so far. A sentence of class 1 gives all of them, one of class 0 the worst. Witnesses of sentences of both classes, with the landmarks chosen among
them, train the next machine. A document's score follows from its most suspicious word and from the number of
sentences that hold one, by a logistic curve fitted on the same documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Collection, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import stored
from . import string_kernel as sk
from .common import draw52

# Labelled documents of each class that are learnt from (about; a hash of the key decides), landmarks of each class,
# words of each class in one fit, rounds of choosing witnesses.
SAMPLE, LANDMARKS, WORDS, ROUNDS = 8_000, 160, 6_000, 2
# How far above chance a word's share in class 1 must be to begin with, in standard deviations.
SURE = 5.0
# How many times as common in class 1 an insult must be; what both classes use is none.
ODDS = 10.0
# Words whose margins a task remembers.
REMEMBERED = 300_000
# Characters of text whose new words are scored together.
CHUNK_CHARS = 4_000_000

_WORD = re.compile(r"[^\W_](?:\S*[^\W_])?")
_SPELT = re.compile(r"\b\w(?:\s\w){2,}\b")
# Where one must be; begins with a class of characters, so that the search skips all others.
_SPELT_HINT = re.compile(r"\s\w\s\w\b(?<=\b\w\s\w\s\w)")
# Common characters around words, none of them a letter or digit.
_EDGES = ".,;:!?()[]{}<>\"'*-_#|"
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
# Where a sentence ends before white space other than a space or a line end.
_ODD_END = re.compile(r"[.!?][^\S \n]")
CLEAR = -3.0


def spelt(text: str) -> list[str]:
    """The text's runs of three or more single letters, as words."""
    return ["".join(m.split()) for m in _SPELT.findall(text)] if _SPELT_HINT.search(text) else []


def words_of(text: str) -> list[str]:
    """White-space parted words of a lower-cased text, and its runs of three or more single letters as words."""
    return text.split() + spelt(text)


def bare(word: str) -> str:
    """The word, without white space, from its first to its last letter or digit."""
    word = word.strip(_EDGES)
    if word and word[0].isalnum() and word[-1].isalnum():
        return word
    m = _WORD.search(word)
    return m.group() if m else ""


def sentences(text: str, runs: bool = True) -> list[list[str]]:
    """Words of the sentences of a lower-cased text; ``runs``: it may have runs of single letters."""
    if _ODD_END.search(text):
        parts = _SENTENCE.split(text)
    else:
        parts = text.replace(". ", ".\n").replace("! ", "!\n").replace("? ", "?\n").split("\n")
    return [w for s in parts if (w := words_of(s) if runs else s.split())]


class Memo:
    """Margins of words, each computed once as long as it is remembered."""

    def __init__(self, score: Callable[[list[str]], np.ndarray]):
        # ``bad``: the known words of positive margin; ``before``: words of former chunks, which come back when they are met
        self.score, self.known, self.bad, self.before = score, {}, set(), {}

    def forget(self) -> None:
        """Make room once there are too many words: those not met until the next time are dropped."""
        if len(self.known) > REMEMBERED:
            self.known, self.bad, self.before = {}, set(), self.known

    def learn(self, words: set[str]) -> None:
        new = words.difference(self.known)
        margins = {w: self.before[w] for w in new if w in self.before} if self.before else {}
        cores = {w: w if w.isalnum() else bare(w) for w in new.difference(margins)}
        known = {c: m for c in set(cores.values()) if (m := self.known.get(c, margins.get(c))) is not None}
        known[""] = CLEAR
        some = [c for c in set(cores.values()) if c not in known]
        if some:
            known.update(zip(some, np.clip(self.score(some), CLEAR, -CLEAR).tolist()))
        margins.update((w, known[c]) for w, c in cores.items())
        self.known.update(margins)
        self.bad.update(w for w, m in margins.items() if m > 0)

    def of(self, words: Collection[str]) -> list[float]:
        try:
            return list(map(self.known.__getitem__, words))
        except KeyError:
            self.learn(set(words))
            return list(map(self.known.__getitem__, words))


class Chunked(NamedTuple):
    """A lower-cased text whose distinct words are learnt; whether some are runs of single letters."""

    text: str
    words: set[str]
    runs: bool


def measures(found: Chunked, memo: Memo) -> tuple[float, int]:
    """The largest margin of a word, and the number of sentences with a word of positive margin.

    ``CLEAR`` and 0 without words.
    """
    text, words, runs = found
    if not words:
        return CLEAR, 0
    bad = words & memo.bad
    if not bad:
        return max(memo.of(words)), 0
    parts = sentences(text, runs)
    # runs differ between a text and its sentences, where line ends part them
    hits = sum(max(memo.of(s)) > 0 for s in parts) if runs else sum(not bad.isdisjoint(s) for s in parts)
    return max(memo.of(bad)), hits


def in_chunks(texts: Iterable[str | None], memo: Memo) -> Iterator[Chunked]:
    """The texts in chunks whose words are learnt together: few large steps instead of many small ones."""

    def learnt(chunk: list[Chunked]) -> list[Chunked]:
        memo.forget()
        memo.learn(set().union(*[c.words for c in chunk]))
        return chunk

    chunk, size = [], 0
    for text in texts:
        low = (text or "").lower()
        runs = spelt(low)
        chunk.append(Chunked(low, {*low.split(), *runs}, bool(runs)))
        size += len(low)
        if size > CHUNK_CHARS:
            yield from learnt(chunk)
            chunk, size = [], 0
    yield from learnt(chunk)


def _sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, trained: str | None) -> tuple[DataFrame, dict[int, float]]:
    """``text, label`` of about SAMPLE documents of each class, and how many labelled keys one of them stands for."""
    marked = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull())
    if trained:
        marked = marked.filter(trained)
    marked = stored(marked.groupBy(F.col(key).alias("__key")).agg(F.max(F.col(label).cast("int")).alias("label")), "toxic_keys")
    counts = {r["label"]: r["n"] for r in marked.filter("label IN (0, 1)").groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = {c: min(1.0, SAMPLE / n) for c, n in counts.items()}
    keep = F.lit(False)
    for c, p in share.items():
        keep = keep | ((F.col("label") == c) & (draw52(F.lit("sample"), F.col("__key")) < int(p * (1 << 52))))
    # at most about two samples of keys, so the texts stay where they are; copies of a document count once
    keys = F.broadcast(marked.filter(keep))
    body = F.col(text).cast("string")
    texts = docs.select(F.col(key).alias("__key"), body.alias("text")).join(keys, "__key").groupBy("__key", F.xxhash64("text")).agg(F.first("text").alias("text"), F.first("label").alias("label"))
    texts = stored(texts.select("text", "label"), "toxic_sample")
    rows = texts.count()
    if rows > 4 * SAMPLE:  # one key stands for very many texts
        texts = stored(texts.filter(draw52(F.lit("text"), F.crc32(F.coalesce("text", F.lit("")).cast("binary"))) < int(4 * SAMPLE / rows * (1 << 52))), "toxic_sample")
    return texts.repartition(32), {c: 1 / p for c, p in share.items()}


def _word_counts(sample: DataFrame) -> pd.DataFrame:
    """``word, n1, n0``: documents of each class of the bounded sample that hold a word, for words in two or more."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            n = {0: Counter(), 1: Counter()}
            for text, label in zip(f["text"], f["label"]):
                n[label].update({bare(w) for w in set(words_of((text or "").lower()))})
            # Arrow takes no strings from a frame without rows
            if words := sorted({*n[0], *n[1]} - {""}):
                yield pd.DataFrame({"word": words, "n1": [n[1][w] for w in words], "n0": [n[0][w] for w in words]})

    seen = sample.mapInPandas(run, "word string, n1 long, n0 long")
    counted = seen.groupBy("word").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    return counted.filter("n1 + n0 > 1").orderBy("word").toPandas()


def _witnesses(sample: DataFrame, score: Callable[[list[str]], np.ndarray]) -> pd.DataFrame:
    """``label, word, n, margin``: the witnesses of the sample's sentences, those of class 0 as far as they are the hardest or drawn."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = Memo(score)
        for f in frames:
            seen: Counter = Counter()
            for (text, words, runs), label in zip(in_chunks(f["text"], memo), f["label"]):
                # every suspicious word speaks for class 1, the most suspicious one for class 0
                if label and not runs and not words & memo.bad:
                    continue
                for s in sentences(text, runs):
                    margins = memo.of(s)
                    if label:
                        seen.update({(1, w, m) for w, m in zip(s, margins) if m > 0})
                    else:
                        top = max(margins)
                        seen[0, s[margins.index(top)], top] += 1
            if out := [(label, core, n, m) for (label, w, m), n in seen.items() if (core := bare(w))]:
                yield pd.DataFrame(out, columns=["label", "word", "n", "margin"])

    found = sample.mapInPandas(run, "label int, word string, n long, margin double")
    counted = stored(found.groupBy("label", "word").agg(F.sum("n").alias("n"), F.max("margin").alias("margin")), "toxic_witnesses")
    positive = counted.filter("label = 1 AND margin > 0").orderBy(F.desc("n"), "word").limit(WORDS)
    hard = counted.filter("label = 0").orderBy(F.desc("margin"), F.desc("n"), "word").limit(WORDS // 2)
    drawn = counted.filter("label = 0").orderBy(draw52(F.lit("word"), F.col("word"))).limit(WORDS // 2)
    return pd.concat([positive.toPandas(), hard.toPandas(), drawn.toPandas()]).drop_duplicates(["label", "word"])


def _surprise(counts: pd.DataFrame, n1: int, n0: int) -> np.ndarray:
    """How many standard deviations the share of class 1 is above that of class 0."""
    a, b = counts["n1"].to_numpy(float), counts["n0"].to_numpy(float)
    p = (a + b) / (n1 + n0)
    return (a / n1 - b / n0) / np.sqrt(np.maximum(p * (1 - p) * (1 / n1 + 1 / n0), 1e-12))


def train_round(seen: pd.DataFrame, counts: pd.DataFrame) -> tuple[np.ndarray, float] | None:
    """Weight and bias from the witnesses ``seen`` and the most common words that no sentence of class 1 stands for."""
    shared = set(counts.loc[counts["odds"] < ODDS, "word"])
    positive = seen[(seen["label"] == 1) & ~seen["word"].isin(shared)]
    harmless = counts.loc[~counts["word"].isin(set(positive["word"])), ["word", "n0"]]
    harmless = harmless.sort_values(["n0", "word"], ascending=[False, True]).head(WORDS // 2)
    negative = pd.concat([seen.loc[seen["label"] == 0, ["word", "n"]], harmless.rename(columns={"n0": "n"})]).drop_duplicates("word")
    if not len(positive) or not len(negative):
        return None
    half = LANDMARKS // 2
    marks = [*positive["word"].head(LANDMARKS), *negative["word"].head(half), *harmless["word"].head(half)]
    space = sk.Nystrom(sorted({sk.marked(w)[0] for w in marks}))
    # words also with a foreign character in them, so that an insertion as such tells nothing
    own = [(w, n, 1.0) for w, n in zip(positive["word"], positive["n"])] + [(w, n, -1.0) for w, n in zip(negative["word"], negative["n"])]
    slips = []
    for i, (w, n, y) in enumerate(own):
        places = range(1, len(w)) if y > 0 else [1 + i % (len(w) - 1)] if len(w) > 3 else []
        slips += [(f"{w[:at]}\x04{w[at:]}", n, y / 2) for at in places if len(w) > 3]
    words = [w for w, *_ in own + slips]
    signed = np.array([y for *_, y in own + slips])
    many = np.log1p(np.array([n for _, n, _ in own + slips], float)) * np.abs(signed)
    y = np.sign(signed)
    coefficients, bias = sk.train_svm(space.map([sk.marked(w)[0] for w in words]), y, many)
    return space.fold(coefficients), bias


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", trained: str | None = None) -> dict:
    """The model: ``weight`` (of every hashed subsequence), ``bias``, ``curve``; or ``share`` alone if a class is missing.

    Learns from at most about SAMPLE labelled documents of each class. ``trained``: a predicate on the key.
    """
    sample, stands_for = _sample(docs, labels, key, text, label, trained)
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return {"share": 1.0 if n1 else 0.0}
    counts = _word_counts(sample)
    counts["z"] = _surprise(counts, n1, n0)
    counts["odds"] = (counts["n1"] / n1) / ((counts["n0"] + 0.5) / n0)
    sure = {w: z / SURE - 1 for w, z, o in zip(counts["word"], counts["z"], counts["odds"]) if z > SURE and o >= ODDS}
    score = lambda words: np.array([sure.get(w, -1.0) for w in words])
    weight, bias = None, 0.0
    for _ in range(1 + ROUNDS):
        seen = _witnesses(sample, score)
        learnt = train_round(seen, counts)
        if learnt is None:
            break
        weight, bias = learnt
        score = _margin(weight, bias)
    if weight is None:
        return {"share": n1 * stands_for[1] / (n1 * stands_for[1] + n0 * stands_for[0])}
    rows = _measured(sample.select("label", "text"), "label", weight, bias).toPandas()
    y = rows["label"].to_numpy()
    curve = sk.logistic(_inputs(rows["top"], rows["hits"]), y, np.where(y == 1, stands_for[1], stands_for[0]))
    return {"weight": weight, "bias": bias, "curve": curve}


def _inputs(top, hits) -> np.ndarray:
    return np.column_stack([np.asarray(top, float), np.log1p(np.asarray(hits, float))])


def _margin(weight: np.ndarray, bias: float) -> Callable[[list[str]], np.ndarray]:
    return lambda words: sk.scores(words, weight, bias)


def _measured(df: DataFrame, kept: str, weight: np.ndarray, bias: float) -> DataFrame:
    """The column ``kept`` of each row with ``top`` and ``hits`` of its text."""
    kind = df.schema[kept].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(_margin(weight, bias))
        for batch in batches:
            found = [measures(c, memo) for c in in_chunks((t.as_py() for t in batch.column("text")), memo)]
            columns = [batch.column(kept), pa.array([x for x, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [kept, "top", "hits"])

    return df.select(kept, "text").mapInArrow(run, f"{kept} {kind}, top double, hits long")


def score_texts(df: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, score, hits`` of every row: the likelihood of label 1, and the sentences with an insult.

    Null and empty texts score as texts without words, the least there is. Equal texts score alike; other columns
    are not read.
    """
    rows = df.select(F.col(key).alias("kept"), F.col(text).cast("string").alias("text"))
    if "share" in model:
        return rows.select(F.col("kept").alias(key), F.lit(float(model["share"])).alias("score"), F.lit(0).cast("long").alias("hits"))
    a, b, c = (float(x) for x in model["curve"])
    measured = _measured(rows, "kept", model["weight"], model["bias"])
    z = F.col("top") * a + F.log1p(F.col("hits").cast("double")) * b + c
    return measured.select(F.col("kept").alias(key), (1 / (1 + F.exp(-z))).alias("score"), "hits")


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", trained: str | None = None) -> DataFrame:
    """``key, score, predicted, hits`` of all documents, learnt from those labelled ones for which ``trained`` holds.

    Labels with a null key or value, or other than 0 and 1, are not used; of several labels of a key the largest
    counts. Without labels of both classes the score is 1 if all are 1, else 0.
    """
    out = score_texts(docs, fit(docs, labels, key, text, label, trained), key, text)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
