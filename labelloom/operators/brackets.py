"""Classifier search in brackets: many configurations train at once, the best of each rung go on from their coefficients.

A bracket starts some configurations with some passes over the training rows; after every rung the best ``1/eta``
of them get ``eta`` times as many passes. All configurations of all brackets that are due train in the same Spark job:
each task goes over its rows in mini-batches for all of them, and coefficients are averaged over the tasks after
every pass. Features are computed once. Coefficients and scores of every pass are stored, so that a search that was
stopped goes on after its last finished pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import hash_int, hash_order, let, remove_stopwords, term_counts, tokenize
from ..schemas import CARDINALITY
from ..session import scratch_path, stored

WIDTH = 1 << 12
# Rows that are made dense at a time.
STRETCH = 512
RECORD_SCHEMA = "bracket int, rung int, config_id int, epochs int, score double, rank int, promoted boolean, rate double, l2 double, batch int"
STATE_SCHEMA = "config_id int, label int, w array<double>"


@dataclass(frozen=True)
class Bracket:
    """``start`` configurations with ``epochs`` passes each in the first rung."""

    start: int
    epochs: int


BRACKETS = (Bracket(27, 1), Bracket(9, 3), Bracket(3, 9))


def sampled_configs(spark: SparkSession, n: int, seed: int = 12) -> DataFrame:
    """``config_id, rate, l2, batch``: rates, penalties and batch sizes drawn log-uniformly; draws are hashes of number and seed."""

    def u(name: str) -> Column:
        return hash_int(F.col("id"), f"{seed}:{name}") / float(1 << 32)

    return spark.range(n).select(
        F.col("id").cast("int").alias("config_id"),
        F.pow(F.lit(10.0), -2 + 3 * u("rate")).alias("rate"),
        F.pow(F.lit(10.0), -6 + 4 * u("l2")).alias("l2"),
        F.floor(F.pow(F.lit(2.0), 3 + 4 * u("batch"))).cast("int").alias("batch"),
    )


def hashed_features(df: DataFrame, key: str, text: Column, lang: Column, label: str, width: int = WIDTH) -> DataFrame:
    """``key, label, at, value``: damped term counts in hashed columns, rows of length one, without leaving the row."""
    counts = term_counts(remove_stopwords(tokenize(text), lang))
    damped = F.transform("e", lambda x: 1 + F.log(x.n.cast("double")))

    # the length is bound once: within the division it would be summed again for every term
    def scaled(v: Column) -> Column:
        return let(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), lambda n: F.transform(v, lambda x: x / n))

    rows = df.select(F.col(key).alias("key"), F.col(label).alias("label"), F.explode_outer(F.array(counts)).alias("e"))
    at = F.transform("e", lambda x: F.pmod(F.xxhash64(x.term), F.lit(width)).cast("int"))
    empty = F.array()
    return rows.select(
        "key", "label", F.coalesce(at, empty.cast("array<int>")).alias("at"), F.coalesce(let(damped, scaled), empty.cast("array<double>")).alias("value")
    )


class _Rows:
    """Hashed rows of a frame in three flat arrays; ``matrix`` makes a stretch of them dense, with a last column of ones."""

    def __init__(self, frame: pd.DataFrame, width: int):
        self.n, self.width = len(frame), width
        self.ends = np.concatenate([[0], np.cumsum([len(x) for x in frame["at"]])]).astype(int)
        self.at = np.concatenate([np.asarray(x, int) for x in frame["at"]])
        self.value = np.concatenate([np.asarray(x, float) for x in frame["value"]])

    def matrix(self, first: int, last: int) -> np.ndarray:
        out = np.zeros((last - first, self.width + 1))
        row = np.repeat(np.arange(last - first), np.diff(self.ends[first : last + 1]))
        part = slice(self.ends[first], self.ends[last])
        np.add.at(out.reshape(-1), row * (self.width + 1) + self.at[part], self.value[part])
        out[:, -1] = 1
        return out


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def sgd_pass(w: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray, rate: float, l2: float, batch: int) -> np.ndarray:
    """Coefficients after the mini-batches of ``x`` in order; the last column is the bias."""
    for i in range(0, len(x), batch):
        part = slice(i, i + batch)
        error = softmax(x[part] @ w[:, :-1].T + w[:, -1])
        error[np.arange(len(error)), y[part]] -= 1
        error *= weight[part, None] / len(error)
        w = w - rate * (np.column_stack([error.T @ x[part], error.sum(axis=0)]) + l2 * w)
    return w


def sgd_passes(w: np.ndarray, rows: _Rows, y: np.ndarray, weight: np.ndarray, configs: Sequence[dict]) -> np.ndarray:
    """``sgd_pass`` of many configurations over the same rows; ``w``: configuration, class, column.

    Within a stretch of rows the coefficients are those at its begin, scaled, plus the moves along the rows seen since.
    So one product for all configurations gives the logits at the begin, the products of the rows with one another give
    the rest, and the coefficients are moved once a stretch. Every configuration keeps its own mini-batches: one that a
    stretch does not hold whole is left to the next stretch, which begins there.
    """
    m, k, columns = w.shape
    w, place = w.copy(), np.zeros(m, int)
    size = max(STRETCH, 4 * max(int(f["batch"]) for f in configs))
    while (first := int(place.min())) < rows.n:
        last = min(first + size, rows.n)
        x = rows.matrix(first, last)
        begin = (x @ w.reshape(m * k, columns).T).reshape(len(x), m, k)
        inner, moves = x @ x.T, np.zeros((len(x), m, k))
        for c, f in enumerate(configs):
            batch, keep, scale = int(f["batch"]), 1 - f["rate"] * f["l2"], 1.0
            z, move = np.ascontiguousarray(begin[:, c]), np.zeros((len(x), k))
            start = i = int(place[c]) - first
            while i < len(x) and (i + batch <= len(x) or last == rows.n):
                part = slice(i, i + batch)
                error = softmax(scale * z[part] + inner[part, start:i] @ move[start:i])
                error[np.arange(len(error)), y[first:last][part]] -= 1
                error *= weight[first:last][part, None] / len(error)
                move[start:i] *= keep
                move[part] = -f["rate"] * error
                scale *= keep
                i += len(error)
            moves[:, c], place[c] = move, first + i
            w[c] *= scale
        w += (moves.reshape(len(x), m * k).T @ x).reshape(w.shape)
    return w


def _one_pass(train: DataFrame, state: dict[int, np.ndarray], configs: dict[int, dict], class_weight: np.ndarray, width: int) -> DataFrame:
    """``STATE_SCHEMA`` after one pass of all configurations in ``state``: averages over the tasks by their rows."""
    ids = list(state)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, n = np.stack([state[c] for c in ids]), 0
        for frame in frames:
            if not len(frame):
                continue
            y = frame["label"].to_numpy(int)
            n += len(frame)
            own = sgd_passes(own, _Rows(frame, width), y, class_weight[y], [configs[c] for c in ids])
        if n:
            yield pd.DataFrame([(c, k, float(n), w[k].tolist()) for c, w in zip(ids, own) for k in range(len(w))], columns=["config_id", "label", "rows", "w"])

    moved = train.select("label", "at", "value").mapInPandas(run, "config_id int, label int, rows double, w array<double>")
    mean = Summarizer.mean(F.col("v"), F.col("rows"))
    out = moved.select("config_id", "label", "rows", array_to_vector("w").alias("v")).groupBy("config_id", "label").agg(mean.alias("w"))
    return out.select("config_id", "label", vector_to_array("w").alias("w"))


def _accuracy(test: DataFrame, state: dict[int, np.ndarray], width: int) -> dict[int, float]:
    """Share of right predictions of every configuration, ties to the lower class."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = np.stack(list(state.values()))
        flat = w.reshape(-1, w.shape[2]).T
        for frame in frames:
            if not len(frame):
                continue
            rows, y = _Rows(frame, width), frame["label"].to_numpy(int)
            hits = np.zeros(len(w), int)
            for i in range(0, rows.n, STRETCH):
                x = rows.matrix(i, min(i + STRETCH, rows.n))
                best = (x @ flat).reshape(len(x), *w.shape[:2]).argmax(axis=2)
                hits += (best == y[i : i + STRETCH, None]).sum(axis=0)
            yield pd.DataFrame({"config_id": list(state), "hits": hits, "n": rows.n})

    found = test.select("label", "at", "value").mapInPandas(run, "config_id int, hits long, n long").groupBy("config_id").agg((F.sum("hits") / F.sum("n")).alias("score"))
    return {r["config_id"]: r["score"] for r in found.collect()}


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def search_brackets(
    train: DataFrame,
    test: DataFrame,
    configs: DataFrame,
    brackets: Sequence[Bracket] = BRACKETS,
    eta: int = 3,
    max_epochs: int = 9,
    width: int = WIDTH,
    path: str | None = None,
) -> DataFrame:
    """``RECORD_SCHEMA``: one row per configuration and rung; ``promoted`` says who goes on.

    ``train`` and ``test`` come from ``hashed_features``. Bracket i takes the next ``start`` configurations by id.
    Within a rung configurations rank by accuracy, ties by id; the best ``1/eta`` (at least one) go on until
    ``max_epochs``. With ``path`` every finished pass is kept there, and a second call with it skips those passes.
    Rows of a class weigh as much as the inverse of its share.
    """
    spark = train.sparkSession
    path = path or scratch_path(spark, "brackets")
    given = [r.asDict() for r in configs.orderBy("config_id").collect()]
    if len(given) < sum(b.start for b in brackets):
        raise ValueError(f"{len(given)} configurations for {sum(b.start for b in brackets)} places")
    by_id = {c["config_id"]: c for c in given}
    # the same rows in the same order in every pass
    tasks = spark.sparkContext.defaultParallelism
    train = stored(train.repartition(tasks, "key").sortWithinPartitions(hash_order(F.col("key"))), "bracket_train")
    test = stored(test, "bracket_test")
    # counted in the stored rows: the features would be computed for it once more
    counts = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    class_weight = np.array([total / (len(counts) * counts[k]) if k in counts else 0.0 for k in range(CARDINALITY)])
    alive, at = [], 0
    for b in brackets:
        alive.append([c["config_id"] for c in given[at : at + b.start]])
        at += b.start
    due, rung = [b.epochs for b in brackets], [0] * len(brackets)
    state = {c: np.zeros((CARDINALITY, width + 1)) for ids in alive for c in ids}
    records = []
    for epoch in range(1, max_epochs + 1):
        # a bracket rests when its rung is over; its coefficients are those of its last pass
        active = sorted(c for i, ids in enumerate(alive) if due[i] >= epoch for c in ids)
        if not active:
            break
        folder = f"{path}/epoch={epoch}"
        if not _exists(spark, f"{folder}/_SUCCESS"):
            _one_pass(train, {c: state[c] for c in active}, by_id, class_weight, width).write.mode("overwrite").parquet(folder)
        for r in spark.read.schema(STATE_SCHEMA).parquet(folder).collect():
            state[r["config_id"]][r["label"]] = r["w"]
        over = [i for i in range(len(brackets)) if alive[i] and due[i] == epoch]
        if not over:
            continue
        scores = _accuracy(test, {c: state[c] for i in over for c in alive[i]}, width)
        for i in over:
            order = sorted(alive[i], key=lambda c: (-scores.get(c, 0.0), c))
            final = epoch * eta > max_epochs
            kept = [] if final else order[: max(1, len(order) // eta)]
            records += [(i, rung[i], c, epoch, scores.get(c, 0.0), n, c in kept, by_id[c]["rate"], by_id[c]["l2"], by_id[c]["batch"]) for n, c in enumerate(order, 1)]
            alive[i], rung[i], due[i] = kept, rung[i] + 1, min(epoch * eta, max_epochs)
    return spark.createDataFrame(records, RECORD_SCHEMA)
