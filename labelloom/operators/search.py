"""Hyper-parameter search: configuration tables, fits in parallel, best results."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import hash_int
from ..schemas import ABSTAIN, CARDINALITY
from .tables import union_rows
from .labelmodel import FLOOR, TIE_TOLERANCE, initial_parameters, lm_fit, sources_of

# Values of the label-model grid: 4 * 3 * 3 * 3 * 3 = 324 configurations.
GRID = {
    "max_iter": (10, 30, 50, 100),
    "tol": (1e-3, 1e-4, 1e-5),
    "smoothing": (0.1, 0.2, 0.3),
    "prior_acc": (0.6, 0.7, 0.8),
    "step": (0.25, 0.5, 1.0),
}
CONFIG_SCHEMA = "config_id int, max_iter int, tol double, smoothing double, prior_acc double, step double"
RESULT_SCHEMA = CONFIG_SCHEMA + (
    ", accuracy double, coverage double, precision_micro double, precision_macro double,"
    " f1_micro double, f1_macro double, mcc double"
)


def grid_configs(spark: SparkSession, grid: dict[str, Sequence] = GRID) -> DataFrame:
    """The full product of the value lists."""
    rows = [(i, *values) for i, values in enumerate(itertools.product(*(grid[k] for k in GRID)))]
    return spark.createDataFrame(rows, CONFIG_SCHEMA)


def random_configs(spark: SparkSession, n: int = 40, seed: int = 12) -> DataFrame:
    """``n`` configurations drawn from ranges; the draws are hashes of the number and the seed."""

    def u(name: str) -> Column:
        return hash_int(F.col("id"), f"{seed}:{name}") / float(1 << 32)

    return spark.range(n).select(
        F.col("id").cast("int").alias("config_id"),
        F.floor(10 + u("max_iter") * 90).cast("int").alias("max_iter"),
        F.pow(F.lit(10.0), -5 + 2 * u("tol")).alias("tol"),
        F.round(0.01 + u("smoothing") * 0.39, 2).alias("smoothing"),
        F.round(0.5 + u("prior_acc") * 0.45, 2).alias("prior_acc"),
        F.round(0.2 + u("step") * 0.8, 2).alias("step"),
    )


class PatternFit:
    """The label model on a bounded pattern table, for many configurations.

    A search repeats the fit hundreds of times on the same few hundred vote
    patterns. The patterns travel with the task; the configurations are the
    rows that Spark spreads over the cluster.
    """

    def __init__(self, train: pd.DataFrame, test: pd.DataFrame, names: Sequence[str]):
        self.sources = sources_of(names)
        self.train = self._codes(train)
        self.test = self._codes(test)
        self.n = train["n"].to_numpy(float)
        self.test_label = test["label"].to_numpy(int)
        self.test_n = test["n"].to_numpy(float)
        self.base = {
            s.name: {o: float(self.n[self.train[i] == j].sum()) for j, o in enumerate(s.outcomes)}
            for i, s in enumerate(self.sources)
        }

    def _codes(self, table: pd.DataFrame) -> list[np.ndarray]:
        out = []
        for s in self.sources:
            best = table[list(s.columns)].max(axis=1).to_numpy()
            out.append(np.searchsorted(np.array(s.outcomes), best))
        return out

    def _posterior(self, mu: list[np.ndarray], codes: list[np.ndarray], use_abstain: bool) -> np.ndarray:
        logits = np.zeros((len(codes[0]), CARDINALITY))
        for m, c in zip(mu, codes):
            part = np.log(np.maximum(m, FLOOR))[c]
            if not use_abstain:
                part[c == 0] = 0.0
            logits += part
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def fit(self, max_iter: int, tol: float, smoothing: float, prior_acc: float, step: float) -> list[np.ndarray]:
        start = initial_parameters(self.base, self.sources, prior_acc)
        mu = [np.array([start[s.name][o] for o in s.outcomes]) for s in self.sources]
        for _ in range(max_iter):
            mass = self._posterior(mu, self.train, True) * self.n[:, None]
            new = []
            for m, c in zip(mu, self.train):
                sums = np.zeros_like(m)
                np.add.at(sums, c, mass)
                target = (sums + smoothing) / (sums.sum(axis=0) + smoothing * len(m))
                new.append(m + step * (target - m))
            change = max(np.abs(a - b).max() for a, b in zip(new, mu))
            mu = new
            if change < tol:
                break
        return mu

    def score(self, mu: list[np.ndarray]) -> dict[str, float]:
        p = self._posterior(mu, self.test, False)
        tied = p >= p.max(axis=1, keepdims=True) - TIE_TOLERANCE
        pred = np.where(tied.sum(axis=1) == 1, p.argmax(axis=1), ABSTAIN)
        table = np.zeros((CARDINALITY + 1, CARDINALITY + 1))
        np.add.at(table, (self.test_label + 1, pred + 1), self.test_n)
        return table_scores(table)


def table_scores(table: np.ndarray) -> dict[str, float]:
    """Metrics of one confusion matrix whose first row and column are abstentions."""

    def ratio(a, b):
        return np.divide(a, b, out=np.zeros_like(np.asarray(a, float)), where=np.asarray(b) != 0)

    s, hit, p, t = table.sum(), np.diag(table), table.sum(axis=0), table.sum(axis=1)
    root = np.sqrt((s * s - p @ p) * (s * s - t @ t))
    return {
        "accuracy": float(ratio(hit.sum(), s)),
        "coverage": float(ratio(p[1:].sum(), s)),
        "precision_micro": float(ratio(hit[1:].sum(), p[1:].sum())),
        "precision_macro": float(ratio(hit[1:], p[1:]).mean()),
        "f1_micro": float(ratio(2 * hit[1:].sum(), p[1:].sum() + t[1:].sum())),
        "f1_macro": float(ratio(2 * hit[1:], p[1:] + t[1:]).mean()),
        "mcc": float(ratio(hit.sum() * s - p @ t, root)),
    }


def search_label_model(
    configs: DataFrame, train: DataFrame, test: DataFrame, names: Sequence[str], max_patterns: int = 50_000, tasks: int = 64
) -> DataFrame:
    """Fit and score every configuration: ``RESULT_SCHEMA``.

    ``train`` holds vote patterns ``(names, n)`` and ``test`` annotated patterns
    ``(names, label, n)``. Their size is checked, since every task reads them;
    a larger pattern table is fitted by ``lm_fit`` instead.
    """
    tables = [t.limit(max_patterns + 1).toPandas() for t in (train, test)]
    if max(map(len, tables)) > max_patterns:
        raise ValueError(f"more than {max_patterns} vote patterns; use lm_fit")
    shared = configs.sparkSession.sparkContext.broadcast((tables, tuple(names)))

    def run(batches):
        (train_pdf, test_pdf), columns = shared.value
        fitter = PatternFit(train_pdf, test_pdf, columns)
        for batch in batches:
            rows = []
            for c in batch.to_dict("records"):
                params = {k: c[k] for k in GRID}
                params["max_iter"] = int(params["max_iter"])
                rows.append({**c, **fitter.score(fitter.fit(**params))})
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in RESULT_SCHEMA.split(", ")])

    return configs.repartition(tasks, "config_id").mapInPandas(run, RESULT_SCHEMA)


def fold_patterns(votes: DataFrame, names: Sequence[str], key: str, label: str, ks: Sequence[int] = range(2, 10), seed: int = 12) -> DataFrame:
    """``(k, fold, names, label, n)``: the vote patterns of every fold of every k, in one aggregation."""
    h = hash_int(F.col(key), seed)
    folds = F.array(*[F.struct(F.lit(k).alias("k"), F.pmod(h, F.lit(k)).cast("int").alias("fold")) for k in ks])
    rows = votes.select(*names, F.col(label).alias("label"), F.inline(folds))
    return rows.groupBy("k", "fold", *names, "label").agg(F.count(F.lit(1)).alias("n"))


def cross_validate(configs: DataFrame, patterns: DataFrame, names: Sequence[str], max_patterns: int = 500_000, tasks: int = 64) -> DataFrame:
    """Fit every configuration on the other folds and score it on the annotated rows of the fold.

    ``patterns`` comes from ``fold_patterns``; its size does not depend on the corpus but on the functions. Up to
    ``max_patterns`` rows travel with the tasks, and each (fold, configuration) pair is a row of work. A larger
    table stays in Spark: every pair is then fitted by ``lm_fit``, one after the other.
    """
    head = patterns.limit(max_patterns + 1).toPandas()
    if len(head) > max_patterns:
        return _cross_validate_in_spark(configs, patterns, names)
    table = head
    shared = configs.sparkSession.sparkContext.broadcast((table, tuple(names)))
    ids = sorted(set(zip(table["k"].tolist(), table["fold"].tolist())))
    work = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(f).alias("fold")) for k, f in ids])
    schema = "k int, fold int, " + RESULT_SCHEMA

    def run(batches):
        rows, columns = shared.value
        ready: dict = {}
        for batch in batches:
            out = []
            for c in batch.to_dict("records"):
                at = (c["k"], c["fold"])
                if at not in ready:
                    of_k = rows[rows["k"] == c["k"]]
                    test = of_k[(of_k["fold"] == c["fold"]) & (of_k["label"] >= 0)]
                    ready[at] = PatternFit(of_k[of_k["fold"] != c["fold"]], test, columns)
                params = {k: c[k] for k in GRID}
                params["max_iter"] = int(params["max_iter"])
                out.append({**c, **ready[at].score(ready[at].fit(**params))})
            yield pd.DataFrame(out, columns=[f.split()[0] for f in schema.split(", ")])

    todo = configs.select(F.inline(work), "*").repartition(tasks, "k", "fold", "config_id")
    return todo.mapInPandas(run, schema)


def _cross_validate_in_spark(configs: DataFrame, patterns: DataFrame, names: Sequence[str]) -> DataFrame:
    """The same results with the patterns left where they are; the driver holds configurations, folds and metrics."""
    spark = patterns.sparkSession
    folds = [(r["k"], r["fold"]) for r in patterns.select("k", "fold").distinct().orderBy("k", "fold").collect()]
    fields = [f.split()[0] for f in RESULT_SCHEMA.split(", ")]
    rows = []
    for c in configs.collect():
        params = {p: c[p] for p in GRID}
        for k, fold in folds:
            of_k = patterns.filter(F.col("k") == k)
            train = of_k.filter(F.col("fold") != fold).groupBy(*names).agg(F.sum("n").alias("n"))
            model = lm_fit(train, names, **params)
            test = model.predict(of_k.filter((F.col("fold") == fold) & (F.col("label") >= 0)), "abstain", None, "pred")
            table = np.zeros((CARDINALITY + 1, CARDINALITY + 1))
            for r in test.groupBy("label", "pred").agg(F.sum("n").alias("n")).collect():
                table[r["label"] + 1, r["pred"] + 1] = r["n"]
            scored = {**c.asDict(), **table_scores(table)}
            rows.append((k, fold, *[scored[f] for f in fields]))
    return spark.createDataFrame(rows, "k int, fold int, " + RESULT_SCHEMA)


def trial_results(stored: DataFrame, new: DataFrame, trial: Column) -> DataFrame:
    """Stored results and the new ones with their trial number."""
    return union_rows(stored, new.withColumn("Trial", trial).select(*stored.columns))


def best_config(results: DataFrame, score: str, tie: Sequence[str]) -> DataFrame:
    """The row with the highest score; ties by the ``tie`` columns."""
    return results.orderBy(F.desc(score), *tie).limit(1)


def next_trial(results: DataFrame, trial: str = "Trial") -> DataFrame:
    return results.agg(F.coalesce(F.max(trial) + 1, F.lit(0)).alias("next_trial"))
