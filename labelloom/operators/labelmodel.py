"""Probabilistic label model over conditionally independent sources.

A source is one labelling function, or a group of functions that split one
assignment between them (the cluster functions). The model holds
P(outcome | class) per source, with abstaining as an outcome, and a uniform
class balance. EM runs on the vote patterns, whose number does not grow with
the corpus: an iteration is one projection and one aggregation, and a few
hundred parameters come back to the driver.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from ..functions.text import compute_once, let
from ..schemas import ABSTAIN, CARDINALITY
from ..session import checkpointed
from .metrics import confusion, metrics
from .votes import LFRegistry, apply_lfs, pick, vote_patterns

TIE_TOLERANCE = 1e-5
FLOOR = 1e-6
SMALL_TABLE = 50_000


@dataclass(frozen=True)
class Source:
    """``columns`` hold the votes of the source; ``labels`` are the classes it may vote for."""

    name: str
    columns: tuple[str, ...]
    labels: tuple[int, ...]

    @property
    def outcomes(self) -> tuple[int, ...]:
        return (ABSTAIN, *self.labels)

    def outcome(self) -> str:
        """SQL for the vote of the source, -1 if none of its functions votes."""
        columns = ", ".join(f"`{c}`" for c in self.columns)
        return columns if len(self.columns) == 1 else f"greatest({columns})"


def sources_of(names: Sequence[str]) -> tuple[Source, ...]:
    """Standard grouping: ``keyword_<k>`` are sources of their own, all ``cluster_<k>`` are one.

    Other functions are taken to vote for any class.
    """
    out = []
    clusters = tuple(n for n in names if re.fullmatch(r"cluster_[0-9]+", n))
    for n in names:
        if re.fullmatch(r"keyword_[0-9]+", n):
            out.append(Source(n, (n,), (int(n.split("_")[1]),)))
        elif n not in clusters:
            out.append(Source(n, (n,), tuple(range(CARDINALITY))))
    if clusters:
        out.append(Source("cluster", clusters, tuple(int(n.split("_")[1]) for n in clusters)))
    return tuple(out)


def source_patterns(patterns: DataFrame, sources: Sequence[Source]) -> DataFrame:
    """One column per source instead of one per function."""
    return patterns.select(*[F.expr(s.outcome()).alias(s.name) for s in sources], "n").groupBy(*[s.name for s in sources]).agg(
        F.sum("n").alias("n")
    )


@dataclass(frozen=True)
class LabelModel:
    """Parameters ``mu[source][outcome][class]``; ``use_abstain`` lets silence count as evidence."""

    sources: tuple[Source, ...]
    mu: dict[str, dict[int, tuple[float, ...]]] = field(hash=False)
    use_abstain: bool = False

    def posterior(self, outcome=Source.outcome) -> Column:
        """Class probabilities of a row as an array, from literal parameters."""
        # as SQL text: the expression has a few hundred literals and is built anew in every EM iteration
        def row(values) -> str:
            return "array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")"

        logits = row([-math.log(CARDINALITY)] * CARDINALITY)
        for s in self.sources:
            weighed = [o for o in s.outcomes if o != ABSTAIN or self.use_abstain]
            logs = {o: row(math.log(max(p, FLOOR)) for p in self.mu[s.name][o]) for o in weighed}
            cases = " ".join(f"WHEN {outcome(s)} = {o} THEN {logs[o]}" for o in weighed)
            logits = f"zip_with({logits}, CASE {cases} ELSE {row([0.0] * CARDINALITY)} END, (a, b) -> a + b)"

        def softmax(scores: Column) -> Column:
            exps = let(F.array_max(scores), lambda m: F.transform(scores, lambda x: F.exp(x - m)))
            return let(
                exps, lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda z: F.transform(e, lambda x: x / z))
            )

        return let(F.expr(logits), softmax)

    def with_posterior(self, df: DataFrame, outcome=Source.outcome, out: str = "posterior") -> DataFrame:
        return df.withColumn(out, self.posterior(outcome))

    def predict(self, df: DataFrame, tie: str = "abstain", key: Column | None = None, out: str = "label") -> DataFrame:
        """Add the most probable class; a tie (no votes at all, for one) is -1 or drawn from a hash of ``key``."""
        return df.withColumn(out, pick(self.posterior(), tie, key, TIE_TOLERANCE).cast("int"))

    def to_table(self, spark: SparkSession) -> DataFrame:
        """``(source, outcome, label, p)``: the model as a table that can be stored."""
        rows = [
            (s.name, o, c, float(self.mu[s.name][o][c])) for s in self.sources for o in s.outcomes for c in range(CARDINALITY)
        ]
        return spark.createDataFrame(rows, "source string, outcome int, label int, p double")

    @classmethod
    def from_table(cls, table: DataFrame, sources: Sequence[Source], use_abstain: bool = False) -> LabelModel:
        mu: dict = {s.name: {o: [FLOOR] * CARDINALITY for o in s.outcomes} for s in sources}
        # the stored table may hold other sources as well; a row per outcome and class is read of these
        own = table.filter(F.col("source").isin(*mu) & F.col("label").between(0, CARDINALITY - 1))
        for r in own.groupBy("source", "outcome", "label").agg(F.max("p").alias("p")).collect():
            if r["outcome"] in mu[r["source"]]:
                mu[r["source"]][r["outcome"]][r["label"]] = r["p"]
        return cls(tuple(sources), mu, use_abstain)


def initial_parameters(counts: dict[str, dict[int, float]], sources: Sequence[Source], prior_acc: float = 0.7) -> dict:
    """Better-than-random start: a vote is right with ``prior_acc``, at the source's observed coverage."""
    mu: dict = {}
    for s in sources:
        total = sum(counts[s.name].values())
        cover = 1.0 - counts[s.name].get(ABSTAIN, 0.0) / total
        table: dict[int, list[float]] = {o: [] for o in s.outcomes}
        for c in range(CARDINALITY):
            if len(s.labels) == 1:
                right = s.labels[0] == c
                p = cover * CARDINALITY * (prior_acc if right else (1 - prior_acc) / (CARDINALITY - 1))
                p = min(max(p, 0.01), 0.99)
                table[s.labels[0]].append(p)
                table[ABSTAIN].append(1 - p)
            else:
                for o in s.labels:
                    table[o].append(max(cover * (prior_acc if o == c else (1 - prior_acc) / (CARDINALITY - 1)), FLOOR))
                table[ABSTAIN].append(max(1 - cover, FLOOR))
        mu[s.name] = {o: tuple(v) for o, v in table.items()}
    return mu


def _outcome_sums(patterns: DataFrame, sources: Sequence[Source], weights: Sequence[Column]) -> list[Row]:
    """Weighted counts per (source, outcome): at most eight rows per source, as a vote is -1 or a class id."""
    pairs = F.array(*[F.struct(F.lit(s.name).alias("source"), F.col(s.name).alias("outcome")) for s in sources])
    named = [w.alias(f"w{i}") for i, w in enumerate(weights)]
    long = patterns.select(F.inline(pairs), *named)
    sums = long.groupBy("source", "outcome").agg(*[F.sum(f"w{i}").alias(f"w{i}") for i in range(len(weights))])
    return sums.collect()


def lm_fit(
    patterns: DataFrame,
    names: Sequence[str],
    max_iter: int = 25,
    tol: float = 1e-4,
    smoothing: float = 0.01,
    prior_acc: float = 0.7,
    step: float = 1.0,
    use_abstain: bool = False,
) -> LabelModel:
    """Expectation maximisation from the better-than-random start.

    Without votes of its own a row carries no evidence about the classes; the
    expectation step always weighs abstentions, as the parameters include them.
    """
    sources = sources_of(names)
    table = checkpointed(source_patterns(patterns, sources))
    if table.count() <= SMALL_TABLE:
        # the usual few hundred patterns: without a shuffle an iteration is one small task
        table = table.coalesce(1)
    base: dict = {s.name: {} for s in sources}
    outcomes = {s.name: set(s.outcomes) for s in sources}
    for r in _outcome_sums(table, sources, [F.col("n").cast("double")]):
        if r["outcome"] not in outcomes[r["source"]]:
            raise ValueError(f"{r['source']} votes for {r['outcome']}, a class that it does not have")
        base[r["source"]][r["outcome"]] = r["w0"]
    mu = initial_parameters(base, sources, prior_acc)
    for _ in range(max_iter):
        model = LabelModel(sources, mu, use_abstain=True)
        post = model.with_posterior(table, lambda s: f"`{s.name}`")
        weights = [F.col("n") * F.get("posterior", F.lit(c)) for c in range(CARDINALITY)]
        sums = {(r["source"], r["outcome"]): r for r in _outcome_sums(post, sources, weights)}
        new, change = {}, 0.0
        for s in sources:
            rows = {o: sums.get((s.name, o)) for o in s.outcomes}
            new[s.name] = {o: [] for o in s.outcomes}
            for c in range(CARDINALITY):
                mass = [0.0 if rows[o] is None else rows[o][f"w{c}"] for o in s.outcomes]
                whole = sum(mass) + smoothing * len(mass)
                for o, m in zip(s.outcomes, mass):
                    p = mu[s.name][o][c] + step * ((m + smoothing) / whole - mu[s.name][o][c])
                    change = max(change, abs(p - mu[s.name][o][c]))
                    new[s.name][o].append(p)
        mu = new
        if change < tol:
            break
    return LabelModel(sources, mu, use_abstain)


def lm_moments(patterns: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(lf1, vote1, lf2, vote2, moment)``: share of rows in which both functions cast these votes.

    The pairs of one pattern are bounded by the number of functions, and they
    are formed per pattern, not per row of the corpus.
    """
    cast = F.filter(
        F.array(*[F.struct(F.lit(n).alias("lf"), F.col(n).alias("vote")) for n in names]), lambda e: e.vote != ABSTAIN
    )
    pairs = F.flatten(F.transform("cast", lambda a: F.transform("cast", lambda b: F.struct(a.alias("a"), b.alias("b")))))
    total = patterns.agg(F.sum("n")).scalar()
    return (
        patterns.select("n", cast.alias("cast"))
        .select("n", F.explode(pairs).alias("p"))
        .groupBy(
            F.col("p.a.lf").alias("lf1"), F.col("p.a.vote").alias("vote1"),
            F.col("p.b.lf").alias("lf2"), F.col("p.b.vote").alias("vote2"),
        )
        .agg((F.sum("n") / total).alias("moment"))
    )


def label_corpus(df: DataFrame, registry: LFRegistry, model: LabelModel, keep: Sequence[str]) -> DataFrame:
    """Vote, predict and drop the rows that stay without a label. One projection and one filter."""
    votes = apply_lfs(df, registry, keep)
    label = pick(model.posterior(), "abstain", None, TIE_TOLERANCE).cast("int")
    return compute_once(votes, list(keep), label, "label").filter(F.col("label") != ABSTAIN)


def label_texts(df: DataFrame, registry: LFRegistry, model: LabelModel, keep: Sequence[str], class_names: Sequence[str]) -> DataFrame:
    """Class name for every text, null where the model abstains."""
    labelled = model.predict(apply_lfs(df, registry, keep)).drop(*registry.names)
    names = F.array(*[F.lit(n) for n in class_names])
    return labelled.withColumn("class_name", F.when(F.col("label") != ABSTAIN, F.get(names, F.col("label"))))


def evaluate_model(votes: DataFrame, label: str, model: LabelModel, key: str) -> DataFrame:
    """All metrics of a model on annotated rows; ties are drawn from a hash of the key."""
    return metrics(confusion(model.predict(votes, tie="hash", key=F.col(key), out="pred"), label, "pred"))


def champion_check(votes: DataFrame, label: str, new: LabelModel, old: LabelModel | None, key: str) -> DataFrame:
    """``(new_accuracy, old_accuracy, replace)``: the new model wins only if it is strictly better."""
    scored = new.predict(votes, "hash", F.col(key), "new_pred")
    hit = F.avg((F.col("new_pred") == F.col(label)).cast("double")).alias("new_accuracy")
    if old is None:
        return scored.agg(hit).select("new_accuracy", F.lit(None).cast("double").alias("old_accuracy"), F.lit(True).alias("replace"))
    scored = old.predict(scored, "hash", F.col(key), "old_pred")
    both = scored.agg(hit, F.avg((F.col("old_pred") == F.col(label)).cast("double")).alias("old_accuracy"))
    return both.withColumn("replace", F.col("new_accuracy") > F.col("old_accuracy"))


__all__ = [
    "LabelModel", "Source", "champion_check", "evaluate_model", "initial_parameters", "label_corpus", "label_texts",
    "lm_fit", "lm_moments", "source_patterns", "sources_of", "vote_patterns",
]
