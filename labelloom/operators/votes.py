"""Labelling functions, the vote table and its analysis."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.patterns import any_literal
from ..functions.text import hash_int, let
from ..schemas import ABSTAIN, CARDINALITY


@dataclass(frozen=True)
class LabelingFunction:
    """A named vote: a Column that is a class id or -1. The column may be a ``pandas_udf`` call."""

    name: str
    vote: Callable[[], Column]


def keyword_lf(label: int, keywords: Sequence[str], text: str) -> LabelingFunction:
    """Vote ``label`` if the lower-case text contains a keyword anywhere. Keywords are taken as they are."""

    def vote() -> Column:
        low = F.lower(F.col(text))
        if not keywords:
            return F.lit(ABSTAIN)
        if len(keywords) > 20:
            found = low.rlike(any_literal(keywords))
        else:
            found = F.lit(False)
            for k in keywords:
                found = found | low.contains(k)
        return F.when(found, F.lit(label)).otherwise(F.lit(ABSTAIN))

    return LabelingFunction(f"keyword_{label}", vote)


def cluster_lf(label: int, cluster: str) -> LabelingFunction:
    """Vote ``label`` if it is the nearest centroid, which is computed once for all of these functions."""
    return LabelingFunction(f"cluster_{label}", lambda: F.when(F.col(cluster) == label, F.lit(label)).otherwise(F.lit(ABSTAIN)))


class LFRegistry:
    """Ordered labelling functions; users add their own to the standard ones."""

    def __init__(self, functions: Sequence[LabelingFunction] = ()):
        self.functions: tuple[LabelingFunction, ...] = ()
        for f in functions:
            self.add(f)

    def add(self, function: LabelingFunction) -> LFRegistry:
        if function.name in self.names:
            raise ValueError(f"labelling function {function.name} exists")
        self.functions += (function,)
        return self

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.functions]

    @classmethod
    def standard(cls, keywords: dict[int, Sequence[str]], text: str, cluster: str | None = None) -> LFRegistry:
        """Keyword functions, and cluster functions if the whole corpus is to be labelled."""
        lfs = [keyword_lf(k, keywords.get(k, ()), text) for k in range(CARDINALITY)]
        if cluster is not None:
            lfs += [cluster_lf(k, cluster) for k in range(CARDINALITY)]
        return cls(lfs)


def apply_lfs(df: DataFrame, registry: LFRegistry, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns and one int vote per labelling function, in a single projection.

    A vote is -1 or a class id; any other, null included, fails the job here rather than bias the model later.
    """

    def checked(f) -> Column:
        vote = f.vote().cast("int")
        wrong = F.concat(F.lit(f"vote of {f.name} is no class: "), F.coalesce(vote.cast("string"), F.lit("null")))
        return F.when(vote.between(ABSTAIN, CARDINALITY - 1), vote).otherwise(F.raise_error(wrong).cast("int"))

    return df.select(*keep, *[checked(f).alias(f.name) for f in registry.functions])


def vote_patterns(votes: DataFrame, names: Sequence[str]) -> DataFrame:
    """Distinct vote rows with counts: all that the analysis and the label model need."""
    return votes.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))


def _voted(names: Sequence[str]) -> Column:
    return F.filter(F.array(*names), lambda v: v != ABSTAIN)


def long_votes(votes: DataFrame, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per labelling function: ``keep``, ``lf``, ``vote``."""
    pairs = F.array(*[F.struct(F.lit(n).alias("lf"), F.col(n).alias("vote")) for n in names])
    return votes.select(*keep, F.inline(pairs))


def lf_summary(patterns: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Polarity, coverage, overlaps and conflicts of every labelling function, from the vote patterns.

    ``by`` names columns of the patterns, such as the fold, for one summary each.
    """
    voted = _voted(names)
    marked = patterns.withColumn("many", F.size(voted) > 1).withColumn("clash", F.size(F.array_distinct(voted)) > 1)
    rows = long_votes(marked, names, [*by, "n", "many", "clash"])
    fires = F.col("vote") != ABSTAIN

    def share(cond: Column) -> Column:
        return F.sum(F.when(cond, F.col("n")).otherwise(0)) / F.sum("n")

    return rows.groupBy(*by, "lf").agg(
        F.array_join(F.sort_array(F.collect_set(F.when(fires, F.col("vote")))).cast("array<string>"), ",").alias("polarity"),
        share(fires).alias("coverage"),
        share(fires & F.col("many")).alias("overlaps"),
        share(fires & F.col("clash")).alias("conflicts"),
    )


def label_coverage(patterns: DataFrame, names: Sequence[str]) -> DataFrame:
    """Share of rows with at least one vote."""
    return patterns.agg((F.sum(F.when(F.size(_voted(names)) > 0, F.col("n")).otherwise(0)) / F.sum("n")).alias("coverage"))


def lf_empirical_accuracy(votes: DataFrame, names: Sequence[str], label: str) -> DataFrame:
    """``(lf, n_votes, accuracy)`` against annotated rows, where the function votes."""
    counted = votes.groupBy(label, *names).agg(F.count(F.lit(1)).alias("n"))
    rows = long_votes(counted, names, [label, "n"]).filter(F.col("vote") != ABSTAIN)
    right = F.sum(F.when(F.col("vote") == F.col(label), F.col("n")).otherwise(0))
    return rows.groupBy("lf").agg(F.sum("n").alias("n_votes"), (right / F.sum("n")).alias("accuracy"))


def pick(scores: Column, tie: str, key: Column | None, tolerance: float = 0.0, seed: int = 123) -> Column:
    """Index of the largest entry of an array. A tie abstains, or draws from a hash of ``key``.

    The array is bound once, so the expression stays small when Catalyst copies
    it, as it does when it moves a filter on the label below the projection.
    """

    def tied(s: Column) -> Column:
        return let(
            F.array_max(s),
            lambda m: F.filter(F.transform(s, lambda x, i: F.when(m - x <= tolerance, i).otherwise(ABSTAIN)), lambda v: v != ABSTAIN),
        )

    if tie == "abstain":
        return let(let(scores, tied), lambda t: F.when(F.size(t) == 1, F.get(t, F.lit(0))).otherwise(ABSTAIN))
    if tie == "hash":
        return let(let(scores, tied), lambda t: F.get(t, F.pmod(hash_int(key, seed), F.size(t)).cast("int")))
    raise ValueError(f"unknown tie policy {tie}")


def majority_vote(names: Sequence[str], tie: str = "abstain", key: Column | None = None) -> Column:
    """Most frequent vote of a row, -1 without votes."""
    counts = F.array(*[sum((F.when(F.col(n) == k, 1).otherwise(0) for n in names), F.lit(0)) for k in range(CARDINALITY)])
    return let(counts, lambda c: F.when(F.array_max(c) == 0, ABSTAIN).otherwise(pick(c, tie, key))).cast("int")
