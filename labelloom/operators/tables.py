"""Dedupe, incremental selection, sentinels, and the join for hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import ABSTAIN, CARDINALITY, UNANNOTATED


def union_rows(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Union by column name.

    Spark 4.1 may treat a union as partitioned by a key if its branches are, and
    pair their partitions by number. Adaptive execution can coalesce the branches
    differently afterwards, and groups then come out twice; so this is switched off.
    """
    first.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    for other in others:
        first = first.unionByName(other)
    return first


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key by a total order.

    ``min_by`` is combined before the shuffle, so a key with a third of all
    rows sends one row per map task; a window would sort all its rows in one.
    """
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("row")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"row.`{c}`").alias(c) for c in rest]).select(*df.columns)


def dedup_first(df: DataFrame, key: str, order: str) -> DataFrame:
    return first_per_key(df, [key], [F.col(order)])


def key_counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def hot_keys(counts: DataFrame, key: str, max_hot: int = 1_000) -> DataFrame:
    """Keys that hold at least ``1/max_hot`` of the rows: there can be no more than ``max_hot`` of them."""
    total = counts.agg(F.sum("n")).scalar()
    return counts.filter((F.col("n") * max_hot >= total) & F.col(key).isNotNull()).select(key)


def join_hot_aware(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str,
    max_hot: int = 1_000,
    counts: DataFrame | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join on a key that is unique on the right and may be very unequal on the left.

    The rows of hot keys meet a broadcast of at most ``max_hot`` right rows and
    never move; no remaining key holds more than ``1/max_hot`` of the rows. The
    left side is read for the counts and for both parts: store it first if it
    is expensive. ``counts`` or ``hot`` may be given if they are known already.
    """
    if hot is None:
        hot = hot_keys(key_counts(left, key) if counts is None else counts, key, max_hot)
    hot = F.broadcast(hot)
    hot_right = F.broadcast(right.join(hot, key, "left_semi"))
    is_hot = left.join(hot, key, "left_semi").join(hot_right, key, how)
    rest = left.join(hot, key, "left_anti").join(right, key, how)
    return union_rows(is_hot, rest)


def lookup_join(left: DataFrame, right: DataFrame, key: str, how: str, max_rows: int = 100_000) -> DataFrame:
    """Join to a table that is unique by ``key`` and usually small.

    The table is counted first. Up to ``max_rows`` rows are broadcast and the
    left side stays where it is; a larger table is joined by ``join_hot_aware``.
    """
    if right.limit(max_rows + 1).count() <= max_rows:
        return left.join(F.broadcast(right), key, how)
    return join_hot_aware(left, right, key, how)


def drop_empty_text(df: DataFrame, text: str) -> DataFrame:
    return df.filter(F.col(text) != "")


def todo_antijoin(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``done`` yet. ``df`` is deduplicated, so no key is hot."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def null_to_empty(df: DataFrame) -> DataFrame:
    return df.na.fill("")


def drop_sentinels(df: DataFrame, label: str) -> DataFrame:
    return df.filter(~F.col(label).isin(ABSTAIN, UNANNOTATED))


def label_range(df: DataFrame, label: str, n_classes: int = CARDINALITY) -> DataFrame:
    return df.filter(F.col(label).between(0, n_classes - 1))
