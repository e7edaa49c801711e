"""Splits, folds, class weights and samples. Order comes from a hash that any engine can replay."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import hash_int, hash_order
from ..schemas import UNANNOTATED
from ..session import stored
from .tables import join_hot_aware, lookup_join, union_rows


def hash_at_rank(df: DataFrame, hashed: str, rank: int, digits: int = 4) -> str:
    """The hex hash at a zero-based rank of the sorted order, without sorting.

    Each round counts the rows per next ``digits`` hex digits (at most 16**digits
    groups) and keeps the group that holds the rank, until the hash is known.
    """
    prefix = ""
    while len(prefix) < 32:
        rows = df.filter(F.col(hashed).startswith(prefix)) if prefix else df
        digit = F.substring(hashed, len(prefix) + 1, digits).alias("d")
        groups = rows.groupBy(digit).count().orderBy("d").limit(16**digits).collect()
        for g in groups:
            if rank < g["count"]:
                prefix += g["d"]
                break
            rank -= g["count"]
        else:
            raise ValueError("rank beyond the last row")
        if g["count"] == 1:
            return df.filter(F.col(hashed).startswith(prefix)).first()[hashed]
    return prefix


def split_60_20_20(df: DataFrame, key: str, seed: int = 42, shares=(0.6, 0.8)) -> DataFrame:
    """Add ``split``: exactly the first 60 %, the next 20 % and the rest of the hash order."""
    hashed = df.withColumn("_h", hash_order(F.col(key), seed))
    n = df.count()
    cuts = [hash_at_rank(hashed.select("_h"), "_h", math.floor(s * n)) if math.floor(s * n) < n else "g" for s in shares]
    return hashed.withColumn(
        "split", F.when(F.col("_h") < cuts[0], "train").when(F.col("_h") < cuts[1], "validate").otherwise("test")
    ).drop("_h")


def split_by_threshold(df: DataFrame, key: str, seed: int = 42, shares=(0.6, 0.8)) -> DataFrame:
    """The same shares in expectation, in one projection; for streams and very large corpora."""
    u = hash_int(F.col(key), seed) / float(1 << 32)
    return df.withColumn("split", F.when(u < shares[0], "train").when(u < shares[1], "validate").otherwise("test"))


def annotation_sheet(split: DataFrame) -> DataFrame:
    """Validation and test rows for manual annotation, labelled as not annotated yet."""
    return split.filter(F.col("split") != "train").withColumn("LABEL", F.lit(UNANNOTATED))


def train_test_union(train: DataFrame, test: DataFrame, label: str = "LABEL") -> DataFrame:
    """Training rows without labels and the annotated test rows."""
    return union_rows(train.withColumn(label, F.lit(UNANNOTATED)), test)


def kfold(df: DataFrame, key: str, ks=range(2, 10), seed: int = 12) -> DataFrame:
    """``(key, k, fold)`` for every number of folds; a row knows its fold without any shuffle."""
    h = hash_int(F.col(key), seed)
    folds = F.array(*[F.struct(F.lit(k).alias("k"), F.pmod(h, F.lit(k)).cast("int").alias("fold")) for k in ks])
    return df.select(key, F.inline(folds))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Add ``weight = total / class count``."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    weights = counts.select(label, (total / F.col("_n")).alias("weight"))
    return lookup_join(df, weights, label, "inner")


def balanced_sample(df: DataFrame, key: str, label: str, seed: int = 42) -> DataFrame:
    """About as many rows as there are, drawn with repetition so that every class is equally frequent.

    A row is wanted ``rate = weight * n / sum(weights)`` times. It gets the whole
    part of its rate, and one copy more with the probability of the rest, from
    its own hash: nothing is sorted or collected, and no rate is cut off.
    """
    weighted = class_weights(df, label)
    scale = weighted.agg((F.count(F.lit(1)) / F.sum("weight")).alias("scale")).scalar()
    u = hash_int(F.col(key), seed) / float(1 << 32)
    copies = F.floor(F.col("weight") * scale + 1 - u).cast("int")
    drawn = weighted.withColumn("_k", copies).filter(F.col("_k") > 0)
    return drawn.withColumn("copy", F.explode_outer(F.sequence(F.lit(1), F.col("_k")))).drop("_k")


def _hash52(key: Column, seed: str) -> Column:
    return F.conv(F.substring(hash_order(key, seed), 1, 13), 16, 10).cast("bigint")


def numbered_rows(df: DataFrame, key: str, group: str, seed: int = 42, rows_per_range: int = 1_000_000) -> DataFrame:
    """Add ``pos``: the place of a row in its group from 0, by the hash of its key and then the key.

    Rows are numbered in ranges of the hash, each by its own task, and a range starts where the sizes of the ranges
    before end; so a group of any size is spread.
    """
    rows = stored(df.withColumn("_h", _hash52(F.col(key), f"{seed}:order")), "numbered")
    ranges = max(1, -(-rows.count() // rows_per_range))
    parted = rows.withColumn("_range", F.floor(F.col("_h") / F.lit((1 << 52) / ranges)).cast("int"))
    sizes = parted.groupBy(F.col(group).alias("_g"), F.col("_range").alias("_r")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_g").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_g", "_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    ranked = parted.withColumn("_i", F.row_number().over(Window.partitionBy(group, "_range").orderBy("_h", key)) - 1)
    at = F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r"))
    return ranked.join(offsets, at).withColumn("pos", (F.col("_offset") + F.col("_i")).cast("bigint")).drop("_h", "_range", "_g", "_r", "_n", "_offset", "_i")


def weighted_draw(df: DataFrame, key: str, label: str, n: int | None = None, seed: int = 42) -> DataFrame:
    """``draw`` and the columns of ``df``: exactly ``n`` rows (all as many as there are) drawn with replacement.

    A row's chance is the inverse share of its class, so a draw is a class, each equally likely, and a row of it, each
    equally likely; both come from hashes of the draw's number. Rows without a label are never drawn. Draws stay rows
    of their own: the copies of one row, if its class is small, are spread and meet a broadcast of that row.
    """
    spark = df.sparkSession
    rows = df.filter(F.col(label).isNotNull())
    numbered = stored(numbered_rows(rows, key, label, seed), "numbered")
    classes = [(r[label], r["n"]) for r in numbered.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(label).collect()]
    total = sum(c for _, c in classes) if n is None else n
    if not classes:
        return rows.select(F.lit(0).cast("bigint").alias("draw"), "*").limit(0)
    names, sizes = F.array(*[F.lit(c) for c, _ in classes]), F.array(*[F.lit(c).cast("bigint") for _, c in classes])
    unit = float(1 << 52)
    at = F.floor(_hash52(F.col("draw"), f"{seed}:class") / unit * len(classes)).cast("int")
    drawn = spark.range(total).select(F.col("id").alias("draw")).withColumn("_at", at)
    drawn = drawn.select(
        "draw",
        F.struct(
            F.get(names, F.col("_at")).alias("c"),
            F.floor(_hash52(F.col("draw"), f"{seed}:row") / unit * F.get(sizes, F.col("_at"))).cast("bigint").alias("p"),
        ).alias("_spot"),
    )
    spots = numbered.withColumn("_spot", F.struct(F.col(label).alias("c"), F.col("pos").alias("p"))).drop("pos")
    return join_hot_aware(drawn, spots, "_spot", "inner").select("draw", *df.columns)


def head_limit(df: DataFrame, key: str, n: int = 1_000) -> DataFrame:
    return df.orderBy(key).limit(n)
