"""Helpers that several operators share: words, scoped values, numbering without a global sort, table input."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# Fixed values of the contract: a word is a run of anything but the six ASCII white-space characters.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

# Rows that one task numbers in a sort; the number of ranges follows the input.
ROWS_PER_RANGE = 50_000


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text; null gives none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def word_count(text: Column) -> Column:
    """Number of words without building them."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def unit_draw(*parts: Column) -> Column:
    """A number in (0, 1) from the MD5 of the parts, the same in Spark and in SQL; null counts as empty."""
    return (draw52(*parts) + F.lit(0.5)) / F.lit(float(1 << 52))


def draw52(*parts: Column) -> Column:
    """The first 52 bits of the MD5 of the parts joined by '/'."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("/", *texts)), 1, 13), 16, 10).cast("long")


def draw52_sql(*parts: str) -> str:
    joined = " || '/' || ".join(f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts)
    return f"CAST(('0x' || substr(md5({joined}), 1, 13)) AS BIGINT)"


def numbered(df: DataFrame, group: Sequence[str], draw: str, order: Sequence[str], count: str, out: str) -> DataFrame:
    """Add ``out``: how many rows of the same group come before, in the order of ``draw`` and then ``order``.

    ``draw`` is a 52-bit hash and ``count`` the number of equal rows that a row stands for. A group of any
    size is numbered in ranges of the draw: each range is sorted by its own task, and the numbers of rows in
    the ranges before come from a table of range sizes. So no task holds a group. ``df`` is read three times: store
    it before if it is dear.
    """
    rows = df.count()
    ranges = max(1, -(-rows // ROWS_PER_RANGE))
    part = F.floor(F.col(draw) / F.lit((1 << 52) / ranges)).cast("int")
    parted = df.withColumn("__range", part)
    keys = [*group, "__range"]
    named = [f"__key{i}" for i in range(len(keys))]
    sizes = parted.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, named)]).agg(F.sum(count).alias("__n"))
    before = Window.partitionBy(*named[:-1]).orderBy(named[-1]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*named, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inner = Window.partitionBy(*keys).orderBy(draw, *order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = parted.withColumn("__rank", F.coalesce(F.sum(count).over(inner), F.lit(0)))
    joined = ranked.join(offsets, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, named)])
    return joined.withColumn(out, (F.col("__offset") + F.col("__rank")).cast("long")).drop("__range", "__rank", "__offset", *named)


def checked_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast if the table has at most ``rows`` rows; a larger one is joined as Catalyst sees fit."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
