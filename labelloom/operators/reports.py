"""Evaluation reports: best runs, renamed values, run times and pipeline logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schemas import CLASSES
from ..session import stored
from .tables import first_per_key

# Titles of the search codes.
SEARCH_TITLES = {"BayesSearch": "Bayesian Optimization", "RandomSearch": "Random Search", "GridSearch": "Grid Search"}
LOG_LINE = r"^(?:[A-Z]+:[A-Za-z]+:)?\[([0-9\-]+ [0-9:]+(?:[.,][0-9]+)?)\]([A-Z]+)\|([^|]*)\|(.*)$"


def _falling(score: str) -> list[Column]:
    """Order from the highest score down, null last."""
    return [F.col(score).isNull(), -F.col(score)]


def best_per_search(results: DataFrame, kind: str, scores: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """Best row per search type, by the scores in order; a row without a score comes after all that have one."""
    return first_per_key(results, [kind], [c for s in scores for c in _falling(s)] + [F.col(t) for t in tie])


def best_per_fold(results: DataFrame, k: str, trial: str, score: str, tie: Sequence[str]) -> DataFrame:
    """Best row per number of folds, the first trial first."""
    return first_per_key(results, [k], [F.col(trial), *_falling(score)] + [F.col(t) for t in tie])


def coverage_best(coverage: DataFrame, tie: Sequence[str] = ()) -> DataFrame:
    """One row per labelling function from the newest trial, and its display name."""
    order = [-F.col("TRIAL"), -F.col("k_fold"), -F.col("k_fold_split"), F.col("Overlaps"), F.col("Conflicts"), *_falling("Coverage")]
    best = first_per_key(coverage, ["LF"], order + [F.col(t) for t in tie])
    name = F.concat_ws("_", rename_classes(F.col("Polarity")), F.split_part(F.col("LF"), F.lit("_"), F.lit(1)))
    return best.withColumn("name", name)


def rename_values(column: Column, names: dict) -> Column:
    """Replace known values, keep the others."""
    pairs = F.create_map(*[F.lit(x) for item in names.items() for x in item])
    return F.coalesce(F.try_element_at(pairs, column), column)


def rename_classes(label: Column, names: Sequence[str] = CLASSES) -> Column:
    """Class id to class name."""
    return F.when((label >= 0) & (label < len(names)), F.get(F.array(*[F.lit(n) for n in names]), label.cast("int")))


def runtime_seconds(start: Column, end: Column) -> Column:
    """Whole seconds between two timestamps, days included."""
    return F.unix_timestamp(end) - F.unix_timestamp(start)


def runtime_summary(df: DataFrame, group: str, seconds: str, shares=(0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """Box-plot numbers ``n, p0, p25, ...`` of whole seconds per group, with linear interpolation.

    The seconds are first counted by value, which combines before the shuffle
    and is bounded by the longest run, not by the rows of a group.
    """
    histogram = df.groupBy(group, F.col(seconds).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(group).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = histogram.withColumn("cum", F.sum("n").over(upto))
    sizes = histogram.groupBy(group).agg(F.sum("n").alias("total"))
    joined = ranked.join(sizes, group)

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("cum") > rank, F.col("v")))

    out = [F.first("total").alias("n")]
    for s in shares:
        pos = F.lit(s) * (F.col("total") - 1)
        low, high = at(F.floor(pos)), at(F.ceil(pos))
        part = F.lit(s) * (F.first("total") - 1)
        out.append((low + (high - low) * (part - F.floor(part))).alias(f"p{int(s * 100)}"))
    return joined.groupBy(group).agg(*out)


def parse_log(lines: DataFrame, line: str = "value") -> DataFrame:
    """``(ts, level, logger, message)`` of the lines in the pipeline's log format; other lines are dropped."""
    part = [F.regexp_extract(line, LOG_LINE, i) for i in range(1, 5)]
    ts = F.to_timestamp(F.replace(part[0], F.lit(","), F.lit(".")))
    return lines.filter(F.col(line).rlike(LOG_LINE)).select(
        ts.alias("ts"), part[1].alias("level"), part[2].alias("logger"), part[3].alias("message")
    )


def log_events(events: DataFrame, rows_per_range: int = 1_000_000) -> DataFrame:
    """Add the seconds since the previous event of the same logger, as a carry scan.

    One logger may write most lines, and most of them within an hour. Events are therefore dealt by ranges of (logger,
    time), each of about ``rows_per_range`` rows whatever the loggers; the lag runs inside a range, and the first event
    of a logger in a range takes the last one before it from a table with one row per range and logger.
    """
    given = stored(events.select("ts", "level", "logger", "message").withColumn("id", F.monotonically_increasing_id()), "log_lines")
    ranges = max(1, -(-given.count() // rows_per_range))
    # the id parts equal lines, so that no value makes a range of its own
    dealt = given.repartitionByRange(ranges, "logger", "ts", "message", "id").withColumn("part", F.spark_partition_id())
    dealt = stored(dealt, "log_ranges")
    lagged = dealt.withColumn("prev", F.lag("ts").over(Window.partitionBy("part", "logger").orderBy("ts", "message", "id")))
    last = dealt.groupBy("part", "logger").agg(F.max("ts").alias("last"))
    carry = last.select("part", "logger", F.lag("last").over(Window.partitionBy("logger").orderBy("part")).alias("before"))
    joined = lagged.join(carry, ["part", "logger"])
    micros = F.unix_micros("ts") - F.unix_micros(F.coalesce("prev", "before"))
    return joined.select("ts", "level", "logger", "message", (micros / 1e6).alias("seconds"))
