"""Mixing sources to target weights by fitting a word budget.

Of every source whole copies are taken first. What is left of its budget is spent by length: documents are counted
by exact number of words, every length gives the same share, and the longest lengths fill up or the shortest give
back until about ``KNAPSACK_WORDS`` are open. A bounded-knapsack dynamic program over the counts spends these as well
as any choice can; a smaller budget is spent by it alone. Which documents of a length are taken follows from a hash
of their keys.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stored
from .common import checked_broadcast, draw52, numbered, word_count

# Fixed values of the contract: weights of the sources in code-point order, repeating; the share of all words that
# the mix has; how often a source may be repeated at most.
WEIGHTS, TOTAL, REPEATS = (5.0, 2.0, 1.0), 1.5, 2.0

# Words of a budget that the dynamic program covers; the counts by length fill what is above.
KNAPSACK_WORDS = 50_000
BROADCAST_ROWS = 1_000_000


def subset_sum(lengths: Sequence[int], counts: Sequence[int], budget: int) -> list[int]:
    """How many of each length to take, at most its count, so that the sum is as large as it can be without passing the budget.

    Bounded knapsack on a bit set: bit ``s`` says that a sum ``s`` can be reached. Counts are split into powers of
    two, every part notes the sums that it reaches first, and the choice is read back from those notes.
    """
    reached, mask, notes = 1, (1 << (budget + 1)) - 1, []
    for i, (length, count) in enumerate(zip(lengths, counts)):
        left, size = min(count, budget // length if length else 0), 1
        while left > 0 and not reached >> budget & 1:
            part = min(size, left)
            new = (reached << part * length) & mask & ~reached
            if new:
                notes.append((i, part, new))
                reached |= new
            left, size = left - part, size * 2
    taken, s = [0] * len(lengths), reached.bit_length() - 1
    for i, part, new in reversed(notes):
        if new >> s & 1:
            taken[i] += part
            s -= part * lengths[i]
    return taken


def spend(lengths: Sequence[int], counts: Sequence[int], budget: int, knapsack_words: int = KNAPSACK_WORDS) -> tuple[int, list[int]]:
    """``(whole copies, documents of each length on top)`` for a budget in words; lengths are distinct and positive."""
    size = sum(n * c for n, c in zip(lengths, counts))
    if size == 0 or budget <= 0:
        return 0, [0] * len(lengths)
    copies, rest = divmod(budget, size)
    extra = [c * rest // size for c in counts]
    left = rest - sum(n * k for n, k in zip(lengths, extra))
    order = sorted(range(len(lengths)), key=lambda i: lengths[i])
    for i in reversed(order):  # never past the window: the program needs room
        more = min(counts[i] - extra[i], max(0, left - knapsack_words) // lengths[i])
        extra[i] += more
        left -= more * lengths[i]
    for i in order:
        back = min(extra[i], max(0, knapsack_words - left) // lengths[i])
        extra[i] -= back
        left += back * lengths[i]
    if left > 0:
        more = subset_sum([lengths[i] for i in order], [counts[i] - extra[i] for i in order], left)
        for i, m in zip(order, more):
            extra[i] += m
    return copies, extra


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, total: float = TOTAL, repeats: float = REPEATS) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``: one row per source.

    Sources in code-point order, null last, have the weights in turn. A target above ``repeats`` times its size is
    cut, and the excess goes to the others by weight until none is above. With sources ordered by size per weight
    the cut ones come first, so one pass over the sorted sources finds the level; the table has a row per source.
    """
    names = Window.orderBy(F.col("source").asc_nulls_last())
    at = F.pmod(F.row_number().over(names) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), at + 1)
    s = sizes.select("source", "source_size", weight.alias("w"), (F.col("source_size") * F.lit(repeats)).alias("cap"))
    by_level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    s = s.withColumn("left", F.lit(total) * F.sum("source_size").over(Window.partitionBy(F.lit(0))) - F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("active", F.sum("w").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
    fits = F.col("left") * F.col("w") / F.col("active") <= F.col("cap")
    # the first source that fits sets the level for itself and all after it
    rank = F.row_number().over(by_level)
    level = s.withColumn("__at", F.when(fits, F.struct(rank, "left", "active")))
    level = level.withColumn("__level", F.min("__at").over(Window.partitionBy(F.lit(0))))
    share = F.col("__level.left") * F.col("w") / F.col("__level.active")
    return level.select("source", "source_size", F.coalesce(F.least(share, F.col("cap")), F.col("cap")).alias("target"))


def _sized(df: DataFrame, key: str, text: str, source: str) -> list[Column]:
    body = F.col(text).cast("string")
    checksum = F.crc32(F.coalesce(body, F.lit("")).cast("binary"))
    return [
        F.col(key).alias("__key"),
        F.col(source).cast("string").alias("source"),
        word_count(body).alias("size"),
        draw52(F.col(key), checksum).alias("__draw"),
    ]


def plan(sized: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """``(sources, limits)`` of a table with source, size and draw.

    ``sources``: ``source, source_size, target, copies``. ``limits``: ``source, size, limit, need, tied`` for the
    lengths of which one copy more is taken: of all documents whose draw is below ``limit``, and of ``need`` of the
    ``tied`` ones that have this draw.
    """
    histogram = stored(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "mix_lengths")
    sizes = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = targets(sizes, **options)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size").reset_index(drop=True)
        with_words = rows["size"] > 0
        some = rows[with_words]
        budget = int(rows["target"].iloc[0] + 0.5)
        copies, extra = spend([int(x) for x in some["size"]], [int(x) for x in some["n"]], budget)
        out = rows[["source", "size", "n", "source_size", "target"]].assign(copies=copies, extra=0)
        out.loc[with_words, "extra"] = extra
        return out

    # one group per source holds its distinct lengths, not its documents
    schema = "source string, size long, n long, source_size long, target double, copies long, extra long"
    goals = goals.withColumnRenamed("source", "__goal")
    joined = histogram.join(goals, F.col("source").eqNullSafe(F.col("__goal"))).drop("__goal")
    fitted = stored(joined.groupBy("source").applyInPandas(fit, schema), "mix_plan")
    partial = fitted.filter("extra > 0 AND extra < n").select(F.col("source").alias("__source"), F.col("size").alias("__size"), "extra")
    at = F.col("source").eqNullSafe(F.col("__source")) & (F.col("size") == F.col("__size"))
    chosen = sized.select("source", "size", "__draw").join(checked_broadcast(partial, BROADCAST_ROWS), at).drop("__source", "__size")
    # rows with one draw, copies of a row for one, are a single row with their number
    drawn = stored(chosen.groupBy("source", "size", "extra", "__draw").agg(F.count("*").alias("__tied")), "mix_draws")
    ranked = numbered(drawn, ["source", "size"], "__draw", [], "__tied", "__before")
    cut = ranked.filter("__before < extra AND extra <= __before + __tied").select("source", "size", F.col("__draw").alias("limit"), (F.col("extra") - F.col("__before")).alias("need"), F.col("__tied").alias("tied"))
    none = F.lit(0).cast("long")
    whole = fitted.filter("extra > 0 AND extra = n").select("source", "size", F.lit(1 << 52).cast("long").alias("limit"), none.alias("need"), none.alias("tied"))
    sources = fitted.select("source", "source_size", "target", "copies").distinct()
    return stored(sources, "mix_sources"), stored(cut.unionByName(whole), "mix_limits")


def _decided(rows: DataFrame, sources: DataFrame, limits: DataFrame) -> DataFrame:
    """Rows with ``source, size, __draw`` and the plan: ``__copies``, ``source_size`` and ``target`` of each.

    Where the limit falls among rows with one draw, they are numbered and only as many as needed are taken.
    """
    s = sources.select(F.col("source").alias("__s1"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("copies").alias("__base"))
    m = limits.select(F.col("source").alias("__s2"), F.col("size").alias("__size2"), F.col("limit").alias("__limit"), F.col("need").alias("__need"), (F.col("need") < F.col("tied")).alias("__split"))
    out = rows.join(checked_broadcast(s, BROADCAST_ROWS), F.col("__source").eqNullSafe(F.col("__s1")), "left")
    out = out.join(checked_broadcast(m, BROADCAST_ROWS), F.col("__source").eqNullSafe(F.col("__s2")) & (F.col("__size") == F.col("__size2")), "left")
    out = out.drop("__s1", "__s2", "__size2")
    among = F.coalesce(F.col("__split") & (F.col("__draw") == F.col("__limit")), F.lit(False))
    parts = [out.withColumn("__more", F.col("__draw") <= F.col("__limit"))]
    if not limits.filter("need < tied").isEmpty():
        tied = stored(out.filter(among).withColumn("__id", F.monotonically_increasing_id()), "mix_tied")
        tied = stored(tied.withColumns({"__sub": draw52(F.lit("tie"), F.col("__id")), "__one": F.lit(1)}), "mix_tied")
        numbers = numbered(tied, ["__source", "__size"], "__sub", ["__id"], "__one", "__before")
        taken = numbers.withColumn("__more", F.col("__before") < F.col("__need")).drop("__id", "__sub", "__one", "__before")
        parts = [parts[0].filter(~among), taken]
    done = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    copies = F.col("__base") + F.coalesce(F.col("__more").cast("long"), F.lit(0))
    return done.withColumn("__copies", F.when(F.col("__size") > 0, copies).otherwise(0)).drop("__limit", "__base", "__need", "__split", "__more")


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """``key, size, source_size, target, taken`` of every row; ``taken`` counts words of all copies that the mix takes.

    Null texts and texts without words have size 0 and are never taken. Null is a source, the last. Of rows with
    equal key and text as many are taken as the source still needs, whichever these are. An empty table gives no rows; other columns are not
    read. The result depends on the rows alone, not on their order or partitions.
    """
    sized = stored(df.select(*_sized(df, key, text, source)), "mix_sizes")
    sources, limits = plan(sized, **options)
    rows = sized.withColumnRenamed("source", "__source").withColumnRenamed("size", "__size")
    done = _decided(rows, sources, limits)
    return done.select(
        F.col("__key").alias(key),
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__size") * F.col("__copies")).alias("taken"),
    )


def mixed(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: every row as often as the mix takes it, with all its columns."""
    sized = stored(df.select(*_sized(df, key, text, source)), "mix_sizes")
    sources, limits = plan(sized, **options)
    columns = df.columns
    names = {"source": "__source", "size": "__size", "__draw": "__draw"}
    added = [c.alias(names[n]) for c, n in zip(_sized(df, key, text, source)[1:], names)]
    done = _decided(df.select(F.struct("*").alias("__row"), *added), sources, limits)
    copies = done.filter("__copies > 0").select("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))).alias("__copy"))
    return copies.select(*[F.col("__row").getField(c).alias(c) for c in columns])
