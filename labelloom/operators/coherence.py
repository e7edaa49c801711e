"""Coherence of topics from sliding windows: normalised mutual information and the indirect cosine measure (C_V).

A window of ``size`` tokens moves over every document by one token; a document that is shorter is one window. Windows
are never built: the windows that hold a term start in stretches around its positions, and the length of their union
is a running sum over the sorted positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import unnest_with_position
from ..session import stored
from .tables import lookup_join

# Fixed value of the measure: added to a joint probability so that its logarithm exists.
EPSILON = 1e-12


def windows_with(positions: Column, n: Column, size: int) -> Column:
    """How many windows over ``n`` tokens hold at least one of the sorted positions (from 0)."""
    last = F.greatest(n - size, F.lit(0)).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("covered"), F.lit(-1).cast("long").alias("end"))

    def step(acc: Column, p: Column) -> Column:
        begin = F.greatest(p.cast("long") - size + 1, acc.end + 1)
        end = F.least(p.cast("long"), last)
        return F.struct((acc.covered + F.greatest(end - begin + 1, F.lit(0))).alias("covered"), F.greatest(end, acc.end).alias("end"))

    return F.aggregate(positions, start, step, lambda acc: acc.covered)


def window_counts(topics: DataFrame, docs: DataFrame, id_col: str, tokens: str, size: int = 110) -> DataFrame:
    """``topic, t1, t2, n12, n1, n2, n``: windows that hold both terms, each, and all windows; also for ``t1 = t2``.

    ``topics`` has ``topic, term``; pairs are formed among the terms of one topic that a document holds. Documents
    without tokens have no window. Terms that no document holds are left out.
    """
    listed = stored(topics.select("topic", "term").distinct(), "coherence_terms")
    by_term = listed.groupBy("term").agg(F.collect_set("topic").alias("topics"))
    length = docs.select(id_col, F.size(tokens).alias("len"), F.col(tokens).alias("toks")).filter("len > 0")
    total = length.agg(F.sum(F.greatest(F.col("len") - size + 1, F.lit(1)))).first()[0] or 0
    placed = unnest_with_position(length, [id_col, "len"], F.col("toks"), "pos", "term")
    found = lookup_join(placed, by_term, "term", "inner")
    spots = found.groupBy(id_col, "len", "term", "topics").agg(F.sort_array(F.collect_list("pos")).alias("spots"))
    # one row per document and topic: at most as many terms as the topic has
    held = spots.select(id_col, "len", F.explode("topics").alias("topic"), F.struct("term", "spots").alias("t"))
    held = held.groupBy(id_col, "len", "topic").agg(F.collect_list("t").alias("ts"))
    pairs = F.flatten(F.transform("ts", lambda a: F.transform(F.filter("ts", lambda b: b.term >= a.term), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    rows = held.select("topic", "len", F.explode(pairs).alias("p"))
    one = lambda c: windows_with(c, F.col("len"), size)
    either = one(F.sort_array(F.concat("p.a.spots", "p.b.spots")))
    both = one(F.col("p.a.spots")) + one(F.col("p.b.spots")) - either
    counted = rows.select("topic", F.col("p.a.term").alias("t1"), F.col("p.b.term").alias("t2"), both.alias("w")).groupBy("topic", "t1", "t2").agg(F.sum("w").alias("n12"))
    counted = stored(counted, "coherence_windows")
    single = counted.filter("t1 = t2").select("topic", F.col("t1").alias("term"), F.col("n12").alias("n"))
    # pairs that never meet are as much part of a topic as the others
    known = single.select("topic", F.col("term").alias("t1"), F.col("n").alias("n1"))
    grid = known.join(single.select("topic", F.col("term").alias("t2"), F.col("n").alias("n2")), "topic").filter("t1 <= t2")
    return grid.join(counted, ["topic", "t1", "t2"], "left").select("topic", "t1", "t2", F.coalesce("n12", F.lit(0)).cast("long").alias("n12"), "n1", "n2", F.lit(int(total)).alias("n"))


def npmi(n12: Column, n1: Column, n2: Column, n: Column) -> Column:
    joint = n12 / n + EPSILON
    return F.log(joint / ((n1 / n) * (n2 / n))) / -F.log(joint)


def coherence_windows(topics: DataFrame, docs: DataFrame, id_col: str, tokens: str, size: int = 110) -> DataFrame:
    """``topic, n_terms, npmi, c_v``: mean over the pairs of a topic, and the mean cosine of terms with their topic.

    The vector of a term holds its normalised mutual information with every term of the topic, itself included; the
    vector of the topic is their sum. A topic of one term has no pair and a null ``npmi``.
    """
    pairs = stored(window_counts(topics, docs, id_col, tokens, size).select("topic", "t1", "t2", npmi(F.col("n12"), F.col("n1"), F.col("n2"), F.col("n")).alias("m")), "coherence_pairs")
    mean = pairs.groupBy("topic").agg(F.count_if(F.col("t1") == F.col("t2")).alias("n_terms"), F.avg(F.when(F.col("t1") < F.col("t2"), F.col("m"))).alias("npmi"))
    cells = pairs.select("topic", F.col("t1").alias("term"), F.col("t2").alias("at"), "m").unionAll(pairs.filter("t1 < t2").select("topic", F.col("t2").alias("term"), F.col("t1").alias("at"), "m"))
    whole = cells.groupBy("topic", "at").agg(F.sum("m").alias("s"))
    dots = cells.join(whole, ["topic", "at"]).groupBy("topic", "term").agg(F.sum(F.col("m") * F.col("s")).alias("dot"), F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("own"), F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("all"))
    length = F.col("own") * F.col("all")
    c_v = dots.groupBy("topic").agg(F.avg(F.when(length > 0, F.col("dot") / length).otherwise(0.0)).alias("c_v"))
    return mean.join(c_v, "topic").select("topic", "n_terms", "npmi", "c_v")
