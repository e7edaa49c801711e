"""Topic terms per document, corpus topics, class documents and coherence."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import remove_stopwords, term_counts, tokenize, top_terms, unnest
from .coherence import window_counts

# A window that no document fills.
ENDLESS = 1 << 30


def topic_terms_doc(text: Column, lang: Column, topics: int = 2, per_topic: int = 7) -> Column:
    """Topic terms of one document as ``array<string>``.

    With every word a document of its own, a topic's mass on a term grows with
    the term's count. Hence the strongest terms of all topics are the most
    frequent terms: ``topics * per_topic`` of them, longer than three characters.
    """
    return top_terms(remove_stopwords(tokenize(text), lang), topics * per_topic)


def class_text_concat(
    df: DataFrame, class_col: str, text: str, ord_col: str, rows_per_part: int | None = 1_000, max_chars: int = 64_000_000
) -> DataFrame:
    """``(class, part, text)``: texts of a class joined by a pipe in the order of the integer ``ord_col``.

    Part p joins the rows whose ``ord_col`` lies in [p * rows_per_part, (p+1) * rows_per_part);
    the parts in order are the class document, and no task holds a whole class.
    ``rows_per_part=None`` gives one row per class, for the few seed pages; the
    size of the largest class is checked first.
    """
    if rows_per_part is None:
        largest = df.groupBy(class_col).agg(F.sum(F.length(text) + 1).alias("n")).agg(F.max("n")).first()[0]
        if (largest or 0) > max_chars:
            raise ValueError(f"a class has more than {max_chars} characters; use rows_per_part")
    part = F.lit(0).cast("bigint") if rows_per_part is None else F.floor(F.col(ord_col) / rows_per_part)
    grouped = df.groupBy(F.col(class_col), part.alias("part")).agg(
        F.sort_array(F.collect_list(F.struct(F.col(ord_col).alias("o"), F.col(text).alias("t")))).alias("rows")
    )
    return grouped.select(class_col, "part", F.array_join(F.transform("rows", lambda r: r.t), "|").alias("text"))


def class_terms(df: DataFrame, classes: Column, tokens: str, out: str, counts: str | None = None, n_classes: int | None = None) -> DataFrame:
    """``(out, term, tf)``: term counts of the class documents, without building their texts.

    ``classes`` is the array of classes a row belongs to. A row counts its terms
    once for all of them, and the counts combine before the shuffle. ``counts`` names a column
    with the row's ``term_counts``. With ``n_classes``, classes are 0 to ``n_classes - 1``, each
    at most once in a row: a counted term is then one row with a sum for every class.
    """
    counted = term_counts(F.col(tokens)) if counts is None else F.col(counts)
    term, n = F.col("e.term").alias("term"), F.col("e.n").alias("n")
    if n_classes is None:
        needed = [tokens] if counts is None else [counts]
        rows = unnest(unnest(df.select(classes.alias("cs"), *needed), ["cs"], counted, "e"), [term, n], F.col("cs"), out)
        return rows.groupBy(out, "term").agg(F.sum("n").alias("tf"))
    marks = [f"in_{c}" for c in range(n_classes)]
    flags = [F.array_contains(classes, F.lit(c)).alias(m) for c, m in enumerate(marks)]
    rows = unnest(df, flags, counted, "e").select(*marks, term, n)
    sums = rows.groupBy("term").agg(F.array(*[F.sum(F.when(F.col(m), F.col("n"))) for m in marks]).alias("tfs"))
    return sums.select(F.posexplode("tfs").alias(out, "tf"), "term").filter("tf IS NOT NULL").select(out, "term", "tf")


def class_topic_terms(
    df: DataFrame, classes: Column, tokens: str, out: str, k: int = 14, min_length: int = 4, counts: str | None = None, n_classes: int | None = None
) -> DataFrame:
    """Topic terms of every class document: ``(out, rank, term)``, at most ``k`` rows per class; see ``class_terms``."""
    w = Window.partitionBy(out).orderBy(F.desc("tf"), "term")
    ranked = class_terms(df, classes, tokens, out, counts, n_classes).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.filter(F.length("term") >= min_length).select(out, "rank", "term")


def _pair_counts(topic_terms: DataFrame, df: DataFrame, terms: str) -> DataFrame:
    """``(topic, r1, r2, d1, d2, d12, n)`` for the term pairs of every topic, ``r1 < r2``: documents with each and both.

    A document is one window of any length. It looks up its own terms, so lists of any length work, and no pair of
    documents or of other terms is formed.
    """
    rows = df.select(F.monotonically_increasing_id().alias("id"), F.array_distinct(terms).alias("terms"))
    counted = window_counts(topic_terms, rows, "id", "terms", ENDLESS)
    single = counted.filter("t1 = t2").select("topic", F.col("t1").alias("t"), F.col("n12").alias("d"))
    one = topic_terms.select("topic", F.col("rank").alias("r1"), F.col("term").alias("a"))
    two = topic_terms.select("topic", F.col("rank").alias("r2"), F.col("term").alias("b"))
    pairs = one.join(two, "topic").filter("r1 < r2").withColumns({"t1": F.least("a", "b"), "t2": F.greatest("a", "b")})
    n = df.agg(F.count(F.lit(1))).scalar()
    zero = F.lit(0).cast("bigint")
    return (
        pairs.join(counted.select("topic", "t1", "t2", F.col("n12").alias("d12")), ["topic", "t1", "t2"], "left")
        .join(single.select("topic", F.col("t").alias("a"), F.col("d").alias("d1")), ["topic", "a"], "left")
        .join(single.select("topic", F.col("t").alias("b"), F.col("d").alias("d2")), ["topic", "b"], "left")
        .select("topic", "r1", "r2", *[F.coalesce(c, zero).alias(c) for c in ("d1", "d2", "d12")], n.alias("n"))
    )


def coherence_umass(topic_terms: DataFrame, df: DataFrame, terms: str) -> DataFrame:
    """Mean of ``ln((d12 + 1) / d1)`` over the pairs of a topic; ``d1`` belongs to the higher-ranked term."""
    pairs = _pair_counts(topic_terms, df, terms)
    return pairs.groupBy("topic").agg(F.avg(F.log((F.col("d12") + 1) / F.col("d1"))).alias("umass"))


def coherence_npmi(topic_terms: DataFrame, df: DataFrame, terms: str) -> DataFrame:
    """Mean normalised pointwise mutual information; a pair that never meets scores -1, one that is everywhere 1."""
    p12, p1, p2 = (F.col(c) / F.col("n") for c in ("d12", "d1", "d2"))
    score = (
        F.when(F.col("d12") == 0, -1.0)
        .when(F.col("d12") == F.col("n"), 1.0)
        .otherwise(F.log(p12 / (p1 * p2)) / -F.log(p12))
    )
    return _pair_counts(topic_terms, df, terms).groupBy("topic").agg(F.avg(score).alias("npmi"))


def coherence_pairwise(df: DataFrame, topic: str, vector: str) -> DataFrame:
    """``(topic, n_terms, coherence)``: mean cosine over all pairs of a topic's term vectors.

    For unit vectors the cosines of all pairs add up to ``(|sum|^2 - n) / 2``,
    so one vector sum per topic replaces the pairs.
    """
    doubles = F.transform(vector, lambda x: x.cast("double"))
    units = df.select(topic, doubles.alias("v")).select(
        topic, "v", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("len")
    )
    unit = array_to_vector(F.transform("v", lambda x: x / F.col("len")))
    sums = units.filter("len > 0").select(topic, unit.alias("u")).groupBy(topic).agg(
        F.count(F.lit(1)).alias("n_terms"), vector_to_array(Summarizer.sum(F.col("u"))).alias("s")
    )
    square = F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x)
    n = F.col("n_terms")
    return sums.filter(n > 1).select(topic, "n_terms", ((square - n) / (n * (n - 1))).alias("coherence"))
