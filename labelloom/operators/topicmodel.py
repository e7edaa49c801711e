"""Corpus topics by expectation maximisation over tables: no vocabulary and no matrix ever reaches the driver.

Topic weights of terms are a table by term, topic shares of documents a table by document. The counted terms lie in a
table bucketed by document. An iteration attaches the shares of the document and the weight of the term, shares every
count out over the topics, and sums by document and by term in the same reading. Shares come to the counts' buckets,
and weights of frequent terms by broadcast, so only counts of rare terms move.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import hash_int, term_counts, unnest
from ..session import scratch_path, stored
from .features import least_frequency
from .tables import union_rows

# Digits of a weight that count when terms are ranked.
DIGITS = 9
# Weights of so many terms, the most frequent ones, are broadcast.
BROADCAST_TERMS = 500_000
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


@dataclass(frozen=True)
class TopicModel:
    """``terms``: ``term, df, weights`` (P(term | topic) per topic); ``docs``: ``id, shares`` (P(topic | document))."""

    k: int
    terms: DataFrame
    docs: DataFrame


def _sums(value: Column, k: int) -> Column:
    return F.array(*[F.sum(F.get(value, F.lit(i))) for i in range(k)])


def _scaled(values: Column, totals: list[Column | float]) -> Column:
    return F.array(*[F.get(values, F.lit(i)) / t for i, t in enumerate(totals)])


def _start(seen: DataFrame, k: int, seed: int) -> DataFrame:
    """Term weights between 1 and 2 from a hash of term and topic."""
    draws = [1 + hash_int(F.col("term"), f"{seed}:{i}") / float(1 << 32) for i in range(k)]
    return seen.groupBy("term").agg(F.count("*").alias("df")).select("term", "df", F.array(*draws).alias("w"))


def _normalised(raw: DataFrame, k: int, beta: float) -> DataFrame:
    """``term, df, weights``: weights add up to one over all terms, each raised by ``beta``; ``k`` totals return to the driver."""
    first = raw.agg(_sums(F.col("w"), k).alias("t"), F.count("*").alias("n")).first()
    totals = [t + beta * first["n"] for t in first["t"] or [1.0] * k]
    return raw.select("term", "df", _scaled(F.transform("w", lambda x: x + beta), totals).alias("weights"))


def _by_document(pairs: DataFrame) -> str:
    """Name of a table of ``id, term, tf``, bucketed by document in the shared folder: its rows meet their document without moving."""
    spark = pairs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "topic_pairs")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    # a task has the documents of one bucket, so it need not sort its rows before it writes them
    before = spark.conf.get(_WRITERS)
    spark.conf.set(_WRITERS, "4")
    try:
        pairs.write.bucketBy(buckets, "id").option("path", path).saveAsTable(name)
    finally:
        spark.conf.set(_WRITERS, before)
    return name


def _least_df(terms: DataFrame) -> int:
    """The document frequency from which on terms are broadcast: at most BROADCAST_TERMS have it. 1 if all terms are."""
    return least_frequency(terms, BROADCAST_TERMS)


def _with_shares(pairs: DataFrame, docs: DataFrame, n: int, k: int) -> DataFrame:
    if n == 0:
        return pairs.withColumn("shares", F.array(*[F.lit(1.0)] * k))
    return pairs.join(docs.hint("shuffle_hash"), "id")


def _summed(joined: DataFrame, k: int) -> DataFrame:
    """``id, term, df, w``: the shared out counts summed by document (``term`` null) and by term (``id`` null), in one reading."""
    p = [F.get("weights", F.lit(i)) * F.get("shares", F.lit(i)) for i in range(k)]
    named = joined.select("id", "term", "tf", *[x.alias(f"p{i}") for i, x in enumerate(p)])
    whole = F.col("p0")
    for i in range(1, k):
        whole = whole + F.col(f"p{i}")
    q = [F.col(f"q{i}") for i in range(k)]
    parts = named.select("id", "term", *[(F.col("tf") * F.col(f"p{i}") / whole).alias(f"q{i}") for i in range(k)])
    no_id, no_term = F.lit(None).cast(parts.schema["id"].dataType), F.lit(None).cast("string")
    twice = F.inline(F.array(F.struct(F.col("id"), no_term.alias("term"), *q), F.struct(no_id.alias("id"), F.col("term"), *q)))
    return parts.select(twice).groupBy("id", "term").agg(F.count("*").alias("df"), F.array(*[F.sum(x) for x in q]).alias("w"))


def fit_topics(df: DataFrame, id_col: str, tokens: str, k: int = 2, iterations: int = 6, alpha: float = 0.1, beta: float = 0.01, seed: int = 42) -> TopicModel:
    """Topics of the corpus; ``alpha`` and ``beta`` smooth the shares of a document and the weights of a topic.

    The start depends on terms and ``seed`` alone, so runs agree. A document without tokens has no shares.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(id_col).alias("id"), tokens).repartition(buckets, "id")
    counted = unnest(rows, ["id"], term_counts(F.col(tokens)), "e")
    pairs = _by_document(counted.select("id", F.col("e.term").alias("term"), F.col("e.n").alias("tf")))
    tables = [pairs]
    try:
        terms = stored(_normalised(_start(spark.table(pairs), k, seed), k, 0.0), "topic_terms")
        least = _least_df(terms)
        if least > 1:
            rare = spark.table(pairs).join(F.broadcast(terms.filter(F.col("df") >= least).select("term")), "term", "left_anti")
            tables.append(_by_document(rare.select("id", "term", "tf")))
        docs = spark.table(pairs).select("id").distinct().select("id", F.array(*[F.lit(1.0)] * k).alias("shares"))
        for n in range(iterations):
            frequent = F.broadcast(terms.filter(F.col("df") >= least).select("term", "weights"))
            joined = [_with_shares(spark.table(pairs), docs, n, k).join(frequent, "term")]
            if least > 1:
                joined.append(_with_shares(spark.table(tables[1]), docs, n, k).join(terms.filter(F.col("df") < least), "term"))
            sums = stored(_summed(union_rows(*[j.select("id", "term", "tf", "shares", "weights") for j in joined]), k), "topic_sums")
            by_doc = sums.filter("term IS NULL").select("id", F.col("w").alias("s"))
            size = F.aggregate("s", F.lit(0.0), lambda a, x: a + x)
            docs = stored(by_doc.select("id", F.transform("s", lambda x: (x + alpha) / (size + alpha * k)).alias("shares")), "topic_docs")
            terms = stored(_normalised(sums.filter("term IS NOT NULL").select("term", "df", "w"), k, beta), "topic_terms")
    finally:
        for t in tables:
            spark.sql(f"DROP TABLE IF EXISTS {t}")
    return TopicModel(k, terms, docs)


def topic_terms(model: TopicModel, per_topic: int = 7) -> DataFrame:
    """``topic, rank, term, weight``: the heaviest terms of every topic, from rank 1; ties by term. Cut per task before the shuffle."""
    long = model.terms.select("term", F.posexplode("weights").alias("topic", "weight"))
    order = Window.partitionBy("topic").orderBy(F.round("weight", DIGITS).desc(), "term")
    ranked = long.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_topic)
    return ranked.select("topic", "rank", "term", "weight")


def dominant_topic(model: TopicModel, df: DataFrame, id_col: str) -> DataFrame:
    """``id, topic, share`` of the largest topic, at ties the first; null and 0 for a document without tokens."""
    best = F.array_position("shares", F.array_max("shares")) - 1
    out = df.select(F.col(id_col).alias("id")).join(model.docs, "id", "left")
    return out.select(F.col("id").alias(id_col), best.cast("int").alias("topic"), F.coalesce(F.array_max("shares"), F.lit(0.0)).alias("share"))
