"""TF-IDF in long form: one row per document and term."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.text import term_counts, unnest
from ..session import stored
from .tables import union_rows

# Terms that are broadcast, chosen on about so many documents: which they are decides what moves, never a result.
BROADCAST_TERMS = 500_000
SAMPLE_DOCS = 20_000
# Documents that a task weighs at a time.
ROWS_AT_ONCE = 256
_ROW = "_row"


def term_table(df: DataFrame, id_col: str, terms: str) -> DataFrame:
    """``(id, term, tf)``: counted inside each row, without a shuffle."""
    return unnest(df, [id_col], term_counts(F.col(terms)), "e").select(
        id_col, F.col("e.term").alias("term"), F.col("e.n").alias("tf")
    )


def document_frequency(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def attach_by_term(tf: DataFrame, terms: DataFrame, max_hot: int = 10_000) -> DataFrame:
    """Join ``terms(term, df, ...)`` to the rows of ``tf``.

    A few terms occur in most documents. Those with at least ``1/max_hot`` of
    all rows are at most ``max_hot`` terms; they are broadcast, so that their
    rows, the bulk of the table, do not move. No other term is hot.
    """
    total = terms.agg(F.sum("df")).scalar()
    is_hot = F.col("df") * max_hot >= total
    hot = F.broadcast(terms.filter(is_hot))
    common = tf.join(hot, "term")
    rare = tf.join(hot.select("term"), "term", "left_anti").join(terms.filter(~is_hot), "term")
    return union_rows(common, rare)


def least_frequency(counts: DataFrame, most: int) -> int:
    """The ``df`` from which on at most ``most`` terms of ``counts(term, df)`` are left; 1 if all are."""
    seen = 0
    for r in counts.groupBy("df").count().orderBy(F.desc("df")).collect():
        seen += r["count"]
        if seen > most:
            return r["df"] + 1
    return 1


def tfidf(df: DataFrame, id_col: str, terms: Column) -> DataFrame:
    """``(id, term, tf, tfidf)``, rows scaled to length one; ``terms`` is an array made of columns of ``df``.

    Documents are stored and move once; their counted terms do not. Frequent terms are chosen on a sample, counted on
    all documents, and broadcast. A document sends its other terms out to be counted, and gets those back that
    occur in other documents too: a term that does not come back occurs in no other. Weights and length are then taken in the row.
    """
    spark = df.sparkSession
    docs = stored(df.withColumn(_ROW, F.monotonically_increasing_id()), "documents")
    n = docs.count()
    every = unnest(docs, [_ROW], F.array_distinct(terms), "term")
    sample = every if n <= SAMPLE_DOCS else every.filter(F.pmod(F.xxhash64(_ROW), F.lit(n // SAMPLE_DOCS)) == 0)
    # a term that the sample has once may be in no other document
    found = stored(document_frequency(sample).filter("df > 1"), "sampled_terms")
    chosen = found.filter(F.col("df") >= least_frequency(found, BROADCAST_TERMS)).select("term")
    frequent = stored(document_frequency(every.join(F.broadcast(chosen), "term")), "frequent_terms")

    rest = every.join(F.broadcast(frequent.select("term")), "term", "left_anti")
    counted = rest.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("term")))
    back = counted.filter("df > 1").repartition(_ROW).groupBy(_ROW).agg(F.collect_list(F.struct("term", "df")).alias("_shared"))
    rows = docs.join(back, _ROW, "left").select(id_col, term_counts(terms).alias("_counts"), "_shared")

    known = frequent.toArrow()
    table = spark.sparkContext.broadcast((known["term"].combine_chunks(), known["df"].to_numpy()))
    out = T.StructType(
        [df.schema[id_col], T.StructField("term", T.StringType()), T.StructField("tf", T.IntegerType()), T.StructField("tfidf", T.DoubleType())]
    )
    return rows.mapInArrow(lambda batches: _weighed(batches, n, *table.value), out)


def _weighed(batches: Iterator[pa.RecordBatch], n: int, known: pa.Array, known_df: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per counted term of a document, weighed and divided by the document's length."""
    for whole in batches:
        for i in range(0, whole.num_rows, ROWS_AT_ONCE):
            batch = whole.slice(i, ROWS_AT_ONCE)
            counts, shared = batch.column(1), batch.column(2).flatten()
            row, (term, tf) = pc.list_parent_indices(counts), counts.flatten().flatten()
            # a term's df is the same for all documents, so those of the batch look up in one list
            terms = pa.chunked_array([known, shared.field("term").cast(known.type)])
            place = pc.index_in(term, value_set=terms.combine_chunks()).fill_null(len(terms)).to_numpy(zero_copy_only=False)
            df = np.concatenate([known_df, shared.field("df").to_numpy(zero_copy_only=False), [1]])[place]
            weight = tf.to_numpy(zero_copy_only=False) * (np.log((1 + n) / (1 + df)) + 1)
            length = np.sqrt(np.bincount(row, weight * weight, batch.num_rows))
            columns = [batch.column(0).take(row), term, tf, pa.array(weight / length[row])]
            yield pa.RecordBatch.from_arrays(columns, [batch.schema.names[0], "term", "tf", "tfidf"])
