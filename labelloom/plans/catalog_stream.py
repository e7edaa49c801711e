"""Incremental queries: the documents arrive as several files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.clean import clean_text
from ..operators.labelmodel import label_corpus
from ..operators.topics import topic_terms_doc
from ..functions import rules as R
from ..session import scratch_path
from ..streaming.incremental import read_arriving, read_target, run_incremental, run_scoring
from .catalog_clean import markup_sql, words_sql
from .catalog_text import ORACLES as TEXT_ORACLES
from .catalog_votes import ORACLES as VOTE_ORACLES, REGISTRY, partial_model, votes
from .inputs import documents, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


# Rows of an arriving file at most, about: files grow in number with the documents, not in size.
ROWS_PER_FILE = 20_000


def arriving(spark, d, files: int = 4, batches: int = 2) -> DataFrame:
    """The documents as a stream over at least ``files`` files of bounded size, which arrive in ``batches`` batches."""
    path = scratch_path(spark, "arriving")
    docs = table(spark, d, "documents").withColumn("url", F.md5("text"))
    files = max(files, -(-docs.count() // ROWS_PER_FILE))
    docs.repartition(files, "doc_id").write.parquet(path)
    return read_arriving(spark, path, docs.schema, -(-files // batches))


def _incremental(spark, d, process, schema: str) -> DataFrame:
    out = T.StructType.fromDDL(schema)
    target, checkpoint = scratch_path(spark, "target"), scratch_path(spark, "progress")
    run_incremental(arriving(spark, d), target, checkpoint, "url", "doc_id", process, out)
    return read_target(spark, target, out).drop("batch")


def incremental_clean(spark, d):
    """Clean the arriving documents, the first of every URL."""
    text = F.replace("text", F.lit("\n"), F.lit("|"))
    return _incremental(spark, d, lambda rows: rows.select("url", clean_text(text).alias("clean")), "url string, clean string")


def incremental_topics(spark, d):
    topic = F.array_join(topic_terms_doc(F.col("text"), F.col("lang")), ",")
    return _incremental(spark, d, lambda rows: rows.select("url", topic.alias("topic")), "url string, topic string")


def stream_label(spark, d):
    """Score the arriving documents with the model of the stored ones."""
    model = partial_model(votes(spark, d))
    target, checkpoint = scratch_path(spark, "target"), scratch_path(spark, "progress")
    run_scoring(arriving(spark, d), target, checkpoint, lambda s: label_corpus(s, REGISTRY, model, ["doc_id"]))
    return spark.read.schema("doc_id bigint, label int").parquet(target)


for _q in (incremental_clean, incremental_topics, stream_label):
    QUERIES[_q.__name__] = _q

_FIRST = "SELECT DISTINCT md5(text) AS url, {} FROM documents JOIN ({}) r USING (doc_id)"
ORACLES["incremental_clean"] = _FIRST.format(
    "r.clean", words_sql(R.word_rules(), f"SELECT doc_id, clean AS t FROM ({markup_sql()}) m")
)
ORACLES["incremental_topics"] = _FIRST.format("r.topic", TEXT_ORACLES["topic_terms_doc"]).replace("SELECT DISTINCT", "SELECT", 1) + (
    " QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1"
)
ORACLES["stream_label"] = f"SELECT doc_id, label FROM ({VOTE_ORACLES['lm_predict']}) p WHERE label <> -1"
__all__ = ["ORACLES", "QUERIES", "documents"]
