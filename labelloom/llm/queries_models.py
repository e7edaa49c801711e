"""Queries of spelling variants, hard negatives and toxicity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import hard_negatives, spelling, toxicity
from .common import sql_text, table
from .queries_corpus import CRC32_TABLE_SQL, crc32_sql

# Fixed value of the contract: one letter is deleted where this divides the checksum of document and word.
SLIPS = 199


def op12_spelling(spark: SparkSession, d: str) -> DataFrame:
    return spelling.variants(table(spark, d, "documents"), slips=SLIPS)


_CUT = "substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2)"
OP12_SQL = f"""
WITH RECURSIVE crc_table AS (SELECT {CRC32_TABLE_SQL} AS t),
found AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{spelling.UPPER}', '{spelling.LOWER}'), {sql_text(spelling.RUN)})) AS run FROM documents
  ) GROUP BY ALL
),
hashed AS (SELECT run, times, {crc32_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM found, crc_table),
words AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (SELECT CASE WHEN h % {SLIPS} = 0 THEN {_CUT} ELSE run END AS word, times FROM hashed)
  WHERE length(word) >= {spelling.MIN_CHARS} GROUP BY word HAVING sum(times) >= {spelling.MIN_COUNT}
),
holes AS (SELECT word, unnest(range(length(word))) AS p FROM words),
cut AS (SELECT word, p, substr(word, 1, p) || substr(word, p + 2) AS rest FROM holes),
near AS (
  SELECT a.word AS x, b.word AS y FROM cut a JOIN cut b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word FROM cut c JOIN words w ON c.rest = w.word
),
best AS (SELECT x, count(*) AS n_near, min({{'m': -n, 'w': y}}) AS b FROM near JOIN words ON y = word GROUP BY x),
formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= n * {spelling.RATIO} THEN b.w END AS form,
    CASE WHEN -b.m >= n * {spelling.RATIO} THEN -b.m END AS form_n
  FROM words LEFT JOIN best ON word = x
),
chain AS (
  SELECT word, word AS root FROM formed
  UNION ALL SELECT chain.word, formed.form FROM chain JOIN formed ON chain.root = formed.word WHERE formed.form IS NOT NULL
)
SELECT formed.word, formed.form, chain.root, formed.n, formed.n_near, formed.form_n
FROM formed JOIN chain ON chain.word = formed.word JOIN formed AS ends ON ends.word = chain.root WHERE ends.form IS NULL
"""


def op13_hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").filter(hard_negatives.valid(F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", label.alias("label"), hard_negatives.quantised(F.col("embedding")).alias("vector"))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


OP13_SQL = f"""
WITH used AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.rid AS anchor, a.vec_id AS anchor_id, a.label = b.label AS same, b.rid, b.vec_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM used a JOIN used b ON a.vec_id % 100 = 0 AND a.rid <> b.rid
),
near AS (
  SELECT anchor, anchor_id, rid AS positive, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST, rid) <= {hard_negatives.POSITIVES}
)
SELECT near.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM near JOIN scored ON scored.anchor = near.anchor AND NOT same
  AND {hard_negatives.LOW} * positive_score <= {hard_negatives.SCALE} * score AND {hard_negatives.SCALE} * score <= {hard_negatives.HIGH} * positive_score
WINDOW w AS (PARTITION BY near.anchor, positive ORDER BY score DESC, vec_id NULLS LAST, rid)
QUALIFY row_number() OVER w <= {hard_negatives.NEGATIVES}
"""


# Documents whose key's checksum leaves no remainder are held out.
LEARNT = "crc32(CAST(coalesce(CAST(doc_id AS STRING), '') AS BINARY)) % 5 <> 0"


def op11_toxicity(spark: SparkSession, d: str) -> DataFrame:
    out = toxicity.toxicity(table(spark, d, "documents"), table(spark, d, "labels"), trained=LEARNT)
    return out.select("doc_id", (~F.expr(LEARNT)).alias("held_out"), "score", "predicted", "hits")


QUERIES = {"op11_toxicity": op11_toxicity, "op12_spelling": op12_spelling, "op13_hard_negatives": op13_hard_negatives}
ORACLES = {"op12_spelling": OP12_SQL, "op13_hard_negatives": OP13_SQL}
