"""Queries over ``documents``: quality rules and sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, katz, license_scan, mixing, ngram_jaccard, quality, secret_scan, sharding, stages
from .common import WORD, draw52_sql, sql_text, table

# CRC-32 of a list of bytes; the 256 entries follow from the reflected polynomial.
CRC32_TABLE_SQL = (
    "list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), "
    "lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
)


def crc32_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes; ``crc_table.t`` holds the table."""
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    step = "lambda c, b: xor(c >> 8, t[CAST(xor(c & 255, b) AS INTEGER) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), {step}), 4294967295::BIGINT)"


def op5_sharding(spark: SparkSession, d: str) -> DataFrame:
    return stages.shards(spark, table(spark, d, "documents"), d)


OP5_SQL = f"""
WITH crc_table AS (SELECT {CRC32_TABLE_SQL} AS t),
placed AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size,
    CAST({crc32_sql("coalesce(text, '')")} AS BIGINT) AS text_crc32,
    {sharding.descend_sql("doc_id", sharding.topology(stages.SHARDS))} AS shard,
    {sharding.descend_sql("doc_id", sharding.topology(stages.SHARDS + 1))} AS grown_shard,
    {draw52_sql("doc_id")} AS draw
  FROM documents, crc_table
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
  row_number() OVER (PARTITION BY shard ORDER BY draw, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot
FROM placed
"""


def op9_quality(spark: SparkSession, d: str) -> DataFrame:
    out = quality.report(table(spark, d, "documents"))
    base = {r.name: r.rejects({c: F.col(c) for c in out.columns}) for r in quality.RULES if r.name in quality.BASE_RULES}
    return out.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (base["few_words"] | base["repeated_windows"]).alias("base_failed"),
        (~F.col("rejected")).alias("kept"),
    )


OP9_SQL = f"""
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
parts AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, {sql_text(WORD)}) AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {sql_text(WORD)})) AS ls
  FROM texts
),
windows AS (
  SELECT rid, unnest(range(1, len(ws) - 1)) AS p,
    unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS win
  FROM parts
),
twins AS (SELECT rid, unnest(list(p)) AS p FROM windows GROUP BY rid, win HAVING count(*) > 1),
covered AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM twins) GROUP BY rid),
measured AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_capitals,
    CAST(len(ls) AS BIGINT) AS n_lines,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM parts LEFT JOIN covered USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  {" OR ".join(f"({r.sql})" for r in quality.RULES if r.name in quality.BASE_RULES)} AS base_failed,
  NOT ({" OR ".join(f"({r.sql})" for r in quality.RULES)}) AS kept
FROM measured
"""



def op7_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, d, "documents"), table(spark, d, "benchmark"))


def _seeds_sql(table: str, key: str, short: str) -> str:
    parts = []
    for mask in (*decontaminate.MASKS, *decontaminate.SHORT_MASKS):
        seed = " || ' ' || ".join(f"ws[i + {o}]" for o, c in enumerate(mask) if c == "1")
        where = f"WHERE {short.format(len(mask))}" if mask in decontaminate.SHORT_MASKS else ""
        parts.append(
            f"SELECT {key}, {sql_text(mask)} AS mask, unnest(range(0, len(ws) - {len(mask)} + 1)) AS pos,"
            f" unnest(list_transform(range(1, len(ws) - {len(mask)} + 2), lambda i: {seed})) AS seed FROM {table} {where}"
        )
    return " UNION ALL ".join(parts)


OP7_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(lower(coalesce(text, '')), {sql_text(WORD)}) AS ws FROM documents),
items AS (SELECT item_id, ws FROM (SELECT DISTINCT item_id, regexp_extract_all(lower(coalesce(text, '')), {sql_text(WORD)}) AS ws FROM benchmark) WHERE len(ws) > 0),
doc_seeds AS ({_seeds_sql("docs", "rid", "EXISTS (SELECT 1 FROM items WHERE len(items.ws) = {})")}),
item_seeds AS ({_seeds_sql("items", "item_id", "len(ws) = {}")}),
hits AS (SELECT DISTINCT rid, item_id, d.pos - b.pos AS diagonal FROM doc_seeds d JOIN item_seeds b USING (mask, seed)),
compared AS (
  SELECT doc_id, hits.item_id, diagonal, len(docs.ws) AS n, len(items.ws) AS wanted, least(len(items.ws), {decontaminate.WINDOW}) AS width,
    list_transform(range(1, len(items.ws) + 1), lambda i: CASE WHEN i + diagonal BETWEEN 1 AND len(docs.ws) AND docs.ws[i + diagonal] = items.ws[i] THEN 1 ELSE 0 END) AS same
  FROM hits JOIN docs USING (rid) JOIN items USING (item_id)
),
verified AS (
  SELECT DISTINCT doc_id, item_id, CAST(list_sum(same) AS BIGINT) AS matched,
    CAST(greatest(-diagonal, 0) + diagonal AS BIGINT) AS doc_start, CAST(greatest(-diagonal, 0) AS BIGINT) AS item_start,
    CAST(least(wanted, n - diagonal) - greatest(-diagonal, 0) AS BIGINT) AS length
  FROM compared
  WHERE list_max(list_transform(range(1, wanted - width + 2), lambda s: list_sum(same[s:s + width - 1])))
    >= CASE WHEN width < {decontaminate.WINDOW} THEN width ELSE {decontaminate.MATCHES} END
)
SELECT doc_id, item_id, matched, doc_start, item_start, length FROM verified
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, doc_start, item_start DESC, length DESC) = 1
"""


def op10_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"))


def op3_secrets(spark: SparkSession, d: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, d, "documents"))


def op1_ngram_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return ngram_jaccard.similar(table(spark, d, "documents"))


_N = ngram_jaccard.WORDS
_NUM, _DEN = ngram_jaccard.THRESHOLD
OP1_SQL = f"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), {sql_text(WORD)}) AS ws FROM documents),
shingles AS (
  SELECT DISTINCT rid, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {_N} THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - {_N} + 2), lambda i: array_to_string(ws[i:i + {_N - 1}], ' ')) END) AS s
  FROM docs
),
sizes AS (SELECT rid, count(*) AS n FROM shingles GROUP BY rid),
shared AS (SELECT a.rid AS x, b.rid AS y, count(*) AS common FROM shingles a JOIN shingles b USING (s) WHERE a.rid <> b.rid GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes a ON a.rid = x JOIN sizes b ON b.rid = y WHERE common * {_NUM + _DEN} >= {_NUM} * (a.n + b.n)),
reached AS (SELECT rid AS x, rid AS y FROM docs UNION SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x),
classes AS (SELECT x, min(doc_id) AS class_id FROM reached JOIN docs ON y = rid GROUP BY x),
degrees AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT doc_id, class_id, CAST(coalesce(degrees.n, 0) AS BIGINT) AS n_links
FROM docs JOIN classes ON rid = classes.x LEFT JOIN degrees ON rid = degrees.x
"""


def op2_licenses(spark: SparkSession, d: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, d, "documents"))


# Documents whose key's checksum leaves no remainder are held out.
TRAINED = "crc32(CAST(coalesce(CAST(doc_id AS STRING), '') AS BINARY)) % 10 <> 0"


def op4_katz(spark: SparkSession, d: str) -> DataFrame:
    out = katz.score_corpus(table(spark, d, "documents"), TRAINED)
    return out.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def _discount_sql(name: str, counts: str) -> str:
    """CTEs ``name_n`` (counts of counts) and ``name_d`` (discounted counts by count) of the column ``c`` of a table."""
    k = katz.CUTOFF
    return f"""
{name}_n AS (SELECT c, CAST(count(*) AS DOUBLE) AS n FROM {counts} GROUP BY c),
{name}_line AS (SELECT least(coalesce(CASE WHEN count(*) > 1 THEN regr_slope(ln(n), ln(c)) END, -2.0), -1.05) AS slope FROM {name}_n WHERE c <= {k + 1}),
{name}_d AS (
  SELECT c, CASE WHEN c <= {k} AND next / n * (c + 1) > 0 AND next / n * (c + 1) < c THEN (c + 1) * next / n ELSE c * pow(1 + 1.0::DOUBLE / c, slope + 1) END AS d
  FROM (SELECT a.c, a.n, b.n AS next FROM {name}_n a LEFT JOIN {name}_n b ON b.c = a.c + 1), {name}_line
)"""


OP4_SQL = f"""
WITH crc_table AS (SELECT {CRC32_TABLE_SQL} AS t),
docs AS (
  SELECT row_number() OVER () AS rid, doc_id, {crc32_sql("coalesce(CAST(doc_id AS VARCHAR), '')")} % 10 = 0 AS held_out,
    list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {sql_text(WORD)}), '  ') AS ws
  FROM documents, crc_table
),
tokens AS (SELECT rid, held_out, unnest(ws) AS w, unnest(list_prepend(' ', ws[1:len(ws) - 1])) AS h FROM docs),
words AS (SELECT w, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY w),
pairs AS (SELECT h, w, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY h, w),
{_discount_sql("word", "words")},
{_discount_sql("pair", "pairs")},
total AS (SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS n, count(*) AS v, coalesce(sum(d), 0) AS kept FROM words JOIN word_d USING (c)),
shares AS (SELECT w, c, d / n AS p FROM words JOIN word_d USING (c), total),
unknown AS (SELECT CASE WHEN n > 0 THEN 1 - kept / n ELSE 1 END AS p FROM total),
histories AS (
  SELECT h, sum(pairs.c) AS c, log10(1 - sum(d) / sum(pairs.c)) - log10(1 - sum(p)) AS alpha
  FROM pairs JOIN pair_d ON pair_d.c = pairs.c JOIN shares USING (w) GROUP BY h
),
scored AS (
  SELECT rid, count(*) AS n_tokens, count(shares.c) AS n_known,
    sum(log10((coalesce(shares.c, 0) + 0.1::DOUBLE) / (total.n + 0.1::DOUBLE * (total.v + 1)))) AS base_score,
    sum(CASE WHEN pairs.c IS NOT NULL THEN log10(d / histories.c) ELSE coalesce(alpha, 0) + log10(coalesce(shares.p, unknown.p)) END) AS score
  FROM tokens LEFT JOIN shares USING (w) LEFT JOIN pairs ON pairs.h = tokens.h AND pairs.w = tokens.w LEFT JOIN pair_d ON pair_d.c = pairs.c
    LEFT JOIN histories ON histories.h = tokens.h, total, unknown
  GROUP BY rid
)
SELECT doc_id, held_out, n_tokens, n_known, n AS train_tokens, round(base_score, 6) AS base_score, round(score, 6) AS score
FROM docs JOIN scored USING (rid), total
"""


QUERIES = {
    "op4_katz": op4_katz,
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_licenses": op2_licenses,
    "op3_secrets": op3_secrets,
    "op5_sharding": op5_sharding,
    "op7_decontamination": op7_decontamination,
    "op9_quality": op9_quality,
    "op10_mixing": op10_mixing,
}
ORACLES = {"op1_ngram_jaccard": OP1_SQL, "op4_katz": OP4_SQL, "op5_sharding": OP5_SQL, "op7_decontamination": OP7_SQL, "op9_quality": OP9_SQL}
