"""How the operators are bound to the given tables, for Spark and for the SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.patterns import portable
from ..functions.text import stopwords_for

# One keyword list per class; each occurs in a fair share of the documents.
KEYWORDS = {
    0: ["keit"],
    1: ["ment"],
    2: ["ción"],
    3: ["eau"],
    4: ["lyre", "shon"],
    5: ["ness", "license"],
    6: ["ndst", "cht"],
}
KEYWORD_NAMES = [f"keyword_{k}" for k in KEYWORDS]
CLUSTER_NAMES = [f"cluster_{k}" for k in KEYWORDS]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores on a small file; an input with enough splits stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"), "doc_id")


def documents_url(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a URL; equal texts have equal URLs."""
    return documents(spark, d).withColumn("url", F.md5("text"))


def segments(spark: SparkSession, d: str) -> DataFrame:
    """``(doc_id, lang, text)``: lines play the part of the text nodes of a page."""
    return documents(spark, d).select("doc_id", "lang", F.replace("text", F.lit("\n"), F.lit("|")).alias("text"))


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Stored pages with the class and the keyword they were found by."""
    return spread(table(spark, d, "pages"), "page_id").select(
        "page_id", "url", "html", F.expr("split_part(url, '/', 4)").alias("CLASS"), F.expr("split_part(url, '/', 3)").alias("KEYWORD")
    )


SHEET = {
    "CLASS_K": "split_part(url, '/', 4)",
    "KEYWORD": "split_part(url, '/', 3)",
    "URL_DE": "CASE WHEN split_part(url, '/', 4) = 'de' THEN url END",
    "URL_EN": "CASE WHEN split_part(url, '/', 4) = 'en' THEN url END",
    "CLASS": "split_part(url, '/', 4)",
    "KEYWORD_DE": "CASE WHEN url LIKE 'https:%' THEN split_part(url, '/', 3) END",
    "KEYWORD_EN": "CASE WHEN url LIKE 'http:%' THEN split_part(url, '/', 3) END",
    "KMEANS_CLASS": "CASE WHEN length(url) > 40 THEN split_part(url, '/', 4) END",
    "KMEANS_URL": "url",
    "KMEANS_LANG": "split_part(url, '/', 4)",
}


def seed_sheet(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").selectExpr(*[f"{e} AS {n}" for n, e in SHEET.items()])


SHEET_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in SHEET.items()) + " FROM pages"

# Class id of the annotated documents.
ANNOTATED = "CAST(CASE WHEN toxic = 1 THEN 2 WHEN quality = 1 THEN 1 ELSE 0 END AS INT)"


def annotated(spark: SparkSession, d: str) -> DataFrame:
    """``(doc_id, LABEL)`` of the annotated documents."""
    return table(spark, d, "labels").selectExpr("doc_id", f"{ANNOTATED} AS LABEL")


# Result tables of searches, derived from the events.
EVAL = {
    "id": "event_id",
    "Type": "CASE event_type WHEN 'click' THEN 'GridSearch' WHEN 'view' THEN 'RandomSearch' WHEN 'signup' THEN 'BayesSearch'"
    " WHEN 'purchase' THEN 'Hyperband' ELSE 'BOHB' END",
    "accuracy": "value / (value + 50.0)",
    "MCC": "value / (value + 80.0) - 0.1",
    "k": "user_id % 8 + 2",
    "Trial": "user_id % 3",
}
EVAL_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in EVAL.items()) + " FROM events"
COVERAGE = {
    "id": "event_id",
    "LF": "concat('keyword_', CAST(user_id % 7 AS STRING))",
    "Polarity": "CAST(user_id % 7 AS INT)",
    "TRIAL": "event_id % 3",
    "k_fold": "event_id % 8 + 2",
    "k_fold_split": "event_id % 5",
    "Coverage": "value / (value + 30.0)",
    "Overlaps": "value / (value + 60.0)",
    "Conflicts": "value / (value + 90.0)",
}
COVERAGE_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in COVERAGE.items()).replace("STRING", "VARCHAR") + " FROM events"


def eval_results(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr(*[f"{e} AS {n}" for n, e in EVAL.items()])


def coverage_results(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr(*[f"{e} AS {n}" for n, e in COVERAGE.items()])


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def deletes(expr: str, patterns) -> str:
    """SQL that deletes the patterns in order."""
    for p in patterns:
        expr = f"regexp_replace({expr}, {quoted(portable(p))}, '', 'g')"
    return expr


def stopword_filter(lang: str = "lang", term: str = "term") -> str:
    """SQL condition that a term is no stop word of its row's language."""
    lists = {c: ", ".join(quoted(w) for w in stopwords_for(c)) for c in ("en", "de")}
    return f"(CASE WHEN {lang} = 'en' THEN {term} NOT IN ({lists['en']}) ELSE {term} NOT IN ({lists['de']}) END)"


VOTES_SQL = "SELECT doc_id, lang, text, " + ", ".join(
    "CASE WHEN " + " OR ".join(f"contains(lower(text), {quoted(w)})" for w in words) + f" THEN {k} ELSE -1 END AS keyword_{k}"
    for k, words in KEYWORDS.items()
) + " FROM documents"
