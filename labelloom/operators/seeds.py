"""Seed tables: normalising the wide seed sheet and filtering search hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.rules import RESULT_BLACKLIST
from .tables import union_rows


def url_seeds(sheet: DataFrame, lang: str) -> DataFrame:
    """``(CLASS, KEYWORD, URL)`` of one language from the wide sheet, without incomplete rows."""
    return sheet.select(F.col("CLASS_K").alias("CLASS"), "KEYWORD", F.col(f"URL_{lang.upper()}").alias("URL")).na.drop()


def keyword_seeds(sheet: DataFrame, lang: str) -> DataFrame:
    return sheet.select("CLASS", F.col(f"KEYWORD_{lang.upper()}").alias("KEYWORD")).na.drop()


def centroid_seeds(sheet: DataFrame, lang: str) -> DataFrame:
    return (
        sheet.select(
            F.col("KMEANS_CLASS").alias("CLASS"), F.col("KMEANS_URL").alias("URL"), F.col("KMEANS_LANG").alias("LANG")
        )
        .na.drop()
        .filter(F.col("LANG") == lang)
    )


def class_keywords(sheet: DataFrame, classes) -> DataFrame:
    """One null-padded column per class to ``(class_id, keyword)``."""
    pairs = F.array(*[F.struct(F.lit(i).alias("class_id"), F.col(c).alias("keyword")) for i, c in enumerate(classes)])
    return sheet.select(F.inline(pairs)).na.drop()


def seed_union(seeds: DataFrame, hits: DataFrame) -> DataFrame:
    """URL seeds and keyword hits; rows with any null are dropped."""
    return union_rows(seeds, hits.select(*seeds.columns)).na.drop()


def is_result_link(link: Column) -> Column:
    """A web link that meets none of the blacklist patterns (case-sensitive)."""
    return link.rlike("^https?://") & ~link.rlike("|".join(RESULT_BLACKLIST))


def result_filter(links: DataFrame, link: str) -> DataFrame:
    return links.filter(is_result_link(F.col(link)))


def top_n_links(hits: DataFrame, keyword: str, rank: list[str], n: int = 10) -> DataFrame:
    """First ``n`` hits per keyword; ``n <= 0`` keeps all.

    The rank filter lets Spark cut every keyword to ``n`` rows per task before
    the shuffle, so a frequent keyword is no hot spot.
    """
    if n <= 0:
        return hits
    w = Window.partitionBy(keyword).orderBy(*rank)
    return hits.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def explode_hits(df: DataFrame, hits: str, out: str = "URL") -> DataFrame:
    """One row per hit; a keyword without hits keeps one row with null."""
    others = [c for c in df.columns if c != hits]
    return df.select(*others, F.explode_outer(hits).alias(out))
