"""Row-local text functions as Column expressions. None of them shuffles."""

from __future__ import annotations

import glob
import html.entities
import os
import zipfile
from functools import lru_cache

import pyspark
from pyspark.sql import Column, DataFrame, functions as F

from .patterns import WORD

TOKEN_PATTERN = f"[{WORD}]+"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unnest(df: DataFrame, keep: list, array: Column, out: str) -> DataFrame:
    """``keep`` columns and one row per array element.

    A plain ``explode`` makes Catalyst add a filter on the array's size, which
    computes an expensive array again, and as early as in the scan. The outer
    form adds none; its null rows are dropped afterwards.
    """
    return df.select(*keep, F.explode_outer(array).alias(out)).filter(F.col(out).isNotNull())


def unnest_with_position(df: DataFrame, keep: list, array: Column, pos: str, out: str) -> DataFrame:
    return df.select(*keep, F.posexplode_outer(array).alias(pos, out)).filter(F.col(pos).isNotNull())


def compute_once(df: DataFrame, keep: list, value: Column, out: str) -> DataFrame:
    """``keep`` columns and a computed column that later filters use without computing it again."""
    return df.select(*keep, F.explode_outer(F.array(value)).alias(out))


def tokenize(text: Column) -> Column:
    """Lower-case word tokens in text order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def truncate_tokens(tokens: Column, limit: int = 512) -> Column:
    return F.slice(tokens, 1, limit)


def ngrams_1_2(tokens: Column) -> Column:
    """The tokens followed by all pairs of neighbours."""
    return let(
        tokens,
        lambda t: F.concat(
            t,
            F.zip_with(
                F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0))),
                F.slice(t, F.lit(2), F.size(t)),
                lambda a, b: F.concat_ws(" ", a, b),
            ),
        ),
    )


def term_counts(terms: Column) -> Column:
    """``array<struct<term, n>>`` in term order, from one sort of the row's terms.

    Equal terms are neighbours after the sort, so the distance between the
    starts of two runs is a count; the row never leaves its task.
    """

    def runs(s: Column) -> Column:
        marked = F.transform(s, lambda x, i: F.struct(x.alias("term"), i.alias("at")))
        starts = F.filter(marked, lambda e: (e.at == 0) | (e.term != F.get(s, e.at - 1)))
        return let(
            starts,
            lambda r: F.transform(
                r,
                lambda e, j: F.struct(
                    e.term.alias("term"),
                    (F.coalesce(F.get(r, j + 1).at, F.size(s)) - e.at).alias("n"),
                ),
            ),
        )

    return let(F.sort_array(terms), runs)


def top_terms(terms: Column, k: int = 14, min_length: int = 4) -> Column:
    """The ``k`` most frequent terms of a row (ties by term), without the short ones."""
    return top_counted(term_counts(terms), k, min_length)


def top_counted(counts: Column, k: int = 14, min_length: int = 4) -> Column:
    """The same from the row's ``term_counts``."""
    ranked = F.sort_array(F.transform(counts, lambda e: F.struct((-e.n).alias("n"), e.term.alias("term"))))
    return F.filter(F.transform(F.slice(ranked, 1, k), lambda e: e.term), lambda t: F.length(t) >= min_length)


@lru_cache
def stopword_list(language: str) -> tuple[str, ...]:
    """Stop words that ship with Spark ML, by language name."""
    home = os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__)
    for jar in glob.glob(os.path.join(home, "jars", "spark-mllib_*.jar")):
        with zipfile.ZipFile(jar) as z:
            words = z.read(f"org/apache/spark/ml/feature/stopwords/{language}.txt").decode("utf-8").split("\n")
            return tuple(dict.fromkeys(w.strip() for w in words if w.strip()))
    from pyspark.ml.feature import StopWordsRemover

    return tuple(StopWordsRemover.loadDefaultStopWords(language))


def stopwords_for(lang_code: str) -> tuple[str, ...]:
    """English has its own list, every other language falls back to German."""
    return stopword_list("english" if lang_code == "en" else "german")


def remove_stopwords(tokens: Column, lang: Column) -> Column:
    """Drop the stop words of the row's language."""
    return F.when(lang == "en", F.filter(tokens, lambda t: ~t.isin(*stopwords_for("en")))).otherwise(
        F.filter(tokens, lambda t: ~t.isin(*stopwords_for("de")))
    )


def hash_order(key: Column, seed: int | str = 42) -> Column:
    """Pseudo-random order of rows that any SQL engine can replay."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hash_int(key: Column, seed: int | str = 42) -> Column:
    """32-bit pseudo-random integer from the same hash."""
    return F.conv(F.substring(hash_order(key, seed), 1, 8), 16, 10).cast("bigint")


def _code_point(n: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


# Named character references of HTML 4 as a map literal, from the standard library's table.
_NAMED = "map(" + ", ".join(f"'{n}', {c}" for n, c in sorted({**html.entities.name2codepoint, "apos": 39}.items())) + ")"
_REFERENCE = "&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"


def _char(ref: Column) -> Column:
    """The character of a reference; an unknown reference stays as it is."""
    point = (
        F.when(ref.rlike("^#[0-9]"), F.substr(ref, F.lit(2)).cast("bigint"))
        .when(ref.startswith("#"), F.conv(F.substr(ref, F.lit(3)), 16, 10).cast("bigint"))
        .otherwise(F.try_element_at(F.expr(_NAMED), ref).cast("bigint"))
    )
    return let(
        point,
        lambda p: F.when((p > 0) & (p < 1114112) & ~p.between(55296, 57343), _code_point(p)).otherwise(
            F.concat(F.lit("&"), ref, F.lit(";"))
        ),
    )


def unescape(text: Column) -> Column:
    """Replace character references in one pass, so that ``&amp;lt;`` becomes ``&lt;``."""

    def join(parts: Column, refs: Column) -> Column:
        chars = F.transform(refs, _char)
        return let(
            chars,
            lambda cs: F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(cs, i), F.lit("")))), ""),
        )

    def replaced(t: Column) -> Column:
        refs = F.regexp_extract_all(t, F.lit(_REFERENCE), F.lit(1))
        return F.when(t.contains("&"), join(F.split(t, _REFERENCE, -1), refs)).otherwise(t)

    return let(text, replaced)
