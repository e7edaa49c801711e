"""Spelling variants: words one edit apart, found by asymmetric chunks, and the frequent form that each of them follows.

Of two words one edit apart the longer one (of equal ones the first) gives two disjoint chunks, its halves; one edit
leaves one of them whole. The other word gives its grams of that length at every position where such a chunk can
lie: at the same one, or one to the left behind a deletion. The half that holds the edit is again two chunks of which
one is whole, so a chunk is joined together with the whole part of the other half; what meets is then verified.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import stored

# Fixed values of the contract: a word is a run of these letters; only A-Z have a lower case.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS, MIN_COUNT, RATIO = 6, 5, 5

QUARTERS = 4


def runs(text: Column) -> Column:
    """The lower-cased runs of letters of a text; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(f"({RUN})"))


def with_slips(df: DataFrame, key: str, word: str, every: int) -> DataFrame:
    """Delete one letter of a word where ``every`` divides the checksum of ``<key>:<word>``; a null key counts as empty."""
    h = F.crc32(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.col(word)).cast("binary"))
    at = (F.col("__h") % F.length(word)).cast("int")
    cut = F.concat(F.substring(word, 1, at), F.substring(F.col(word), at + 2, F.length(word)))
    return df.withColumn("__h", h).withColumn(word, F.when(F.col("__h") % every == 0, cut).otherwise(F.col(word))).drop("__h")


def count_words(df: DataFrame, key: str = "doc_id", text: str = "text", slips: int | None = None, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n``: the words of at least ``min_chars`` code points that occur at least ``min_count`` times in all texts.

    Counts are summed in every task before the shuffle. Null and empty texts have no words; other columns are not read.
    """
    # the outer form keeps Catalyst from computing the array once more to test its size
    words = df.select(F.col(key).alias("__key"), F.explode_outer(runs(F.col(text).cast("string"))).alias("word"))
    if slips:
        words = with_slips(words, "__key", "word", slips)
    counted = words.filter(F.length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= min_count)


def _bound(length: Column, k: int) -> Column:
    return F.floor(length * k / QUARTERS).cast("int")


def _without(word: Column, length: Column, k: int, shift: int) -> Column:
    """The word without quarter ``k`` of a word of ``length``; what follows lies ``shift`` to the left."""
    return F.concat(F.substring(word, F.lit(1), _bound(length, k)), F.substring(word, _bound(length, k + 1) + 1 - shift, F.length(word)))


def _joinable(words: DataFrame, shifts: Sequence[int], names: tuple[str, str]) -> DataFrame:
    """``key, part`` of every way in which a chunk and the whole part of the other half can be kept, with the word."""
    word = F.col("word")
    keys = []
    for shift in shifts:
        longer = F.length(word) + shift
        for k in range(QUARTERS):
            keys.append(F.struct(F.xxhash64(longer, F.lit(k), _without(word, longer, k, shift)).alias("key"), F.lit(k).alias("part")))
    # the outer form again: the keys are computed once
    out = words.select(word.alias(names[0]), F.col("n").alias(names[1]), F.explode_outer(F.array(*keys)).alias("k"))
    return out.select(*names, F.col("k.key").alias("key"), F.col("k.part").alias("part"))


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, a_n, b, b_n``: every pair of words that differ by exactly one inserted, deleted or replaced code point, once.

    A key holds the length and three quarters of the longer word, so few words meet; a hash that two keys share is
    undone by the verification. A pair counts at the quarter of its first difference only, so none is found twice.
    """
    chunks = _joinable(words, (0,), ("a", "a_n"))
    grams = _joinable(words, (0, 1), ("b", "b_n"))
    end = _bound(F.length("a"), QUARTERS)
    for k in range(QUARTERS):
        end = F.when(F.col("part") == k, _bound(F.length("a"), k + 1)).otherwise(end)
    once = (F.length("a") > F.length("b")) | (F.col("a") < F.col("b"))
    first = F.substring(F.col("a"), F.lit(1), end) != F.substring(F.col("b"), F.lit(1), end)
    met = chunks.join(grams, ["key", "part"]).filter(once & first)
    return met.filter(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``: the last word when forms are followed. Every round doubles the steps taken.

    A form is several times as frequent as its word, so chains are as short as the logarithm of the largest count.
    """
    at = stored(forms.select("word", F.col("form").alias("root")), "spelling_roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        step = at.join(further, "root", "left").select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved"))
        step = stored(step, "spelling_roots")
        at = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return at


def group_variants(words: DataFrame, ratio: float = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of ``word, n`` (distinct words).

    ``form``: the near word of largest n, of equal ones the smallest in code-point order, if its n is at least
    ``ratio`` times the word's; else null, as is ``form_n``. ``root``: the last word when forms are followed, the word
    itself without one. An empty table gives no rows.
    """
    words = stored(words.select("word", F.col("n").cast("long").alias("n")), "spelling_words")
    pairs = stored(near_pairs(words), "spelling_pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n"))
    both = both.unionAll(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = F.min(F.struct((-F.col("near_n")).alias("minus_n"), "near"))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    formed = F.col("n_near").isNotNull() & (-F.col("best.minus_n") >= F.col("n") * ratio)
    out = words.join(near, "word", "left").select(
        "word",
        F.when(formed, F.col("best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(formed, -F.col("best.minus_n")).alias("form_n"),
    )
    out = stored(out, "spelling_forms")
    last = roots(out.filter("form IS NOT NULL"))
    return out.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(df: DataFrame, key: str = "doc_id", text: str = "text", slips: int | None = None, **options) -> DataFrame:
    """Spelling variants of all words of a table of texts: ``count_words``, then ``group_variants``.

    Null and empty texts add no word. A repeated row counts again. Very long words are joined by hashes of their
    parts. Columns besides ``key`` and ``text`` are not read, so their names cannot clash.
    """
    return group_variants(count_words(df, key, text, slips, **options))
