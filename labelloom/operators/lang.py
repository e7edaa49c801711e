"""Language identification by character trigrams.

The profile of a language is the multinomial distribution of its trigrams, as a table by trigram with one
log-probability per language. Texts look up the distinct trigrams they hold: the profile is broadcast while it is
small, and joined with frequent trigrams apart beyond that. No trigram is left out on either side.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import term_counts, unnest
from ..session import stored
from .tables import join_hot_aware

# A profile of so many trigrams is broadcast.
BROADCAST_GRAMS = 100_000


def trigrams(text: Column) -> Column:
    """Trigrams of the lower-case words, each word framed by blanks.

    A look-ahead matches at every position without consuming it, so one call
    returns the overlapping trigrams. Their middle is a letter: none spans two words.
    """
    framed = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "), F.lit(" "))
    return F.regexp_extract_all(framed, F.lit(r"(?=([ \p{L}]\p{L}[ \p{L}]))"), F.lit(1))


def _text_key(text: Column) -> Column:
    """Equal texts have equal languages, so a text is its own key."""
    return F.md5(F.coalesce(text, F.lit("")))


def _counted(df: DataFrame, keep: list, text: str) -> DataFrame:
    """``keep`` columns, ``gram`` and ``n``: the distinct trigrams of each row, counted inside the row."""
    rows = unnest(df, keep, term_counts(trigrams(F.col(text))), "e")
    return rows.select(*[c for c in rows.columns if c != "e"], F.col("e.term").alias("gram"), F.col("e.n").alias("n"))


def _occurring(df: DataFrame, keep: list, text: str) -> DataFrame:
    """The same with a row for every trigram that occurs, ``n`` is 1: sums over it need no sort in the row."""
    return unnest(df, keep, trigrams(F.col(text)), "gram").withColumn("n", F.lit(1))


@dataclass(frozen=True)
class LanguageModel:
    """``profile``: ``gram, logs``, the log-probabilities in the order of ``languages``; ``priors``: theirs."""

    languages: tuple[str, ...]
    priors: tuple[float, ...]
    profile: DataFrame

    def detect(self, df: DataFrame, text: str, out: str = "lang_pred") -> DataFrame:
        """Add the best language (ties: the first) and its mean log-probability per known trigram; null without any."""
        k = len(self.languages)
        keyed = df.withColumn("_key", _text_key(F.col(text)))
        if self.profile.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS:
            known = _occurring(keyed, [F.col("_key")], text).join(F.broadcast(self.profile), "gram")
        else:
            # rows that move are worth the sort that makes them few
            known = join_hot_aware(_counted(keyed, ["_key"], text), self.profile, "gram", "inner")
        # a text's trigrams are in one task still, so its sums combine before the shuffle; copies add up alike
        sums = known.groupBy("_key").agg(
            F.array(*[F.sum(F.col("n") * F.get("logs", F.lit(i))) for i in range(k)]).alias("s"), F.sum("n").alias("grams")
        )
        copies = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("copies"))
        priors = F.array(*[F.lit(p) for p in self.priors])
        total = F.zip_with(F.transform("s", lambda x: x / F.col("copies")), priors, lambda a, b: a + b)
        names = F.array(*[F.lit(x) for x in self.languages])
        scored = sums.join(copies, "_key").select("_key", (F.col("grams") / F.col("copies")).alias("g"), total.alias("s"))
        best = scored.select(
            "_key",
            F.get(names, F.array_position("s", F.array_max("s")).cast("int") - 1).alias(out),
            (F.array_max("s") / F.col("g")).alias("lang_score"),
        )
        best = stored(best, "languages")
        return join_hot_aware(keyed, best, "_key", "left", counts=copies.withColumnRenamed("copies", "n")).drop("_key")


def train_language_model(df: DataFrame, text: str, lang: str) -> LanguageModel:
    """Profiles of all languages of ``lang`` (rows without one are not used) over all their trigrams, add-one smoothing."""
    rows = df.filter(F.col(lang).isNotNull())
    docs = {r[lang]: r["n"] for r in rows.groupBy(lang).agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = tuple(sorted(docs))
    counts = stored(_occurring(rows, [F.col(lang).alias("l")], text).groupBy("l", "gram").agg(F.sum("n").alias("n")), "language_counts")
    totals = {r["l"]: r["n"] for r in counts.groupBy("l").agg(F.sum("n").alias("n")).collect()}
    vocabulary = counts.select("gram").distinct().count()
    per_language = [F.coalesce(F.sum(F.when(F.col("l") == x, F.col("n"))), F.lit(0)) for x in languages]
    logs = [F.log((c + 1.0) / float(totals.get(x, 0) + vocabulary)) for c, x in zip(per_language, languages)]
    whole = sum(docs.values()) + len(docs)
    priors = tuple(math.log((docs[x] + 1.0) / whole) for x in languages)
    if not languages:
        logs = [F.lit(0.0)]
    return LanguageModel(languages, priors, stored(counts.groupBy("gram").agg(F.array(*logs).alias("logs")), "language_profile"))
