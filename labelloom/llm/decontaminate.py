"""Benchmark passages in training texts, found by spaced seeds.

A mask hashes the tokens at some positions of a window and ignores the others, so a substitution at an ignored
position leaves the hash as it is. Hashes of benchmark and training windows are joined; every hit names a diagonal
(training position minus benchmark position), on which the tokens themselves are compared.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import stored
from .common import checked_broadcast, let, words

# Fixed values: '1' is hashed, '0' ignored. Whatever two of twelve tokens are substituted, one of the masks still
# fits somewhere in the twelve (tests go through all cases).
MASKS = ("11101011", "101100111", "111111")
# An overlap is a stretch of WINDOW tokens on one diagonal of which at least MATCHES are equal; an item of fewer tokens
# must be there as a whole. One that is shorter than every mask has the mask of its own length.
WINDOW, MATCHES = 12, 10
SHORT_MASKS = tuple("1" * n for n in range(1, min(map(len, MASKS))))

# Rows up to which a table of benchmark hashes or of hit documents is sent to all executors.
BROADCAST_ROWS = 1_000_000


def token_hashes(text: Column) -> Column:
    """Hashes of the lower-case words."""
    return F.transform(words(F.lower(text)), lambda w: F.xxhash64(w))


def _seeds(df: DataFrame, keys: list[str], hashes: str, masks: Sequence[str] = MASKS) -> DataFrame:
    """``keys, pos, seed``: one row per mask and window position. The generators see plain longs, no arrays."""
    offsets = sorted({i for m in masks for i, c in enumerate(m) if c == "1"})
    span = max(len(m) for m in masks)
    # windows run to the last one that the shortest mask fits in; what is past the end is null and dropped
    n = F.size(hashes) - min(len(m) for m in masks) + 1
    padded = F.concat(F.col(hashes), F.array_repeat(F.lit(None).cast("long"), span))
    columns = [F.slice("__padded", i + 1, F.col("__n")).alias(f"c{i}") for i in offsets]
    table = df.select(*keys, padded.alias("__padded"), n.alias("__n")).filter("__n > 0")
    windows = table.select(*keys, F.inline(F.arrays_zip(F.sequence(F.lit(0), F.col("__n") - 1).alias("pos"), *columns)))
    windows = windows.toDF(*keys, "pos", *[f"c{i}" for i in offsets])
    seeds = []
    for m in masks:
        used = [F.col(f"c{i}") for i, c in enumerate(m) if c == "1"]
        seeds.append(F.when(used[-1].isNotNull(), F.xxhash64(F.lit(m), *used)))
    return windows.select(*keys, "pos", F.explode(F.array(*seeds)).alias("seed")).filter("seed IS NOT NULL")


def _equal(tokens: Column, hit: Column) -> Column:
    """For each token of the item, 1 if the document has it at its place on the diagonal, else 0."""
    return F.transform(hit["wanted"], lambda x, i: F.coalesce(F.get(tokens, i + hit["diagonal"]) == x, F.lit(False)).cast("int"))


def _overlap(same: Column) -> Column:
    """Whether a window has enough equal tokens; a short item is one window and needs all of its tokens."""
    width = F.least(F.size(same), F.lit(WINDOW))
    starts = F.sequence(F.lit(1), F.size(same) - width + 1)
    most = F.array_max(F.transform(starts, lambda s: F.aggregate(F.slice(same, s, width), F.lit(0), lambda a, x: a + x)))
    return most >= F.when(width < WINDOW, width).otherwise(MATCHES)


def _checksum(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


# Rows of one key are told apart by their texts: a key, or null, may stand for very many.
def _same() -> Column:
    return F.col("__key").eqNullSafe(F.col("__hit_key")) & (F.col("__sum") == F.col("__hit_sum"))


def _tokens(docs: DataFrame, key: str, text: str) -> DataFrame:
    body = F.col(text).cast("string")
    return docs.select(F.col(key).alias("__key"), _checksum(body).alias("__sum"), token_hashes(body).alias("__tokens"))


def _suspects(docs: DataFrame, benchmark: DataFrame, key: str, text: str, item: str, item_text: str) -> DataFrame:
    """``__hit_key, __hit_sum, __hits``: the diagonals on which a seed of a text with this key and checksum hits an item, with the item's tokens.

    The hashes of all windows are joined with those of the benchmark in the task that reads the text, as long as
    the benchmark has at most BROADCAST_ROWS hashes, and are shuffled beyond; only hits leave the task.
    """
    items = (
        benchmark.select(F.col(item).alias("__item"), token_hashes(F.col(item_text).cast("string")).alias("__tokens"))
        .filter(F.size("__tokens") > 0)
        .distinct()
    )
    items = stored(items, "benchmark_tokens")
    lengths = items.filter(F.size("__tokens") <= len(SHORT_MASKS)).select(F.size("__tokens").alias("n")).distinct()
    short = [SHORT_MASKS[r["n"] - 1] for r in lengths.collect()]
    seeds = _seeds(items, ["__item"], "__tokens")
    for m in short:
        seeds = seeds.unionByName(_seeds(items.filter(F.size("__tokens") == len(m)), ["__item"], "__tokens", [m]))
    seeds = seeds.select("__item", F.col("pos").alias("__pos"), "seed").distinct()
    seeds = checked_broadcast(stored(seeds, "benchmark_seeds"), BROADCAST_ROWS)
    tokens = _tokens(docs, key, text)
    found = _seeds(tokens, ["__key", "__sum"], "__tokens", [*MASKS, *short]).join(seeds, "seed")
    hits = found.select("__key", "__sum", "__item", (F.col("pos") - F.col("__pos")).alias("diagonal")).distinct()
    # an item id that stands for several texts is compared with each
    wanted = items.select(F.col("__item").alias("__wanted_item"), F.col("__tokens").alias("wanted"))
    by_doc = (
        hits.join(wanted, F.col("__item").eqNullSafe(F.col("__wanted_item")))
        .select("__key", "__sum", F.struct(F.col("__item").alias("item"), "diagonal", "wanted").alias("hit"))
        .groupBy(F.col("__key").alias("__hit_key"), F.col("__sum").alias("__hit_sum"))
        .agg(F.collect_list("hit").alias("__hits"))
    )
    return checked_broadcast(stored(by_doc, "benchmark_suspects"), BROADCAST_ROWS // 10)


def overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``key, item, matched, doc_start, item_start, length`` for every document and benchmark item that overlap.

    Tokens are lower-case words. An overlap has a window of WINDOW tokens with at least MATCHES equal ones; of the
    diagonals of a pair with such a window the one with the most equal tokens is returned, at ties the first.
    ``matched`` counts equal tokens on the diagonal, over ``length`` tokens that both texts have there. An item of
    fewer than WINDOW tokens overlaps where all of them are. Null and empty texts never overlap. Rows with the same key, null included, are one
    document's; a repeated item is reported once. Empty tables give no rows. Other columns are not read.
    """
    suspects = _tokens(docs, key, text).join(_suspects(docs, benchmark, key, text, item, item_text), _same())
    own = F.col("__tokens")
    compared = suspects.select("__key", F.explode(F.transform("__hits", lambda h: F.struct(h["item"].alias("item"), h["diagonal"].alias("diagonal"), F.size(h["wanted"]).alias("wanted"), F.size(own).alias("n"), _equal(own, h).alias("same")))).alias("o"))
    total = F.aggregate("o.same", F.lit(0), lambda a, x: a + x)
    first = F.greatest(-F.col("o.diagonal"), F.lit(0))
    length = F.least(F.col("o.wanted"), F.col("o.n") - F.col("o.diagonal")) - first
    verified = compared.filter(_overlap(F.col("o.same"))).select(
        "__key",
        F.col("o.item").alias("__item"),
        F.struct(
            total.cast("long").alias("matched"),
            (-first - F.col("o.diagonal")).cast("long").alias("minus_start"),
            first.cast("long").alias("item_start"),
            length.cast("long").alias("length"),
        ).alias("o"),
    )
    one = verified.groupBy("__key", "__item").agg(F.max("o").alias("o"))
    return one.select(
        F.col("__key").alias(key),
        F.col("__item").alias(item),
        F.col("o.matched").alias("matched"),
        (-F.col("o.minus_start")).alias("doc_start"),
        F.col("o.item_start").alias("item_start"),
        F.col("o.length").alias("length"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows whose text overlaps no benchmark item, with all their columns. Every row is judged by its own text, whatever its key."""
    suspects = _suspects(docs, benchmark, key, text, item, item_text)
    rows = docs.select(F.struct("*").alias("__row"), F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"))
    joined = rows.withColumn("__sum", _checksum(F.col("__text"))).join(suspects, _same(), "left")
    found = let(token_hashes(F.col("__text")), lambda t: F.exists("__hits", lambda h: _overlap(_equal(t, h))))
    kept = joined.filter(~F.when(F.col("__hits").isNotNull(), found).otherwise(False))
    return kept.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])
