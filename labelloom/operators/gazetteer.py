"""Names of any number of words, deleted from token lists leftmost and longest first.

Names form a trie that is cut by its first two levels: a name of one word is found by its word, a longer one by its
first two words. A row looks up its distinct words and pairs of neighbours, so it gets back the few names that can
occur in it, whatever the length of the list; which of them do occur, and where, is decided in the row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.text import tokenize, unnest
from ..session import stored
from .tables import lookup_join

# Texts that a task holds as lists of words at a time.
ROWS_AT_ONCE = 256


def phrase_table(names: DataFrame) -> DataFrame:
    """``key, names``: for every first word or first pair of words the names, as word lists, that begin with it."""
    words = names.select(tokenize(F.col(names.columns[0])).alias("name")).filter("size(name) > 0").distinct()
    head = F.array_join(F.slice("name", 1, 2), " ")
    return words.groupBy(head.alias("key")).agg(F.collect_list("name").alias("names"))


def _heads(tokens: Column) -> Column:
    """Distinct words and pairs of neighbours of a row."""
    pairs = F.zip_with(F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, F.lit(2), F.size(tokens)), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(tokens, pairs))


def _without(tokens: list[str | None], names: list[list[str]]) -> str:
    """The tokens outside of the names, joined by blanks: leftmost first, of the names at a place the longest."""
    by_first: dict[str, list[list[str]]] = {}
    for n in sorted(names, key=len, reverse=True):
        by_first.setdefault(n[0], []).append(n)
    kept, at = [], 0
    while at < len(tokens):
        width = next((len(n) for n in by_first.get(tokens[at], ()) if tokens[at : at + len(n)] == n), 0)
        if not width and tokens[at] is not None:
            kept.append(tokens[at])
        at += width or 1
    return " ".join(kept)


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for i in range(0, whole.num_rows, ROWS_AT_ONCE):
            batch = whole.slice(i, ROWS_AT_ONCE)
            texts = map(_without, batch.column(1).to_pylist(), batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [batch.schema.names[0], "text"])


def remove_names(df: DataFrame, names: DataFrame, id_col: str, tokens: str) -> DataFrame:
    """``(id, text)``: the tokens that belong to no name of the one-column table ``names``, joined by blanks.

    Names are tokenised like texts. At every place the longest name counts, and none begins inside another. Null
    tokens give an empty text, null and empty names are no names. ``id_col`` is unique. The list may have any length.
    """
    table = stored(phrase_table(names), "phrases")
    rows = df.select(id_col, F.coalesce(F.col(tokens), F.array().cast("array<string>")).alias("toks"))
    hits = lookup_join(unnest(rows, [id_col], _heads(F.col("toks")), "key"), table, "key", "inner")
    # a group holds the names of one text
    by_row = hits.groupBy(id_col).agg(F.flatten(F.collect_list("names")).alias("names"))
    none = F.array().cast("array<array<string>>")
    joined = rows.join(by_row, id_col, "left").select(id_col, "toks", F.coalesce("names", none).alias("names"))
    return joined.mapInArrow(_cleaned, T.StructType([df.schema[id_col], T.StructField("text", T.StringType())]))
