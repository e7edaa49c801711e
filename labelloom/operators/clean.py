"""Rule cleaning of text. Everything is row-local and stays in the JVM."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import rules as R
from ..functions.patterns import any_of, needed_text, portable
from ..functions.text import let, unnest

# The same rule with a possessive run of plain characters: Java would otherwise
# recurse once per character and overflow its stack on a long text without ">".
_JAVA_TAG = R.TAG_RULE.replace("[^'\">])", "[^'\">]++)")
# Java also recurses once per quoted run. Beyond SAFE_QUOTES quotes in a segment the loop is possessive, which needs no
# stack; there a tag that ends only if a quote is read as the begin of another run stays.
_LONG_TAG = r"""<(?:"[^"]*+"['"]*+|'[^']*+'['"]*+|[^'">]++)++>"""
SAFE_QUOTES = 200
# Texts that a task holds as lists of words at a time.
ROWS_AT_ONCE = 256
# The rule for gaps: most characters are passed by one comparison instead of one for every range of white space.
GAP = R.MARKUP[4]
_JAVA_GAP = "(?![!-~])" + portable(GAP)
_SHORT_SEGMENT = portable(R.SHORT[0])
# What a rule of R.MARKUP needs to be found: one of its characters, its word, or a gap. Most characters fail the first test.
_MARKED = r"(?![!-;=-ce-z|}~ß-áã-ÿ])(?:[<{\n\x{a0}\x{e2}\x{80}\x{8b}\x{9d}\x{200b}]|dbx707|" + _JAVA_GAP + ")"


def _delete(text: Column, patterns) -> Column:
    for p in patterns:
        text = F.regexp_replace(text, _JAVA_GAP if p == GAP else portable(p), "")
    return text


def _delete_found(text: Column, patterns) -> Column:
    """The same for a long list of mostly plain rules that are rarely found.

    The rules are a constant array, folded over the text. A rule runs only where
    the text contains its plain part, so most of them cost one substring test.
    """
    table = F.array(*[F.struct(F.lit(needed_text(p)).alias("part"), F.lit(portable(p)).alias("rule")) for p in patterns])
    return F.aggregate(
        table, text, lambda t, r: F.when(F.contains(t, r.part), F.regexp_replace(t, r.rule, F.lit(""))).otherwise(t)
    )


def _delete_markup(segment: Column, extra) -> Column:
    before, after = R.MARKUP[:1], R.MARKUP[2:]
    text = _delete(segment, tuple(extra) + before)
    # deleting characters cannot create a bracket pair, so the test may look at the raw segment
    quotes = F.char_length(segment) - F.char_length(F.translate(segment, "\"'", ""))
    tags = F.when(quotes <= SAFE_QUOTES, F.regexp_replace(text, _JAVA_TAG, "")).otherwise(F.regexp_replace(text, _LONG_TAG, ""))
    text = F.when(segment.rlike("(?s)<.*>"), tags).otherwise(text)
    return _delete(text, after)


def strip_markup(text: Column, extra=()) -> Column:
    """Delete markup from every pipe-separated segment; drop short and repeated segments."""
    segments = F.filter(F.split(text, r"\|"), lambda s: (s != "") & (s != "\n"))

    def marked(segment: Column) -> Column:
        return F.when(segment.rlike(_MARKED), _delete_markup(segment, ())).otherwise(segment)

    # without user rules the test looks at the segment itself
    one = (lambda s: let(_delete(s, extra), marked)) if extra else marked
    cleaned = F.transform(segments, lambda s: F.regexp_replace(one(s), _SHORT_SEGMENT, ""))
    return F.array_join(F.array_distinct(F.filter(cleaned, lambda s: s != "")), "|")


def _word_segments(text: Column, clean_words) -> Column:
    """Apply ``clean_words`` (array to array) to the distinct words of every segment."""

    def one(segment: Column) -> Column:
        words = clean_words(F.array_distinct(F.split(segment, " ")))
        return F.array_join(F.array_distinct(F.filter(words, lambda w: w != "")), " ")

    return F.array_join(F.filter(F.transform(F.split(F.lower(text), r"\|"), one), lambda s: s != ""), " ")


def strip_words(text: Column, patterns) -> Column:
    """Delete the given word rules, in order, from every lower-case word."""
    if len(patterns) > 8:
        # a word that contains no stem of any rule meets none of them
        stems = any_of(patterns)
        return _word_segments(
            text, lambda words: F.transform(words, lambda w: F.ltrim(F.when(w.rlike(stems), _delete_found(w, patterns)).otherwise(w)))
        )
    return _word_segments(text, lambda words: F.transform(words, lambda w: F.ltrim(_delete(w, patterns))))


def stopword_strip(text: Column, extra=(), compat: bool = False) -> Column:
    """All word rules in order, the user's rules first.

    Most words meet no rule, so each step tests before it runs its rules. A word
    of plain letters can only meet the two ``www`` rules of the first step; one
    without digit, bracket, slash or at sign can also meet the special-character
    rule, but no other. The second step first tests a whole segment for any stem
    of the website and industry lists, then its words.
    """
    first = R.URL + R.EMAIL + R.ZIP + R.PHONE + R.DATES + R.NUMBERS + R.SPECIAL
    second = R.website_rules(compat) + R.DOMAIN
    stems = any_of(second)

    def clean(words: Column) -> Column:
        if extra:
            words = F.transform(words, lambda w: _delete(w, extra))
        words = F.transform(
            words,
            lambda w: F.when(w.rlike(r"^[a-zäöüß]*\z") & ~w.contains("www"), w)
            .when(~w.rlike(r"[\p{Nd}@/(\[ ]|www"), _delete(w, R.SPECIAL))
            .otherwise(_delete(w, first)),
        )
        words = let(
            words,
            lambda ws: F.when(
                F.array_join(ws, " ").rlike(stems),
                F.transform(ws, lambda w: F.when(w.rlike(stems), _delete_found(w, second)).otherwise(w)),
            ).otherwise(ws),
        )
        return F.transform(
            words, lambda w: F.ltrim(F.when(F.length(w) > 3, w).otherwise(F.regexp_replace(w, portable(R.SHORT[0]), "")))
        )

    return _word_segments(text, clean)


def strip_urls(text: Column) -> Column:
    return strip_words(text, R.URL)


def strip_email(text: Column) -> Column:
    return strip_words(text, R.EMAIL)


def strip_zip(text: Column) -> Column:
    return strip_words(text, R.ZIP)


def strip_phone(text: Column) -> Column:
    return strip_words(text, R.PHONE)


def strip_dates(text: Column) -> Column:
    return strip_words(text, R.DATES)


def strip_website_words(text: Column, compat: bool = False) -> Column:
    return strip_words(text, R.website_rules(compat))


def strip_domain_words(text: Column) -> Column:
    return strip_words(text, R.DOMAIN)


def strip_numbers(text: Column) -> Column:
    return strip_words(text, R.NUMBERS)


def strip_special(text: Column) -> Column:
    return strip_words(text, R.SPECIAL)


def strip_short(text: Column) -> Column:
    return strip_words(text, R.SHORT)


def read_rules(rules: DataFrame, max_rules: int = 5_000) -> dict[str, tuple[str, ...]]:
    """User rules ``(ord, kind, regex)`` by kind, in order. Rules become part of the plan, so their number is checked."""
    rows = rules.orderBy("ord").limit(max_rules + 1).collect()
    if len(rows) > max_rules:
        raise ValueError(f"more than {max_rules} rules")
    return {kind: tuple(r["regex"] for r in rows if r["kind"] == kind) for kind in ("pattern", "stopword")}


def clean_text(text: Column, rules: dict[str, tuple[str, ...]] | None = None, compat: bool = False) -> Column:
    """Markup, then words; the user's rules run before the built-in ones in both steps."""
    rules = rules or {}
    return stopword_strip(strip_markup(text, rules.get("pattern", ())), rules.get("stopword", ()), compat)


def whole_text_clean(text: Column) -> Column:
    """Variant that runs the rules over the whole lower-case text instead of single words."""
    first, last = R.URL + R.ZIP + R.PHONE + R.DATES, R.NUMBERS + R.SPECIAL

    def clean(raw: Column) -> Column:
        flat = F.regexp_replace(raw, r"\r+|\n+|\t+/", "")
        flat = F.regexp_replace(F.regexp_replace(flat, r"\|+", " "), _JAVA_GAP, " ")
        flat = _delete(_delete_markup(_delete(flat, R.EMAIL), ()), first)
        flat = _delete(_delete_found(flat, R.WEBSITES + R.DOMAIN), last)
        return F.regexp_replace(F.regexp_replace(flat, r"^\.{0,3}\z", ""), _JAVA_GAP, " ")

    # bound in a lambda: the chain copies its input, and as generated code it would be larger than a Java method may be
    return let(F.lower(text), clean)


def remove_gazetteer(df: DataFrame, gazetteer: DataFrame, id_col: str, tokens: str, max_inline: int = 50_000) -> DataFrame:
    """Drop tokens that are names of the one-column gazetteer; returns ``(id, text)``.

    Up to ``max_inline`` names become a hash set inside the plan and no row
    moves. A longer gazetteer is joined: only the distinct tokens of a row are
    looked up, and each row gets back the short list of names it contains.
    """
    from .tables import join_hot_aware

    name = gazetteer.columns[0]
    names = gazetteer.select(F.lower(name).alias("token")).distinct()
    head = names.limit(max_inline + 1).collect()
    if len(head) <= max_inline:
        words = ", ".join("'" + r["token"].replace("\\", "\\\\").replace("'", "\\'") + "'" for r in head if r["token"] is not None)
        kept = F.expr(f"filter(`{tokens}`, t -> t NOT IN ({words}))") if words else F.col(tokens)
        return df.select(id_col, F.array_join(kept, " ").alias("text"))
    found = join_hot_aware(
        unnest(df, [id_col], F.array_distinct(tokens), "token"), names, "token", "left_semi"
    )
    hits = found.groupBy(id_col).agg(F.collect_set("token").alias("hits"))
    return (
        df.select(id_col, tokens)
        .join(hits, id_col, "left")
        .select(
            id_col,
            F.array_join(
                F.when(F.col("hits").isNull(), F.col(tokens)).otherwise(
                    F.filter(F.col(tokens), lambda t: ~F.array_contains("hits", t))
                ),
                " ",
            ).alias("text"),
        )
    )


def _replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of the rows: each word, or its lemma if the entries of the row have one."""
    for whole in batches:
        for i in range(0, whole.num_rows, ROWS_AT_ONCE):
            batch = whole.slice(i, ROWS_AT_ONCE)
            texts = []
            for words, entries in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                lemma = {e["token"]: e["lemma"] for e in entries}
                texts.append(" ".join([lemma.get(w, w) for w in words if w is not None]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [batch.schema.names[0], "text"])


def lemmatize_lookup(df: DataFrame, lemmas: DataFrame, id_col: str, tokens: str) -> DataFrame:
    """Replace tokens by the lemma of a ``(token, lemma)`` dictionary; returns ``(id, text)``.

    A row looks up its distinct tokens and gets back the entries it needs, so no token moves with its place.
    """
    from .tables import lookup_join

    rows = df.select(id_col, F.coalesce(F.col(tokens), F.array().cast("array<string>")).alias("toks"))
    entries = lemmas.select("token", F.struct("token", "lemma").alias("entry")).filter("entry.lemma IS NOT NULL")
    found = lookup_join(unnest(rows, [id_col], F.array_distinct("toks"), "token"), entries, "token", "inner", max_rows=500_000)
    # a group holds the entries of one text
    by_row = found.groupBy(id_col).agg(F.collect_list("entry").alias("entries"))
    none = F.array().cast("array<struct<token:string,lemma:string>>")
    joined = rows.join(by_row, id_col, "left").select(id_col, "toks", F.coalesce("entries", none).alias("entries"))
    return joined.mapInArrow(_replaced, T.StructType([df.schema[id_col], T.StructField("text", T.StringType())]))


def filter_language(df: DataFrame, lang_col: str, lang: str | None) -> DataFrame:
    """Rows in the wanted language; no language means no filter."""
    return df if lang is None else df.filter(F.col(lang_col) == lang)
