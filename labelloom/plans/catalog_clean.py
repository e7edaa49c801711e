"""Queries over the cleaning steps and language identification, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.text import tokenize, truncate_tokens
from ..operators import gazetteer as G, clean as K, lang as L
from .inputs import deletes, documents, segments, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def words_sql(patterns, source: str = "SELECT doc_id, replace(text, chr(10), '|') AS t FROM documents") -> str:
    """Word cleaning by a dictionary of the distinct words, joined back to the texts."""
    return f"""
    WITH d AS ({source}),
    s AS (SELECT doc_id, unnest(string_split(lower(t), '|')) AS seg, generate_subscripts(string_split(lower(t), '|'), 1) AS si FROM d),
    w AS (SELECT doc_id, si, unnest(string_split(seg, ' ')) AS w, generate_subscripts(string_split(seg, ' '), 1) AS wi FROM s),
    v AS (SELECT w, ltrim({deletes('w', patterns)}) AS c FROM (SELECT DISTINCT w FROM w) x),
    k AS (SELECT doc_id, si, c, min(wi) AS wi FROM w JOIN v USING (w) WHERE c <> '' GROUP BY 1, 2, 3),
    g AS (SELECT doc_id, si, string_agg(c, ' ' ORDER BY wi) AS s FROM k GROUP BY 1, 2),
    r AS (SELECT doc_id, string_agg(s, ' ' ORDER BY si) AS clean FROM g GROUP BY 1)
    SELECT doc_id, coalesce(clean, '') AS clean FROM d LEFT JOIN r USING (doc_id)
    """


def markup_sql(extra=()) -> str:
    seg = "string_split(t, '|')"
    return f"""
    WITH d AS (SELECT doc_id, replace(text, chr(10), '|') AS t FROM documents),
    s AS (SELECT doc_id, unnest({seg}) AS s, generate_subscripts({seg}, 1) AS si FROM d),
    c AS (SELECT doc_id, si, {deletes('s', tuple(extra) + R.MARKUP + R.SHORT[:1])} AS c FROM s WHERE s <> ''),
    k AS (SELECT doc_id, c, min(si) AS si FROM c WHERE c <> '' GROUP BY 1, 2),
    r AS (SELECT doc_id, string_agg(c, '|' ORDER BY si) AS clean FROM k GROUP BY 1)
    SELECT doc_id, coalesce(clean, '') AS clean FROM d LEFT JOIN r USING (doc_id)
    """


def _cleaner(name: str, sql: str, fn) -> None:
    def run(spark, d):
        return segments(spark, d).select("doc_id", fn(F.col("text")).alias("clean"))

    QUERIES[name] = run
    ORACLES[name] = sql


_cleaner("strip_markup", markup_sql(), K.strip_markup)
_cleaner("stopword_strip", words_sql(R.word_rules()), K.stopword_strip)
_cleaner("strip_urls", words_sql(R.URL), K.strip_urls)
_cleaner("strip_email", words_sql(R.EMAIL), K.strip_email)
_cleaner("strip_zip", words_sql(R.ZIP), K.strip_zip)
_cleaner("strip_phone", words_sql(R.PHONE), K.strip_phone)
_cleaner("strip_dates", words_sql(R.DATES), K.strip_dates)
_cleaner("strip_website_words", words_sql(R.WEBSITES), K.strip_website_words)
_cleaner("strip_domain_words", words_sql(R.DOMAIN), K.strip_domain_words)
_cleaner("strip_numbers", words_sql(R.NUMBERS), K.strip_numbers)
_cleaner("strip_special", words_sql(R.SPECIAL), K.strip_special)
_cleaner("strip_short", words_sql(R.SHORT), K.strip_short)

# A user's rules: they run before the built-in ones.
CUSTOM = ((1, "pattern", r"license:?\s"), (2, "stopword", r"tion\w*"), (3, "stopword", r"^the$"), (4, "stopword", "ment"))


def custom_rules(spark, d):
    rules = K.read_rules(spark.createDataFrame(list(CUSTOM), "ord int, kind string, regex string"))
    return segments(spark, d).select("doc_id", K.clean_text(F.col("text"), rules).alias("clean"))


QUERIES["custom_rules"] = custom_rules
ORACLES["custom_rules"] = words_sql(
    tuple(r for _, kind, r in CUSTOM if kind == "stopword") + R.word_rules(),
    f"SELECT doc_id, clean AS t FROM ({markup_sql(tuple(r for _, kind, r in CUSTOM if kind == 'pattern'))}) m",
)


def whole_text_clean(spark, d):
    return documents(spark, d).select("doc_id", K.whole_text_clean(F.col("text")).alias("clean"))


QUERIES["whole_text_clean"] = whole_text_clean
_GAP = "regexp_replace({}, '[\\t-\\r\\x1c-\\x20\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]{{2,}}', ' ', 'g')"
_WHOLE = R.EMAIL + R.MARKUP + R.URL + R.ZIP + R.PHONE + R.DATES + R.WEBSITES + R.DOMAIN + R.NUMBERS + R.SPECIAL
ORACLES["whole_text_clean"] = f"""
    WITH a AS (SELECT doc_id, {_GAP.format("regexp_replace(regexp_replace(lower(text), '[\\r\\n]+|\\t+/', '', 'g'), '[|]+', ' ', 'g')")} AS t FROM documents),
    b AS (SELECT doc_id, {deletes('t', _WHOLE)} AS t FROM a)
    SELECT doc_id, {_GAP.format("CASE WHEN regexp_matches(t, '^\\.{0,3}$') THEN '' ELSE t END")} AS clean FROM b
"""

_TOKENS_SQL = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


def _tokens(spark, d):
    return documents(spark, d).select("doc_id", "lang", tokenize(F.col("text")).alias("tokens"))


QUERIES["tokenize"] = lambda spark, d: _tokens(spark, d).select(
    "doc_id", F.size("tokens").cast("bigint").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens")
)
ORACLES["tokenize"] = f"SELECT doc_id, len({_TOKENS_SQL}) AS n_tokens, array_to_string({_TOKENS_SQL}, ' ') AS tokens FROM documents"

QUERIES["truncate_tokens"] = lambda spark, d: _tokens(spark, d).select(
    "doc_id", F.array_join(truncate_tokens(F.col("tokens"), 512), " ").alias("tokens")
)
ORACLES["truncate_tokens"] = f"SELECT doc_id, array_to_string(list_slice({_TOKENS_SQL}, 1, 512), ' ') AS tokens FROM documents"

_EXPLODED_SQL = f"tok AS (SELECT doc_id, unnest({_TOKENS_SQL}) AS token, generate_subscripts({_TOKENS_SQL}, 1) AS pos FROM documents)"


def remove_gazetteer(spark, d):
    """The words of the benchmark texts play the part of the names."""
    names = table(spark, d, "benchmark").select(F.explode_outer(tokenize(F.col("text"))).alias("name"))
    return K.remove_gazetteer(_tokens(spark, d), names, "doc_id", "tokens")


QUERIES["remove_gazetteer"] = remove_gazetteer
ORACLES["remove_gazetteer"] = f"""
    WITH {_EXPLODED_SQL}, g AS (SELECT DISTINCT unnest({_TOKENS_SQL}) AS token FROM benchmark),
    r AS (SELECT doc_id, string_agg(token, ' ' ORDER BY pos) AS text FROM tok WHERE token NOT IN (SELECT token FROM g) GROUP BY 1)
    SELECT doc_id, coalesce(r.text, '') AS text FROM documents LEFT JOIN r USING (doc_id)
"""


# Names of one to four words: every fifth place of a benchmark text begins one.
_WIDTH = "1 + place % 4"


def remove_names(spark, d):
    """Passages of the benchmark texts play the part of names of several words."""
    toks = table(spark, d, "benchmark").select(tokenize(F.col("text")).alias("t"))
    starts = toks.select("t", F.explode(F.sequence(F.lit(0), F.size("t") - 1, F.lit(5))).alias("place"))
    names = starts.select(F.array_join(F.slice("t", F.col("place") + 1, F.expr(_WIDTH)), " ").alias("name"))
    return G.remove_names(_tokens(spark, d), names, "doc_id", "tokens")


QUERIES["remove_names"] = remove_names
ORACLES["remove_names"] = f"""
    WITH RECURSIVE {_EXPLODED_SQL},
    toks AS (SELECT doc_id, {_TOKENS_SQL} AS t FROM documents),
    b AS (SELECT {_TOKENS_SQL} AS t FROM benchmark),
    s AS (SELECT t, unnest(range(0, len(t), 5)) AS place FROM b),
    g AS (SELECT DISTINCT t[place + 1:place + {_WIDTH}] AS name FROM s),
    m AS MATERIALIZED (SELECT doc_id, pos, max(len(name)) AS width FROM tok JOIN toks USING (doc_id) JOIN g ON name[1] = token AND t[pos:pos + len(name) - 1] = name GROUP BY 1, 2),
    cut AS (
      SELECT doc_id, 0 AS pos, 1 AS until FROM toks
      UNION ALL
      SELECT doc_id, pos, until FROM (
        SELECT m.doc_id, m.pos, m.pos + width AS until, row_number() OVER (PARTITION BY m.doc_id ORDER BY m.pos) AS k
        FROM cut JOIN m ON m.doc_id = cut.doc_id AND m.pos >= cut.until) x WHERE k = 1),
    gone AS (SELECT doc_id, unnest(range(pos, until)) AS pos FROM cut WHERE pos > 0),
    r AS (SELECT doc_id, string_agg(token, ' ' ORDER BY pos) AS text FROM tok ANTI JOIN gone USING (doc_id, pos) GROUP BY 1)
    SELECT doc_id, coalesce(r.text, '') AS text FROM documents LEFT JOIN r USING (doc_id)
"""


def lemmatize_lookup(spark, d):
    """Dictionary derived from the benchmark words: a long word has its first five characters as lemma."""
    words = table(spark, d, "benchmark").select(F.explode_outer(tokenize(F.col("text"))).alias("token")).distinct()
    lemmas = words.filter(F.length("token") > 6).select("token", F.substring("token", 1, 5).alias("lemma"))
    return K.lemmatize_lookup(_tokens(spark, d), lemmas, "doc_id", "tokens")


QUERIES["lemmatize_lookup"] = lemmatize_lookup
ORACLES["lemmatize_lookup"] = f"""
    WITH {_EXPLODED_SQL}, g AS (SELECT DISTINCT unnest({_TOKENS_SQL}) AS token FROM benchmark),
    l AS (SELECT token, substr(token, 1, 5) AS lemma FROM g WHERE length(token) > 6),
    r AS (SELECT doc_id, string_agg(coalesce(lemma, token), ' ' ORDER BY pos) AS text FROM tok LEFT JOIN l USING (token) GROUP BY 1)
    SELECT doc_id, coalesce(r.text, '') AS text FROM documents LEFT JOIN r USING (doc_id)
"""


def detect_language(spark, d):
    """Profiles from all documents with a language, applied to all documents."""
    docs = documents(spark, d).select("doc_id", "lang", "text")
    model = L.train_language_model(docs, "text", "lang")
    return model.detect(docs, "text").select("doc_id", "lang_pred", F.round("lang_score", 6).alias("lang_score"))


QUERIES["detect_language"] = detect_language
DETECT_SQL = """
    WITH w AS (
      SELECT doc_id, lang, concat(' ', unnest(regexp_extract_all(lower(text), '\\p{L}+')), ' ') AS w FROM documents),
    g AS (SELECT doc_id, lang, substr(w, CAST(i AS BIGINT), 3) AS gram FROM (SELECT doc_id, lang, w, unnest(generate_series(1, length(w) - 2)) AS i FROM w) x),
    c AS (SELECT doc_id, lang, gram, count(*) AS n FROM g GROUP BY 1, 2, 3),
    train AS (SELECT * FROM c WHERE lang IS NOT NULL),
    vocab AS (SELECT DISTINCT gram FROM train),
    tl AS (SELECT lang, gram, sum(n) AS n FROM train GROUP BY 1, 2),
    langs AS (SELECT lang, count(*) AS docs FROM documents WHERE lang IS NOT NULL GROUP BY 1),
    prior AS (SELECT lang, ln((docs + 1.0) / ((SELECT sum(docs) FROM langs) + (SELECT count(*) FROM langs))) AS p FROM langs),
    tot AS (SELECT lang, coalesce(sum(n), 0) AS n FROM langs LEFT JOIN tl USING (lang) GROUP BY 1),
    theta AS (
      SELECT l.lang, v.gram, ln((coalesce(tl.n, 0) + 1.0) / (tot.n + (SELECT count(*) FROM vocab))) AS t
      FROM langs l CROSS JOIN vocab v JOIN tot ON tot.lang = l.lang LEFT JOIN tl ON tl.lang = l.lang AND tl.gram = v.gram),
    s AS (
      SELECT c.doc_id, th.lang, sum(c.n * th.t) + any_value(p.p) AS s, sum(c.n) AS n
      FROM c JOIN theta th USING (gram) JOIN prior p ON p.lang = th.lang GROUP BY 1, 2),
    best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, lang) = 1)
    SELECT d.doc_id, best.lang AS lang_pred, round(best.s / best.n, 6) AS lang_score FROM documents d LEFT JOIN best USING (doc_id)
"""
ORACLES["detect_language"] = DETECT_SQL

QUERIES["filter_language"] = lambda spark, d: K.filter_language(
    table(spark, d, "documents").select("doc_id", "lang", "text"), "lang", "de"
)
ORACLES["filter_language"] = "SELECT doc_id, lang, text FROM documents WHERE lang = 'de'"
