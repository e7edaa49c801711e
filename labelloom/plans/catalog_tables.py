"""Queries over sources, seeds, pages, frontier and stage tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import BLOCKED_MARKERS, JOURNALS, JOURNAL_TOPICS, LINK_BLACKLIST, RESULT_BLACKLIST
from ..functions.patterns import any_literal
from ..functions.text import unnest_with_position
from ..operators import seeds as S, tables as T, web as W
from ..schemas import RAW_TEXTS
from ..session import scratch_path
from ..sources import corpus as C
from .inputs import (
    SHEET_SQL, annotated, documents, documents_url, pages, quoted, seed_sheet, spread, table,
)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("read_corpus", "SELECT doc_id, lang, source, n_chars, text FROM documents")
def _(spark, d):
    return C.read_corpus(spark, f"{d}/documents.parquet").select("doc_id", "lang", "source", "n_chars", "text")


@query(
    "read_items_json",
    "SELECT lang AS CLASS, source AS KEYWORD, concat(source, '.example') AS DOMAIN, md5(text) AS URL, text AS URL_TEXT FROM documents",
)
def _(spark, d):
    items = documents(spark, d).select(
        F.col("lang").alias("CLASS"), F.col("source").alias("KEYWORD"), F.concat("source", F.lit(".example")).alias("DOMAIN"),
        F.md5("text").alias("URL"), F.col("text").alias("URL_TEXT"),
    )
    path = scratch_path(spark, "items")
    items.write.json(path)
    return C.read_items_json(spark, path, RAW_TEXTS)


@query("write_table", "SELECT doc_id, lang, n_chars FROM documents WHERE lang IN ('en', 'de')")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    path = scratch_path(spark, "stage")
    C.write_table(docs.filter("lang IN ('en', 'fr')"), path)
    C.write_table(docs.filter("lang = 'de'"), path, "append")
    # an overwrite that reads its own target
    C.write_table(spark.read.parquet(path).filter("lang <> 'fr'"), path)
    return spark.read.parquet(path)


@query(
    "dataset_profile",
    """
    WITH u AS (
      SELECT 'documents' AS stage, lang AS c, md5(text) AS u FROM documents
      UNION ALL SELECT 'pages', split_part(url, '/', 4), url FROM pages
      UNION ALL SELECT 'conversations', role, md5(text) FROM conversations)
    SELECT stage, count(*) AS n_rows, count(DISTINCT c) AS n_classes, count(*) - count(DISTINCT u) AS n_duplicates,
           (SELECT string_agg(c, ',' ORDER BY c) FROM (SELECT DISTINCT stage, c FROM u) v WHERE v.stage = u.stage) AS classes
    FROM u GROUP BY stage
    """,
)
def _(spark, d):
    talk = table(spark, d, "conversations").select(F.col("role").alias("CLASS"), F.md5("text").alias("url"))
    docs = documents_url(spark, d).select(F.col("lang").alias("CLASS"), "url")
    return C.dataset_profile({"documents": docs, "pages": pages(spark, d), "conversations": talk}, "CLASS", "url")


@query(
    "seed_normalise",
    f"""
    WITH s AS ({SHEET_SQL})
    SELECT 'url' AS kind, CLASS_K AS CLASS, KEYWORD, URL_EN AS URL FROM s WHERE CLASS_K IS NOT NULL AND KEYWORD IS NOT NULL AND URL_EN IS NOT NULL
    UNION ALL SELECT 'keyword', CLASS, KEYWORD_EN, NULL FROM s WHERE CLASS IS NOT NULL AND KEYWORD_EN IS NOT NULL
    UNION ALL SELECT 'centroid', KMEANS_CLASS, NULL, KMEANS_URL FROM s WHERE KMEANS_CLASS IS NOT NULL AND KMEANS_LANG = 'en'
    """,
)
def _(spark, d):
    sheet = seed_sheet(spark, d)
    none = F.lit(None).cast("string")
    return T.union_rows(
        S.url_seeds(sheet, "en").select(F.lit("url").alias("kind"), "CLASS", "KEYWORD", "URL"),
        S.keyword_seeds(sheet, "en").select(F.lit("keyword").alias("kind"), "CLASS", "KEYWORD", none.alias("URL")),
        S.centroid_seeds(sheet, "en").select(F.lit("centroid").alias("kind"), "CLASS", none.alias("KEYWORD"), "URL"),
    )


# Links of all pages. The stored pages only have root-relative links.
LINKS_SQL = """
    lnk AS (
      SELECT page_id, CLASS, KEYWORD, link, row_number() OVER (PARTITION BY page_id ORDER BY first_pos) - 1 AS pos
      FROM (
        SELECT page_id, CLASS, KEYWORD, link, min(p) AS first_pos
        FROM (
          SELECT page_id, split_part(url, '/', 4) AS CLASS, split_part(url, '/', 3) AS KEYWORD,
                 concat(regexp_extract(url, '^(https?://[^/]+)', 1), unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1))) AS link,
                 generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) AS p
          FROM pages) h
        GROUP BY ALL) m)
"""


def links(spark, d):
    p = pages(spark, d)
    found = unnest_with_position(p, ["page_id", "CLASS", "KEYWORD"], W.page_links(F.col("html"), F.col("url")), "pos", "link")
    return found.withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "seed_union",
    f"""
    WITH s AS ({SHEET_SQL}), {LINKS_SQL}
    SELECT CLASS_K AS CLASS, KEYWORD, URL_EN AS URL FROM s WHERE URL_EN IS NOT NULL
    UNION ALL SELECT CLASS, KEYWORD, link FROM lnk
    """,
)
def _(spark, d):
    hits = pages(spark, d).select("CLASS", "KEYWORD", W.page_links(F.col("html"), F.col("url")).alias("hits"))
    return S.seed_union(S.url_seeds(seed_sheet(spark, d), "en"), S.explode_hits(hits, "hits"))


_RESULT_SQL = " AND ".join(["regexp_matches(link, '^https?://')", f"NOT regexp_matches(link, {quoted('|'.join(RESULT_BLACKLIST))})"])


@query("result_filter", f"WITH {LINKS_SQL} SELECT page_id, pos, link FROM lnk WHERE {_RESULT_SQL}")
def _(spark, d):
    return S.result_filter(links(spark, d), "link").select("page_id", "pos", "link")


@query(
    "top_n_links",
    f"""
    WITH {LINKS_SQL}, ok AS (SELECT * FROM lnk WHERE {_RESULT_SQL})
    SELECT KEYWORD, page_id, pos, link FROM ok QUALIFY row_number() OVER (PARTITION BY KEYWORD ORDER BY page_id, pos) <= 10
    """,
)
def _(spark, d):
    hits = S.result_filter(links(spark, d), "link").select("KEYWORD", "page_id", "pos", "link")
    return S.top_n_links(hits, "KEYWORD", ["page_id", "pos"], 10)


@query(
    "explode_hits",
    f"""
    WITH {LINKS_SQL}, ok AS (SELECT * FROM lnk WHERE {_RESULT_SQL})
    SELECT p.page_id, split_part(p.url, '/', 3) AS KEYWORD, ok.link AS URL FROM pages p LEFT JOIN ok USING (page_id)
    """,
)
def _(spark, d):
    hits = F.filter(W.page_links(F.col("html"), F.col("url")), S.is_result_link)
    return S.explode_hits(pages(spark, d).select("page_id", "KEYWORD", hits.alias("hits")), "hits")


@query(
    "html_body_text",
    r"""
    WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<script.*?</script\s*>|<style.*?</style\s*>', '', 'g') AS h FROM pages),
    b AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?is)^.*?<body[^>]*>', ''), '(?is)</body\s*>.*$', '') AS h FROM a),
    n AS (SELECT page_id, list_filter(regexp_split_to_array(h, '<[^>]*>'), lambda x: x <> '') AS n FROM b)
    SELECT page_id,
      replace(replace(replace(replace(array_to_string(n, '|'), '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&amp;', '&') AS text FROM n
    """,
)
def _(spark, d):
    return pages(spark, d).select("page_id", W.html_body_text(F.col("html")).alias("text"))


_MARKERS = (*BLOCKED_MARKERS, "license")


@query(
    "blocked_page_blank",
    f"SELECT doc_id, CASE WHEN regexp_matches(lower(text), '{any_literal(_MARKERS)}') THEN '' ELSE text END AS text FROM documents",
)
def _(spark, d):
    return documents(spark, d).select("doc_id", W.blocked_page_blank(F.col("text"), _MARKERS).alias("text"))


@query("link_extract", f"WITH {LINKS_SQL} SELECT page_id, pos, link FROM lnk")
def _(spark, d):
    found = W.link_extract(pages(spark, d), "page_id", "url", "html")
    return found.withColumn("pos", F.col("pos").cast("bigint"))


@query("domain_of", f"WITH {LINKS_SQL} SELECT page_id, pos, split_part(link, '/', 3) AS domain FROM lnk")
def _(spark, d):
    return links(spark, d).select("page_id", "pos", W.domain_of(F.col("link")).alias("domain"))


@query(
    "link_blacklist",
    f"WITH {LINKS_SQL} SELECT page_id, pos, link FROM lnk WHERE NOT ("
    + " OR ".join(f"contains(lower(link), {quoted(w)})" for w in LINK_BLACKLIST) + ")",
)
def _(spark, d):
    return W.link_blacklist(links(spark, d), "link").select("page_id", "pos", "link")


_JOURNAL = "CASE WHEN CLASS = 'de' THEN concat('https://www.welt.de/', split_part(link, '/', 4)) ELSE link END"


@query(
    "journal_rule",
    f"WITH {LINKS_SQL}, j AS (SELECT page_id, pos, {_JOURNAL} AS link FROM lnk) SELECT * FROM j WHERE NOT (("
    + " OR ".join(f"contains(lower(link), {quoted(w)})" for w in JOURNALS) + ") AND NOT ("
    + " OR ".join(f"contains(lower(link), {quoted(w)})" for w in JOURNAL_TOPICS) + "))",
)
def _(spark, d):
    return W.journal_rule(links(spark, d).selectExpr("page_id", "pos", f"{_JOURNAL} AS link"), "link")


@query(
    "allowed_domains",
    f"""
    WITH {LINKS_SQL}, s AS (SELECT DISTINCT lower(split_part(url, '/', 3)) AS h FROM pages WHERE url LIKE 'https:%'),
    h AS (SELECT DISTINCT KEYWORD FROM lnk
          WHERE EXISTS (SELECT 1 FROM s WHERE lower(KEYWORD) = s.h OR ends_with(lower(KEYWORD), concat('.', s.h))))
    SELECT page_id, pos, link FROM lnk WHERE KEYWORD IN (SELECT KEYWORD FROM h)
    """,
)
def _(spark, d):
    seeds = table(spark, d, "pages").filter("url LIKE 'https:%'").select("url")
    return W.allowed_domains(links(spark, d).select("page_id", "pos", "link"), seeds, "link", "url")


@query(
    "visited_skip",
    "SELECT doc_id, md5(text) AS link FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents JOIN labels USING (doc_id))",
)
def _(spark, d):
    docs = documents_url(spark, d).select("doc_id", F.col("url").alias("link"))
    visited = docs.join(table(spark, d, "labels"), "doc_id", "left_semi")
    return W.visited_skip(docs, visited, "link", "link")


@query(
    "crawl_frontier_bfs",
    """
    WITH RECURSIVE e AS (
      SELECT p.page_id AS src, unnest([2 * p.page_id + 1, 2 * p.page_id + 2]) AS dst FROM pages p),
    e2 AS (SELECT src, dst FROM e WHERE dst IN (SELECT page_id FROM pages)),
    r AS (
      SELECT page_id AS url, 0 AS depth, split_part(url, '/', 4) AS CLASS, split_part(url, '/', 3) AS KEYWORD
      FROM pages WHERE split_part(url, '/', 4) = 'de'
      UNION ALL
      SELECT dst, depth + 1, CLASS, KEYWORD FROM r JOIN e2 ON e2.src = r.url WHERE depth < 3)
    SELECT url, depth, CLASS, KEYWORD FROM r
    QUALIFY row_number() OVER (PARTITION BY url ORDER BY depth, CLASS, KEYWORD) = 1
    """,
)
def _(spark, d):
    p = pages(spark, d).drop("html")
    edges = p.select(F.col("page_id").alias("src"), F.explode(F.expr("array(2 * page_id + 1, 2 * page_id + 2)")).alias("dst"))
    edges = edges.join(p.select(F.col("page_id").alias("dst")), "dst", "left_semi").select("src", "dst")
    seeds = p.filter("CLASS = 'de'").select(F.col("page_id").alias("url"), "CLASS", "KEYWORD")
    return W.crawl_frontier_bfs(seeds, edges, 3)


_MERGE_SQL = """
    WITH o AS (SELECT 0 AS s, doc_id, md5(text) AS url, lang, n_chars FROM documents JOIN labels USING (doc_id)
      UNION ALL SELECT 1, doc_id, md5(text), lang, n_chars FROM documents)
    SELECT doc_id, url, lang, n_chars FROM o QUALIFY row_number() OVER (PARTITION BY url ORDER BY s, doc_id) = 1
"""


@query("merge_crawl", _MERGE_SQL)
def _(spark, d):
    new = documents_url(spark, d).select("doc_id", "url", "lang", "n_chars")
    old = new.join(table(spark, d, "labels"), "doc_id", "left_semi")
    return W.merge_crawl(old, new, "url", "doc_id")


@query(
    "dedup_first",
    "SELECT doc_id, md5(text) AS url, lang, text FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1",
)
def _(spark, d):
    return T.dedup_first(documents_url(spark, d).select("doc_id", "url", "lang", "text"), "url", "doc_id")


@query(
    "drop_empty_text",
    f"SELECT doc_id, text FROM (SELECT doc_id, CASE WHEN regexp_matches(lower(text), '{any_literal(_MARKERS)}') THEN '' ELSE text END AS text FROM documents) WHERE text <> ''",
)
def _(spark, d):
    blanked = documents(spark, d).select("doc_id", W.blocked_page_blank(F.col("text"), _MARKERS).alias("text"))
    return T.drop_empty_text(blanked, "text")


@query(
    "todo_antijoin",
    """
    WITH f AS (SELECT doc_id, md5(text) AS url, text FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1)
    SELECT doc_id, url FROM f WHERE text <> '' AND url NOT IN (SELECT md5(text) FROM documents JOIN labels USING (doc_id))
    """,
)
def _(spark, d):
    docs = documents_url(spark, d).select("doc_id", "url", (F.col("text") == "").alias("empty"))
    done = docs.join(table(spark, d, "labels"), "doc_id", "left_semi")
    todo = T.dedup_first(docs, "url", "doc_id").filter(~F.col("empty"))
    return T.todo_antijoin(todo, done, "url").select("doc_id", "url")


@query(
    "null_to_empty",
    "SELECT doc_id, lang, coalesce(CAST(quality AS VARCHAR), '') AS quality FROM documents LEFT JOIN labels USING (doc_id)",
)
def _(spark, d):
    marks = table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"))
    return T.null_to_empty(documents(spark, d).select("doc_id", "lang").join(marks, "doc_id", "left"))


_SENTINEL_SQL = """SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN -2 WHEN quality = 0 AND toxic = 0 THEN -1 WHEN toxic = 1 THEN 7 ELSE 1 END AS LABEL
    FROM documents LEFT JOIN labels l USING (doc_id)"""


def _sentinels(spark, d):
    label = F.expr("CASE WHEN quality IS NULL THEN -2 WHEN quality = 0 AND toxic = 0 THEN -1 WHEN toxic = 1 THEN 7 ELSE 1 END")
    joined = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return joined.select("doc_id", label.alias("LABEL"))


@query("drop_sentinels", f"SELECT * FROM ({_SENTINEL_SQL}) WHERE LABEL NOT IN (-1, -2)")
def _(spark, d):
    return T.drop_sentinels(_sentinels(spark, d), "LABEL")


@query("label_range", f"SELECT * FROM ({_SENTINEL_SQL}) WHERE LABEL BETWEEN 0 AND 6")
def _(spark, d):
    return T.label_range(_sentinels(spark, d), "LABEL")


__all__ = ["LINKS_SQL", "ORACLES", "QUERIES", "annotated", "links", "spread"]
