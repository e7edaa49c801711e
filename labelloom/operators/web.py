"""Stored pages: text, links, link filters and the crawl frontier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.patterns import any_literal
from ..functions.rules import BLOCKED_MARKERS, JOURNALS, JOURNAL_TOPICS, LINK_BLACKLIST
from ..functions.text import let, unescape, unnest_with_position
from ..session import checkpointed
from .tables import first_per_key, hot_keys, join_hot_aware, key_counts, union_rows

# File endings that a link extractor skips by default.
SKIPPED_ENDINGS = (
    "7z", "7zip", "bz2", "rar", "tar", "tar.gz", "xz", "zip", "mng", "pct", "bmp", "gif", "jpg", "jpeg", "png",
    "pst", "psp", "tif", "tiff", "ai", "drw", "dxf", "eps", "ps", "svg", "cdr", "ico", "webp", "mp3", "wma", "ogg",
    "wav", "ra", "aac", "mid", "au", "aiff", "3gp", "asf", "asx", "avi", "mov", "mp4", "mpg", "qt", "rm", "swf",
    "wmv", "m4a", "m4v", "flv", "webm", "xls", "xlsx", "ppt", "pptx", "pps", "doc", "docx", "odt", "ods", "odg",
    "odp", "css", "pdf", "exe", "bin", "rss", "dmg", "iso", "apk", "jar", "sh", "rb", "js", "hta", "bat", "cpl",
    "msi", "msp", "py",
)
_TAG = r"<[^>]*>"


def drop_invisible(html: Column) -> Column:
    """Page without comments, scripts and styles. They go first: a script may contain tags in its strings."""
    return F.regexp_replace(
        html, r"(?is)<!--.*?-->|<script(?:\s[^>]*)?>.*?</script\s*>|<style(?:\s[^>]*)?>.*?</style\s*>", ""
    )


def html_body_text(html: Column) -> Column:
    """Text nodes of the body, joined by a pipe."""
    page = F.regexp_replace(drop_invisible(html), r"(?is)^.*?<body[^>]*>|<head(?:\s[^>]*)?>.*?</head\s*>|</body\s*>.*$", "")
    nodes = F.filter(F.split(page, _TAG, -1), lambda n: n != "")
    return F.array_join(F.transform(nodes, unescape), "|")


def blocked_page_blank(text: Column, markers=BLOCKED_MARKERS, ignore_case: bool = True) -> Column:
    """Blank text that contains a marker of an unreadable page."""
    seen = F.lower(text) if ignore_case else text
    return F.when(seen.rlike(any_literal(markers)), "").otherwise(text)


def domain_of(url: Column) -> Column:
    """Network location of a URL, empty if it has none."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def _without_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""
    parts = F.split(F.substr(path, F.lit(2)), "/")
    ends_open = path.rlike(r"/\.{1,2}$")
    stack = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(p == ".", acc)
        .otherwise(F.array_append(acc, p)),
    )
    joined = F.concat(F.lit("/"), F.array_join(stack, "/"), F.when(ends_open & (F.size(stack) > 0), "/").otherwise(""))
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), joined).otherwise(path)


def _base_parts(base: Column) -> Column:
    """What references are resolved against, as a struct."""
    return let(
        F.regexp_replace(base, "(?s)#.*$", ""),
        lambda full: let(
            F.struct(
                full.alias("full"),
                F.regexp_replace(full, r"(?s)\?.*$", "").alias("page"),
                F.regexp_extract(full, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1).alias("scheme"),
                F.regexp_extract(full, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?]*)", 1).alias("origin"),
            ),
            lambda b: F.struct(
                b.full.alias("full"),
                b.page.alias("page"),
                b.scheme.alias("scheme"),
                b.origin.alias("origin"),
                F.concat(
                    F.lit("/"), F.regexp_extract(F.substr(b.page, F.length(b.origin) + 1), r"(?s)^/(.*/)?[^/]*$", 1)
                ).alias("folder"),
            ),
        ),
    )


def _resolve(base: Column, ref: Column) -> Column:
    """Resolve a reference without fragment; null if it is no web link."""
    path = F.regexp_replace(ref, r"(?s)\?.*$", "")
    absolute = let(F.when(path.startswith("/"), path).otherwise(F.concat(base.folder, path)), _without_dots)
    url = (
        F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), ref)
        .when(ref == "", base.full)
        .when(ref.startswith("//"), F.concat(base.scheme, ref))
        .when(ref.startswith("?"), F.concat(base.page, ref))
        .otherwise(F.concat(base.origin, absolute, F.regexp_extract(ref, r"(?s)(\?.*)$", 1)))
    )
    return let(url, lambda u: F.when(u.rlike("^(?i)https?://"), u))


def absolute_links(base: Column, hrefs: Column) -> Column:
    """Resolve the references of a page and drop their fragments."""
    refs = F.transform(hrefs, lambda h: F.regexp_replace(F.trim(h), "(?s)#.*$", ""))
    return let(_base_parts(base), lambda b: F.transform(refs, lambda r: _resolve(b, r)))


def page_links(html: Column, base: Column, skipped=SKIPPED_ENDINGS) -> Column:
    """Distinct absolute links of a page in order of appearance."""
    hrefs = F.regexp_extract_all(
        drop_invisible(html),
        F.lit(r"""(?is)<a(?:rea)?\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""),
        F.lit(1),
    )
    plain = F.transform(hrefs, lambda h: unescape(F.regexp_replace(h, "^[\"']|[\"']$", "")))
    endings = r"(?i)^https?://[^/?]*/[^?]*\.(?:" + any_literal(skipped) + r")(?:\?|$)"
    return F.array_distinct(F.filter(absolute_links(base, plain), lambda u: u.isNotNull() & ~u.rlike(endings)))


def link_extract(pages: DataFrame, id_col: str, url: str, html: str) -> DataFrame:
    """``(id, pos, link)`` for every distinct link of every page."""
    return unnest_with_position(pages, [id_col], page_links(F.col(html), F.col(url)), "pos", "link")


def is_blacklisted(link: Column) -> Column:
    return F.lower(link).rlike(any_literal(LINK_BLACKLIST))


def is_offtopic_journal(link: Column) -> Column:
    """A journal link without any mobility word."""
    low = F.lower(link)
    return low.rlike(any_literal(JOURNALS)) & ~low.rlike(any_literal(JOURNAL_TOPICS))


def link_blacklist(links: DataFrame, link: str) -> DataFrame:
    return links.filter(~is_blacklisted(F.col(link)))


def journal_rule(links: DataFrame, link: str) -> DataFrame:
    return links.filter(~is_offtopic_journal(F.col(link)))


def allowed_domains(links: DataFrame, seeds: DataFrame, link: str, seed_url: str, mode: str = "internal") -> DataFrame:
    """Internal crawl: links whose host is a seed host or below one. External crawl: every link.

    Hosts are few next to links: the subdomain test runs on the distinct hosts,
    and the links meet the surviving hosts by the join for hot keys.
    """
    if mode == "external":
        return links

    def host(c: Column) -> Column:
        return F.lower(F.regexp_replace(F.regexp_replace(domain_of(c), "^.*@", ""), ":[0-9]*$", ""))

    seed_hosts = seeds.select(host(F.col(seed_url)).alias("host")).filter("host <> ''").distinct()
    with_host = links.withColumn("_host", host(F.col(link)))
    counts = key_counts(with_host, "_host")
    labels = F.split("_host", r"\.")
    suffixes = F.transform(
        labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")
    )
    allowed = (
        counts.select("_host", F.explode(suffixes).alias("host"))
        .join(seed_hosts, "host", "left_semi")
        .select("_host")
        .distinct()
    )
    return join_hot_aware(with_host, allowed, "_host", "left_semi", counts=counts).select(*links.columns)


def visited_skip(links: DataFrame, visited: DataFrame, link: str, url: str) -> DataFrame:
    """Links that are not crawled yet. Many pages may point to one URL, so the link side may be hot."""
    seen = visited.select(F.col(url).alias(link)).distinct()
    return join_hot_aware(links, seen, link, "left_anti").select(*links.columns)


def crawl_frontier_bfs(seeds: DataFrame, edges: DataFrame, depth: int = 1) -> DataFrame:
    """Breadth-first expansion over a stored link graph.

    ``seeds(url, CLASS, KEYWORD)`` and ``edges(src, dst)`` give
    ``(url, depth, CLASS, KEYWORD)``. A page is reached once, at its smallest
    depth, and inherits from the smallest ``(CLASS, KEYWORD)`` among its parents.
    Depth is bounded, and each level is cut off by a reliable checkpoint.
    """
    tag = ["CLASS", "KEYWORD"]
    order = [F.col(c) for c in tag]
    level = checkpointed(first_per_key(seeds.select("url", F.lit(0).alias("depth"), *tag), ["url"], order))
    reached = level
    edges = edges.withColumnRenamed("src", "url")
    hubs = checkpointed(hot_keys(key_counts(edges, "url"), "url"))
    for d in range(1, depth + 1):
        # the out-links of a hub meet a broadcast parent, the others meet by shuffle
        found = join_hot_aware(edges, level.select("url", *tag), "url", "inner", hot=hubs)
        found = first_per_key(found.select(F.col("dst").alias("url"), F.lit(d).alias("depth"), *tag), ["url"], order)
        level = checkpointed(found.join(reached.select("url"), "url", "left_anti"))
        if level.isEmpty():
            break
        reached = union_rows(reached, level)
    return reached


def merge_crawl(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Old and new items, the first row per URL, old before new."""
    both = union_rows(old.withColumn("_src", F.lit(0)), new.withColumn("_src", F.lit(1)))
    return first_per_key(both, [key], [F.col("_src"), F.col(order)]).drop("_src")


def count_duplicates(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of the union beyond the first of each URL."""
    per_key = union_rows(old.select(key), new.select(key)).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg((F.sum("n") - F.count(F.lit(1))).alias("duplicates"))
