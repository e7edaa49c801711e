import random

from pyspark.sql import functions as F

from labelloom.functions.text import ngrams_1_2, term_counts, top_terms, unescape
from labelloom.operators import seeds as S, web as W


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_unescape_in_one_pass(spark):
    text = "a &amp;lt; &#228;&#x20AC;&auml; &apos;&nosuch; &#0; & b&#128512;"
    assert one(spark, unescape(F.col("t")), t=text) == "a &lt; ä€ä '&nosuch; &#0; & b\U0001f600"


def test_body_text(spark):
    html = "<html><head><title>T</title></head><body><!-- <p>x</p> --><script>var a='<p>';</script><p>A|B</p> <b>c&amp;</b></body></html>"
    assert one(spark, W.html_body_text(F.col("h")), h=html) == "A|B| |c&"


def test_blocked(spark):
    assert one(spark, W.blocked_page_blank(F.col("t")), t="Please enable JavaScript") == ""
    assert one(spark, W.blocked_page_blank(F.col("t"), ("javascript",), False), t="JavaScript") == "JavaScript"


def test_links_resolve_like_rfc3986(spark):
    base = "http://a/b/c/d;p?q"
    # reference -> target, from the normal examples of RFC 3986, without fragments
    cases = {
        "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g",
        "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q", "g#s": "http://a/b/c/g",
        ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/",
        "../../g": "http://a/g", "../../../g": "http://a/g", "mailto:x@y.z": None, "https://x.org/a": "https://x.org/a",
    }
    df = spark.createDataFrame([(base, list(cases))], "b string, h array<string>")
    got = df.select(W.absolute_links(F.col("b"), F.col("h")).alias("l")).first()["l"]
    assert dict(zip(cases, got)) == cases


def test_page_links(spark):
    html = """<a href='/x?a=1&amp;b=2'>1</a><A class="k" HREF="y.html#top">2</A><a href="/x?a=1&amp;b=2">3</a>
    <a href="/f.pdf">4</a><!-- <a href="/no"> --><a href="javascript:void(0)">5</a><area href=z >"""
    got = one(spark, W.page_links(F.col("h"), F.col("u")), h=html, u="https://s.de/d/i.html")
    assert got == ["https://s.de/x?a=1&b=2", "https://s.de/d/y.html", "https://s.de/d/z"]


def test_domain_of(spark):
    df = spark.createDataFrame([("https://u@h.de:8/p",), ("//h/x",), ("no url",), ("mailto:a@b",)], "u string")
    assert [r[0] for r in df.select(W.domain_of(F.col("u"))).collect()] == ["u@h.de:8", "h", "", ""]


def test_allowed_domains(spark):
    links = spark.createDataFrame([("http://a.de/x",), ("http://s.A.de/",), ("http://ba.de/",), ("http://a.de:80/",)], "link string")
    seeds = spark.createDataFrame([("https://a.de/",)], "url string")
    got = {r["link"] for r in W.allowed_domains(links, seeds, "link", "url").collect()}
    assert got == {"http://a.de/x", "http://s.A.de/", "http://a.de:80/"}
    assert W.allowed_domains(links, seeds, "link", "url", "external").count() == 4


def test_journals_need_a_mobility_word(spark):
    links = spark.createDataFrame([("https://faz.net/Auto",), ("https://faz.net/kultur",), ("https://x.de/kultur",)], "link string")
    assert W.journal_rule(links, "link").count() == 2


def test_frontier_against_brute_force(spark):
    rng = random.Random(5)
    # node 0 is a hub: it has a third of all links, and a third of all links point to it
    pairs = {(0, rng.randrange(60)) for _ in range(80)} | {(rng.randrange(60), 0) for _ in range(80)}
    pairs |= {(rng.randrange(60), rng.randrange(60)) for _ in range(80)}
    seeds = [(7, "A", "k1"), (11, "B", "k2")]
    best = {u: (0, c, k) for u, c, k in seeds}
    level = dict(best)
    for d in (1, 2, 3):
        found = {}
        for s, t in pairs:
            if s in level and t not in best:
                cand = (d, *level[s][1:])
                found[t] = min(found.get(t, cand), cand)
        best.update(found)
        level = found
    got = W.crawl_frontier_bfs(
        spark.createDataFrame(seeds, "url bigint, CLASS string, KEYWORD string"),
        spark.createDataFrame(sorted(pairs), "src bigint, dst bigint"), 3,
    )
    assert {r["url"]: (r["depth"], r["CLASS"], r["KEYWORD"]) for r in got.collect()} == best


def test_merge_counts_duplicates(spark):
    old = spark.createDataFrame([("u1", 1, "old"), ("u2", 2, "old")], "url string, o int, t string")
    new = spark.createDataFrame([("u2", 0, "new"), ("u3", 1, "new"), ("u3", 0, "first")], "url string, o int, t string")
    got = {r["url"]: r["t"] for r in W.merge_crawl(old, new, "url", "o").collect()}
    assert got == {"u1": "old", "u2": "old", "u3": "first"}
    assert W.count_duplicates(old, new, "url").first()["duplicates"] == 2


def test_seed_sheet(spark):
    sheet = spark.createDataFrame([("a", None, "x"), (None, "b", "y")], "K1 string, K2 string, z string")
    assert sorted(map(tuple, S.class_keywords(sheet, ["K1", "K2"]).collect())) == [(0, "a"), (1, "b")]
    hits = spark.createDataFrame([("k", i) for i in range(5)], "k string, r int")
    assert S.top_n_links(hits, "k", ["r"], 2).count() == 2 and S.top_n_links(hits, "k", ["r"], 0).count() == 5
    empty = spark.createDataFrame([("k", [])], "k string, h array<string>")
    assert [tuple(r) for r in S.explode_hits(empty, "h").collect()] == [("k", None)]


def test_term_functions(spark):
    words = ["b", "a", "b", "cccc", "dddd", "cccc", "b"]
    df = spark.createDataFrame([(words,), ([],)], "w array<string>")
    counts = [[(e["term"], e["n"]) for e in r[0]] for r in df.select(term_counts(F.col("w"))).collect()]
    assert counts == [[("a", 1), ("b", 3), ("cccc", 2), ("dddd", 1)], []]
    assert [r[0] for r in df.select(top_terms(F.col("w"), 3)).collect()] == [["cccc"], []]
    grams = [r[0] for r in df.select(ngrams_1_2(F.col("w"))).collect()]
    assert grams == [words + [f"{a} {b}" for a, b in zip(words, words[1:])], []]
