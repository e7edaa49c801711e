"""Rule behaviour on literals, and the guarded rule chains against Python's ``re``."""

import random
import re

import pytest
from pyspark.sql import functions as F

from labelloom.functions import rules as R
from labelloom.functions.patterns import any_of, literal_core, needed_text, portable
from labelloom.operators import clean as K


def apply(spark, fn, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r["c"] for r in df.select("i", fn(F.col("t")).alias("c")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "fn, text, expected",
    [
        (K.strip_markup, "a<b c='d'>efgh", "aefgh"),
        (K.strip_markup, "abc{{..}}bcd", "abcbcd"),
        (K.strip_markup, "one two|abc|one two||x", "one two"),
        (K.strip_markup, "a  b  c long", "abc long"),
        (K.strip_domain_words, "12g/km", "12"),
        (K.strip_numbers, "a[b]c", "ac"),
        (K.strip_special, "añb-c", "abc"),
        (K.strip_short, "für wort", "wort"),
        (K.strip_website_words, "modellübersicht", ""),
        (K.strip_urls, "https://www.a.de/x wort", "wort"),
        (K.strip_email, "Me@x.org wort", "wort"),
        (K.strip_zip, "12345 12345-1234 123456 1234", "1234"),
        (K.strip_phone, "+4912345678 wort", "wort"),
        (K.strip_dates, "01/02/2020 1-2-2020 2020-01-02 1.2.2020", "1.2.2020"),
        (K.stopword_strip, "Newsletter Abo Elektroauto|Elektroauto laden laden", "letter elektroauto elektroauto laden"),
        (K.stopword_strip, "the and", ""),
    ],
)
def test_literals(spark, fn, text, expected):
    assert apply(spark, fn, text) == [expected]


def test_fused_rules():
    assert len(R.word_rules()) == 170 and len(R.word_rules(compat=True)) == 167


def reference_words(text: str) -> str:
    """The word rules one by one, with Python's regular expressions."""
    rules = [re.compile(r.replace("\\x{", "\\x{")) for r in R.word_rules()]
    out = []
    for segment in text.lower().split("|"):
        words = []
        for w in segment.split(" "):
            for r in rules:
                w = r.sub("", w)
            w = w.lstrip()
            if w and w not in words:
                words.append(w)
        if words:
            out.append(" ".join(words))
    return " ".join(out)


def test_guarded_chain_equals_plain_chain(spark):
    rng = random.Random(7)
    stems = [w for w in R.WEBSITES + R.DOMAIN if literal_core(w)]
    bits = ["au", "to", "en", "ß", "é", "-", ".", "(", ")", "[", "]", "7", "2020", "@", "www", "de", "com", "x", "/", "news", " ", "|"]
    texts = []
    for _ in range(300):
        parts = [rng.choice(bits) if rng.random() < 0.7 else literal_core(rng.choice(stems)) for _ in range(rng.randint(1, 25))]
        texts.append("".join(parts))
    assert apply(spark, K.stopword_strip, *texts) == [reference_words(t) for t in texts]


def test_any_of_is_exact():
    rng = random.Random(3)
    test = re.compile(any_of([r for r in R.WEBSITES if "recht" not in r]))
    singles = [re.compile(r) for r in R.WEBSITES if "recht" not in r]
    for _ in range(3000):
        word = "".join(rng.choice("abcdeiklmnopstuvwxy1 ") for _ in range(rng.randint(0, 9)))
        word += rng.choice(["", "abo", "tel", "app", "mai", "sho", "lo", "in"])
        assert bool(test.search(word)) == any(s.search(word) for s in singles), word


def test_any_of_looks_at_few_characters():
    """All rules of the second word step are plain or contain a plain one, and a common letter starts no comparison."""
    pattern = any_of(R.WEBSITES + R.DOMAIN)
    test, plain = re.compile(pattern), [literal_core(r) for r in R.WEBSITES + R.DOMAIN if literal_core(r)]
    assert "g/km" in plain and "hinweis" not in pattern and re.match(r"\(\?=\[([^]]*)\]\)", pattern)
    assert not set(re.match(r"\(\?=\[([^]]*)\]\)", pattern)[1]) & set("aeinor ")
    for word in plain:
        assert test.search(word) and test.search(f"x{word}x") and test.search(f"{word[:-1]}{word}")
        assert bool(test.search(word[:-1])) == any(w in word[:-1] for w in plain)
        assert bool(test.search(word[1:])) == any(w in word[1:] for w in plain)
    odd = re.compile(any_of(["a-b", "a]c", "^x", r"d\*", "a^"]))
    assert [bool(odd.search(t)) for t in ("1a-b", "a]c", "x", "yx", "d*", "dd", "a^", "ab", "ac")] == [True, True, True, False, True, False, False, False, False]


def test_markup_rules_run_where_one_can_be_found(spark):
    """A segment without mark is not touched by any rule; all others meet all rules, after the user's."""
    rng = random.Random(5)
    marks = ["<", ">", "<from>", "</from>", "@", ".", "{", "}", "{{..}}", "  ", "\t\u2003", "\n", "\xa0", "dbx707", "dbx", "707", "\xe2"]
    bits = marks + ["\x80", "\x8b", "\x9d", "\u200b", "'", '"', " "] + ["word", "Ünlü", "é", "d", "ß", "zz", "~"] * 4
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 9))) + " long end" for _ in range(3000)] + [m + " long end" for m in marks]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    quiet = ~F.col("t").rlike(K._MARKED)
    for extra in ((), ("zz", r"^word")):
        every = F.regexp_replace(K._delete_markup(F.col("t"), extra), K._SHORT_SEGMENT, "")
        rows = df.select(every.alias("want"), K.strip_markup(F.col("t"), extra).alias("got"), quiet.alias("quiet"), "t").collect()
        assert [r["got"] for r in rows] == [r["want"] for r in rows]
        assert extra or all(r["want"] == r["t"] for r in rows if r["quiet"]) and 100 < sum(r["quiet"] for r in rows) < 2900


def test_long_tag_without_end(spark):
    text = "<" + "a" * 200_000
    assert apply(spark, K.strip_markup, text, text + ">rest of it") == [text, "rest of it"]


def test_custom_rules_run_first(spark):
    rules = {"pattern": ("zz+",), "stopword": ("^auto",)}
    assert apply(spark, lambda c: K.clean_text(c, rules), "azza|autobahn fahrt weit") == ["bahn fahrt weit"]


def test_rule_count_is_checked(spark):
    rules = spark.createDataFrame([(i, "stopword", "a") for i in range(4)], "ord int, kind string, regex string")
    with pytest.raises(ValueError):
        K.read_rules(rules, max_rules=3)


def test_gazetteer_join_equals_inline(spark):
    df = spark.createDataFrame([(1, ["a", "berlin", "b", "berlin"]), (2, []), (3, ["köln"])], "id int, tokens array<string>")
    names = spark.createDataFrame([("Berlin",), ("Köln",)], "name string")
    inline = sorted(map(tuple, K.remove_gazetteer(df, names, "id", "tokens").collect()))
    joined = sorted(map(tuple, K.remove_gazetteer(df, names, "id", "tokens", max_inline=1).collect()))
    assert inline == joined == [(1, "a b"), (2, ""), (3, "")]


def test_portable_keeps_classes():
    assert portable(r"[^\w.]+$") == r"[^\p{L}\p{N}_.]+\z"
    assert portable(r"a.b") == r"a[^\n]b"


def test_names_of_several_words(spark):
    from labelloom.operators.gazetteer import remove_names

    rng = random.Random(3)
    names = ["a", "b c", "b c d", "d a", "c c c c", "New  York", None, "", "--"]
    rows = [(i, [rng.choice("abcd") for _ in range(rng.randrange(12))]) for i in range(300)] + [(900, ["in", "new", "york", "a"]), (901, None), (902, ["x"] * 20_000 + ["b", "c"])]
    df = spark.createDataFrame(rows, "id int, tokens array<string>")
    lists = [["a"], ["b", "c"], ["b", "c", "d"], ["d", "a"], ["c"] * 4, ["new", "york"]]

    def brute(tokens):
        out, i = [], 0
        while i < len(tokens):
            width = max((len(n) for n in lists if tokens[i : i + len(n)] == n), default=0)
            out += [] if width else [tokens[i]]
            i += width or 1
        return " ".join(out)

    table = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r["id"]: r["text"] for r in remove_names(df, table, "id", "tokens").collect()}
    assert got == {i: brute(t or []) for i, t in rows}
    many = table.unionByName(spark.range(120_000).select(F.concat(F.lit("zz"), F.col("id").cast("string"), F.lit(" yy")).alias("name")))
    assert {r["id"]: r["text"] for r in remove_names(df, many, "id", "tokens").collect()} == got


def test_names_of_a_text_are_looked_up_not_searched(spark):
    """20,000 words with 3,000 names among them: matching every place with every name took minutes."""
    import time

    from labelloom.operators.gazetteer import remove_names

    words = [f"w{i * 7919 % 6_000}" for i in range(20_000)]
    names = {(f"w{i}", f"w{(i + 7919) % 6_000}") if i % 3 else (f"w{i}",) for i in range(0, 6_000, 2)}
    df = spark.createDataFrame([(1, words), (2, ["w1", None, "w0"])], "id long, tokens array<string>")
    begin = time.monotonic()
    got = {r["id"]: r["text"] for r in remove_names(df, spark.createDataFrame([(" ".join(n),) for n in names], "name string"), "id", "tokens").collect()}
    assert time.monotonic() - begin < 20
    want, at = [], 0
    while at < len(words):
        width = next((n for n in (2, 1) if tuple(words[at : at + n]) in names), 0)
        want += words[at : at + 1] * (not width)
        at += width or 1
    assert got == {1: " ".join(want), 2: "w1"}


def test_lemmas_come_to_the_texts(spark):
    """No token moves with its place: a row gets back the entries of its distinct tokens."""
    rows = [(1, ["b", "a", "b", None, "c"]), (2, []), (3, None), (4, ["c"])]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    lemmas = spark.createDataFrame([("a", "x"), ("b", "c"), ("c", None), (None, "y")], "token string, lemma string")
    out = K.lemmatize_lookup(df, lemmas, "id", "tokens")
    assert {r["id"]: r["text"] for r in out.collect()} == {1: "c x c c", 2: "", 3: "", 4: "c"}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "array_distinct" in plan


def test_every_website_rule_has_a_text_it_needs():
    """A rule without one ran over every text."""
    assert needed_text(r"\w*recht\w* hinweis\w*") == " hinweis" and needed_text("(g/km)") == "g/km"
    assert all(needed_text(r) for r in R.WEBSITES + R.DOMAIN)
    assert needed_text(r"a|b") == needed_text(r"(a|b)") == needed_text("a.c") == ""


def test_gap_rule_means_the_same_to_java(spark):
    parts = ["a", "!", "~", " ", "\t", "\n", "\x1c", "\x85", "\xa0", " ", " ", " ", " ", "　", "é", "\x7f"]
    df = spark.createDataFrame([("b" + x + y + z + "c",) for x in parts for y in parts for z in parts], "t string")
    differs = F.regexp_replace("t", K._JAVA_GAP, "_") != F.regexp_replace("t", portable(K.GAP), "_")
    assert df.filter(differs).count() == 0
    assert df.filter(F.regexp_replace("t", K._JAVA_GAP, "_").contains("_")).count() > 1000
