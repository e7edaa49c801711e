"""Spelling variants, hard negatives and toxicity: brute force, planted cases, odd rows."""

import collections
import itertools
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.llm import hard_negatives, rtree, spelling, string_kernel as sk, toxicity
from labelloom.llm.queries_models import LEARNT

# --- spelling


def one_edit(a: str, b: str) -> bool:
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def test_near_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(6, 10))) for _ in range(300)}
    words |= {w[:i] + c + w[i:] for w in list(words)[:80] for i in (0, 3, len(w)) for c in "aé"}
    words |= {"x" * 5_000, "x" * 5_001, "x" * 2_500 + "y" + "x" * 2_499}
    counted = {w: rng.randrange(5, 500) for w in words}
    df = spark.createDataFrame(list(counted.items()), "word string, n long")
    got = spelling.near_pairs(df).collect()
    pairs = [tuple(sorted((r["a"], r["b"]))) for r in got]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {tuple(sorted(p)) for p in itertools.combinations(words, 2) if one_edit(*p)}
    assert all(r["a_n"] == counted[r["a"]] and r["b_n"] == counted[r["b"]] for r in got)


def test_forms_and_roots(spark):
    words = [("colour", 5_000), ("colours", 1_000), ("coloursx", 200), ("coloursxy", 6), ("abcdef", 30), ("abcdeg", 150), ("abcdeh", 150), ("zzzzzz", 9)]
    got = {r["word"]: r for r in spelling.group_variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert [got[w]["form"] for w, _ in words] == [None, "colour", "colours", "coloursx", "abcdeg", None, None, None]
    assert got["coloursxy"]["root"] == "colour" and got["coloursxy"]["form_n"] == 200
    assert got["zzzzzz"]["root"] == "zzzzzz" and got["zzzzzz"]["n_near"] == 0
    assert got["abcdef"]["n_near"] == 2 and got["abcdef"]["root"] == "abcdeg"
    assert spelling.group_variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_words_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "ÀBCDEF abcdefÿ"), (None, "ÀBCDEF abcdefÿ"), (3, "a1b-c " + "Q" * 9_000), (3, "abcdefÿ")] + [(4, "abcdefÿ")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("z") for c in ("word", "n", "key", "part", "__key", "__h")})
    assert {(r["word"], r["n"]) for r in spelling.count_words(df).collect()} == {("abcdefÿ", 6)}
    assert {(r["word"], r["n"]) for r in spelling.count_words(df, min_count=1).collect()} == {("abcdefÿ", 6), ("Àbcdef", 2), ("q" * 9_000, 1)}
    assert spelling.variants(df.limit(0)).count() == 0


def test_slips_follow_the_checksum(spark):
    import zlib

    rows = [(i, "letters") for i in range(2_000)] + [(None, "letters")]
    got = {r["__key"]: r["word"] for r in spelling.with_slips(spark.createDataFrame(rows, "__key long, word string"), "__key", "word", 199).collect()}
    for key, word in rows:
        h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
        assert got[key] == (word if h % 199 else word[: h % 7] + word[h % 7 + 1 :])
    assert any(len(w) == 6 for w in got.values())


# --- hard negatives


def mined(rows, anchors, positives=5, negatives=10):
    """Brute force over rows of (id, label, vector)."""
    rows = [(i, k, lab, v) for i, (k, lab, v) in enumerate(rows) if lab is not None and v is not None and all(x is not None for x in v)]
    dims = max((len(v) for *_, v in rows), default=0)
    dot = lambda a, b: sum(x * y for x, y in zip(a + [0] * dims, b + [0] * dims))
    order = lambda t: (-t[0], t[1] is None, t[1] or 0)
    out = []
    for i, k, lab, v in rows:
        if not anchors(k):
            continue
        scored = sorted(((dot(v, w), kk, ll) for j, kk, ll, w in rows if j != i), key=order)
        for s, p, _ in [t for t in scored if t[2] == lab][:positives]:
            hard = [t for t in scored if t[2] != lab and 30 * s <= 100 * t[0] <= 90 * s][:negatives]
            out += [(k, p, r, n, s, t) for r, (t, n, _) in enumerate(hard, 1)]
    return sorted(out, key=repr)


def run_mine(spark, rows, condition="vec_id % 10 = 0"):
    df = spark.createDataFrame(rows, "vec_id long, label int, vector array<long>")
    df = df.withColumns({c: F.lit("z") for c in ("id", "row", "slab", "score", "anchor", "rank", "window")})
    got = hard_negatives.mine(df, F.expr(condition))
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert got.columns == list(names)
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_mined_negatives_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "TILE_ROWS", 100)
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", 20)
    rng = random.Random(7)
    rows = [(i, rng.randrange(3), [rng.randrange(-6, 7) for _ in range(4)]) for i in range(450)]
    rows += [(900, None, [1, 2, 3, 4]), (910, 1, None), (920, 1, [1, None, 3, 4]), (930, 1, [5, 5]), (940, 2, []), (7, 1, [3, 3, 3, 3])]
    assert run_mine(spark, rows) == mined(rows, lambda k: k % 10 == 0)


def test_mining_odd_tables(spark):
    twins = [(0, 1, [4, 4])] * 3 + [(None, 2, [3, 3])] * 2 + [(5, 2, [3, 3])]
    assert run_mine(spark, twins) == mined(twins, lambda k: k == 0)
    assert run_mine(spark, [(1, 1, [1])]) == run_mine(spark, [(0, None, None)]) == []
    big = [(0, 1, [1 << 30, 1]), (1, 1, [1 << 30, 3]), (2, 2, [1 << 29, 5])]
    assert run_mine(spark, big) == mined(big, lambda k: k == 0)


def test_search_prunes_and_keeps_ties():
    rng = np.random.default_rng(3)
    centres = rng.integers(-500, 500, (40, 6))
    points = np.repeat(centres, 64, axis=0) + rng.integers(-3, 4, (2560, 6))
    order = rtree.str_order(points)
    assert sorted(order) == list(range(2560))
    tree = rtree.Tree(points[order].astype(float))
    tie = np.argsort(np.argsort(order))
    for q in points[::200]:
        bounds = [(lo[0], hi[0]) for lo, hi in tree.intervals(q[None].astype(float))]
        scores = tree.vectors @ q
        for lo, hi in tree.intervals(q[None].astype(float))[:1]:
            for leaf in range(40):
                part = scores[leaf * 64 : leaf * 64 + 64]
                assert lo[0][leaf] <= part.min() and part.max() <= hi[0][leaf]
        top = scores.max()
        found, read = rtree.search(tree, bounds, q.astype(float), np.ones(2560, bool), [(-np.inf, np.inf), (0.3 * top, 0.9 * top)], 10, tie)
        want = sorted(range(2560), key=lambda i: (-scores[i], tie[i]))
        assert sorted(i for _, i in found[0]) == sorted(want[:10])
        assert sorted(i for _, i in found[1]) == sorted([i for i in want if 0.3 * top <= scores[i] <= 0.9 * top][:10])
        assert read < 40


def test_invalid_components(spark):
    rows = [(1, [1.0, 2.0]), (2, [float("nan")]), (3, [float("inf")]), (4, [None]), (5, None), (6, [])]
    df = spark.createDataFrame(rows, "i int, v array<float>")
    assert {r["i"] for r in df.filter(hard_negatives.valid(F.col("v"))).collect()} == {1, 6}
    assert df.filter("i = 1").select(hard_negatives.quantised(F.lit([0.5, -0.001]).cast("array<float>"))).first()[0] == [128, -1]


# --- toxicity


def kernel(a: str, b: str) -> float:
    """Plain sum over pairs of equal hashed subsequences, by their spans."""

    def table(word):
        out: dict = {}
        for places, weights in [(p, w) for _, ps, w in sk._by_length([word]) for p in ps]:
            for place, weight in zip(places, weights):
                out[place] = out.get(place, 0.0) + weight
        return out

    x, y = table(a), table(b)
    return sum(v * y.get(k, 0.0) for k, v in x.items())


def test_kernel_and_folding():
    words = [sk.marked(w)[0] for w in ("idiot", "id-iot", "i.d.i.o.t", "patio", "worthless", "x", "")]
    gram = sk.gram(words, words)
    assert gram == pytest.approx(np.array([[kernel(a, b) for b in words] for a in words]), abs=1e-5)
    assert np.linalg.eigvalsh(gram).min() > -1e-6
    assert gram[0, 1] > 3 * gram[0, 3] and gram[0, 2] > gram[0, 3]
    space = sk.Nystrom(words[:5])
    coefficients = np.arange(1.0, space.root.shape[1] + 1)
    direct = space.map(words) @ coefficients + 0.5
    folded = sk.scores(["idiot", "id-iot", "i.d.i.o.t", "patio", "worthless", "x", ""], space.fold(coefficients), 0.5)
    # words with marks inside are read without them as well
    direct[1:3] = np.maximum(direct[1:3], direct[0])
    assert folded == pytest.approx(direct, abs=1e-4)


def test_subsequences_are_weighed_by_span():
    # every subsequence of three letters within a span of six, and of four within seven, once
    for word in ("\x02abcdefg\x03",):
        [(_, places, weights)] = list(sk._by_length([word]))
        want = [sk.DECAY ** (c[-1] - c[0] + 1) for n, span in sk.ORDERS for c in itertools.combinations(range(len(word)), n) if c[-1] - c[0] < span]
        assert places.shape[1] == len(want)
        assert sorted(weights) == pytest.approx(sorted(np.array(want) / math.sqrt(sum(w * w for w in want))))


def test_machine_and_curve():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3))
    y = np.where(x[:, 0] > 0.2, 1.0, -1.0)
    w, b = sk.train_svm(x, y, np.ones(200))
    assert (np.sign(x @ w + b) == y).mean() > 0.97
    curve = sk.logistic(x[:, :1], (y > 0).astype(int), np.ones(200))
    assert curve[0] > 1


def test_machine_holds_little_besides_its_rows():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40_000, 100)).astype(np.float32)
    y = np.where(x[:, 0] + 0.1 * x[:, 1] > 0.2, 1.0, -1.0)
    tracemalloc.start()
    w, b = sk.train_svm(x, y, np.ones(len(x)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < x.nbytes
    assert (np.sign(x @ w + b) == y).mean() > 0.97


CLEAN = ["the garden was quiet in the morning", "they read a long book about rivers", "bread and cheese are on the table", "a small boat came home late", "we patiently wait for the tram", "you can go now"]


def corpus(rng, n):
    rows, marks = [], []
    for i in range(n):
        text = [rng.choice(CLEAN) for _ in range(6)]
        toxic = int(rng.random() < 0.3)
        if toxic:
            text[rng.randrange(6)] += " you " + rng.choice(["blarghead", "snorkwit", "dunderpate"])
        rows.append((i, ". ".join(text) + "."))
        marks.append((i, toxic))
    return rows, marks


def test_gapped_insults_are_found(spark):
    rows, marks = corpus(random.Random(4), 300)
    planted = ["you blar.ghead", "you snork-wit, go", "what a d*underpate", "b l a r g h e a d", "he is a snorkxwit"]
    rows += [(1_000 + i, f"{CLEAN[0]}. {p}. {CLEAN[1]}") for i, p in enumerate(planted)]
    rows += [(2_000, None), (2_001, ""), (2_002, "  \n"), (None, "you blarghead"), (None, None), (2_003, "snow work with heads"), (2_004, f"{CLEAN[2]} " * 20_000 + "snorkwit"), (2_005, "a" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("z") for c in ("score", "top", "hits", "kept", "toxic", "label", "word")})
    labels = spark.createDataFrame([*marks, (None, 1), (3, None), (99_999, 1)], "doc_id long, toxic int").withColumn("text", F.lit("q"))
    out = toxicity.toxicity(docs, labels, trained=LEARNT)
    got = {r["doc_id"]: r for r in out.collect() if r["doc_id"] is not None}
    truth = dict(marks)
    assert sum(got[i]["predicted"] != t for i, t in truth.items()) <= 3
    assert [got[1_000 + i]["predicted"] for i in range(len(planted))] == [1] * len(planted)
    assert all(got[i]["predicted"] == 0 for i in (2_000, 2_001, 2_002, 2_003, 2_005)) and got[2_004]["predicted"] == 1
    assert got[2_000]["score"] == got[2_001]["score"] == got[2_002]["score"] == min(r["score"] for r in got.values())
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert sorted(r["predicted"] for r in out.filter("doc_id IS NULL").collect()) == [0, 1]


def test_labels_of_one_class_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for labels, score in ((none, 0.0), (spark.createDataFrame([(1, 1)], none.schema), 1.0), (spark.createDataFrame([(2, 0)], none.schema), 0.0)):
        assert [r["score"] for r in toxicity.toxicity(docs, labels).collect()] == [score] * 2
    assert toxicity.toxicity(docs.limit(0), none).count() == 0


def test_labelled_documents_without_words(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " . ")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.toxicity(docs, labels).collect()] == [0.5] * 3


def test_words_in_use_are_scored_once(monkeypatch):
    # a chunk for every text, and room for the words of two of them
    monkeypatch.setattr(toxicity, "REMEMBERED", 50)
    monkeypatch.setattr(toxicity, "CHUNK_CHARS", 1)
    asked = collections.Counter()

    def score(words):
        asked.update(words)
        return np.zeros(len(words))

    texts = [" ".join(["garden", ["(garden)", "garden,", "garden"][i % 3], "river.", *[f"w{i}x{j}" for j in range(20)]]) for i in range(60)]
    list(toxicity.in_chunks(texts, toxicity.Memo(score)))
    assert len(asked) == 2 + 60 * 20 and set(asked.values()) == {1}


def test_sentences_and_hits_by_the_plain_rules(monkeypatch):
    monkeypatch.setattr(toxicity, "REMEMBERED", 200)
    monkeypatch.setattr(toxicity, "CHUNK_CHARS", 500)
    rng = random.Random(5)
    bits = ["a", "b", "_", "\u00e9", "1", "foo", "id-iot", "x.y", *"   \n\t.!?'()*", "\x85", "\u00a0", "\u2028", "I\u0307"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(4_000)]

    def words(text):
        return text.split() + ["".join(m.split()) for m in re.findall(r"\b\w(?:\s\w){2,}\b", text)]

    def margin(word):
        m = re.search(r"[^\W_](?:\S*[^\W_])?", word)
        return max(toxicity.CLEAR, (zlib.crc32(m.group().encode()) % 100 - 70) / 20) if m else toxicity.CLEAR

    def plain(text):
        parts = [w for s in re.split(r"(?<=[.!?])\s+|\n+", text) if (w := words(s))]
        top = max(map(margin, words(text)), default=toxicity.CLEAR)
        return parts, (top, sum(max(map(margin, p)) > 0 for p in parts) if top > 0 else 0)

    memo = toxicity.Memo(lambda ws: np.array([margin(w) for w in ws]))
    found = [toxicity.measures(c, memo) for c in toxicity.in_chunks(texts, memo)]
    want = [plain(t.lower()) for t in texts]
    assert [toxicity.sentences(t.lower()) for t in texts] == [p for p, _ in want]
    assert found == [m for _, m in want]
    assert sum(n > 1 for _, n in found) > 100 and sum(len(toxicity.spelt(t.lower())) > 0 for t in texts) > 20


def test_held_out_documents(spark):
    import labelloom.llm.queries_models as q

    # the smaller tables have some ten held-out documents of class 1
    d = "/root/testdata/sf0.1"
    out = q.op11_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").filter("toxic IS NOT NULL"), "doc_id").filter("held_out").toPandas()
    ranks = out["score"].rank()
    n1 = (out["toxic"] == 1).sum()
    auc = (ranks[out["toxic"] == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(out) - n1))
    assert auc > 0.93
