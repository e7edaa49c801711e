import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelloom.operators import features as X, reports as R, splits as S, tables as T, topics as P
from labelloom.operators.centroids import nearest_centroid_vec
from labelloom.schemas import class_table


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows has one key, some rows have none, some keys have no partner."""
    rows = [(i, "hot" if i % 3 == 0 else (None if i % 50 == 1 else f"k{i % 40}")) for i in range(3000)]
    return spark.createDataFrame(rows, "i int, key string").repartition(8, "i")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_hot_join_equals_plain_join(spark, skewed, how):
    right = spark.createDataFrame([("hot", 0)] + [(f"k{i}", i) for i in range(0, 60, 2)], "key string, v int")
    for max_hot in (2, 10, 1000):
        got = T.join_hot_aware(skewed, right, "key", how, max_hot)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, skewed.join(right, "key", how).collect()))


def test_groups_after_union_come_out_once(spark):
    docs = spark.range(5000).repartition(8, "id").selectExpr("id", "explode(sequence(0, 40)) AS t").withColumn("t", F.expr("id * t % 997"))
    terms = docs.groupBy("t").agg(F.count(F.lit(1)).alias("df")).withColumnRenamed("t", "term")
    joined = X.attach_by_term(docs.withColumnRenamed("t", "term"), terms, max_hot=500)
    assert joined.groupBy("id").count().count() == 5000 and joined.count() == 5000 * 41


@pytest.mark.parametrize("most, sampled", [(500_000, 20_000), (7, 20_000), (0, 20_000), (7, 10)])
def test_tfidf_moves_no_counted_term_of_a_document(spark, monkeypatch, most, sampled):
    """Whatever is broadcast or sampled, weights agree with brute force, and no row leaves its document to be scaled."""
    monkeypatch.setattr(X, "BROADCAST_TERMS", most)
    monkeypatch.setattr(X, "SAMPLE_DOCS", sampled)
    monkeypatch.setattr(X, "ROWS_AT_ONCE", 16)
    draw = random.Random(1)
    texts = {i: ["all"] + [draw.choice("abcdefgh") * draw.randint(1, 9) for _ in range(draw.randint(0, 30))] + [f"only{i}", "ä b"] for i in range(200)}
    texts |= {200: [], 201: None, None: ["all", "none"]}
    df = spark.createDataFrame(list(texts.items()), "id int, words array<string>").repartition(5)
    got = X.tfidf(df, "id", F.col("words"))
    assert "hashpartitioning(id" not in got._jdf.queryExecution().executedPlan().toString()
    frequency = Counter(t for words in texts.values() for t in set(words or []))
    want = {}
    for i, words in texts.items():
        raw = {t: c * (math.log((1 + len(texts)) / (1 + frequency[t])) + 1) for t, c in Counter(words).items()}
        want |= {(i, t): (Counter(words)[t], w / math.hypot(*raw.values())) for t, w in raw.items()}
    rows = got.collect()
    assert len(rows) == len(want)
    assert {(r["id"], r["term"]): (r["tf"], pytest.approx(r["tfidf"])) for r in rows} == want


def test_first_per_key_with_hot_key(skewed):
    got = {r["key"]: r["i"] for r in T.first_per_key(skewed, ["key"], [-F.col("i")]).collect()}
    want = {}
    for r in skewed.collect():
        want[r["key"]] = max(want.get(r["key"], -1), r["i"])
    assert got == want


def test_split_is_exact_and_complete(spark):
    df = spark.range(997).withColumnRenamed("id", "k")
    counts = {r["split"]: r["count"] for r in S.split_60_20_20(df, "k").groupBy("split").count().collect()}
    assert counts == {"train": 598, "validate": 199, "test": 200}


def test_small_splits(spark):
    for n in (1, 2, 5):
        parts = S.split_60_20_20(spark.range(n), "id").collect()
        assert len(parts) == n
        assert sum(r["split"] == "train" for r in parts) == int(0.6 * n)


def test_rank_without_sort(spark):
    df = spark.range(300).withColumn("h", F.md5(F.col("id").cast("string")))
    hashes = sorted(r["h"] for r in df.collect())
    assert [S.hash_at_rank(df, "h", i, digits=1) for i in (0, 7, 150, 299)] == [hashes[i] for i in (0, 7, 150, 299)]


def test_folds_partition_the_rows(spark):
    folds = S.kfold(spark.range(500), "id").collect()
    assert len(folds) == 500 * 8 and all(0 <= r["fold"] < r["k"] for r in folds)


def test_balanced_sample(spark):
    df = spark.range(6000).withColumn("label", (F.col("id") % 10 == 0).cast("int"))
    counts = {r["label"]: r["count"] for r in S.balanced_sample(df, "id", "label").groupBy("label").count().collect()}
    assert all(abs(c - 3000) < 100 for c in counts.values())


def test_rare_class_is_not_cut_off(spark):
    df = spark.range(5000).withColumn("label", (F.col("id") == 17).cast("int"))
    counts = {r["label"]: r["count"] for r in S.balanced_sample(df, "id", "label").groupBy("label").count().collect()}
    assert counts[1] in (2500, 2501) and abs(counts[0] - 2500) < 120


def test_lookup_join_beyond_its_bound(spark, skewed):
    right = spark.createDataFrame([("hot", 0), ("k1", 1), ("k2", 2)], "key string, v int")
    small, large = (T.lookup_join(skewed, right, "key", "left", max_rows=m) for m in (3, 2))
    assert sorted(map(repr, small.collect())) == sorted(map(repr, large.collect()))


def test_class_parts_join_to_the_class_text(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b", f"t{i}") for i in range(25)], "o bigint, c string, t string")
    whole = {r["c"]: r["text"] for r in P.class_text_concat(df, "c", "t", "o", rows_per_part=None).collect()}
    with pytest.raises(ValueError):
        P.class_text_concat(df, "c", "t", "o", rows_per_part=None, max_chars=10)
    parts = P.class_text_concat(df, "c", "t", "o", rows_per_part=10).orderBy("c", "part").collect()
    assert len(parts) == 6
    for c in whole:
        assert "|".join(r["text"] for r in parts if r["c"] == c) == whole[c]


def test_pairwise_coherence_equals_pairs(spark):
    rng = random.Random(1)
    rows = [(i % 3, [rng.gauss(0, 1) for _ in range(5)]) for i in range(30)]
    got = {r["t"]: r["coherence"] for r in P.coherence_pairwise(spark.createDataFrame(rows, "t int, v array<double>"), "t", "v").collect()}
    for t in range(3):
        vs = [v for k, v in rows if k == t]
        cos = [
            sum(a * b for a, b in zip(x, y)) / (sum(a * a for a in x) * sum(b * b for b in y)) ** 0.5
            for i, x in enumerate(vs) for y in vs[i + 1 :]
        ]
        assert got[t] == pytest.approx(sum(cos) / len(cos))


def test_tie_goes_to_the_lowest_centre(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0])], "id int, v array<double>")
    centres = spark.createDataFrame([(2, [0.0, 1.0]), (1, [1.0, 0.0])], "label int, centre array<double>")
    assert nearest_centroid_vec(df, "id", "v", centres, "label").first()["cluster"] == 1


def test_runtime_keeps_days_and_interpolates(spark):
    df = spark.sql("SELECT timestamp'2023-03-01 22:18:05' AS s, timestamp'2023-03-03 15:54:29' AS e")
    assert df.select(R.runtime_seconds(F.col("s"), F.col("e")).alias("x")).first()["x"] == 149784
    runs = spark.createDataFrame([("a", v) for v in (10, 20, 40, 80)] + [("b", 5)], "g string, v bigint")
    box = {r["g"]: (r["n"], r["p0"], r["p25"], r["p50"], r["p75"], r["p100"]) for r in R.runtime_summary(runs, "g", "v").collect()}
    assert box == {"a": (4, 10, 17.5, 30, 50, 80), "b": (1, 5, 5, 5, 5, 5)}


def test_log_lines(spark):
    lines = [
        "[2023-01-14 23:59:00,500]INFO|Topic|a", "[2023-01-15 00:01:00,500]INFO|Topic|b|c", "INFO:root:[2023-01-17 00:01:00.5]INFO|Topic|d", "noise",
    ]
    rows = R.log_events(R.parse_log(spark.createDataFrame([(x,) for x in lines], "value string"))).orderBy("ts").collect()
    assert [(r["message"], r["seconds"]) for r in rows] == [("a", None), ("b|c", 120.0), ("d", 172800.0)]


def test_class_table(spark):
    assert class_table(spark).count() == 7
