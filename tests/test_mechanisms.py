"""Keyed streaming state, the carry scan over log lines, and the weighted draw."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F, types as T

from labelloom.operators import reports as R, splits as S
from labelloom.streaming import incremental as I

SCHEMA = T.StructType([T.StructField("url", T.StringType()), T.StructField("o", T.IntegerType())])


def test_a_batch_never_reads_the_target(spark, tmp_path):
    """The target may be lost between two batches: what has been seen is state, not a table."""
    arriving, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    rows = [(i, f"u{i % 50}" if i % 4 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "o int, url string")
    process = lambda new: new.select("url", "o")
    run = lambda: I.run_incremental(I.read_arriving(spark, arriving, df.schema, 1), target, progress, "url", "o", process, SCHEMA)
    df.filter("o < 200").coalesce(1).write.parquet(arriving)
    run()
    first = I.read_target(spark, target, SCHEMA).select("url", "o").collect()
    want = {}
    for o, u in rows[:200]:
        want.setdefault(u, o)
    assert sorted(map(tuple, first), key=repr) == sorted(((u, o) for u, o in want.items()), key=repr)
    moved = str(tmp_path / "elsewhere")
    df.filter("o >= 200").coalesce(1).write.mode("append").parquet(arriving)
    I.run_incremental(I.read_arriving(spark, arriving, df.schema, 1), moved, progress, "url", "o", process, SCHEMA)
    assert I.read_target(spark, moved, SCHEMA).count() == 0
    assert spark.conf.get(I.STATE_STORE) != I.ROCKSDB


def test_lag_over_ranges_equals_lag(spark):
    rng = random.Random(2)
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(seconds=rng.randrange(50)), "INFO", "hot" if i % 10 else f"l{i % 3}", f"m{rng.randrange(30)}") for i in range(2_000)]
    rows += [(start + dt.timedelta(days=1), "INFO", "last", "m")]
    df = spark.createDataFrame(rows, "ts timestamp, level string, logger string, message string")
    got = sorted(tuple(r) for r in R.log_events(df, rows_per_range=100).select("logger", "ts", "message", F.coalesce("seconds", F.lit(-1.0))).collect())
    want, before = [], {}
    for ts, _, logger, message in sorted(rows, key=lambda r: (r[2], r[0], r[3])):
        want.append((logger, ts, message, (ts - before[logger]).total_seconds() if logger in before else -1.0))
        before[logger] = ts
    assert got == sorted(want)


def test_ranges_split_a_hot_logger(spark, monkeypatch):
    seen = {}
    real = R.stored
    monkeypatch.setattr(R, "stored", lambda df, name: seen.setdefault(name, real(df, name)))
    spark.range(5_000).select(F.lit(dt.datetime(2024, 1, 1)).alias("ts"), F.lit("INFO").alias("level"), F.lit("one").alias("logger"), F.lit("same").alias("message")).createOrReplaceTempView("hot_lines")
    assert R.log_events(spark.table("hot_lines"), rows_per_range=500).filter("seconds = 0").count() == 4_999
    sizes = [r["n"] for r in seen["log_ranges"].groupBy("part").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 10 and max(sizes) < 1_000


def test_weighted_draw_is_exact_and_balanced(spark):
    rows = [(i, "big") for i in range(3_000)] + [(i, "small") for i in range(3_000, 3_010)] + [(9_000, "one"), (9_001, None)]
    df = spark.createDataFrame(rows, "id int, label string").withColumn("extra", F.lit("x"))
    out = S.weighted_draw(df, "id", "label", n=6_000).toPandas()
    assert len(out) == 6_000 and sorted(out["draw"]) == list(range(6_000)) and list(out.columns) == ["draw", "id", "label", "extra"]
    shares = out["label"].value_counts()
    # three classes, each 2,000 times within five standard deviations
    assert all(abs(shares[c] - 2_000) < 5 * (6_000 * 2 / 9) ** 0.5 for c in ("big", "small", "one"))
    small = out[out["label"] == "small"]["id"].value_counts()
    assert len(small) == 10 and all(abs(n - 200) < 5 * 200**0.5 for n in small)
    again = S.weighted_draw(df.repartition(3), "id", "label", n=6_000).toPandas()
    key = ["draw", "id"]
    assert out[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()
    assert S.weighted_draw(df.filter("label IS NULL"), "id", "label").count() == 0
    assert len(S.weighted_draw(df, "id", "label").collect()) == 3_011


def test_rows_are_numbered_over_ranges(spark):
    df = spark.range(1_000).select(F.col("id"), (F.col("id") % 3).alias("g"))
    whole = {r["id"]: r["pos"] for r in S.numbered_rows(df, "id", "g").collect()}
    parts = {r["id"]: r["pos"] for r in S.numbered_rows(df, "id", "g", rows_per_range=50).collect()}
    assert whole == parts
    for g in range(3):
        mine = sorted(whole[i] for i in range(g, 1_000, 3))
        assert mine == list(range(len(mine)))


def test_topic_counts_stay_with_their_documents(spark, monkeypatch):
    """Iterations move shares and rare terms, no counts of frequent terms; where terms are parted changes no result."""
    from labelloom.operators import topicmodel as T

    rows = [(i, [f"w{i * j % 17}" for j in range(1, 12)] + [f"r{i}"]) for i in range(60)] + [(60, []), (61, None)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    names, plans = [], []
    by_document, summed = T._by_document, T._summed
    monkeypatch.setattr(T, "_by_document", lambda p: (names.append(by_document(p)), names[-1])[1])
    monkeypatch.setattr(T, "_summed", lambda j, k: (plans.append(j._jdf.queryExecution().executedPlan().toString()), summed(j, k))[1])

    def model():
        m = T.fit_topics(df, "id", "tokens", 2, 3)
        return {r["term"]: r["weights"] for r in m.terms.collect()}, {r["id"]: r["shares"] for r in m.docs.collect()}

    terms, docs = model()
    assert len(names) == 1 and set(docs) == set(range(60))
    assert [p.count("Exchange hashpartitioning") for p in plans] == [0, 1, 1]
    monkeypatch.setattr(T, "BROADCAST_TERMS", 9)
    parted_terms, parted_docs = model()
    assert len(names) == 3 and not any(spark.catalog.tableExists(n) for n in names)
    assert parted_terms.keys() == terms.keys() and all(parted_terms[t] == pytest.approx(w) for t, w in terms.items())
    assert all(parted_docs[i] == pytest.approx(s) for i, s in docs.items())


def test_arriving_files_grow_in_number_not_in_size(spark, sf_dir, monkeypatch):
    from labelloom.plans import catalog_stream as C

    seen = []
    monkeypatch.setattr(C, "ROWS_PER_FILE", 25, raising=False)
    monkeypatch.setattr(C, "read_arriving", lambda spark, path, schema, per_batch: seen.append((path, per_batch)))
    C.arriving(spark, sf_dir)
    path, per_batch = seen[0]
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()]
    rows = sum(sizes)
    assert rows == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert per_batch == -(-(-(-rows // 25)) // 2) and max(sizes) < rows / 4


def test_class_terms_are_one_row_for_all_classes(spark):
    """Sums by class give the same counts as rows by class, from counts that the row brings."""
    from labelloom.functions.text import term_counts
    from labelloom.operators import topics as P

    rows = [([0, 2], ["a", "b", "a"]), ([2], ["b", None, "c"]), ([], ["d"]), ([1], []), ([0], None)]
    df = spark.createDataFrame(rows, "cs array<int>, tokens array<string>").withColumn("counts", term_counts(F.filter("tokens", lambda t: t.isNotNull())))
    plain = P.class_terms(df.withColumn("tokens", F.filter("tokens", lambda t: t.isNotNull())), F.col("cs"), "tokens", "c")
    summed = P.class_terms(df, F.col("cs"), "tokens", "c", counts="counts", n_classes=3)
    assert sorted(map(tuple, summed.collect())) == sorted(map(tuple, plain.collect())) == [(0, "a", 2), (0, "b", 1), (2, "a", 2), (2, "b", 2), (2, "c", 1)]
    grouped = summed._jdf.queryExecution().optimizedPlan().toString()
    assert grouped.count("Aggregate [") == 1 and "explode_outer(cs" not in grouped.replace(" ", "")
