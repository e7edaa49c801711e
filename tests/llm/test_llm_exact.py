"""Exact budgets with ties, short benchmark items, hot null keys: against brute force."""

import itertools
import random

import pytest
from compare import connect
from pyspark.sql import functions as F
from test_llm_queries import mixing_targets

from labelloom.llm import decontaminate, mixing, url_filter
from labelloom.llm.queries_corpus import op10_mixing


def test_small_budgets_are_spent_as_well_as_possible():
    rng = random.Random(8)
    for _ in range(300):
        lengths = rng.sample(range(1, 30), rng.randrange(1, 5))
        counts = [rng.randrange(1, 5) for _ in lengths]
        size = sum(a * b for a, b in zip(lengths, counts))
        budget = rng.randrange(2 * size + 1)
        copies, extra = mixing.spend(lengths, counts, budget)
        sums = (sum(a * b for a, b in zip(lengths, t)) for t in itertools.product(*[range(c + 1) for c in counts]))
        assert sum(a * b for a, b in zip(lengths, extra)) == max(s for s in sums if s <= budget - copies * size)


def check_mix(rows, got):
    """Sizes, targets and budgets of a mix, from the rows ``(doc_id, text, source)`` alone."""
    sizes: dict = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    goals = mixing_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    want = sorted(((d, len((t or "").split()), s) for d, t, s in rows), key=repr)
    assert len(got) == len(rows)
    by_row: dict = {}
    for d, n, s in want:
        by_row.setdefault((d, n), []).append(s)
    for r in got:
        source = by_row[r["doc_id"], r["size"]]
        assert r["source_size"] in {sizes[s] for s in source}
        assert r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 2 * r["size"]
    return sizes, goals, taken


def test_tied_rows_do_not_overshoot(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(20, 200))), "a") for i in range(400)]
    rows += [(None, "x y z " * 40, "a")] * 200 + [(None, "x y z " * 40, None)] * 30 + [(i, "q " * 50, "b") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    sizes, goals, _ = check_mix(rows, got)
    by_target = {round(goals[s], 6): s for s in goals}
    taken = dict.fromkeys(goals, 0)
    for r in got:
        taken[by_target[round(r["target"], 6)]] += r["taken"]
    for s in goals:
        assert 0 <= int(goals[s] + 0.5) - taken[s] <= 1
    out = mixing.mixed(df.withColumn("size", F.lit("z")))
    assert out.columns == ["doc_id", "text", "source", "size"]
    words = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " +"))).alias("n")).collect()}
    assert words == {s: n for s, n in taken.items() if n}
    again = sorted(map(repr, mixing.mix(df.repartition(7)).collect()))
    assert again == sorted(map(repr, got))


def test_mixing_query_against_sql_and_brute_force(spark, sf_dir):
    con = connect(sf_dir)
    sizes = con.execute(
        r"SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) FROM documents"
    ).fetchall()
    totals: dict = {}
    for _, s, n in sizes:
        totals[s] = totals.get(s, 0) + n
    goals = mixing_targets(totals)
    got = {r["doc_id"]: r for r in op10_mixing(spark, sf_dir).collect()}
    assert len(got) == len(sizes)
    for d, s, n in sizes:
        assert (got[d]["size"], got[d]["source_size"]) == (n, totals[s])
        assert got[d]["target"] == pytest.approx(goals[s])
    for s in totals:
        mine = [(n, got[d]["taken"]) for d, source, n in sizes if source == s]
        lengths = sorted({n for n, _ in mine if n})
        copies, extra = mixing.spend(lengths, [sum(n == m for m, _ in mine) for n in lengths], int(goals[s] + 0.5))
        for n, e in zip(lengths, extra):
            assert sum(t for m, t in mine if m == n) == n * (copies * sum(m == n for m, _ in mine) + e)
        assert sum(t for _, t in mine) <= goals[s] + 0.5


FOX = "the quick brown fox jumps over the lazy dog"


def test_short_items_must_be_there_as_a_whole(spark):
    bench = spark.createDataFrame([(1, FOX), (2, "call me Ishmael"), (3, "eureka"), (4, None), (5, "a b c d e f g h i j k")], "item_id long, text string")
    docs = [(1, f"well {FOX} again"), (2, FOX.replace("fox", "cat")), (3, "Call me  ishmael."), (4, "Call me Ishmael"), (5, "eureka"), (6, "a b c d e f g h i j x"), (7, "z a b c d e f g h i j k"), (8, "me ishmael"), (9, None), (10, "call me")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["matched"], r["doc_start"]) for r in decontaminate.overlaps(df, bench).collect()}
    assert got == {(1, 1, 9, 1), (4, 2, 3, 0), (5, 3, 1, 0), (7, 5, 11, 1)}
    assert {r["doc_id"] for r in decontaminate.clean(df, bench).collect()} == {2, 3, 6, 8, 9, 10}


def test_rows_of_a_null_key_are_told_apart(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    bench = spark.createDataFrame([(7, passage)], "item_id long, text string").withColumn("doc_id", F.lit(0))
    docs = [(None, f"text {i} " + " ".join(f"w{i}x{j}" for j in range(20)) + (f" {passage}" if i % 2 else "")) for i in range(300)] + [(1, None), (2, passage), (2, "clean text")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("z") for c in ("item_id", "pos", "seed", "diagonal", "hit", "__sum", "__hits", "o")})
    kept = decontaminate.clean(df, bench)
    assert kept.count() == 152 and kept.columns == df.columns
    hits = decontaminate.overlaps(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in hits} == {(None, 7), (2, 7)} and len(hits) == 2
    assert decontaminate.overlaps(df.limit(0), bench).count() == decontaminate.overlaps(df, bench.limit(0)).count() == 0
    # the rows that meet for verification: each its own hits only
    suspects = decontaminate._suspects(df, bench, "doc_id", "text", "item_id", "text")
    assert suspects.count() == 151 and suspects.agg(F.max(F.size("__hits"))).first()[0] == 1


def test_url_models_count_all_examples(spark, monkeypatch):
    """300,000 accepted URLs: all but the held-out fold are in the counts, however many there are."""
    seen = []
    fit = url_filter.fit
    monkeypatch.setattr(url_filter, "fit", lambda rows: (seen.append(rows.groupBy("accepted").count().collect()), fit(rows))[1])
    n = 300_000
    pages = spark.range(n).select(F.col("id").alias("page_id"), F.concat(F.lit("http://s.com/"), F.md5(F.col("id").cast("string"))).alias("url"))
    held = pages.filter(url_filter.draw52(F.concat(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url")))) % url_filter.FOLDS == 0).count()
    assert url_filter.judge(pages).limit(1).count() == 1
    assert [(r["accepted"], r["count"]) for r in seen[0]] == [(True, n - held)]
