"""The queries of the ten operators against their SQL twins, and edge cases that all of them must define."""

import pytest
from compare import connect, differences
from pyspark.sql import functions as F

from labelloom.llm import catalog, decontaminate, katz, license_scan, mixing, ngram_jaccard, quality, secret_scan, sharding, url_filter, warc
from labelloom.llm.queries_corpus import TRAINED

QUERIES, ORACLES = catalog.queries(), catalog.oracles()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name]) == []


LONG = "lang wort " * 30_000
ROWS = [(1, None, "a"), (2, "", "b"), (3, "   \n", None), (None, "one two three four five six", "a"), (None, None, None), (4, "x", "a"), (4, "x", "a"), (5, LONG, "b"), (6, LONG, "c")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, very long and repeated rows, and columns whose names the operators use themselves."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    clash = ("size", "shard", "node", "n_words", "kept", "score", "chunk", "bucket", "__key", "__text", "__row", "item_id", "path", "s")
    return df.withColumns({c: F.lit("z") for c in clash})


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "lang wort " * 10), (None, "lang wort " * 10)], "item_id long, text string")


OPERATORS = {
    "similar": lambda df, b: ngram_jaccard.similar(df),
    "licenses": lambda df, b: license_scan.scan_licenses(df),
    "secrets": lambda df, b: secret_scan.find_secrets(df),
    "katz": lambda df, b: katz.score_corpus(df, TRAINED),
    "shards": lambda df, b: sharding.shard_rows(df, sharding.topology(3)),
    "urls": lambda df, b: url_filter.judge(df, "doc_id", "text"),
    "archives": lambda df, b: warc.read_archives(warc.write_archives(warc.deduplicated(df, "doc_id", "source", "text"))),
    "quality": lambda df, b: quality.report(df),
    "mix": lambda df, b: mixing.mix(df),
}
STAGES = {
    "first": lambda df, b: ngram_jaccard.first_of_each(df),
    "clean": lambda df, b: decontaminate.clean(df, b),
    "kept": lambda df, b: quality.kept(df),
    "mixed": lambda df, b: mixing.mixed(df),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_tables(spark, odd, bench, name):
    assert OPERATORS[name](odd, bench).count() == len(ROWS)
    assert OPERATORS[name](odd.limit(0), bench).count() == 0


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns(spark, odd, bench, name):
    out = STAGES[name](odd, bench)
    assert out.columns == odd.columns and out.count() <= len(ROWS) * 2
    assert STAGES[name](odd.limit(0), bench.limit(0)).count() == 0


def test_defined_results(spark, odd, bench):
    classes = {(r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_jaccard.similar(odd).collect()}
    assert classes == {(1, 1, 0), (2, 2, 0), (3, 3, 0), (None, None, 0), (4, 4, 1), (5, 5, 1), (6, 5, 1)}
    hits = {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(odd, bench).collect()}
    assert hits == {(5, 3), (6, 3), (5, None), (6, None)}
    assert all(r["size"] * 2 >= r["taken"] for r in mixing.mix(odd).collect())


def test_pipeline_holds_what_its_parts_say(spark, sf_dir):
    import corpus_pipeline

    con = connect(sf_dir)
    rows = {r[0]: r[1:] for r in con.execute("SELECT doc_id, text, source FROM documents").fetchall()}
    good = {r[0] for r in con.execute(f"SELECT doc_id FROM ({ORACLES['op9_quality']}) WHERE kept").fetchall()}
    con.execute("CREATE TEMP TABLE kept AS SELECT documents.* FROM documents WHERE doc_id IN (SELECT unnest($1))", [sorted(good)])
    con.execute("DROP VIEW documents; CREATE VIEW documents AS SELECT * FROM kept")
    first = {r[0] for r in con.execute(f"SELECT doc_id FROM ({ORACLES['op1_ngram_jaccard']}) WHERE doc_id = class_id").fetchall()}
    leaks = {r[0] for r in con.execute(ORACLES["op7_decontamination"]).fetchall()}
    left = first - leaks
    sizes = {d: len([w for w in rows[d][0].split()]) for d in left}
    totals: dict = {}
    for d in left:
        totals[rows[d][1]] = totals.get(rows[d][1], 0) + sizes[d]
    out = corpus_pipeline.run(spark, sf_dir)
    got = [(r["doc_id"], r["shard"], r["slot"]) for r in out.collect()]
    assert {d for d, _, _ in got} <= left
    times = {d: sum(x == d for x, _, _ in got) for d in left}
    assert max(times.values()) <= 2
    taken: dict = {}
    for d, n in times.items():
        taken[rows[d][1]] = taken.get(rows[d][1], 0) + n * sizes[d]
    goal = mixing_targets(totals)
    for s in totals:
        lengths = sorted({sizes[d] for d in left if rows[d][1] == s})
        copies, extra = mixing.spend(lengths, [sum(sizes[d] == n for d in left if rows[d][1] == s) for n in lengths], int(goal[s] + 0.5))
        assert taken[s] == copies * totals[s] + sum(n * e for n, e in zip(lengths, extra)) <= goal[s] + 0.5
    for s in range(8):
        slots = sorted(x[2] for x in got if x[1] == s)
        assert slots == list(range(len(slots)))


def mixing_targets(sizes: dict) -> dict:
    """Shares by weight, cut at twice the size, the excess shared again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    done: dict = {}
    while True:
        free = [s for s in names if s not in done]
        rest = 1.5 * sum(sizes.values()) - sum(done.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s: 2.0 * sizes[s] for s in free if share[s] > 2 * sizes[s]}
        if not above:
            return done | share
        done |= above


def test_targets_equal_repeated_sharing(spark):
    import random

    rng = random.Random(3)
    for n in (1, 4, 11):
        sizes = {(None if i == 0 else f"s{i:02d}"): rng.choice([0, 5, 100, 3000, 100000]) for i in range(n)}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
        assert got == pytest.approx(mixing_targets(sizes))
