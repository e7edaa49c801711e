import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.operators import labelmodel as M, metrics as E, search as H, votes as V

NAMES = [f"keyword_{k}" for k in range(7)]
ALL = NAMES + [f"cluster_{k}" for k in range(7)]


@pytest.fixture(scope="module")
def simulated(spark):
    """Rows drawn from the model: a keyword function fires on its class with 0.7, elsewhere with 0.03; clusters are right with 0.6."""
    rng, rows = random.Random(11), []
    for i in range(6000):
        c = rng.randrange(7)
        kw = [k if rng.random() < (0.7 if k == c else 0.03) else -1 for k in range(7)]
        cl = c if rng.random() < 0.6 else rng.randrange(7)
        rows.append((i, c, *kw, *[k if k == cl else -1 for k in range(7)]))
    return spark.createDataFrame(rows, "id int, LABEL int, " + ", ".join(f"{n} int" for n in ALL)).repartition(8, "id").cache()


def test_fit_recovers_the_parameters(simulated):
    model = M.lm_fit(V.vote_patterns(simulated, ALL), ALL, max_iter=30)
    for k in range(7):
        for c in range(7):
            assert model.mu[f"keyword_{k}"][k][c] == pytest.approx(0.7 if k == c else 0.03, abs=0.06)
    for source in model.mu.values():
        for c in range(7):
            assert sum(row[c] for row in source.values()) == pytest.approx(1)


def test_model_beats_majority_vote(simulated):
    model = M.lm_fit(V.vote_patterns(simulated, ALL), ALL, max_iter=10)
    scored = model.predict(simulated, "hash", F.col("id"), "pred").withColumn("mv", V.majority_vote(ALL, "hash", F.col("id")))
    acc, mv = scored.agg(F.avg((F.col("pred") == F.col("LABEL")).cast("int")), F.avg((F.col("mv") == F.col("LABEL")).cast("int"))).first()
    assert acc > mv - 0.005 and acc > 0.75


def test_posterior_sums_to_one_and_silence_abstains(spark):
    model = M.LabelModel(
        M.sources_of(NAMES), M.initial_parameters({n: {-1: 80.0, k: 20.0} for k, n in enumerate(NAMES)}, M.sources_of(NAMES))
    )
    df = spark.createDataFrame([(1, *[-1] * 7), (2, 0, *[-1] * 6), (3, 0, 1, *[-1] * 5)], "id int, " + ", ".join(f"{n} int" for n in NAMES))
    rows = model.predict(model.with_posterior(df)).orderBy("id").collect()
    assert all(math.isclose(sum(r["posterior"]), 1) for r in rows)
    assert [r["label"] for r in rows] == [-1, 0, -1]
    hashed = model.predict(df, "hash", F.col("id")).orderBy("id").collect()
    assert hashed[1]["label"] == 0 and hashed[2]["label"] in (0, 1) and 0 <= hashed[0]["label"] < 7


def test_pattern_fit_equals_distributed_fit(simulated):
    patterns = V.vote_patterns(simulated, ALL)
    model = M.lm_fit(patterns, ALL, max_iter=4, tol=0.0, smoothing=0.1, prior_acc=0.8, step=0.5)
    pdf = patterns.toPandas()
    fit = H.PatternFit(pdf, pdf.assign(label=0), ALL)
    for s, mu in zip(fit.sources, fit.fit(4, 0.0, 0.1, 0.8, 0.5)):
        assert np.allclose(mu, [model.mu[s.name][o] for o in s.outcomes], atol=1e-9)


def test_model_table_round_trip(spark, simulated):
    model = M.lm_fit(V.vote_patterns(simulated, ALL), ALL, max_iter=1)
    table = model.to_table(spark)
    assert table.count() == 154
    again = M.LabelModel.from_table(table, model.sources)
    assert all(tuple(again.mu[s][o]) == tuple(model.mu[s][o]) for s in model.mu for o in model.mu[s])


def test_champion_must_be_strictly_better(simulated):
    model = M.lm_fit(V.vote_patterns(simulated, ALL), ALL, max_iter=1)
    same = M.champion_check(simulated, "LABEL", model, model, "id").first()
    assert same["new_accuracy"] == same["old_accuracy"] and not same["replace"]
    assert M.champion_check(simulated, "LABEL", model, None, "id").first()["replace"]


def test_summary_bounds(simulated):
    for r in V.lf_summary(V.vote_patterns(simulated, ALL), ALL).collect():
        assert 0 <= r["conflicts"] <= r["overlaps"] <= r["coverage"] <= 1
        assert r["polarity"] == r["lf"].split("_")[1]


def test_keyword_is_not_lowered_and_matches_inside_words(spark):
    df = spark.createDataFrame([("Auto",), ("Autobahn",), ("x",)], "text string")

    def run(*words):
        return [r[0] for r in df.select(V.keyword_lf(3, words, "text").vote().alias("v")).collect()]

    assert run("Auto") == [-1, -1, -1] and run("auto") == [3, 3, -1] and run() == [-1, -1, -1]
    assert run(*[f"w{i}." for i in range(30)], "auto") == [3, 3, -1]


def test_user_functions_may_be_pandas_udfs(spark):
    import pandas as pd

    @F.pandas_udf("int")
    def long_text(t: pd.Series) -> pd.Series:
        return t.str.len().gt(3).map({True: 2, False: -1})

    registry = V.LFRegistry.standard({}, "text").add(V.LabelingFunction("long", lambda: long_text("text")))
    df = spark.createDataFrame([(1, "abc"), (2, "abcd")], "id int, text string")
    assert [r["long"] for r in V.apply_lfs(df, registry, ["id"]).orderBy("id").collect()] == [-1, 2]
    with pytest.raises(ValueError):
        registry.add(V.LabelingFunction("long", lambda: F.lit(0)))


def test_ties(spark):
    df = spark.createDataFrame([(i, 0, 1, -1) for i in range(200)], "id int, a int, b int, c int")
    assert df.filter(V.majority_vote(["a", "b", "c"]) == -1).count() == 200
    drawn = df.groupBy(V.majority_vote(["a", "b", "c"], "hash", F.col("id")).alias("v")).count().collect()
    assert {r["v"] for r in drawn} == {0, 1} and min(r["count"] for r in drawn) > 60


def test_metrics_of_degenerate_predictions(spark):
    rows = spark.createDataFrame([(0, 1), (1, 1), (2, 1)], "l int, p int")
    m = E.metrics(E.confusion(rows, "l", "p")).first()
    assert m["mcc"] == 0 and m["accuracy"] == pytest.approx(1 / 3) and m["precision_macro"] == pytest.approx(1 / 21)


def test_metrics_equal_the_numpy_ones(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(7), rng.choice([-1, *range(7)])) for _ in range(500)]
    m = E.metrics(E.confusion(spark.createDataFrame(pairs, "l int, p int"), "l", "p")).first().asDict()
    table = np.zeros((8, 8))
    for a, b in pairs:
        table[a + 1, b + 1] += 1
    for name, value in H.table_scores(table).items():
        assert m[name] == pytest.approx(value), name
