"""Moment-based label model, corpus topics, coherence on windows, and the bracket search."""

import itertools
import math
import random
import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from labelloom.operators import brackets as B, coherence as W, momentmodel as MM, topicmodel as T, votes as V
from labelloom.session import scratch_path

ACCURACY = {"a": 0.9, "b": 0.8, "c": 0.7, "d": 0.6, "e": 0.75}
COVER = 0.8


@pytest.fixture(scope="module")
def planted(spark):
    """Vote patterns of five independent sources that vote for any class, with planted accuracies."""
    rng, rows = random.Random(2), []
    for _ in range(40_000):
        c = rng.randrange(7)
        vote = lambda p: c if rng.random() < p else rng.choice([k for k in range(7) if k != c])
        rows.append(tuple(vote(p) if rng.random() < COVER else -1 for p in ACCURACY.values()))
    df = spark.createDataFrame(rows, ", ".join(f"{n} int" for n in ACCURACY))
    return V.vote_patterns(df, list(ACCURACY)).cache()


@pytest.mark.parametrize("optimizer,rate,epochs", [("sgd", 0.5, 3_000), ("adam", 0.01, 1_500), ("adamax", 0.01, 1_500)])
def test_moments_recover_planted_accuracies(planted, optimizer, rate, epochs):
    model, history = MM.lm_fit_moments(planted, list(ACCURACY), epochs, rate, optimizer=optimizer)
    for name, accuracy in ACCURACY.items():
        right = np.mean([model.mu[name][k][k] for k in range(7)]) / COVER
        assert right == pytest.approx(accuracy, abs=0.03)
    losses = [x for _, x in history]
    assert losses[-1] < 0.05 * losses[0] and history[0][0] == 0 and history[-1][0] == epochs


def test_gradient_is_that_of_the_loss(planted):
    problem = MM.moment_problem(planted, list(ACCURACY))
    rng = np.random.default_rng(1)
    mu = rng.uniform(0.05, 0.9, problem.start.shape)
    grad = problem.gradient(mu, 0.3)
    for i, j in [(0, 0), (9, 3), (34, 6)]:
        up, down = mu.copy(), mu.copy()
        up[i, j] += 1e-5
        down[i, j] -= 1e-5
        assert grad[i, j] == pytest.approx((problem.loss(up, 0.3) - problem.loss(down, 0.3)) / 2e-5, rel=1e-4, abs=1e-7)


def test_foreign_votes_fail(spark):
    df = spark.createDataFrame([(5, 3)], "keyword_3 int, n long")
    with pytest.raises(ValueError, match="does not have"):
        MM.moment_problem(df, ["keyword_3"])


def test_topics_separate_and_ignore_partitions(spark):
    rng = random.Random(3)
    rows = [(i, [f"{'ab'[i % 2]}{rng.randrange(30)}" for _ in range(40)]) for i in range(200)] + [(1_000, []), (1_001, None)]
    df = spark.createDataFrame(rows, "doc int, tokens array<string>")
    model = T.fit_topics(df, "doc", "tokens", iterations=25)
    got = {r["doc"]: r for r in T.dominant_topic(model, df, "doc").collect()}
    assert len({got[i]["topic"] for i in range(0, 200, 2)}) == 1 and len({got[i]["topic"] for i in range(200)}) == 2
    assert got[1_000]["topic"] is None and got[1_001]["share"] == 0.0
    assert model.terms.agg(*[F.sum(F.get("weights", F.lit(i))) for i in range(2)]).first()[0] == pytest.approx(1)
    terms = T.topic_terms(model, 5).orderBy("topic", "rank").collect()
    assert [r["rank"] for r in terms] == [1, 2, 3, 4, 5] * 2
    again = T.topic_terms(T.fit_topics(df.repartition(5), "doc", "tokens", iterations=25), 5).orderBy("topic", "rank").collect()
    assert [(r["topic"], r["term"]) for r in terms] == [(r["topic"], r["term"]) for r in again]


def windows(docs, topics, size):
    """Brute force over all windows."""
    seen, total = {}, 0
    for tokens in docs:
        for s in range(max(1, len(tokens) - size + 1) if tokens else 0):
            total += 1
            part = set(tokens[s : s + size])
            for t, terms in topics.items():
                for a, b in itertools.combinations_with_replacement(sorted(part & set(terms)), 2):
                    seen[t, a, b] = seen.get((t, a, b), 0) + 1
    return seen, total


@pytest.mark.parametrize("size", [1, 3, 10, 200])
def test_window_counts_equal_brute_force(spark, size):
    rng = random.Random(size)
    docs = [[rng.choice("abcdefgh") for _ in range(n)] for n in (0, 1, 2, 9, 10, 11, 60, 120)]
    topics = {0: ["a", "b", "c"], 1: ["a", "d", "z"], 2: ["e"]}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)] + [(99, None)], "doc int, tokens array<string>")
    listed = spark.createDataFrame([(t, w) for t, ws in topics.items() for w in ws], "topic int, term string")
    seen, total = windows(docs, topics, size)
    got = W.window_counts(listed, df, "doc", "tokens", size).collect()
    assert {(r["topic"], r["t1"], r["t2"]): r["n12"] for r in got if r["n12"]} == seen
    assert all(r["n"] == total and r["n1"] == seen[r["topic"], r["t1"], r["t1"]] for r in got)
    scores = {r["topic"]: r for r in W.coherence_windows(listed, df, "doc", "tokens", size).collect()}
    assert scores[2]["npmi"] is None and scores[2]["c_v"] == pytest.approx(1) and scores[1]["n_terms"] == 2
    p = lambda a, b: seen.get((0, *sorted((a, b))), 0) / total
    m = lambda a, b: math.log((p(a, b) + 1e-12) / (p(a, a) * p(b, b))) / -math.log(p(a, b) + 1e-12)
    if max(p(a, a) for a in "abc") < 1:
        grid = np.array([[m(a, b) for b in "abc"] for a in "abc"])
        whole = grid.sum(axis=0)
        cosines = [row @ whole / np.linalg.norm(row) / np.linalg.norm(whole) for row in grid]
        assert scores[0]["c_v"] == pytest.approx(np.mean(cosines))
        assert scores[0]["npmi"] == pytest.approx(np.mean([m(a, b) for a, b in itertools.combinations("abc", 2)]))


def classified(spark, n=600):
    rng, rows = random.Random(9), []
    for i in range(n):
        c = rng.randrange(7)
        rows.append((i, " ".join(f"word{c}x{rng.randrange(5)}" if rng.random() < 0.4 else f"noise{rng.randrange(50)}" for _ in range(12)), "en", c))
    df = spark.createDataFrame(rows, "id int, text string, lang string, label int")
    feats = B.hashed_features(df, "id", F.col("text"), F.col("lang"), "label", 512)
    return feats.filter("key % 4 > 0"), feats.filter("key % 4 = 0")


REPLAY = """
SELECT * FROM r WHERE promoted <> (rank <= greatest(1, of // 3) AND epochs * 3 <= 9)
  OR rank <> (SELECT count(*) FROM r AS o WHERE o.bracket = r.bracket AND o.rung = r.rung AND (o.score > r.score OR o.score = r.score AND o.config_id <= r.config_id))
"""


def test_brackets_promote_by_score_and_learn(spark):
    train, test = classified(spark)
    rows = B.search_brackets(train, test, B.sampled_configs(spark, 39), width=512).toPandas()
    assert sorted(rows.groupby(["bracket", "rung"]).size().items()) == [((0, 0), 27), ((0, 1), 9), ((0, 2), 3), ((1, 0), 9), ((1, 1), 3), ((2, 0), 3)]
    rows["of"] = rows.groupby(["bracket", "rung"])["config_id"].transform("size")
    con = duckdb.connect()
    con.register("r", rows)
    assert con.execute(REPLAY).fetchall() == []
    went_on = {(r.bracket, r.rung + 1, r.config_id) for r in rows.itertuples() if r.promoted}
    assert went_on == {(r.bracket, r.rung, r.config_id) for r in rows.itertuples() if r.rung}
    assert rows["score"].max() > 0.9


def test_brackets_resume_from_stored_passes(spark, monkeypatch):
    train, test = classified(spark, 200)
    few = (B.Bracket(3, 1), B.Bracket(1, 3))
    path = scratch_path(spark, "brackets")
    configs = B.sampled_configs(spark, 4)
    whole = B.search_brackets(train, test, configs, few, max_epochs=3, width=512, path=path).collect()
    passes = []
    real = B._one_pass
    monkeypatch.setattr(B, "_one_pass", lambda *a: passes.append(1) or real(*a))
    assert B.search_brackets(train, test, configs, few, max_epochs=3, width=512, path=path).collect() == whole
    assert passes == []
    with pytest.raises(ValueError, match="configurations for"):
        B.search_brackets(train, test, configs.limit(2), few, width=512)


def test_brackets_train_together_as_alone():
    """Many configurations in one go over the rows end where each would end alone."""
    rng = np.random.default_rng(3)
    at = [rng.integers(0, 40, rng.integers(0, 12)) for _ in range(1300)]
    frame = pd.DataFrame({"at": at, "value": [rng.random(len(x)) for x in at]})
    rows, y = B._Rows(frame, 40), rng.integers(0, 3, len(at))
    weight, w = rng.random(len(at)), rng.random((3, 3, 41))
    configs = [{"rate": 0.5, "l2": 0.01, "batch": 7}, {"rate": 3.0, "l2": 1e-4, "batch": 127}, {"rate": 0.1, "l2": 0.5, "batch": 600}]
    x = rows.matrix(0, len(at))
    assert x[5, at[5]].sum() > 0 or not len(at[5])
    together = B.sgd_passes(w, rows, y, weight, configs)
    for c, f in enumerate(configs):
        alone = B.sgd_pass(w[c], x[:, :-1], y, weight, f["rate"], f["l2"], f["batch"])
        assert np.abs(together[c] - alone).max() < 1e-9


def test_hashed_features_of_a_long_text_grow_with_it(spark):
    """The length of a row is summed once, not once per term: thirty thousand different terms took minutes."""
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(30_000)), lambda i: F.concat(F.lit("w"), i.cast("string"))))
    df = spark.range(1).select(F.col("id").cast("int").alias("id"), text.alias("text"), F.lit("en").alias("lang"), F.lit(1).alias("label"))
    began = time.time()
    row = B.hashed_features(df, "id", F.col("text"), F.col("lang"), "label").first()
    assert time.time() - began < 15
    assert len(row["value"]) == 30_000 and abs(sum(v * v for v in row["value"]) - 1) < 1e-9
