"""Every registered query against its SQL twin; the others must run and keep their invariants."""

import pytest
from compare import connect, differences

import __spark_entry__ as entry
from labelloom.plans import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracles()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf_dir, con, name):
    assert differences(QUERIES[name](spark, sf_dir), con, ORACLES[name]) == []


def test_entry_has_all_classes(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 7 and sum(r["n"] for r in rows) > 0


def test_topic_model(spark, sf_dir):
    rows = QUERIES["topic_model_corpus"](spark, sf_dir).collect()
    assert len(rows) == 14 and all(r["term"] and r["weight"] > 0 for r in rows)


def test_dominant_topic(spark, sf_dir):
    rows = QUERIES["dominant_topic"](spark, sf_dir).collect()
    assert len(rows) == 200
    assert all(r["topic"] in (0, 1) and r["share"] >= 0.5 - 1e-9 if r["share"] > 0 else r["topic"] is None for r in rows)


def test_clf_features_are_unit_vectors(spark, sf_dir):
    for r in QUERIES["clf_features"](spark, sf_dir).collect():
        assert r["square"] == (1.0 if r["n_features"] else 0.0)


def test_classifier_beats_the_largest_class(spark, sf_dir):
    scores = QUERIES["clf_validate"](spark, sf_dir).first()
    assert scores["accuracy"] > 0.5 and 0 < scores["mcc"] <= 1


def test_stored_model_predicts_the_same(spark, sf_dir):
    rows = QUERIES["model_save_load"](spark, sf_dir).collect()
    assert len(rows) == 200 and all(r["pred"] == r["pred_loaded"] for r in rows)


def test_search_tables(spark, sf_dir):
    grid = QUERIES["search_grid"](spark, sf_dir).collect()
    drawn = QUERIES["search_random"](spark, sf_dir).collect()
    assert len({r["config_id"] for r in grid}) == 324 and len({r["config_id"] for r in drawn}) == 40
    assert all(0 <= r["accuracy"] <= r["coverage"] <= 1 for r in grid + drawn)


def test_search_halving_keeps_thirds(spark, sf_dir):
    rows = QUERIES["search_halving"](spark, sf_dir).collect()
    assert [sum((r["bracket"], r["rung"]) == x for r in rows) for x in ((0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (2, 0))] == [27, 9, 3, 9, 3, 3]
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_centroids_have_terms_and_members(spark):
    d = "/root/testdata/sf0.01"
    terms = {r["cluster"]: r["n"] for r in QUERIES["fixed_centroids"](spark, d).groupBy("cluster").count().withColumnRenamed("count", "n").collect()}
    assert sorted(terms) == list(range(7)) and min(terms.values()) >= 5
    members = {r["cluster"] for r in QUERIES["nearest_centroid"](spark, d).select("cluster").distinct().collect()}
    assert members == set(range(7))
