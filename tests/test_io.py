import json
import random

import pandas as pd
import pyarrow as pa
import pyarrow.feather as feather
import pytest
from pyspark.sql import functions as F, types as T

from labelloom import session
from labelloom.operators.clean import clean_text
from labelloom.operators.lang import train_language_model
from labelloom.schemas import RAW_TEXTS
from labelloom.sources import corpus as C
from labelloom.streaming import incremental as I


def test_feather_is_read_by_batches(spark, tmp_path):
    path = str(tmp_path / "c.feather")
    table = pa.Table.from_pandas(pd.DataFrame({"URL": [f"u{i}" for i in range(2500)], "n": range(2500), "x": [None, 1.5] * 1250}))
    feather.write_feather(table, path, chunksize=300)
    df = C.read_corpus(spark, path)
    assert df.rdd.getNumPartitions() > 1
    assert df.count() == 2500 and df.agg(F.sum("n")).first()[0] == sum(range(2500)) and df.filter("x IS NULL").count() == 1250


def test_csv_with_line_breaks(spark, tmp_path):
    path = str(tmp_path / "c.csv")
    pd.DataFrame({"URL": ["a", "b"], "URL_TEXT": ['x "y"\nz', "t"]}).to_csv(path, index=False)
    assert {r["URL_TEXT"] for r in C.read_corpus(spark, path).collect()} == {'x "y"\nz', "t"}
    with pytest.raises(ValueError):
        C.read_corpus(spark, "c.xlsx")


def test_item_feeds(spark, tmp_path):
    items = [{"CLASS": "A", "KEYWORD": "k,", "DOMAIN": "d", "URL": f"u{i}", "URL_TEXT": "a]},\n[{b"} for i in range(3)]
    array, lines = tmp_path / "a.json", tmp_path / "l.json"
    array.write_text("[\n" + ",\n".join(json.dumps(i) for i in items) + "\n]")
    lines.write_text("\n".join(json.dumps(i) for i in items))
    for path in (array, lines):
        rows = C.read_items_json(spark, str(path)).collect()
        assert sorted(r["URL"] for r in rows) == ["u0", "u1", "u2"] and {r["URL_TEXT"] for r in rows} == {"a]},\n[{b"}
    assert C.read_items_json(spark, str(lines)).schema == RAW_TEXTS


def test_overwrite_of_the_table_being_read(spark, tmp_path):
    path = str(tmp_path / "t")
    C.write_table(spark.range(10), path)
    C.write_table(spark.read.parquet(path).filter("id < 4"), path)
    C.write_table(spark.range(1), path, "append")
    assert spark.read.parquet(path).count() == 5
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_shared_folder_comes_from_the_session(spark):
    class Conf:
        def get(self, key, default=None):
            return {session.CHECKPOINT_CONF: "s3://cluster/shared/"}.get(key, default)

    class Session:
        conf = Conf()

    assert session.scratch_path(Session(), "x").startswith("s3://cluster/shared/x-")
    configured = spark.conf.get(session.CHECKPOINT_CONF, None)
    assert session.shared_dir(spark) == configured or (configured is None and session.shared_dir(spark).startswith("/tmp/run-"))


def test_language_model(spark):
    rng = random.Random(4)
    syllables = {"de": ["ung", "sch", "ein", "cht"], "en": ["the", "ing", "tio", "ess"]}
    rows = [(i, lang, " ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(8))) for i, lang in enumerate(["de", "en"] * 30)]
    df = spark.createDataFrame(rows + [(99, "de", "123 --")], "id int, lang string, text string")
    got = train_language_model(df, "text", "lang").detect(df, "text").collect()
    assert all(r["lang_pred"] == r["lang"] for r in got if r["id"] != 99)
    assert [r["lang_pred"] for r in got if r["id"] == 99] == [None]
    many = spark.createDataFrame([(i, f"l{i:04d}", f"word{chr(97 + i % 26)}") for i in range(1_200)], "id int, lang string, text string")
    assert len(train_language_model(many, "text", "lang").languages) == 1_200


def test_language_profiles_keep_rare_trigrams(spark):
    """A text whose only trigrams are rarer than thousands of others is still recognised."""
    letters = "abcdefghijklmnop"
    common = " ".join(a + b + c for a in letters for b in letters for c in letters)
    rows = [(1, "xx", common), (2, "xx", common), (3, "yy", "qzq"), (4, None, "qzq qzq"), (5, None, "qzq qzq"), (6, "xx", None), (7, None, "ßßß")]
    df = spark.createDataFrame(rows, "id int, lang string, text string")
    got = {r["id"]: r for r in train_language_model(df, "text", "lang").detect(df, "text").collect()}
    assert [got[i]["lang_pred"] for i in (3, 4, 5, 6, 7)] == ["yy", "yy", "yy", None, None]
    assert got[4]["lang_score"] == got[5]["lang_score"] and len(got) == 7


SCHEMA = T.StructType([T.StructField("url", T.StringType()), T.StructField("clean", T.StringType())])


def test_incremental_resumes_and_equals_batch(spark, tmp_path):
    arriving, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    rng = random.Random(9)
    rows = [(i, f"u{rng.randrange(60)}" if i % 3 else "hot") for i in range(200)]
    df = spark.createDataFrame(rows, "o int, url string").withColumn("text", F.concat(F.lit("Lange Worte "), F.col("url")))
    process = lambda new: new.select("url", clean_text(F.col("text")).alias("clean"))

    def run():
        I.run_incremental(I.read_arriving(spark, arriving, df.schema, 1), target, progress, "url", "o", process, SCHEMA)

    df.filter("o < 120").repartition(3).write.parquet(arriving)
    run()
    first = I.read_target(spark, target, SCHEMA).count()
    run()
    assert I.read_target(spark, target, SCHEMA).count() == first
    df.filter("o >= 120").write.mode("append").parquet(arriving)
    run()
    got = I.read_target(spark, target, SCHEMA).drop("batch")
    want = df.select("url", clean_text(F.col("text")).alias("clean")).distinct()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_repeated_batch_overwrites_itself(spark, tmp_path):
    """A micro-batch that is run again after a failure must not drop its own rows."""
    arriving, target = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame([(1, "a", "wort eins"), (2, "b", "wort zwei")], "o int, url string, text string")
    df.write.parquet(arriving)
    process = lambda new: new.select("url", F.col("text").alias("clean"))
    for attempt in ("p1", "p2"):
        # a lost checkpoint repeats batch 0
        I.run_incremental(I.read_arriving(spark, arriving, df.schema), target, str(tmp_path / attempt), "url", "o", process, SCHEMA)
    assert I.read_target(spark, target, SCHEMA).count() == 2


def test_item_feeds_of_any_shape(spark, tmp_path):
    item = {"CLASS": "A", "KEYWORD": "k", "DOMAIN": "d", "URL": "u", "URL_TEXT": "t"}
    one, two = item | {"URL": "u1"}, item | {"URL": "u2"}
    (tmp_path / "line.json").write_text(json.dumps([one, two]))
    (tmp_path / "wide.json").write_text(json.dumps([one, two], indent=2))
    (tmp_path / "broken.json").write_text(json.dumps(one) + '\n{"CLASS": \n' + json.dumps(two) + "\n")
    for name in ("line.json", "wide.json", "broken.json"):
        assert sorted(r["URL"] for r in C.read_items_json(spark, str(tmp_path / name)).collect()) == ["u1", "u2"]
    assert C.read_items_json(spark, str(tmp_path)).count() == 6
    assert [r["record"] for r in C.broken_items(spark, str(tmp_path)).collect()] == ['{"CLASS": ']


def test_scores_without_a_value_come_last(spark):
    from labelloom.operators import reports

    df = spark.createDataFrame([("a", None, 1.0, 1), ("a", 0.9, 0.1, 2), ("b", None, None, 3)], "Type string, accuracy double, MCC double, id int")
    got = reports.best_per_search(df, "Type", ["accuracy", "MCC"], ["id"]).collect()
    assert {r["Type"]: r["id"] for r in got} == {"a": 2, "b": 3}


def test_many_quotes_in_markup(spark):
    from labelloom.operators.clean import strip_markup

    texts = ["<" + '"a"b' * 100_000 + "> kept text here", "<" + "'a'" * 100_000 + " kept text", "<" + '"a""' * 50_000 + "b> kept text here"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(strip_markup(F.col("t"))).collect()]
    assert got[0].strip() == "kept text here" and "kept text" in got[1]


def test_votes_outside_the_classes_fail(spark):
    from labelloom.operators import votes

    registry = votes.LFRegistry.standard({0: ["x"]}, "t")
    df = spark.createDataFrame([("x",), (None,)], "t string")
    assert votes.apply_lfs(df, registry, []).count() == 2


def test_small_profiles_count_without_a_sort(spark, monkeypatch):
    """Training and detection took a sort of every text's trigrams; only rows that move need it, with the same result."""
    from labelloom.operators import lang as L

    rows = [(i, t, l) for i, (t, l) in enumerate([("the house and the river", "en"), ("das haus und der fluss", "de"), ("the end", None), ("", "en"), (None, "de"), ("the end", None)])]
    df = spark.createDataFrame(rows, "id int, text string, lang string")
    run = lambda: sorted((r["id"], r["lang_pred"], r["lang_score"] and round(r["lang_score"], 9)) for r in L.train_language_model(df, "text", "lang").detect(df, "text").collect())
    with monkeypatch.context() as m:
        m.setattr(L, "_counted", None)
        small = run()
    monkeypatch.setattr(L, "BROADCAST_GRAMS", 1)
    assert run() == small and [x[1] for x in small[:3]] == ["en", "de", "en"]
