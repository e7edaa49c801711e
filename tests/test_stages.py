"""From stored pages to a classifier, on the smallest tables."""

import random

from pyspark.sql import functions as F

from labelloom.operators import labelmodel as M, search as H, votes as V
from labelloom.operators.lang import train_language_model
from labelloom.plans import stages
from labelloom.plans.inputs import KEYWORDS


def test_pages_to_topics(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        F.lit("SHARED").alias("CLASS"), F.lit("k").alias("KEYWORD"), F.col("url").alias("URL"), "html", F.col("page_id").alias("ord")
    )
    raw = stages.raw_texts(pages.unionByName(pages)).cache()
    assert raw.count() == pages.count() and raw.filter("URL_TEXT = '' OR DOMAIN = ''").count() == 0
    assert stages.raw_texts(pages, raw.limit(20)).count() == pages.count() - 20
    model = train_language_model(docs, "text", "lang")
    cleaned = stages.cleaned_texts(raw, model, "en").cache()
    assert cleaned.columns == ["CLASS", "KEYWORD", "DOMAIN", "URL", "URL_TEXT", "LANG"]
    assert 0 < cleaned.count() < raw.count() and cleaned.select("LANG").distinct().count() == 1
    assert stages.cleaned_texts(raw, model, None).count() == raw.count()
    assert stages.cleaned_texts(raw, model, "en", done=cleaned).count() == 0
    topiced = stages.topiced_texts(cleaned)
    assert topiced.filter(F.size(F.split("TOPIC", ",")) > 14).count() == 0 and topiced.filter("TOPIC <> ''").count() > 0


def test_label_and_classify(spark):
    """Texts of seven classes with typical words; a tenth is annotated."""
    rng, rows = random.Random(8), []
    for i in range(1500):
        c = rng.randrange(7)
        words = [f"w{c}x{rng.randrange(6)}" if rng.random() < 0.5 else f"noise{rng.randrange(40)}" for _ in range(12)]
        if rng.random() < 0.7:
            words.append(KEYWORDS[c][0])
        if rng.random() < 0.1:
            words.append(KEYWORDS[rng.randrange(7)][0])
        rows.append((f"u{i}", c, " ".join(words)))
    corpus = spark.createDataFrame(rows, "URL string, truth int, text string").repartition(4, "URL").cache()
    annotated = corpus.filter(F.substring("URL", -1, 1) == "7").select(
        "URL", F.col("truth").alias("LABEL"), F.when(F.crc32("URL") % 2 == 0, "test").otherwise("validate").alias("split")
    )
    registry = V.LFRegistry.standard(KEYWORDS, "text")
    configs = H.random_configs(spark, 6)
    run = stages.label_run(corpus, annotated, registry, configs, ks=(2, 3))
    assert run.accepted and run.trials.count() == 6 * 5 and run.coverage.count() == 7 * 5
    assert run.coverage.filter("conflicts > overlaps OR overlaps > coverage").count() == 0
    again = stages.label_run(corpus, annotated, registry, configs, ks=(2,), champion=run.model)
    assert not again.accepted or again.model != run.model
    labelled = M.label_corpus(corpus, registry, run.model, ["URL", "text", "truth"]).cache()
    right = labelled.agg(F.avg((F.col("label") == F.col("truth")).cast("int"))).first()[0]
    assert right > 0.85 and labelled.count() > 1000
    model, scores = stages.classifier_run(labelled, "text", "label", n_features=1 << 10, max_iter=10)
    assert scores.first()["accuracy"] > 0.8


def test_classifier_reads_texts_once(spark):
    """Idf weights and every step of the regression that touched the rows tokenised the texts again."""
    from pyspark.sql import functions as F

    from labelloom.operators import classify as C

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(i):
        seen.add(1)
        return f"word{i % 3} thing{i % 7} other"

    df = spark.range(90).repartition(3).select(F.col("id").cast("int").alias("id"), read("id").alias("text"), (F.col("id") % 3).cast("int").alias("label"))
    model = C.clf_train(df, "text", "label", max_iter=5)
    assert seen.value == 90
    texts = spark.createDataFrame([(i, f"word{i} thing1") for i in range(3)], "id int, text string")
    assert {r["id"]: r["pred"] for r in C.clf_predict(model, texts).collect()} == {0: 0, 1: 1, 2: 2}
