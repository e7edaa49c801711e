"""Physical plans: what must not shuffle does not, and filters reach the scan."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from labelloom.functions.text import remove_stopwords, term_counts, tokenize
from labelloom.operators import clean as K, labelmodel as M, tables as T, topics as P, votes as V
from labelloom.plans.inputs import KEYWORD_NAMES, KEYWORDS


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_row_local_operators_do_not_shuffle(spark, sf_dir):
    text, lang = F.col("text"), F.col("lang")
    cleaned = docs(spark, sf_dir).select("doc_id", K.clean_text(text).alias("c"), F.array_join(P.topic_terms_doc(text, lang), ","))
    counted = docs(spark, sf_dir).select(term_counts(remove_stopwords(tokenize(text), lang)))
    for df in (cleaned, counted):
        assert "Exchange" not in plan(df) and "Python" not in plan(df)


def test_labelling_is_one_projection(spark, sf_dir):
    registry = V.LFRegistry.standard(KEYWORDS, "text")
    sources = M.sources_of(KEYWORD_NAMES)
    model = M.LabelModel(sources, M.initial_parameters({s.name: {-1: 8.0, s.labels[0]: 2.0} for s in sources}, sources))
    p = plan(M.label_corpus(docs(spark, sf_dir), registry, model, ["doc_id"]))
    assert "Exchange" not in p and "Join" not in p and "BatchEvalPython" not in p
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p


def test_filter_and_columns_reach_the_scan(spark, sf_dir):
    p = plan(K.filter_language(docs(spark, sf_dir).select("doc_id", "lang"), "lang", "de"))
    assert "EqualTo(lang,de)" in p and "ReadSchema: struct<doc_id:bigint,lang:string>" in p


def test_votes_and_dedupe_combine_before_the_shuffle(spark, sf_dir):
    registry = V.LFRegistry.standard(KEYWORDS, "text")
    patterns = plan(V.vote_patterns(V.apply_lfs(docs(spark, sf_dir), registry, []), KEYWORD_NAMES))
    first = plan(T.dedup_first(docs(spark, sf_dir).withColumn("url", F.md5("text")).select("doc_id", "url"), "url", "doc_id"))
    assert "partial_count" in patterns and patterns.count("Exchange") == first.count("Exchange")
    assert "partial_min_by" in first and "Window" not in first


def test_top_terms_of_a_class_are_cut_before_the_shuffle(spark, sf_dir):
    tokens = docs(spark, sf_dir).select(F.array("lang").alias("cs"), tokenize(F.col("text")).alias("tokens"))
    p = plan(P.class_topic_terms(tokens, F.col("cs"), "tokens", "cluster"))
    assert "WindowGroupLimit" in p


def test_expensive_arrays_are_computed_once(spark, sf_dir):
    from labelloom.operators.features import term_table

    p = plan(term_table(docs(spark, sf_dir).select("doc_id", tokenize(F.col("text")).alias("t")), "doc_id", "t"))
    assert "size(" not in p.split("Generate")[0] or p.count("regexp_extract_all") <= 2
