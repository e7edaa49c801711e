"""Queries over splits, classifier, search, metrics and reports, with SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..operators import brackets as H2, classify as C, labelmodel as M, metrics as E, reports as R, search as H, splits as S, votes as V
from ..schemas import CARDINALITY, CLASSES, UNANNOTATED
from ..session import scratch_path, stored
from .catalog_votes import ANN_SQL, MAJORITY_SQL, REGISTRY, partial_model, total_votes, votes
from .inputs import CLUSTER_NAMES, COVERAGE_SQL, EVAL_SQL, KEYWORD_NAMES, VOTES_SQL, annotated, coverage_results, documents, eval_results, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# Splits, folds, weights.


def split(spark, d) -> DataFrame:
    return S.split_60_20_20(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")


_SPLIT_SQL = """
    o AS (SELECT doc_id, lang, row_number() OVER (ORDER BY md5(concat('42:', CAST(doc_id AS VARCHAR)))) - 1 AS r, count(*) OVER () AS n FROM documents),
    sp AS (SELECT doc_id, lang, CASE WHEN r < floor(0.6 * n) THEN 'train' WHEN r < floor(0.8 * n) THEN 'validate' ELSE 'test' END AS split FROM o)"""

QUERIES["split_60_20_20"] = split
ORACLES["split_60_20_20"] = f"WITH {_SPLIT_SQL} SELECT * FROM sp"


def annotation_sheet(spark, d):
    """The sheet is written as csv for the annotators and read back."""
    path = scratch_path(spark, "sheet")
    S.annotation_sheet(split(spark, d)).write.csv(path, header=True)
    return spark.read.schema("doc_id bigint, lang string, split string, LABEL int").csv(path, header=True)


QUERIES["annotation_sheet"] = annotation_sheet
ORACLES["annotation_sheet"] = f"WITH {_SPLIT_SQL} SELECT doc_id, lang, split, -2 AS LABEL FROM sp WHERE split <> 'train'"


def train_test_union(spark, d):
    parts = split(spark, d)
    test = parts.filter("split = 'test'").join(annotated(spark, d), "doc_id")
    return S.train_test_union(parts.filter("split = 'train'"), test)


QUERIES["train_test_union"] = train_test_union
ORACLES["train_test_union"] = f"""
    WITH {_SPLIT_SQL}, {ANN_SQL}
    SELECT doc_id, lang, split, -2 AS LABEL FROM sp WHERE split = 'train'
    UNION ALL SELECT doc_id, lang, split, LABEL FROM sp JOIN ann USING (doc_id) WHERE split = 'test'"""

QUERIES["kfold"] = lambda spark, d: S.kfold(table(spark, d, "documents"), "doc_id")
ORACLES["kfold"] = """
    WITH h AS (SELECT doc_id, CAST(concat('0x', substr(md5(concat('12:', CAST(doc_id AS VARCHAR))), 1, 8)) AS BIGINT) AS h FROM documents),
    k AS (SELECT CAST(unnest(range(2, 10)) AS INT) AS k)
    SELECT doc_id, k, CAST(h % k AS INT) AS fold FROM h CROSS JOIN k"""

QUERIES["class_weights"] = lambda spark, d: S.class_weights(table(spark, d, "documents").select("doc_id", "lang"), "lang").withColumn(
    "weight", F.round("weight", 6)
)
ORACLES["class_weights"] = """
    SELECT doc_id, lang, round(count(*) OVER () / count(*) OVER (PARTITION BY lang), 6) AS weight FROM documents"""

QUERIES["balanced_sample"] = lambda spark, d: S.balanced_sample(
    table(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang"
).withColumn("weight", F.round("weight", 6))
ORACLES["balanced_sample"] = """
    WITH w AS (SELECT doc_id, lang, count(*) OVER () / count(*) OVER (PARTITION BY lang) AS weight,
        CAST(concat('0x', substr(md5(concat('42:', CAST(doc_id AS VARCHAR))), 1, 8)) AS BIGINT) / 4294967296.0 AS u FROM documents),
    s AS (SELECT count(*) / sum(weight) AS scale FROM w),
    c AS (SELECT doc_id, lang, weight, CAST(floor(weight * scale + 1 - u) AS INT) AS k FROM w, s)
    SELECT doc_id, lang, round(weight, 6) AS weight, CAST(unnest(range(1, k + 1)) AS INT) AS copy FROM c WHERE k > 0"""


def weighted_draw(spark, d):
    """As many documents as there are, drawn with replacement, every language equally likely."""
    return S.weighted_draw(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang")


def _hash52(key: str, seed: str) -> str:
    return f"CAST(concat('0x', substr(md5(concat('{seed}:', CAST({key} AS VARCHAR))), 1, 13)) AS BIGINT)"


QUERIES["weighted_draw"] = weighted_draw
ORACLES["weighted_draw"] = f"""
    WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_hash52('doc_id', '42:order')}, doc_id) - 1 AS pos FROM documents WHERE lang IS NOT NULL),
    c AS (SELECT lang, count(*) AS n, row_number() OVER (ORDER BY lang) - 1 AS i FROM r GROUP BY 1),
    d AS (SELECT unnest(range((SELECT count(*) FROM r))) AS draw),
    s AS (SELECT draw, lang, CAST(floor({_hash52('draw', '42:row')} / 4503599627370496.0 * n) AS BIGINT) AS pos
          FROM d JOIN c ON c.i = floor({_hash52('draw', '42:class')} / 4503599627370496.0 * (SELECT count(*) FROM c)))
    SELECT draw, doc_id, lang FROM s JOIN r USING (lang, pos)"""


def head_limit(spark, d):
    events = table(spark, d, "events").select("event_id", "event_type", "value")
    return S.head_limit(events, "event_id", 1_000)


QUERIES["head_limit"] = head_limit
ORACLES["head_limit"] = "SELECT event_id, event_type, value FROM events ORDER BY event_id LIMIT 1000"

# Classifier.


def weak_labels(spark, d) -> DataFrame:
    """Documents with the label of the keyword label model."""
    docs = documents(spark, d)
    model = partial_model(votes(spark, d))
    return M.label_corpus(docs, REGISTRY, model, ["doc_id", "lang", "text"])


def train_and_test(spark, d) -> tuple[DataFrame, DataFrame]:
    parts = stored(S.split_by_threshold(weak_labels(spark, d), "doc_id"), "labelled")
    return parts.filter("split = 'train'"), parts.filter("split <> 'train'")


def clf_features(spark, d):
    feats = C.clf_features(documents(spark, d).select("doc_id", "text"), "text")
    values = vector_to_array("features")
    return feats.select(
        "doc_id",
        F.size(F.filter(values, lambda x: x != 0)).alias("n_features"),
        F.round(F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x), 6).alias("square"),
    )


def clf_train(spark, d):
    """Coefficients of the trained classifier: one row per class."""
    model = C.clf_train(train_and_test(spark, d)[0], "text", "label")
    lr = model.stages[-1]
    rows = [(i, float(b), float(abs(lr.coefficientMatrix.toArray()[i]).sum())) for i, b in enumerate(lr.interceptVector)]
    return spark.createDataFrame(rows, "label int, intercept double, weight double")


def clf_validate(spark, d):
    train, test = train_and_test(spark, d)
    return C.clf_evaluate(C.clf_train(train, "text", "label"), test, "label")


def clf_evaluate(spark, d):
    """The classifier against the annotated documents."""
    model = C.clf_train(train_and_test(spark, d)[0], "text", "label")
    return C.clf_evaluate(model, documents(spark, d).join(annotated(spark, d), "doc_id"), "LABEL")


def clf_predict(spark, d):
    model = C.clf_train(train_and_test(spark, d)[0], "text", "label")
    return C.clf_predict(model, documents(spark, d).select("doc_id", "text")).select("doc_id", "pred", "class_name")


def model_save_load(spark, d):
    """Predictions of a stored and reloaded model next to those of the model itself."""
    model = C.clf_train(train_and_test(spark, d)[0], "text", "label")
    path = scratch_path(spark, "model")
    C.save_model(model, path)
    docs = documents(spark, d).select("doc_id", "text")
    again = C.clf_predict(C.load_model(path), docs).select("doc_id", F.col("pred").alias("pred_loaded"))
    return C.clf_predict(model, docs).select("doc_id", "pred").join(again, "doc_id")


for _q in (clf_features, clf_train, clf_validate, clf_evaluate, clf_predict, model_save_load):
    QUERIES[_q.__name__] = _q

# Search.


def _folds(spark, d, voted: DataFrame, names: list[str]) -> DataFrame:
    """Vote patterns of 2 to 9 folds; documents without annotation take part in the fits only."""
    marked = voted.join(annotated(spark, d), "doc_id", "left").withColumn("label", F.coalesce("LABEL", F.lit(UNANNOTATED)))
    return H.fold_patterns(marked.select("doc_id", *names, F.col("label").alias("truth")), names, "doc_id", "truth")


QUERIES["fold_patterns"] = lambda spark, d: _folds(spark, d, votes(spark, d), KEYWORD_NAMES)
ORACLES["fold_patterns"] = f"""
    WITH v AS ({VOTES_SQL}), {ANN_SQL},
    m AS (SELECT v.*, coalesce(LABEL, {UNANNOTATED}) AS label, CAST(concat('0x', substr(md5(concat('12:', CAST(v.doc_id AS VARCHAR))), 1, 8)) AS BIGINT) AS h
          FROM v LEFT JOIN ann ON ann.doc_id = v.doc_id),
    k AS (SELECT CAST(unnest(range(2, 10)) AS INT) AS k)
    SELECT k, CAST(h % k AS INT) AS fold, {', '.join(KEYWORD_NAMES)}, CAST(label AS INT) AS label, count(*) AS n FROM m CROSS JOIN k GROUP BY ALL"""


def search_grid(spark, d):
    """Every grid configuration of the keyword functions, fitted on the other folds and scored on the annotated rows of its fold."""
    patterns = stored(_folds(spark, d, votes(spark, d), KEYWORD_NAMES), "patterns")
    return H.cross_validate(H.grid_configs(spark), patterns, KEYWORD_NAMES)


def search_random(spark, d):
    """Drawn configurations of all fourteen functions, keyword and cluster, in the same folds."""
    names = KEYWORD_NAMES + CLUSTER_NAMES
    patterns = stored(_folds(spark, d, total_votes(spark, d), names), "patterns")
    return H.cross_validate(H.random_configs(spark), patterns, names)


QUERIES["search_grid"] = search_grid
QUERIES["search_random"] = search_random


def search_halving(spark, d):
    """39 drawn classifier configurations in three brackets, trained in passes, the best third of each rung going on."""
    train, test = (H2.hashed_features(part, "doc_id", F.col("text"), F.col("lang"), "label") for part in train_and_test(spark, d))
    return H2.search_brackets(train, test, H2.sampled_configs(spark, sum(b.start for b in H2.BRACKETS)))


QUERIES["search_halving"] = search_halving


def trial_results(spark, d):
    results = eval_results(spark, d)
    old = results.filter("Type IN ('GridSearch', 'RandomSearch')")
    new = R.best_per_search(results.filter("Type NOT IN ('GridSearch', 'RandomSearch')"), "Type", ["accuracy", "MCC"], ["id"])
    return H.trial_results(old, new, H.next_trial(old).scalar())


QUERIES["trial_results"] = trial_results
ORACLES["trial_results"] = f"""
    WITH e AS ({EVAL_SQL}), o AS (SELECT * FROM e WHERE Type IN ('GridSearch', 'RandomSearch')),
    n AS (SELECT * FROM e WHERE Type NOT IN ('GridSearch', 'RandomSearch')
          QUALIFY row_number() OVER (PARTITION BY Type ORDER BY accuracy DESC, MCC DESC, id) = 1)
    SELECT * FROM o UNION ALL SELECT id, Type, accuracy, MCC, k, (SELECT max(Trial) + 1 FROM o) AS Trial FROM n"""

QUERIES["best_config"] = lambda spark, d: H.best_config(eval_results(spark, d), "accuracy", ["id"])
ORACLES["best_config"] = f"SELECT * FROM ({EVAL_SQL}) e ORDER BY accuracy DESC, id LIMIT 1"
QUERIES["next_trial"] = lambda spark, d: H.next_trial(eval_results(spark, d))
ORACLES["next_trial"] = f"SELECT coalesce(max(Trial) + 1, 0) AS next_trial FROM ({EVAL_SQL}) e"

# Metrics of the majority vote on the annotated documents.


def _confusion(spark, d) -> DataFrame:
    pred = votes(spark, d).select("doc_id", V.majority_vote(KEYWORD_NAMES).alias("pred"))
    return E.confusion(pred.join(annotated(spark, d), "doc_id"), "LABEL", "pred")


_PRED_SQL = f"""
    {MAJORITY_SQL}, {ANN_SQL},
    pr AS (SELECT doc_id, LABEL AS label, CAST(CASE WHEN len(t) = 1 THEN t[1] ELSE -1 END AS INT) AS pred FROM ann LEFT JOIN tied USING (doc_id)),
    k AS (SELECT unnest(range({CARDINALITY})) AS k),
    st AS (SELECT k, (SELECT count(*) FROM pr WHERE label = k AND pred = k) AS tp,
             (SELECT count(*) FROM pr WHERE pred = k) AS p, (SELECT count(*) FROM pr WHERE label = k) AS t FROM k)"""

QUERIES["confusion"] = _confusion
ORACLES["confusion"] = f"WITH {_PRED_SQL} SELECT label, pred, count(*) AS n FROM pr GROUP BY 1, 2"


def _metric(name: str, columns: list[str], sql: str) -> None:
    QUERIES[name] = lambda spark, d: E.metrics(_confusion(spark, d)).select(*[F.round(c, 6).alias(c) for c in columns])
    ORACLES[name] = f"WITH {_PRED_SQL} {sql}"


_metric("m_accuracy", ["accuracy"], "SELECT round(avg(CASE WHEN label = pred THEN 1.0 ELSE 0 END), 6) AS accuracy FROM pr")
_metric(
    "m_precision_micro_macro",
    ["precision_micro", "precision_macro"],
    "SELECT round(sum(tp) / sum(p), 6) AS precision_micro, round(avg(CASE WHEN p = 0 THEN 0 ELSE tp / p END), 6) AS precision_macro FROM st",
)
_metric("m_recall_macro", ["recall_macro"], "SELECT round(avg(CASE WHEN t = 0 THEN 0 ELSE tp / t END), 6) AS recall_macro FROM st")
_metric(
    "m_f1_micro_macro",
    ["f1_micro", "f1_macro"],
    "SELECT round(2 * sum(tp) / (sum(p) + sum(t)), 6) AS f1_micro, round(avg(CASE WHEN p + t = 0 THEN 0 ELSE 2 * tp / (p + t) END), 6) AS f1_macro FROM st",
)
_metric(
    "m_mcc",
    ["mcc"],
    """, a AS (SELECT -1 AS k UNION ALL SELECT k FROM k),
    x AS (SELECT CAST((SELECT count(*) FROM pr WHERE pred = a.k) AS DOUBLE) AS p, CAST((SELECT count(*) FROM pr WHERE label = a.k) AS DOUBLE) AS t FROM a),
    y AS (SELECT (SELECT count(*) FROM pr WHERE label = pred) AS c, (SELECT count(*) FROM pr) AS s, sum(p * t) AS pt, sum(p * p) AS pp, sum(t * t) AS tt FROM x)
    SELECT round(CASE WHEN (s * s - pp) * (s * s - tt) = 0 THEN 0 ELSE (c * s - pt) / sqrt((s * s - pp) * (s * s - tt)) END, 6) AS mcc FROM y""",
)
_metric("m_coverage", ["coverage"], "SELECT round(avg(CASE WHEN pred <> -1 THEN 1.0 ELSE 0 END), 6) AS coverage FROM pr")

_CLASS_VALUES = ", ".join(f"({i}, '{c}')" for i, c in enumerate(CLASSES))


def class_distribution(spark, d):
    """Rows per class of the weakly labelled corpus: keyword votes and majority vote."""
    return E.class_distribution(votes(spark, d).select(V.majority_vote(KEYWORD_NAMES).alias("label")), "label")


QUERIES["class_distribution"] = class_distribution
ORACLES["class_distribution"] = f"""
    WITH {MAJORITY_SQL}, c AS (SELECT col0 AS label, col1 AS class_name FROM (VALUES {_CLASS_VALUES}))
    SELECT label, class_name, (SELECT count(*) FROM tied WHERE len(t) = 1 AND t[1] = c.label) AS n FROM c"""

# Reports.
QUERIES["best_per_search"] = lambda spark, d: R.best_per_search(eval_results(spark, d), "Type", ["accuracy", "MCC"], ["id"])
ORACLES["best_per_search"] = f"""
    SELECT * FROM ({EVAL_SQL}) e QUALIFY row_number() OVER (PARTITION BY Type ORDER BY accuracy DESC, MCC DESC, id) = 1"""
QUERIES["best_per_fold"] = lambda spark, d: R.best_per_fold(eval_results(spark, d), "k", "Trial", "accuracy", ["id"])
ORACLES["best_per_fold"] = f"""
    SELECT * FROM ({EVAL_SQL}) e QUALIFY row_number() OVER (PARTITION BY k ORDER BY Trial, accuracy DESC, id) = 1"""
QUERIES["coverage_best"] = lambda spark, d: R.coverage_best(coverage_results(spark, d), ["id"])
_POLARITY = "CASE Polarity " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CLASSES)) + " END"
ORACLES["coverage_best"] = f"""
    SELECT *, concat({_POLARITY}, '_', split_part(LF, '_', 1)) AS name FROM ({COVERAGE_SQL}) c
    QUALIFY row_number() OVER (PARTITION BY LF ORDER BY TRIAL DESC, k_fold DESC, k_fold_split DESC, "Overlaps", "Conflicts", "Coverage" DESC, id) = 1"""


def rename_values(spark, d):
    renamed = R.rename_values(F.col("Type"), R.SEARCH_TITLES).alias("title")
    return eval_results(spark, d).select("id", renamed, R.rename_classes((F.col("k") - 2).cast("int")).alias("class_name"))


QUERIES["rename_values"] = rename_values
ORACLES["rename_values"] = f"""
    SELECT id, CASE Type WHEN 'BayesSearch' THEN 'Bayesian Optimization' WHEN 'RandomSearch' THEN 'Random Search'
      WHEN 'GridSearch' THEN 'Grid Search' ELSE Type END AS title, CASE k - 2 {_POLARITY.removeprefix('CASE Polarity ')} AS class_name
    FROM ({EVAL_SQL}) e"""


def _spans(spark, d) -> DataFrame:
    span = table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("s"), F.max("ts").alias("e"))
    return span.select("user_id", R.runtime_seconds(F.col("s"), F.col("e")).alias("seconds"))


_SPAN_SQL = "SELECT user_id, CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS seconds FROM events GROUP BY 1"
QUERIES["runtime_seconds"] = _spans
ORACLES["runtime_seconds"] = _SPAN_SQL


def runtime_summary(spark, d):
    """Seconds since the start of the day, by event type."""
    seconds = F.unix_timestamp("ts") - F.unix_timestamp(F.date_trunc("day", "ts"))
    box = R.runtime_summary(table(spark, d, "events").select("event_type", seconds.alias("seconds")), "event_type", "seconds")
    return box.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("p0", "p25", "p50", "p75", "p100")])


QUERIES["runtime_summary"] = runtime_summary
ORACLES["runtime_summary"] = """
    WITH s AS (SELECT event_type, CAST(floor(epoch(ts) - epoch(date_trunc('day', ts))) AS DOUBLE) AS v FROM events)
    SELECT event_type, count(*) AS n, round(quantile_cont(v, 0.0), 6) AS p0, round(quantile_cont(v, 0.25), 6) AS p25,
      round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.75), 6) AS p75, round(quantile_cont(v, 1.0), 6) AS p100
    FROM s GROUP BY 1"""

_LOGGER = "CASE user_id % 3 WHEN 0 THEN 'Cleaning' WHEN 1 THEN 'Topic' ELSE 'Labeler' END"
_LEVEL = "CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'INFO' END"


def log_events(spark, d):
    """Events written as lines of the pipeline log, read back as text."""
    line = F.expr(
        f"concat('[', date_format(ts, 'yyyy-MM-dd HH:mm:ss,SSS'), ']', {_LEVEL}, '|', {_LOGGER}, '|sampleset ', event_id) AS value"
    )
    path = scratch_path(spark, "log")
    table(spark, d, "events").select(line).write.text(path)
    parsed = R.log_events(R.parse_log(spark.read.text(path)))
    return parsed.select(F.unix_millis("ts").alias("ts_ms"), "level", "logger", "message", F.round("seconds", 6).alias("seconds"))


QUERIES["log_events"] = log_events
ORACLES["log_events"] = f"""
    WITH l AS (SELECT epoch_ms(date_trunc('millisecond', ts)) AS ts_ms, {_LEVEL} AS level, {_LOGGER} AS logger,
               concat('sampleset ', CAST(event_id AS VARCHAR)) AS message FROM events)
    SELECT ts_ms, level, logger, message,
      round((ts_ms - lag(ts_ms) OVER (PARTITION BY logger ORDER BY ts_ms, message)) / 1000.0, 6) AS seconds FROM l"""
