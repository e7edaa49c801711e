"""Queries over labelling functions, votes and the label model, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import labelmodel as M, votes as V
from ..schemas import CARDINALITY, CLASSES
from ..session import stored
from .catalog_text import CENTROID_SQL, nearest
from .inputs import ANNOTATED, CLUSTER_NAMES, KEYWORDS, KEYWORD_NAMES, VOTES_SQL, annotated, documents, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_K = ", ".join(KEYWORD_NAMES)
REGISTRY = V.LFRegistry.standard(KEYWORDS, "text")


def votes(spark, d) -> DataFrame:
    """Keyword votes of all documents."""
    return V.apply_lfs(documents(spark, d), REGISTRY, ["doc_id"])


def total_votes(spark, d) -> DataFrame:
    """Keyword and cluster votes: every document has a nearest centroid, which is found once."""
    docs, near = nearest(spark, d)
    registry = V.LFRegistry([V.cluster_lf(k, "cluster") for k in range(CARDINALITY)])
    return V.apply_lfs(docs.select("doc_id", *KEYWORD_NAMES).join(near, "doc_id"), registry, ["doc_id", *KEYWORD_NAMES])


_CLUSTER_CASES = ", ".join(f"CASE WHEN cluster = {k} THEN {k} ELSE -1 END AS cluster_{k}" for k in range(CARDINALITY))
TOTAL_SQL = f"SELECT doc_id, {_K}, {_CLUSTER_CASES} FROM votes JOIN nearest USING (doc_id)"

QUERIES["lf_keyword"] = votes
ORACLES["lf_keyword"] = f"SELECT doc_id, {_K} FROM ({VOTES_SQL}) v"
QUERIES["lf_cluster"] = lambda spark, d: total_votes(spark, d).select("doc_id", *CLUSTER_NAMES)
ORACLES["lf_cluster"] = f"WITH {CENTROID_SQL} SELECT doc_id, {_CLUSTER_CASES} FROM nearest"


def user_registry() -> V.LFRegistry:
    """The keyword functions and two functions of a user."""
    added = V.LFRegistry(REGISTRY.functions)
    added.add(V.LabelingFunction("long_text", lambda: F.when(F.col("n_chars") > 3000, F.lit(2)).otherwise(F.lit(-1))))
    return added.add(V.LabelingFunction("german", lambda: F.when(F.col("lang") == "de", F.lit(3)).otherwise(F.lit(-1))))


QUERIES["lf_registry"] = lambda spark, d: V.apply_lfs(documents(spark, d), user_registry(), ["doc_id"])
ORACLES["lf_registry"] = f"""
    SELECT doc_id, {_K}, CASE WHEN n_chars > 3000 THEN 2 ELSE -1 END AS long_text, CASE WHEN d.lang = 'de' THEN 3 ELSE -1 END AS german
    FROM documents d JOIN ({VOTES_SQL}) v USING (doc_id)"""

QUERIES["apply_lfs"] = total_votes
ORACLES["apply_lfs"] = f"WITH {CENTROID_SQL} {TOTAL_SQL}"

QUERIES["vote_patterns"] = lambda spark, d: V.vote_patterns(votes(spark, d), KEYWORD_NAMES)
ORACLES["vote_patterns"] = f"SELECT {_K}, count(*) AS n FROM ({VOTES_SQL}) v GROUP BY ALL"

_LONG_SQL = "lv AS (" + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS lf, {n} AS vote FROM v" for n in KEYWORD_NAMES) + ")"


def lf_summary(spark, d):
    summary = V.lf_summary(V.vote_patterns(votes(spark, d), KEYWORD_NAMES), KEYWORD_NAMES)
    return summary.select("lf", "polarity", *[F.round(c, 6).alias(c) for c in ("coverage", "overlaps", "conflicts")])


QUERIES["lf_summary"] = lf_summary
ORACLES["lf_summary"] = f"""
    WITH v AS ({VOTES_SQL}), {_LONG_SQL},
    o AS (SELECT a.doc_id, a.lf, a.vote, count(b.vote) AS others, count(b.vote) FILTER (b.vote <> a.vote) AS other_labels
          FROM lv a LEFT JOIN lv b ON a.doc_id = b.doc_id AND a.lf <> b.lf AND b.vote <> -1 GROUP BY 1, 2, 3)
    SELECT lf, coalesce(string_agg(DISTINCT CAST(vote AS VARCHAR), ',') FILTER (vote <> -1), '') AS polarity,
      round(avg(CASE WHEN vote <> -1 THEN 1.0 ELSE 0 END), 6) AS coverage,
      round(avg(CASE WHEN vote <> -1 AND others > 0 THEN 1.0 ELSE 0 END), 6) AS overlaps,
      round(avg(CASE WHEN vote <> -1 AND other_labels > 0 THEN 1.0 ELSE 0 END), 6) AS conflicts
    FROM o GROUP BY 1"""

QUERIES["label_coverage"] = lambda spark, d: V.label_coverage(
    V.vote_patterns(votes(spark, d), KEYWORD_NAMES), KEYWORD_NAMES
).select(F.round("coverage", 6).alias("coverage"))
ORACLES["label_coverage"] = f"SELECT round(avg(CASE WHEN greatest({_K}) > -1 THEN 1.0 ELSE 0 END), 6) AS coverage FROM ({VOTES_SQL}) v"

ANN_SQL = f"ann AS (SELECT doc_id, {ANNOTATED} AS LABEL FROM labels)"


def annotated_votes(spark, d) -> DataFrame:
    return votes(spark, d).join(annotated(spark, d), "doc_id")


QUERIES["lf_empirical_accuracy"] = lambda spark, d: V.lf_empirical_accuracy(
    annotated_votes(spark, d), KEYWORD_NAMES, "LABEL"
).select("lf", "n_votes", F.round("accuracy", 6).alias("accuracy"))
ORACLES["lf_empirical_accuracy"] = f"""
    WITH v AS ({VOTES_SQL}), {_LONG_SQL}, {ANN_SQL}
    SELECT lf, count(*) AS n_votes, round(avg(CASE WHEN vote = LABEL THEN 1.0 ELSE 0 END), 6) AS accuracy
    FROM lv JOIN ann USING (doc_id) WHERE vote <> -1 GROUP BY 1"""

MAJORITY_SQL = f"""
    v AS ({VOTES_SQL}), {_LONG_SQL},
    cnt AS (SELECT doc_id, vote, count(*) AS n FROM lv WHERE vote <> -1 GROUP BY 1, 2),
    tied AS (SELECT doc_id, list(vote ORDER BY vote) AS t FROM (SELECT * FROM cnt QUALIFY n = max(n) OVER (PARTITION BY doc_id)) x GROUP BY 1)"""


def _hash_sql(seed: int, key: str = "doc_id") -> str:
    return f"CAST(concat('0x', substr(md5(concat('{seed}:', CAST({key} AS VARCHAR))), 1, 8)) AS BIGINT)"


QUERIES["majority_vote"] = lambda spark, d: votes(spark, d).select(
    "doc_id",
    V.majority_vote(KEYWORD_NAMES).alias("label"),
    V.majority_vote(KEYWORD_NAMES, "hash", F.col("doc_id")).alias("label_hash"),
)
ORACLES["majority_vote"] = f"""
    WITH {MAJORITY_SQL}
    SELECT doc_id, CASE WHEN len(t) = 1 THEN t[1] ELSE -1 END AS label,
      coalesce(t[1 + {_hash_sql(123)} % len(t)], -1) AS label_hash
    FROM documents LEFT JOIN tied USING (doc_id)"""


# Iterations of every fit, in Spark and in SQL.
ITERATIONS = 25


# The label model in SQL.
def lm_sql(votes_cte: str, sources: tuple[str, ...], iterations: int, prior_acc: float = 0.7, smoothing: float = 0.01, tag: str = "") -> str:
    """CTEs up to ``mu{tag}``: the parameters after a number of EM iterations; ``votes_cte`` has one column per source."""
    cols = ", ".join(sources)
    outcomes = []
    for s in sources:
        labels = range(CARDINALITY) if s == "cluster" else (int(s.split("_")[1]),)
        outcomes += [f"('{s}', {o})" for o in (-1, *labels)]
    share = f"CASE WHEN o.outcome = c.c THEN {prior_acc} ELSE {1 - prior_acc!r} / {CARDINALITY - 1} END"
    own = f"CASE WHEN CAST(split_part(o.source, '_', 2) AS INT) = c.c THEN {prior_acc} ELSE {1 - prior_acc!r} / {CARDINALITY - 1} END"
    vote = f"least(greatest(cov.cov * {CARDINALITY} * {own}, 0.01), 0.99)"
    longs = " UNION ALL ".join(f"SELECT pid, n, '{s}' AS source, {s} AS outcome FROM pat{tag}" for s in sources)
    out = f"""
    pat{tag} AS MATERIALIZED (SELECT {cols}, n, row_number() OVER (ORDER BY {cols}) AS pid FROM (SELECT {cols}, count(*) AS n FROM {votes_cte} GROUP BY ALL) x),
    lng{tag} AS MATERIALIZED ({longs}),
    so{tag} AS (SELECT col0 AS source, col1 AS outcome FROM (VALUES {', '.join(outcomes)})),
    cs{tag} AS (SELECT unnest(range({CARDINALITY})) AS c),
    cov{tag} AS MATERIALIZED (SELECT source, 1 - sum(CASE WHEN outcome = -1 THEN n ELSE 0 END) / sum(n) AS cov FROM lng{tag} GROUP BY 1),
    mu{tag}_0 AS MATERIALIZED (SELECT o.source, o.outcome, c.c, CASE
        WHEN o.source = 'cluster' AND o.outcome = -1 THEN greatest(1 - cov.cov, 1e-6)
        WHEN o.source = 'cluster' THEN greatest(cov.cov * ({share}), 1e-6)
        WHEN o.outcome = -1 THEN 1 - {vote} ELSE {vote} END AS p
      FROM so{tag} o CROSS JOIN cs{tag} c JOIN cov{tag} cov ON cov.source = o.source)"""
    for i in range(iterations):
        out += f""",
    l{tag}_{i} AS MATERIALIZED (SELECT pid, any_value(n) AS n, c, sum(ln(greatest(p, 1e-6))) AS l FROM lng{tag} JOIN mu{tag}_{i} USING (source, outcome) GROUP BY pid, c),
    e{tag}_{i} AS MATERIALIZED (SELECT pid, n, c, exp(l - max(l) OVER (PARTITION BY pid)) AS e FROM l{tag}_{i}),
    q{tag}_{i} AS MATERIALIZED (SELECT pid, n, c, e / sum(e) OVER (PARTITION BY pid) AS q FROM e{tag}_{i}),
    m{tag}_{i} AS MATERIALIZED (SELECT source, outcome, c, sum(g.n * q) AS m FROM lng{tag} g JOIN q{tag}_{i} USING (pid) GROUP BY 1, 2, 3),
    mu{tag}_{i + 1} AS MATERIALIZED (SELECT o.source, o.outcome, o.c,
        (coalesce(m, 0) + {smoothing}) / (sum(coalesce(m, 0)) OVER w + {smoothing} * count(*) OVER w) AS p
      FROM mu{tag}_{i} o LEFT JOIN m{tag}_{i} USING (source, outcome, c) WINDOW w AS (PARTITION BY o.source, o.c))"""
    return out + f""",
    mu{tag} AS (SELECT * FROM mu{tag}_{iterations}),
    pl{tag} AS (SELECT g.pid, m.c, sum(CASE WHEN g.outcome = -1 THEN 0 ELSE ln(greatest(m.p, 1e-6)) END) AS l
                FROM lng{tag} g JOIN mu{tag} m USING (source, outcome) GROUP BY 1, 2),
    pe{tag} AS (SELECT pid, c, exp(l - max(l) OVER (PARTITION BY pid)) AS e FROM pl{tag}),
    post{tag} AS (SELECT pid, c, e / sum(e) OVER (PARTITION BY pid) AS p FROM pe{tag}),
    pick{tag} AS (SELECT pid, list(c ORDER BY c) AS t FROM (SELECT * FROM post{tag} QUALIFY max(p) OVER (PARTITION BY pid) - p <= 1e-5) x GROUP BY 1)"""


_SRC = tuple(KEYWORD_NAMES)
_ALL = (*KEYWORD_NAMES, "cluster")
_PARTIAL_VOTES = f"vk AS ({VOTES_SQL})"
_TOTAL_VOTES = f"{CENTROID_SQL}, vt AS (SELECT doc_id, {_K}, cluster FROM votes JOIN nearest USING (doc_id))"


def lm_moments(spark, d):
    moments = M.lm_moments(V.vote_patterns(votes(spark, d), KEYWORD_NAMES), KEYWORD_NAMES)
    return moments.withColumn("moment", F.round("moment", 6))


QUERIES["lm_moments"] = lm_moments
ORACLES["lm_moments"] = f"""
    WITH v AS ({VOTES_SQL}), {_LONG_SQL}
    SELECT a.lf AS lf1, a.vote AS vote1, b.lf AS lf2, b.vote AS vote2, round(count(*) / (SELECT count(*) FROM documents), 6) AS moment
    FROM lv a JOIN lv b USING (doc_id) WHERE a.vote <> -1 AND b.vote <> -1 GROUP BY 1, 2, 3, 4"""


def lm_fit(spark, d):
    """The label model of keyword and cluster votes."""
    model = M.lm_fit(V.vote_patterns(total_votes(spark, d), KEYWORD_NAMES + CLUSTER_NAMES), KEYWORD_NAMES + CLUSTER_NAMES, max_iter=ITERATIONS, tol=0.0)
    return model.to_table(spark).withColumn("p", F.round("p", 6))


QUERIES["lm_fit"] = lm_fit
ORACLES["lm_fit"] = f"""
    WITH {_TOTAL_VOTES}, {lm_sql('vt', _ALL, ITERATIONS)}
    SELECT source, outcome, CAST(c AS INT) AS label, round(p, 6) AS p FROM mu"""


def partial_model(vote_table: DataFrame, iterations: int = ITERATIONS, prior_acc: float = 0.7) -> M.LabelModel:
    return M.lm_fit(V.vote_patterns(vote_table, KEYWORD_NAMES), KEYWORD_NAMES, max_iter=iterations, tol=0.0, prior_acc=prior_acc)


_PARTIAL_JOIN = " AND ".join(f"p.{n} = vk.{n}" for n in KEYWORD_NAMES)


def lm_predict_proba(spark, d):
    v = votes(spark, d)
    scored = partial_model(v).with_posterior(v)
    return scored.select("doc_id", *[F.round(F.get("posterior", F.lit(c)), 6).alias(f"p_{c}") for c in range(CARDINALITY)])


QUERIES["lm_predict_proba"] = lm_predict_proba
_PIVOT = ", ".join(f"round(max(CASE WHEN c = {c} THEN q.p END), 6) AS p_{c}" for c in range(CARDINALITY))
ORACLES["lm_predict_proba"] = f"""
    WITH {_PARTIAL_VOTES}, {lm_sql('vk', _SRC, ITERATIONS)}
    SELECT vk.doc_id, {_PIVOT} FROM vk JOIN pat p ON {_PARTIAL_JOIN} JOIN post q ON q.pid = p.pid GROUP BY 1"""


def lm_predict(spark, d):
    v = votes(spark, d)
    model = partial_model(v)
    both = model.predict(model.predict(v), "hash", F.col("doc_id"), "label_hash")
    return both.select("doc_id", "label", "label_hash")


QUERIES["lm_predict"] = lm_predict
_PREDICTED = f"""
    pred AS (SELECT vk.doc_id, CAST(CASE WHEN len(t) = 1 THEN t[1] ELSE -1 END AS INT) AS label, CAST(t[1 + {_hash_sql(123, 'vk.doc_id')} % len(t)] AS INT) AS label_hash
             FROM vk JOIN pat p ON {_PARTIAL_JOIN} JOIN pick USING (pid))"""
ORACLES["lm_predict"] = f"WITH {_PARTIAL_VOTES}, {lm_sql('vk', _SRC, ITERATIONS)}, {_PREDICTED} SELECT * FROM pred"


def label_corpus(spark, d):
    """Total labelling: no document stays without a label."""
    v = stored(total_votes(spark, d), "votes")
    names = KEYWORD_NAMES + CLUSTER_NAMES
    model = M.lm_fit(V.vote_patterns(v, names), names, max_iter=ITERATIONS, tol=0.0)
    given = V.LFRegistry([V.LabelingFunction(n, lambda n=n: F.col(n)) for n in names])
    return M.label_corpus(v, given, model, ["doc_id"])


QUERIES["label_corpus"] = label_corpus
ORACLES["label_corpus"] = f"""
    WITH {_TOTAL_VOTES}, {lm_sql('vt', _ALL, ITERATIONS)}
    SELECT doc_id, CAST(t[1] AS INT) AS label FROM vt JOIN pat p ON {' AND '.join(f'p.{n} = vt.{n}' for n in _ALL)}
    JOIN pick USING (pid) WHERE len(t) = 1"""


def label_texts(spark, d):
    """The model of the documents names the class of conversation turns."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return M.label_texts(turns, REGISTRY, partial_model(votes(spark, d)), ["conv_id", "turn"], CLASSES)


QUERIES["label_texts"] = label_texts
_TURN_VOTES = VOTES_SQL.replace("doc_id, lang, text, ", "conv_id, turn, ").replace("FROM documents", "FROM conversations")
_CLASS_CASE = "CASE label " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CLASSES)) + " END"
ORACLES["label_texts"] = f"""
    WITH {_PARTIAL_VOTES}, {lm_sql('vk', _SRC, ITERATIONS)}, tv AS ({_TURN_VOTES}),
    tl AS ({' UNION ALL '.join(f"SELECT conv_id, turn, '{n}' AS source, {n} AS outcome FROM tv" for n in KEYWORD_NAMES)}),
    ll AS (SELECT conv_id, turn, c, sum(CASE WHEN outcome = -1 THEN 0 ELSE ln(greatest(p, 1e-6)) END) AS l FROM tl JOIN mu USING (source, outcome) GROUP BY 1, 2, 3),
    le AS (SELECT conv_id, turn, c, exp(l - max(l) OVER (PARTITION BY conv_id, turn)) AS e FROM ll),
    lp AS (SELECT conv_id, turn, c, e / sum(e) OVER (PARTITION BY conv_id, turn) AS p FROM le),
    lt AS (SELECT conv_id, turn, list(c) AS t FROM (SELECT * FROM lp QUALIFY max(p) OVER (PARTITION BY conv_id, turn) - p <= 1e-5) x GROUP BY 1, 2),
    r AS (SELECT conv_id, turn, CAST(CASE WHEN len(t) = 1 THEN t[1] ELSE -1 END AS INT) AS label FROM lt)
    SELECT conv_id, turn, label, {_CLASS_CASE} AS class_name FROM r"""


def champion_check(spark, d):
    v = votes(spark, d)
    test = v.join(annotated(spark, d), "doc_id")
    check = M.champion_check(test, "LABEL", partial_model(v, ITERATIONS, 0.7), partial_model(v, ITERATIONS, 0.6), "doc_id")
    return check.select(F.round("new_accuracy", 6).alias("new_accuracy"), F.round("old_accuracy", 6).alias("old_accuracy"), "replace")


QUERIES["champion_check"] = champion_check


def _accuracy_sql(tag: str) -> str:
    return f"""(SELECT avg(CASE WHEN t[1 + {_hash_sql(123, 'vk.doc_id')} % len(t)] = LABEL THEN 1.0 ELSE 0 END)
      FROM vk JOIN ann USING (doc_id) JOIN pat{tag} p ON {_PARTIAL_JOIN} JOIN pick{tag} USING (pid))"""


ORACLES["champion_check"] = f"""
    WITH {_PARTIAL_VOTES}, {ANN_SQL}, {lm_sql('vk', _SRC, ITERATIONS, tag='a')}, {lm_sql('vk', _SRC, ITERATIONS, 0.6, tag='b')},
    acc AS (SELECT {_accuracy_sql('a')} AS n, {_accuracy_sql('b')} AS o)
    SELECT round(n, 6) AS new_accuracy, round(o, 6) AS old_accuracy, n > o AS replace FROM acc"""
