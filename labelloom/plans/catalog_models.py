"""Queries over fitted models: the moment-based label model and the bracket search, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import labelmodel as M, momentmodel as MM, votes as V
from ..schemas import CARDINALITY
from ..session import stored
from .catalog_votes import ITERATIONS, _ALL, _TOTAL_VOTES, lm_sql, total_votes
from .inputs import CLUSTER_NAMES, KEYWORD_NAMES

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# Steps and rate of the moment-based fits.
EPOCHS, RATE, LOG_EVERY = 200, 0.2, 20
_NAMES = KEYWORD_NAMES + CLUSTER_NAMES


def _patterns(spark, d) -> DataFrame:
    return stored(V.vote_patterns(total_votes(spark, d), _NAMES), "patterns")


def lm_fit_moments(spark, d):
    """Parameters of all sources estimated by EM and from moments, side by side."""
    patterns = _patterns(spark, d)
    em = M.lm_fit(patterns, _NAMES, max_iter=ITERATIONS, tol=0.0)
    model, _ = MM.lm_fit_moments(patterns, _NAMES, EPOCHS, RATE)
    both = MM.compared(spark, {"em": em, "moments": model})
    return both.select("source", "outcome", "label", F.round("p_em", 6).alias("p_em"), F.round("p_moments", 6).alias("p_moments"))


def lm_moment_loss(spark, d):
    """The objective of the moment-based fit along its steps."""
    _, history = MM.lm_fit_moments(_patterns(spark, d), _NAMES, EPOCHS, RATE, log_every=LOG_EVERY)
    return spark.createDataFrame([(e, round(x, 9)) for e, x in history], "epoch int, loss double")


def _moments_sql() -> str:
    """CTEs up to ``fit`` (epoch, mu): gradient steps on lists, one row per epoch; ``idx`` numbers the votes of all sources."""
    rows = [(s, o) for s in _ALL for o in (range(CARDINALITY) if s == "cluster" else (int(s.split("_")[1]),))]
    r, k = len(rows), CARDINALITY
    index = ", ".join(f"({i}, '{s}', {o})" for i, (s, o) in enumerate(rows))
    src = "[" + ", ".join(str(_ALL.index(s)) for s, _ in rows) + "]"
    apart = f"CASE WHEN src[x // {r} + 1] = src[x % {r} + 1] THEN 0.0 ELSE 1.0 END"
    pair = f"list_sum(list_transform(range({k}), lambda c: mu[(x // {r}) * {k} + c + 1] * mu[(x % {r}) * {k} + c + 1])) / {k}"
    share = f"list_sum(list_transform(range({k}), lambda c: mu[x * {k} + c + 1])) / {k}"
    grad = (
        f"(4 * list_sum(list_transform(range({r}), lambda s: e[(x // {k}) * {r} + s + 1] * mu[s * {k} + x % {k} + 1])) + 2 * sh[x // {k} + 1]) / {k}"
    )
    return f"""
    idx AS (SELECT col0 AS r, col1 AS source, col2 AS outcome FROM (VALUES {index})),
    whole AS (SELECT sum(n) AS n FROM pat),
    cast_votes AS (SELECT pid, n, r FROM lng JOIN idx USING (source, outcome)),
    seen AS (SELECT a.r AS r1, b.r AS r2, sum(a.n) / any_value(whole.n) AS m FROM cast_votes a JOIN cast_votes b USING (pid), whole GROUP BY 1, 2),
    obs AS MATERIALIZED (SELECT list(coalesce(m, 0)::DOUBLE ORDER BY i.r, j.r) AS o FROM idx i CROSS JOIN idx j LEFT JOIN seen ON r1 = i.r AND r2 = j.r),
    first AS MATERIALIZED (SELECT list(least(greatest(p, {MM.LOWEST}), {MM.HIGHEST})::DOUBLE ORDER BY r, c) AS mu FROM mu_0 JOIN idx USING (source, outcome)),
    fit AS (
      SELECT 0 AS epoch, mu FROM first
      UNION ALL
      SELECT epoch + 1, list_transform(range({r * k}), lambda x: least(greatest(mu[x + 1] - {RATE}::DOUBLE * {grad}, {MM.LOWEST}), {MM.HIGHEST}))
      FROM (SELECT epoch, mu,
          list_transform(range({r * r}), lambda x: ({pair} - o[x + 1]) * {apart}) AS e,
          list_transform(range({r}), lambda x: {share} - o[x * {r} + x + 1]) AS sh
        FROM fit, obs, (SELECT {src} AS src) WHERE epoch < {EPOCHS}) g),
    losses AS (SELECT epoch,
        list_sum(list_transform(range({r * r}), lambda x: pow(({pair} - o[x + 1]) * {apart}, 2)))
        + list_sum(list_transform(range({r}), lambda x: pow({share} - o[x * {r} + x + 1], 2))) AS loss
      FROM fit, obs, (SELECT {src} AS src) WHERE epoch % {LOG_EVERY} = 0 OR epoch = {EPOCHS}),
    voted AS (SELECT source, outcome, c, mu[r * {k} + c + 1] AS p FROM fit, idx, (SELECT unnest(range({k})) AS c) WHERE epoch = {EPOCHS}),
    moments AS (SELECT * FROM voted UNION ALL SELECT source, -1 AS outcome, c, greatest(1 - sum(p), 1e-6) AS p FROM voted GROUP BY source, c)"""


QUERIES["lm_fit_moments"] = lm_fit_moments
ORACLES["lm_fit_moments"] = f"""
    WITH RECURSIVE {_TOTAL_VOTES}, {lm_sql('vt', _ALL, ITERATIONS)}, {_moments_sql()}
    SELECT source, outcome, CAST(c AS INT) AS label, round(mu.p, 6) AS p_em, round(moments.p, 6) AS p_moments FROM mu JOIN moments USING (source, outcome, c)"""
QUERIES["lm_moment_loss"] = lm_moment_loss
ORACLES["lm_moment_loss"] = f"""
    WITH RECURSIVE {_TOTAL_VOTES}, {lm_sql('vt', _ALL, 0)}, {_moments_sql()} SELECT epoch, round(loss, 9) AS loss FROM losses"""
