"""URL verdicts by host rules and by a character language-model ratio.

URLs that a rule decides are the accepted and the rejected examples. A smoothed variable-order Markov model is
counted on each class, from all of its examples but the held-out fold. Another URL is scored by the difference of the two log-likelihoods per character, with the
longest context that the examples have, against a threshold that is calibrated on examples held out of the counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import stored
from .common import draw52, draw52_sql, sql_text

# Fixed values of the contract: action, host and path of the rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
ORDER = 4  # characters of the longest context
SMOOTHING = 2.0  # weight of the shorter context, in counts
FOLDS = 5  # one fold of the examples calibrates, the others are counted
# Rows of the model's levels, shortest first, that are broadcast; longer grams than these are joined.
BROADCAST_ROWS = 2_000_000
_PAD, _END = "\x02" * ORDER, "\x03"


def host_of(url: Column) -> Column:
    """Text after the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; empty without '://' or for null."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to '?', '#' or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def _ordered(rules: Sequence[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    return sorted(rules, key=lambda r: -len(r[1] + r[2]))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """``(rule, action)`` of the longest rule that fits, of equally long ones the first; null if none does."""
    name = action = F.lit(None).cast("string")
    for act, h, p in reversed(_ordered(rules)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)).otherwise(name)
        action = F.when(fits, F.lit(act)).otherwise(action)
    return name, action


def _grams(rows: DataFrame, keep: list[str]) -> DataFrame:
    """One row per predicted character of ``s``: the character behind its longest context."""
    padded = rows.withColumn("__p", F.concat(F.lit(_PAD), F.col("s"), F.lit(_END)))
    at = F.explode(F.sequence(F.lit(1), F.char_length("s") + 1))
    return padded.select(*keep, "__p", at.alias("__i")).select(*keep, F.substring("__p", F.col("__i"), F.lit(ORDER + 1)).alias("gram"))


def fit(examples: DataFrame) -> DataFrame:
    """``gram, ratio`` from ``s, accepted``: log-likelihood difference of a character behind a context.

    ``P(c | context) = (n(context c) + m P(c | shorter context)) / (n(context) + m)`` for each class; the empty context
    falls back to equal chances. Grams of both classes are in the table, whichever class has them.
    """
    full = _grams(examples, ["accepted"]).groupBy("gram").agg(F.count_if(F.col("accepted")).alias("a"), F.count_if(~F.col("accepted")).alias("r"))
    longest = stored(full, "url_grams")
    size = F.explode(F.sequence(F.lit(1), F.lit(ORDER + 1)))
    pieces = longest.select("a", "r", size.alias("n"), "gram").select("a", "r", "n", F.expr("right(gram, n)").alias("gram"))
    counts = stored(pieces.groupBy("n", "gram").agg(F.sum("a").alias("a"), F.sum("r").alias("r")), "url_counts")
    contexts = counts.groupBy("n", F.expr("left(gram, n - 1)").alias("context")).agg(F.sum("a").alias("ta"), F.sum("r").alias("tr"))
    grams = stored(counts.withColumn("context", F.expr("left(gram, n - 1)")).join(contexts, ["n", "context"]), "url_contexts")
    chance = 1.0 / (grams.filter("n = 1").count() + 1)
    m = F.lit(SMOOTHING)
    level = grams.filter("n = 1").select("gram", ((F.col("a") + m * chance) / (F.col("ta") + m)).alias("pa"), ((F.col("r") + m * chance) / (F.col("tr") + m)).alias("pr"))
    out = level
    for n in range(2, ORDER + 2):
        shorter = level.select(F.col("gram").alias("__tail"), F.col("pa").alias("qa"), F.col("pr").alias("qr"))
        here = grams.filter(F.col("n") == n).withColumn("__tail", F.expr("substring(gram, 2)"))
        level = here.join(shorter, "__tail").select(
            "gram",
            ((F.col("a") + m * F.col("qa")) / (F.col("ta") + m)).alias("pa"),
            ((F.col("r") + m * F.col("qr")) / (F.col("tr") + m)).alias("pr"),
        )
        out = out.unionByName(level)
    return stored(out.select("gram", (F.log("pa") - F.log("pr")).alias("ratio")), "url_model")


def score(rows: DataFrame, model: DataFrame) -> DataFrame:
    """Rows (with ``s``) and ``score``: the mean ratio of their characters, each behind the longest context in the model; 0 for unknown characters."""
    keep = rows.columns
    numbered = rows.withColumn("__row", F.monotonically_increasing_id())
    grams = _grams(numbered, ["__row", *keep])
    sizes = {r["n"]: r["rows"] for r in model.groupBy(F.char_length("gram").alias("n")).agg(F.count("*").alias("rows")).collect()}
    ratio = []
    for n in range(ORDER + 1, 0, -1):
        part = model.filter(F.char_length("gram") == n).select(F.col("gram").alias(f"__g{n}"), F.col("ratio").alias(f"__r{n}"))
        # short grams are few and each is frequent, so they do not move their rows even if the model is large
        if sum(sizes.get(i, 0) for i in range(1, n + 1)) <= BROADCAST_ROWS:
            part = F.broadcast(part)
        grams = grams.join(part, F.expr(f"right(gram, {n})") == F.col(f"__g{n}"), "left")
        ratio.append(F.col(f"__r{n}"))
    # the row number is a group by itself; the other columns come along
    return grams.groupBy("__row", *keep).agg(F.avg(F.coalesce(*ratio, F.lit(0.0))).alias("score")).drop("__row")


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """``key, host, path, rule, verdict, score`` of every row.

    ``verdict`` is the rule's action, else ``allow`` if the score reaches the threshold and ``block`` if not; ``score``
    is null where a rule decides. The threshold lies between the mean scores of the two classes on the calibration
    fold, nearer to the class that varies less. Without examples of both classes in that fold nothing but rules
    blocks. A null or odd URL has an empty host and path and is scored like any other. Keys may be null and rows
    repeated. An empty table gives no rows; other columns are not read.
    """
    u = F.col(url).cast("string")
    parsed = pages.select(F.col(key).alias("__key"), host_of(u).alias("host"), path_of(u).alias("path"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    # digits are one character: numbers say nothing about a site
    s = F.translate(F.concat("host", "path"), "123456789", "0" * 9)
    base = stored(parsed.select("__key", "host", "path", rule.alias("rule"), action.alias("action"), s.alias("s"), draw52(F.concat("host", "path")).alias("draw")), "url_rows")
    known = base.filter("action IS NOT NULL").select("s", "draw", (F.col("action") == "allow").alias("accepted"))
    held_out = F.col("draw") % FOLDS == 0
    model = fit(known.filter(~held_out).select("s", "accepted"))
    asked = base.filter(F.col("action").isNull() | held_out)
    scored = stored(score(asked.select("__key", "host", "path", "rule", "action", "s"), model), "url_scores")
    known_scores = scored.filter("action IS NOT NULL").groupBy("action").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s"))
    stats = {r["action"]: (r["m"], r["s"]) for r in known_scores.collect()}
    if len(stats) < 2:
        threshold = float("-inf")
    else:
        (ma, sa), (mr, sr) = stats["allow"], stats["block"]
        threshold = (ma * sr + mr * sa) / (sa + sr) if sa + sr > 0 else (ma + mr) / 2
    by_model = scored.filter("action IS NULL").select(
        "__key", "host", "path", "rule", F.when(F.col("score") >= F.lit(threshold), "allow").otherwise("block").alias("verdict"), F.round("score", 4).alias("score")
    )
    by_rule = base.filter("action IS NOT NULL").select("__key", "host", "path", "rule", F.col("action").alias("verdict"), F.lit(None).cast("double").alias("score"))
    return by_rule.unionByName(by_model).withColumnRenamed("__key", key)


def judge_sql(rules: Sequence[tuple[str, str, str]] = RULES) -> str:
    """The same in SQL over ``pages``."""
    whens = [(f"(host = {sql_text(h)} OR ends_with(host, {sql_text('.' + h)})) AND starts_with(path, {sql_text(p)})", a, h + p) for a, h, p in _ordered(rules)]
    rule = "CASE " + " ".join(f"WHEN {c} THEN {sql_text(n)}" for c, _, n in whens) + " END"
    action = "CASE " + " ".join(f"WHEN {c} THEN {sql_text(a)}" for c, a, _ in whens) + " END"
    pad, top = f"repeat(chr(2), {ORDER})", ORDER + 1
    ctes = [
        "parsed AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages)",
        f"base AS (SELECT row_number() OVER () AS rid, page_id, host, path, {rule} AS rule, {action} AS action, translate(host || path, '123456789', '000000000') AS s, {draw52_sql('host || path')} % {FOLDS} = 0 AS held FROM parsed)",
        f"chars AS (SELECT rid, unnest(list_transform(range(1, length(s) + 2), lambda i: substring({pad} || s || chr(3), CAST(i AS INTEGER), {top}))) AS gram FROM base)",
        f"pieces AS (SELECT CASE action WHEN 'allow' THEN 1 ELSE 0 END AS acc, n, right(gram, n) AS gram FROM chars JOIN base USING (rid), (SELECT unnest(range(1, {top + 1})) AS n) WHERE action IS NOT NULL AND NOT held)",
        "counts AS (SELECT n, gram, left(gram, n - 1) AS context, sum(acc) AS a, sum(1 - acc) AS r FROM pieces GROUP BY ALL)",
        "grams AS (SELECT *, sum(a) OVER (PARTITION BY n, context) AS ta, sum(r) OVER (PARTITION BY n, context) AS tr FROM counts)",
        "chance AS (SELECT 1.0::DOUBLE / (count(*) + 1) AS p FROM grams WHERE n = 1)",
        f"p1 AS (SELECT gram, (a + {SMOOTHING}::DOUBLE * p) / (ta + {SMOOTHING}::DOUBLE) AS pa, (r + {SMOOTHING}::DOUBLE * p) / (tr + {SMOOTHING}::DOUBLE) AS pr FROM grams, chance WHERE n = 1)",
    ]
    for n in range(2, top + 1):
        ctes.append(
            f"p{n} AS (SELECT g.gram, (g.a + {SMOOTHING}::DOUBLE * q.pa) / (g.ta + {SMOOTHING}::DOUBLE) AS pa, (g.r + {SMOOTHING}::DOUBLE * q.pr) / (g.tr + {SMOOTHING}::DOUBLE) AS pr"
            f" FROM grams g JOIN p{n - 1} q ON substring(g.gram, 2) = q.gram WHERE g.n = {n})"
        )
    joins = " ".join(f"LEFT JOIN p{n} ON right(chars.gram, {n}) = p{n}.gram" for n in range(top, 0, -1))
    ratios = ", ".join(f"ln(p{n}.pa) - ln(p{n}.pr)" for n in range(top, 0, -1))
    ctes += [
        f"scores AS (SELECT rid, avg(coalesce({ratios}, 0.0::DOUBLE)) AS score FROM chars {joins} GROUP BY rid)",
        "classes AS (SELECT avg(score) FILTER (action = 'allow') AS ma, stddev_pop(score) FILTER (action = 'allow') AS sa, avg(score) FILTER (action = 'block') AS mr, stddev_pop(score) FILTER (action = 'block') AS sr FROM base JOIN scores USING (rid) WHERE held)",
        "bound AS (SELECT CASE WHEN ma IS NULL OR mr IS NULL THEN '-inf'::DOUBLE WHEN sa + sr > 0 THEN (ma * sr + mr * sa) / (sa + sr) ELSE (ma + mr) / 2 END AS t FROM classes)",
    ]
    return (
        "WITH " + ",\n".join(ctes) + "\nSELECT page_id, host, path, rule, coalesce(action, CASE WHEN score >= t THEN 'allow' ELSE 'block' END) AS verdict,"
        " CASE WHEN action IS NULL THEN round(score, 4) END AS score FROM base JOIN scores USING (rid), bound"
    )
