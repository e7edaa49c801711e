"""Quality rules as a short-circuit cascade.

Every rule is a test on measures of a text. On a sample each rule is timed and its rejections are counted; rules
then run in the order of rejections per cost, each only on the texts that passed the ones before. The order
changes the cost, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..session import stored
from .common import SPACES, WORD, let, word_count, words

# Fixed values of the contract: characters that count as symbols.
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Rows of the sample on which costs and rejections are estimated.
SAMPLE_ROWS = 4_000


def _without(text: Column, characters: str) -> Column:
    return F.char_length(F.translate(text, characters, ""))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))


def _repeat_words(text: Column) -> Column:
    """Words that lie in a three-word window found at least twice.

    Windows are compared as 64-bit hashes within one text. Texts without an equal pair stop there; in the
    others the windows are sorted with their positions, so that equal ones are neighbours.
    """

    def positions(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        twin = lambda s: F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
        return F.transform(let(pairs, twin), lambda x: x["p"])

    def covered(p: Column) -> Column:
        return let(p, lambda q: F.size(F.array_union(F.array_union(q, F.transform(q, lambda x: x + 1)), F.transform(q, lambda x: x + 2))))

    def of(w: Column) -> Column:
        hashes = F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), 1, F.greatest(F.size(w) - 2, F.lit(0)))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(positions(h))).otherwise(0))

    return let(words(text), of)


def measures(text: Column) -> dict[str, Column]:
    """The measures of a text; null is the empty text."""
    t = F.coalesce(text, F.lit(""))
    return {
        "n_words": word_count(t),
        "word_chars": _without(t, SPACES).cast("long"),
        "n_symbols": (F.char_length(t) - _without(t, SYMBOLS)).cast("long"),
        "n_capitals": (F.char_length(t) - _without(t, CAPITALS)).cast("long"),
        "n_lines": F.size(_lines(t)).cast("long"),
        "n_dup_lines": let(_lines(t), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": _repeat_words(t).cast("long"),
    }


@dataclass(frozen=True)
class Rule:
    """``rejects`` maps the measures to a condition; true rejects a text."""

    name: str
    rejects: Callable[[Mapping[str, Column]], Column]
    sql: str


RULES = (
    Rule("few_words", lambda m: m["n_words"] < 50, "n_words < 50"),
    Rule("repeated_windows", lambda m: m["n_repeat_words"] * 100 > m["n_words"] * 50, "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", lambda m: m["n_symbols"] * 4 > m["n_words"], "4 * n_symbols > n_words"),
    Rule("capitals", lambda m: m["n_capitals"] * 10 > m["word_chars"] * 4, "10 * n_capitals > 4 * word_chars"),
    Rule("repeated_lines", lambda m: m["n_dup_lines"] * 2 > m["n_lines"], "2 * n_dup_lines > n_lines"),
    Rule("word_length", lambda m: (m["word_chars"] < m["n_words"] * 2) | (m["word_chars"] > m["n_words"] * 15), "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
)
BASE_RULES = ("few_words", "repeated_windows")


@dataclass(frozen=True)
class Estimate:
    name: str
    seconds: float
    rejected: int


def estimate(df: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> tuple[list[Estimate], dict[int, int]]:
    """Cost of each rule alone on the sample, and how many sampled texts have each set of rejecting rules (as bits).

    The sample is drawn by chance with a fixed seed from the whole table, ``sample_rows`` expected rows; it is
    stored, so that the times hold no scan. The pattern counts, at most ``2 ** len(rules)``, show what a rule
    still rejects after others.
    """
    total = df.count()
    share = min(1.0, sample_rows / total) if total else 1.0
    sample = stored(df.select(F.col(text).cast("string").alias("__text")).sample(share, seed=11), "quality_sample")
    m = measures(F.col("__text"))
    bits = sum((F.when(r.rejects(m), F.lit(1 << i)).otherwise(0) for i, r in enumerate(rules)), F.lit(0))
    patterns = {r["bits"]: r["count"] for r in sample.groupBy(bits.alias("bits")).count().collect()}

    def seconds(condition: Column) -> float:
        start = time.perf_counter()
        sample.agg(F.count_if(condition)).collect()
        return time.perf_counter() - start

    idle = seconds(F.col("__text").isNull())
    out = []
    for i, r in enumerate(rules):
        spent = max(seconds(r.rejects(m)) - idle, 1e-3)
        out.append(Estimate(r.name, spent, sum(n for b, n in patterns.items() if b >> i & 1)))
    return out, patterns


def cascade_order(estimates: Sequence[Estimate], patterns: Mapping[int, int]) -> list[str]:
    """Greedy order: next comes the rule with the most rejections per second among texts that passed so far; ties keep the given order."""
    left = dict(patterns)
    rest = list(range(len(estimates)))
    order = []
    while rest:
        gain = lambda i: sum(n for b, n in left.items() if b >> i & 1) / estimates[i].seconds
        best = max(rest, key=lambda i: (gain(i), -i))
        order.append(estimates[best].name)
        left = {b: n for b, n in left.items() if not b >> best & 1}
        rest.remove(best)
    return order


def rejected_by(m: Mapping[str, Column], order: Sequence[str], rules: Sequence[Rule] = RULES) -> Column:
    """Name of the first rule in this order that rejects, else null. A CASE stops at the first, so later rules cost nothing."""
    by_name = {r.name: r for r in rules}
    first, *others = order
    out = F.when(by_name[first].rejects(m), F.lit(first))
    for name in others:
        out = out.when(by_name[name].rejects(m), F.lit(name))
    return out


def kept(df: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows that no rule rejects, with all their columns. Null is the empty text, which is rejected; repeated rows stay repeated."""
    order = cascade_order(*estimate(df, rules, text, sample_rows))
    return df.filter(rejected_by(measures(F.col(text).cast("string")), order, rules).isNull())


def report(df: DataFrame, key: str = "doc_id", rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``key``, all measures and ``rejected`` (whether a rule rejects) for every row.

    All measures are asked for, so they are computed once and the cascade reads them. A null or empty text has
    zero everywhere and is rejected for its few words. Keys may be null or repeated; an empty table gives no
    rows; other columns are not read.
    """
    order = cascade_order(*estimate(df, rules, text, sample_rows))
    m = measures(F.col("__text"))
    rows = df.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"))
    measured = rows.select("__key", *[c.alias(n) for n, c in m.items()])
    found = rejected_by({n: F.col(n) for n in m}, order, rules)
    return measured.select(F.col("__key").alias(key), *m, found.isNotNull().alias("rejected"))
