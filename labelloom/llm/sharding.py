"""Shards by a hierarchical weighted hash tree.

A key descends from the root through regions and racks to a shard. At each level every child draws
``-ln(u) / weight``, where ``u`` is a hash of the key and the child's name in (0, 1); the smallest draw wins.
A child's weight is the sum of its shards' weights. A draw depends on nothing but key, child and weight, so a
changed weight moves only keys that enter or leave that child's subtree, and a new region takes keys into
itself only.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..session import stored
from .common import draw52, draw52_sql, numbered, unit_draw

# {region: {rack: {shard number: weight}}}
Tree = Mapping[str, Mapping[str, Mapping[int, float]]]


def topology(shards: int, racks_per_region: int = 2, shards_per_rack: int = 2) -> dict[str, dict[str, dict[int, float]]]:
    """Tree of equal shards, filled rack by rack and region by region; a whole region more leaves the others as they are."""
    if shards < 1:
        raise ValueError("at least one shard")
    tree: dict[str, dict[str, dict[int, float]]] = {}
    for s in range(shards):
        rack, region = s // shards_per_rack, s // shards_per_rack // racks_per_region
        tree.setdefault(f"region{region}", {}).setdefault(f"rack{rack}", {})[s] = 1.0
    return tree


def _weight(node) -> float:
    return math.fsum(_weight(v) for v in node.values()) if isinstance(node, Mapping) else float(node)


def _children(node, path: str) -> list[tuple[str, float, object]]:
    """``(name, weight, subtree or shard number)`` of the children that have weight."""
    out = []
    for name, child in node.items():
        if (w := _weight(child)) > 0:
            out.append((f"{path}/{name}", w, child if isinstance(child, Mapping) else int(name)))
    if not out:
        raise ValueError(f"no weight below {path or 'the root'}")
    return out


def descend(key: Column, tree: Tree) -> Column:
    """Shard number of a key, a Column of built-in functions; null is a key like any other.

    A level costs one hash per child of the chosen node only: the branches stand in a CASE.
    """

    def below(node, path: str) -> Column:
        children = _children(node, path)
        leaf = [below(c, n) if isinstance(c, Mapping) else F.lit(c) for n, _, c in children]
        if len(children) == 1:
            return leaf[0]
        draws = [-F.log(unit_draw(key, F.lit(n))) / F.lit(w) for n, w, _ in children]
        best = F.least(*draws)
        out = leaf[-1]
        for d, x in list(zip(draws, leaf))[-2::-1]:
            out = F.when(d == best, x).otherwise(out)
        return out

    return below(tree, "").cast("int")


def descend_sql(key: str, tree: Tree) -> str:
    def below(node, path: str) -> str:
        children = _children(node, path)
        leaf = [below(c, n) if isinstance(c, Mapping) else str(c) for n, _, c in children]
        if len(children) == 1:
            return leaf[0]
        draws = [f"(-ln(({draw52_sql(key, repr(n))} + 0.5::DOUBLE) / {float(1 << 52)!r}::DOUBLE) / {w!r})" for n, w, _ in children]
        best = f"least({', '.join(draws)})"
        whens = " ".join(f"WHEN {d} = {best} THEN {x}" for d, x in zip(draws[:-1], leaf[:-1]))
        return f"(CASE {whens} ELSE {leaf[-1]} END)"

    return f"CAST({below(tree, '')} AS INTEGER)"


def shard_rows(df: DataFrame, tree: Tree, grown: Tree | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, size, text_crc32, shard, slot, grown_shard`` of every row.

    ``size`` is the text's UTF-8 bytes plus one, ``slot`` a gapless number within the shard from 0 on, in the
    order of a hash of the key. A null text has size 1 and the checksum of the empty text. A null key is one
    key. Repeated rows get different slots of the same shard; they travel as one row with a count, so a key
    with a third of all rows is no larger than another. An empty table gives no rows. Other columns are not
    read, so their names cannot clash.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.select(
        F.col(key).alias("__key"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).cast("long").alias("text_crc32"),
    )
    counted = (
        rows.groupBy("__key", "size", "text_crc32")
        .agg(F.count("*").alias("__count"))
        .withColumn("shard", descend(F.col("__key"), tree))
        .withColumn("__draw", draw52(F.col("__key")))
    )
    placed = stored(counted, "shard_rows")
    ranked = numbered(placed, ["shard"], "__draw", ["__key", "size", "text_crc32"], "__count", "__first")
    grown_shard = descend(F.col("__key"), grown) if grown is not None else F.lit(None).cast("int")
    return ranked.select(
        F.col("__key").alias(key),
        "size",
        "text_crc32",
        "shard",
        F.explode(F.sequence(F.col("__first"), F.col("__first") + F.col("__count") - 1)).alias("slot"),
        grown_shard.alias("grown_shard"),
    )
