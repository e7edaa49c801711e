"""Hard negatives: for anchors and their nearest rows of the same label, rows of other labels that score nearly as high.

All rows are packed into R-trees by sort-tile-recursive: slabs along the first coordinate, tiles along the second (both
by Spark), and in each tile leaves along the coordinates that vary most. Anchors go through all tiles in blocks: a
best-first search in each tile, then the first rows over all tiles by a window. The search is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import scratch_path, stored
from . import rtree

# Rows of a tile (one tree, read whole by a task), and anchors of a block (sent to all tasks).
TILE_ROWS, BLOCK_ANCHORS = 4_096, 4_096
POSITIVES, NEGATIVES = 5, 10
# Fixed values of the contract: 30 * positive <= 100 * negative <= 90 * positive.
LOW, SCALE, HIGH = 30, 100, 90

TILE_SCHEMA = "dims int, rows binary, ids binary, nulls binary, labels binary, vectors binary"
FOUND_SCHEMA = "anchor long, window int, row long, id long, score long"


def valid(vector: Column) -> Column:
    """Whether a vector is there and every component is a finite number."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(number(x.cast("double")), F.lit(False)))


def quantised(vector: Column, scale: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def _padded(column: pa.ListArray, dims: int) -> np.ndarray:
    """Lists of numbers as a matrix; shorter ones end in zeros."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes == dims).all():
        return values.reshape(len(sizes), dims).astype(np.int64)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = values
    return out


def packed_tiles(rows: DataFrame, dims: int) -> DataFrame:
    """One row per tile: its rows in leaf order as arrays of bytes."""
    tiles = max(1, -(-rows.count() // TILE_ROWS))
    slabs = int(np.ceil(np.sqrt(tiles)))
    first, second = F.coalesce(F.get("vector", F.lit(0)), F.lit(0)), F.coalesce(F.get("vector", F.lit(1)), F.lit(0))
    cuts = rows.select(F.percentile_approx(first, [i / slabs for i in range(1, slabs)], 10_000)).first()[0] if slabs > 1 else []
    slab = F.size(F.filter(F.lit(cuts or [0]), lambda c: c < first)) if cuts else F.lit(0)
    # the row breaks ties, so that no value of a coordinate makes a large tile
    dealt = rows.withColumn("slab", slab).repartitionByRange(tiles, "slab", second, "row").drop("slab")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = [b for b in batches if b.num_rows]
        if not read:
            return
        table = pa.Table.from_batches(read).combine_chunks()
        vectors = _padded(table["vector"].chunk(0), dims)
        ids = table["id"].fill_null(0).to_numpy().astype(np.int64)
        nulls = table["id"].is_null().to_numpy()
        row, labels = table["row"].to_numpy().astype(np.int64), table["label"].to_numpy().astype(np.int64)
        order = rtree.str_order(vectors)
        arrays = [a[order].tobytes() for a in (row, ids, nulls, labels, vectors)]
        yield pa.RecordBatch.from_pydict({n: [v] for n, v in zip(("dims", "rows", "ids", "nulls", "labels", "vectors"), [dims, *arrays])}, schema=pa.schema([("dims", pa.int32()), *((n, pa.binary()) for n in ("rows", "ids", "nulls", "labels", "vectors"))]))

    return dealt.select("row", "id", "label", "vector").mapInArrow(pack, TILE_SCHEMA)


def _searched(tiles: DataFrame, anchors: dict[str, np.ndarray], windows: list[np.ndarray], same_label: bool, k: int) -> DataFrame:
    """``anchor, window, row, id, score``: of every tile the first ``k`` rows of each anchor's windows.

    ``windows[i]``: the ``(low, high)`` of anchor ``i``. The anchor's own row is never among them.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for tile in frame.itertuples(index=False):
                rows, ids, labels = (np.frombuffer(x, np.int64) for x in (tile.rows, tile.ids, tile.labels))
                nulls = np.frombuffer(tile.nulls, bool)
                raw = np.frombuffer(tile.vectors, np.int64).reshape(len(rows), tile.dims)
                kind = rtree.exact_type(raw, anchors["vector"])
                tree, queries = rtree.Tree(raw.astype(kind)), anchors["vector"].astype(kind)
                # earlier ids get lower tie numbers; null is the last
                tie = np.empty(len(rows), np.int64)
                tie[np.lexsort((rows, ids, nulls))] = np.arange(len(rows))
                bounds = tree.intervals(queries)
                out = []
                for i, q in enumerate(queries):
                    if not len(windows[i]):
                        continue
                    mine = labels == anchors["label"][i]
                    allowed = (mine if same_label else ~mine) & (rows != anchors["row"][i])
                    mine_bounds = [(lo[i], hi[i]) for lo, hi in bounds]
                    found, _ = rtree.search(tree, mine_bounds, q, allowed, windows[i], k, tie)
                    out += [(anchors["row"][i], w, rows[p], None if nulls[p] else ids[p], s) for w, hits in enumerate(found) for s, p in hits]
                yield pd.DataFrame({n: pd.Series([x[j] for x in out], dtype="Int64") for j, n in enumerate(("anchor", "window", "row", "id", "score"))})

    return tiles.mapInPandas(run, FOUND_SCHEMA)


def _first(found: DataFrame, k: int) -> DataFrame:
    """Add ``rank`` and keep the first ``k`` rows of each anchor and window over all tiles."""
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(
    df: DataFrame,
    anchors: Column,
    key: str = "vec_id",
    vector: str = "vector",
    label: str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    scale: int = SCALE,
    high: int = HIGH,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``; ``vector`` holds whole numbers.

    Rows with a null label or vector or a null component take no part; ``anchors`` says which of the others are
    anchors. Scores are inner products; shorter vectors end in zeros, and products must fit a long. Higher scores come
    first, ties by smaller key, null last, then in any fixed order. An anchor's positives are its first other rows of
    the same label; a repeated row is another row. For each anchor and positive the first rows of other labels with
    ``low * positive_score <= scale * score <= high * positive_score`` are returned, ranked from 1. An empty table
    gives no rows; other columns are not read.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<long>").alias("vector"), F.coalesce(anchors, F.lit(False)).alias("is_anchor"))
    rows = rows.filter(F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull()))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "hard_rows")
    dims, n = rows.agg(F.max(F.size("vector")), F.count_if("is_anchor")).first()
    blocks = -(-n // BLOCK_ANCHORS)
    results = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not blocks:
        return spark.createDataFrame([], results)
    tiles = stored(packed_tiles(rows, dims), "hard_tiles")
    numbered = rows.filter("is_anchor").withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    path = scratch_path(spark, "hard_negatives")
    spark.createDataFrame([], results).write.parquet(path)
    for b in range(blocks):
        taken = numbered.filter(F.col("block") == b).select("row", "id", "label", "vector").toArrow().combine_chunks()
        if not taken.num_rows:
            continue
        block = {"row": taken["row"].to_numpy(), "label": taken["label"].to_numpy(), "vector": _padded(taken["vector"].chunk(0), dims)}
        everything = [np.array([(-np.inf, np.inf)])] * taken.num_rows
        near = stored(_first(_searched(tiles, block, everything, True, positives), positives), "hard_positives")
        # at most ``positives`` rows for each anchor of the block; bounds are whole numbers, so nothing is multiplied in the search
        scores = {(r["anchor"], r["rank"]): r["score"] for r in near.select("anchor", "rank", "score").collect()}
        windows = [[(-(-low * s // scale), high * s // scale) for i in range(1, positives + 1) if (s := scores.get((int(row), i))) is not None] for row in block["row"]]
        far = _first(_searched(tiles, block, windows, False, negatives), negatives)
        named = near.select("anchor", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        ids = numbered.filter(F.col("block") == b).select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
        out = far.join(named, ["anchor", "window"]).join(ids, "anchor")
        out = out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out.write.mode("append").parquet(path)
    return spark.read.schema(results).parquet(path)
