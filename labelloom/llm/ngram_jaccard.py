"""Self-join of texts on the Jaccard similarity of their word shingles by chosen paths.

Equal sets are one node. A set is embedded as COORDINATES minimum tokens: coordinate ``i`` of two sets agrees with
the chance of their similarity. From the root a run chooses BRANCH coordinates, and a set goes into one bucket for
each, named by its token there. A bucket with at most LEAF sets is compared by brute force; a larger one chooses
coordinates again and splits, so that unlike sets part while like ones meet in some bucket. Sets that resemble the
first of their bucket are linked to it at once, and a bucket whose sets are connected by then is done: a group of
copies of any size costs a comparison per member and bucket. Runs are repeated until a pair at the threshold is missed with a chance
below ``1 - recall``.

Buckets are compared on the embeddings, with slack. That gives candidate components, in which the sets themselves
are compared, all pairs, in blocks: so links are exact, and none inside a component depends on chance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import stored
from .common import WORD, checked_broadcast
from .wordhash import chunks, mixed, word_hashes

WORDS = 5
THRESHOLD = (4, 5)  # similarity as a fraction
RECALL = 0.999999
BRANCH = 2
COORDINATES = 64
LEAF = 128
BUCKET_SETS = 4096  # members of a larger bucket that is not split further; its pairs take a task a second or two
DEPTH = 4
# Agreeing coordinates that make a candidate: a pair at the threshold has fewer with a chance of 1e-8.
AGREE = 32
# Sets and shingles of a block, about; a larger component is compared in pairs of blocks.
BLOCK_SETS, BLOCK_SHINGLES = 512, 1 << 20
# Candidate sets, or kept keys, up to which a table of a few numbers each is sent to the tasks that read the texts.
BROADCAST_ROWS = 1_000_000

_rng = np.random.default_rng(20240501)
_SALTS = _rng.integers(1, 1 << 63, size=4096, dtype=np.uint64) | np.uint64(1)
_FACTORS = _rng.integers(1, 1 << 32, size=COORDINATES, dtype=np.uint32) | np.uint32(1)
_SHIFTS = _rng.integers(1, 1 << 32, size=COORDINATES, dtype=np.uint32)


def runs_for(recall: float = RECALL, similarity: float = THRESHOLD[0] / THRESHOLD[1], branch: int = BRANCH) -> int:
    """Runs after which a pair at the threshold is missed with a chance of at most ``1 - recall``, at whatever depth its buckets end.

    A pair that is together in a bucket is together in a bucket one level down with the chance ``f = 1 - (1 - s f)**branch``
    (each choice keeps it with the chance ``s``, and it must survive below); iterated, ``f`` falls to the chance at any depth.
    """
    f = 1.0
    for _ in range(200):
        f = 1 - (1 - similarity * f) ** branch
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - f)))


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle, a text without words none."""
    for first, last, raw, offsets in chunks(texts):
        hashes, owner = word_hashes(raw, offsets)
        bounds = np.searchsorted(owner, np.arange(last - first + 1))
        n = len(hashes)
        rolled = np.zeros(n, dtype=np.uint64)
        for k in range(words):
            rolled[: max(n - k, 0)] += hashes[k:] * _SALTS[k]
        rolled = mixed(rolled)
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            if hi - lo >= words:
                yield np.unique(rolled[lo : hi - words + 1])
            elif hi > lo:
                few = np.add.reduce(hashes[lo:hi] * _SALTS[: hi - lo], keepdims=True)
                yield mixed(few + _SALTS[words + hi - lo])
            else:
                yield np.empty(0, dtype=np.uint64)


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers; the first names the node."""
    a = mixed(np.array([np.add.reduce(mixed(shingles ^ _SALTS[20])), np.add.reduce(mixed(shingles ^ _SALTS[21]))], dtype=np.uint64) + np.uint64(len(shingles)))
    hi, lo = a.view(np.int64)
    return int(hi), int(lo)


def _minima(shingles: np.ndarray) -> np.ndarray:
    """The set's minimum token at each coordinate."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    at = np.zeros(COORDINATES, dtype=np.int64)
    least = np.full(COORDINATES, 0xFFFFFFFF, dtype=np.uint32)
    for start in range(0, len(low), 1 << 14):
        ranks = _FACTORS[:, None] * low[None, start : start + (1 << 14)] + _SHIFTS[:, None]
        here = ranks.argmin(axis=1)
        value = ranks[np.arange(COORDINATES), here]
        better = (value < least) | (start == 0)
        at[better], least[better] = here[better] + start, value[better]
    return shingles[at]


def _hash(text: str) -> Column:
    """What tells apart the texts of rows with the same key."""
    return F.xxhash64(F.col(text).cast("string"))


def _embed(df: DataFrame, key: str, text: str, runs: int) -> DataFrame:
    """``key, hash, node, low, size, sketch, paths`` of every row; texts without words have null but for the key and the text's hash."""
    roots = BRANCH * runs

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, lows, sizes, sketches, paths = [], [], [], [], []
            for s in shingle_sets(batch.column(1)):
                if len(s) == 0:
                    for column in (nodes, lows, sizes, sketches, paths):
                        column.append(None)
                    continue
                hi, lo = _digest(s)
                tokens = _minima(s)
                nodes.append(hi)
                lows.append(lo)
                sizes.append(len(s))
                sketches.append(tokens.astype(np.uint16).tobytes())
                paths.append(mixed(tokens[np.arange(roots) % COORDINATES] ^ _SALTS[100 : 100 + roots]).view(np.int64))
            columns = [batch.column(0), batch.column(2), pa.array(nodes, pa.int64()), pa.array(lows, pa.int64()), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()), pa.array(paths, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["__key", "hash", "node", "low", "size", "sketch", "paths"])

    given = df.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"), _hash(text).alias("hash"))
    schema = f"__key {given.dtypes[0][1]}, hash long, node long, low long, size int, sketch binary, paths array<long>"
    return given.mapInArrow(rows, schema)


def _sketches(column: pa.Array) -> np.ndarray:
    flat = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16)
    return flat.reshape(-1, COORDINATES)


def _alike(sketches: np.ndarray, sizes: np.ndarray, i: int) -> np.ndarray:
    """Which rows resemble row ``i`` closely enough to be compared."""
    num, den = THRESHOLD
    agree = (sketches == sketches[i]).sum(axis=1) >= AGREE
    return agree & (np.minimum(sizes, sizes[i]) * den >= np.maximum(sizes, sizes[i]) * num)


def _roots(n: int, alike) -> np.ndarray:
    """Smallest index of the component of each of ``n`` rows, ``alike(i)`` giving the rows that are linked to row ``i``."""
    root = np.arange(n)
    for i in range(n):
        near = alike(i)
        near[i] = True
        least = root[near].min()
        root[np.isin(root, np.unique(root[near]))] = least
    return root


def _compare(buckets: DataFrame) -> DataFrame:
    """Links ``a, b`` that span the candidate components of each bucket; ``members`` is an array of node, size and sketch of bounded length."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column(0)
            flat = members.flatten()
            if len(flat) == 0:
                continue
            nodes = flat.field("node").to_numpy()
            sizes = flat.field("size").to_numpy().astype(np.int64)
            sketches = _sketches(flat.field("sketch"))
            ends = np.cumsum(members.value_lengths().to_numpy())
            a, b, start = [], [], 0
            for end in ends:
                order = start + np.argsort(nodes[start:end], kind="stable")
                s, z = sketches[order], sizes[order]
                root = _roots(len(order), lambda i: _alike(s, z, i))
                moved = np.flatnonzero(root != np.arange(len(order)))
                a.append(nodes[order[moved]])
                b.append(nodes[order[root[moved]]])
                start = end
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return buckets.select("members").mapInArrow(rows, "a long, b long")


def _stars(large: DataFrame) -> DataFrame:
    """Rows of large buckets with ``covered`` (resembles the bucket's first set) and the paths of the buckets below."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, first = _sketches(batch.column("sketch")), _sketches(batch.column("first_sketch"))
            size, first_size = (batch.column(c).to_numpy().astype(np.int64) for c in ("size", "first_size"))
            num, den = THRESHOLD
            covered = ((own == first).sum(axis=1) >= AGREE) & (np.minimum(size, first_size) * den >= np.maximum(size, first_size) * num)
            path = batch.column("path").to_numpy().view(np.uint64)
            below = np.empty((len(path), BRANCH), dtype=np.uint64)
            for k in range(BRANCH):
                choice = (mixed(path ^ _SALTS[40 + k]) % np.uint64(COORDINATES)).astype(np.int64)
                token = own[np.arange(len(path)), choice].astype(np.uint64)
                below[:, k] = mixed(path * _SALTS[50 + k] + token)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(below.view(np.int64).ravel()), BRANCH).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("node"), batch.column("first"), pa.array(covered), lists], ["path", "node", "first", "covered", "below"])

    return large.mapInArrow(rows, "path long, node long, first long, covered boolean, below array<long>")


def _members(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``members`` arrays of the buckets of ``bucket, node``, which are of bounded size."""
    rows = pairs.join(sets.select("node", "size", "sketch"), "node")
    return rows.groupBy("bucket").agg(F.collect_list(F.struct("node", "size", "sketch")).alias("members"))


def candidates(sets: DataFrame) -> DataFrame:
    """``node, root``: the candidate components of all nodes that resemble another.

    A level compares the small buckets and links the members of large ones to their first. A large bucket whose
    members are in one component by then is done; another is compared if it has at most BUCKET_SETS members, else it splits. Only components are asked for, so nothing is
    lost by leaving out pairs that are connected already.
    """
    rows = sets.select("node", F.explode("paths").alias("path"))
    roots, waiting = None, None
    for depth in range(1, DEPTH + 1):
        info = rows.groupBy("path").agg(F.count("*").alias("n"), F.min("node").alias("first"), F.bit_xor("node").alias("check")).filter("n > 1")
        held = stored(rows.join(info, "path"), "paths")
        # buckets with the same members need one comparison
        small = held.filter(F.col("n") <= LEAF).select(F.xxhash64("n", "first", "check").alias("bucket"), "node").distinct()
        # the buckets left over from the level above are compared in the same pass
        links = [_compare(_members(small if waiting is None else small.union(waiting), sets))]
        large = held.filter(F.col("n") > LEAF)
        firsts = sets.select(F.col("node").alias("first"), F.col("size").alias("first_size"), F.col("sketch").alias("first_sketch"))
        stars = stored(_stars(large.select("path", "node", "first").join(sets.select("node", "size", "sketch"), "node").join(firsts, "first")), "stars")
        links += _spanning(stars.filter("covered"))
        roots = _connected(links, roots)
        named = stars.join(roots, "node", "left").select("path", F.coalesce("root", "node").alias("root"))
        spread = named.groupBy("path").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("n"))
        unfinished = stored(spread.filter("least <> most").select("path", "n"), "unfinished")
        if unfinished.isEmpty():
            break
        # what one task can compare at once is not split further
        middle = held.join(unfinished.filter(F.col("n") <= BUCKET_SETS).select("path"), "path")
        # its links count from the next level on
        waiting = middle.select(F.xxhash64("n", "first", "check").alias("bucket"), "node").distinct()
        wide = stars.join(unfinished.filter(F.col("n") > BUCKET_SETS), "path")
        if wide.isEmpty():
            return _connected([_compare(_members(waiting, sets))], roots)
        if depth < DEPTH:
            rows = wide.select("node", F.explode("below").alias("path"))
            continue
        # what the depth did not part is compared in blocks, all pairs of them
        blocks = F.ceil(F.col("n") / F.lit(BUCKET_SETS // 2)).cast("int")
        rest = wide.select("path", "node", blocks.alias("blocks"))
        block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        paired = rest.select("path", "node", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        pairs = paired.select(F.xxhash64("path", F.least("block", "other"), F.greatest("block", "other")).alias("bucket"), "node")
        return _connected([_compare(_members(waiting.union(pairs), sets))], roots)
    return roots


def _connected(links: list[DataFrame], roots: DataFrame | None) -> DataFrame:
    """Components of links and of what was connected before; only links between those components are followed."""
    links = _union(links)
    if roots is None:
        return components(links)
    at, to = (roots.select(F.col("node").alias(end), F.col("root").alias(name)) for end, name in (("a", "x"), ("b", "y")))
    between = links.distinct().join(at, "a", "left").join(to, "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
    met = components(between)
    if met.isEmpty():
        return roots
    before = roots.join(met.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return stored(before.union(met.join(roots, "node", "left_anti").select("node", "root")), "roots")


def _spanning(stars: DataFrame) -> list[DataFrame]:
    """Links that join the same nodes as all ``node, first`` do: each node with its smallest first one, which is linked to its other first ones.

    Members of a large group are covered in every bucket they share; so they have a link each instead of one per bucket.
    """
    near = stars.groupBy("node").agg(F.min("first").alias("least"), F.collect_set("first").alias("firsts"))
    firsts = near.select(F.explode("firsts").alias("a"), F.col("least").alias("b")).distinct()
    return [near.select(F.col("node").alias("a"), F.col("least").alias("b")).filter("a <> b"), firsts.filter("a <> b")]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of all nodes of the links ``a, b``: the smallest node of each component.

    In a round every node points to its smallest neighbour and then to that one's, and links are drawn anew between
    what their ends point to; those inside one node vanish. Every component that has a link left loses at least half of
    its nodes in a round. The tables of a round are written to the shared folder; where a node points to in the end is
    looked up once, along all rounds.
    """
    links = stored(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    jumps = []
    while not links.isEmpty():
        ends = links.union(links.select("b", "a"))
        near = ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
        near = stored(near.select("node", F.least("node", "near").alias("near")), "near")
        second = near.select(F.col("node").alias("near"), F.col("near").alias("to"))
        jump = stored(near.join(second, "near").select("node", "to"), "jump")
        jumps.append(jump)
        left = links.join(jump.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(jump.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        left = left.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        links = stored(left.distinct(), "links")
    if not jumps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = jumps[0].select("node", F.col("to").alias("root"))
    for jump in jumps[1:]:
        roots = roots.join(jump.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return stored(roots, "roots") if len(jumps) > 1 else roots


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, as a product of the sets' incidence matrix in slabs of columns."""
    k = len(sets)
    if k <= 4:
        out = np.diag([len(s) for s in sets]).astype(np.int64)
        for i in range(k):
            for j in range(i):
                out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    owner = np.repeat(np.arange(k), [len(s) for s in sets])
    tokens, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.where(shared, np.cumsum(shared) - 1, -1)[column]
    order = np.argsort(column, kind="stable")
    order = order[np.searchsorted(column[order], 0) :]
    owner, column = owner[order], column[order]
    out = np.zeros((k, k), dtype=np.float64)
    for lo in range(0, int(shared.sum()), 4096):
        at, end = np.searchsorted(column, [lo, lo + 4096])
        slab = np.zeros((k, 4096), dtype=np.float32)
        slab[owner[at:end], column[at:end] - lo] = 1
        out += slab @ slab.T
    return out.astype(np.int64)


def _exact(blocks: DataFrame) -> DataFrame:
    """``node, links, root`` of each set of a block; rows of a block lie together, ``x`` and ``y`` name its two sides.

    Links count documents, so a set counts as often as it has copies. Pairs within one side of a block of two sides
    belong to another block.
    """

    def block(rows: list[tuple]) -> list[tuple]:
        rows = sorted({r[3]: r for r in rows}.values(), key=lambda r: r[3])
        sets = list(shingle_sets(pa.array([r[5] for r in rows], pa.string())))
        sizes = np.array([len(s) for s in sets])
        side = np.array([r[6] for r in rows])
        num, den = THRESHOLD
        # |A & B| / |A | B| >= num / den
        linked = _intersections(sets) * (num + den) >= num * (sizes[:, None] + sizes[None, :])
        np.fill_diagonal(linked, False)
        if rows[0][1] != rows[0][2]:
            linked &= side[:, None] != side[None, :]
        copies = np.array([r[4] for r in rows], dtype=np.int64)
        links = linked @ copies
        root = _roots(len(rows), lambda i: linked[i].copy())
        return [(r[3], int(n), rows[k][3]) for r, n, k in zip(rows, links, root)]

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = [], []

        def flushed() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ([], [], []))], ["node", "links", "root"])
            out.clear()
            return made

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if held and r[:3] != held[0][:3]:
                    out.extend(block(held))
                    held = []
                held.append(r)
            yield flushed()
        if held:
            out.extend(block(held))
        yield flushed()

    return blocks.select("comp", "x", "y", "node", "copies", "text", "side").mapInArrow(rows_of, "node long, links long, root long")


def _classes(df: DataFrame, key: str, text: str, recall: float) -> tuple[DataFrame, DataFrame]:
    """``__key, hash, node`` and more of every row, and ``node, root, head, n_links`` of every set.

    A set's text is that of one of its rows, ``rep``, which is looked up by key and hash of the text. ``head`` is the
    first ``rep`` of a class: keys that are null come last, rows of one key are ordered by the hash.
    """
    docs = stored(_embed(df, key, text, runs_for(recall)), "shingle_embeddings")
    grouped = docs.filter("node IS NOT NULL").groupBy("node", "low")
    sets = stored(grouped.agg(F.min(F.struct(F.col("__key").isNull().alias("none"), F.col("__key").alias("key"), "hash")).alias("rep"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("paths").alias("paths")), "shingle_sets")
    roots = candidates(sets)

    known = sets.select("node", "rep", "copies", "size").join(roots, "node")
    weight = known.groupBy(F.col("root").alias("comp")).agg(F.greatest(F.ceil(F.count("*") / F.lit(BLOCK_SETS)), F.ceil(F.sum("size") / F.lit(BLOCK_SHINGLES))).cast("int").alias("blocks"))
    placed = known.join(weight, F.col("root") == F.col("comp")).select("rep", "node", "comp", "copies", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("side"))
    placed = stored(placed, "candidate_sets")
    texts = df.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("text"), _hash(text).alias("__hash"))
    # few texts are candidates: the table of their keys goes to the texts while it is small, else the texts move
    at = F.col("rep.key").eqNullSafe(F.col("__key")) & (F.col("rep.hash") == F.col("__hash"))
    full = texts.join(checked_broadcast(placed, BROADCAST_ROWS), at).select("text", *placed.columns)
    # a set of several rows may have its row more than once, but needs one text
    several = full.filter("copies > 1").groupBy(*[c for c in placed.columns if c != "rep"]).agg(F.first("text").alias("text"))
    full = full.filter("copies = 1").select(*several.columns).union(several)
    spread = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("comp", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "node", "copies", "text", "side")
    compared = stored(_exact(spread.repartition("comp", "x", "y").sortWithinPartitions("comp", "x", "y", "node")), "exact_links")

    # a component in one block has its classes already; the parts of others meet in their links
    single = compared.join(placed.filter("blocks = 1").select("node"), "node", "left_semi").select("node", "root")
    wide = compared.join(placed.filter("blocks > 1").select("node"), "node", "left_semi").filter("node <> root")
    if not wide.isEmpty():
        met = components(wide.select(F.col("node").alias("a"), F.col("root").alias("b")))
        single = single.union(met)
    totals = compared.groupBy("node").agg(F.sum("links").alias("links"))
    classes = sets.select("node", "rep", "copies").join(single, "node", "left").select("node", "rep", "copies", F.coalesce("root", "node").alias("root"))
    heads = classes.groupBy("root").agg(F.min("rep").alias("head"))
    return docs, classes.join(heads, "root").join(totals, "node", "left").select("node", "root", "head", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))


def similar(df: DataFrame, key: str = "doc_id", text: str = "text", recall: float = RECALL) -> DataFrame:
    """``key, class_id, n_links`` of every row.

    Two documents are linked if their sets of five-word shingles have a Jaccard similarity of 0.8 or more; equal texts
    are. A class is a connected component of links, named by its smallest key. ``n_links`` counts the documents that
    a document is linked to. A text of one to four words is one shingle; a null text or one without words has no
    links and is a class of its own. Keys may be null (they never name a class that has another key); rows with the
    same key count as documents of their own. An empty table gives no rows; other columns are not read.

    Nodes are 64-bit names of 128-bit set digests.
    """
    kind = dict(df.dtypes)[key]
    docs, named = _classes(df, key, text, recall)
    out = docs.select("__key", "node").join(named.select("node", F.col("head.key").alias("class_id"), "n_links"), "node", "left")
    # a class of its own is named by its key
    return out.select(
        F.col("__key").alias(key),
        F.when(F.col("node").isNull(), F.col("__key")).otherwise(F.col("class_id")).cast(kind).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def first_of_each(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, with all its columns: the row of the smallest key, null last, and then of the text's hash.

    Rows are chosen, not keys: of rows with the same key and unlike texts each class keeps its own, and a class without
    any key keeps a row too. Of rows that repeat the chosen one, the one whose columns have the smallest hash is kept.
    Texts without words are classes of their own, so all of them stay. Only rows that are repeated are grouped.
    """
    docs, named = _classes(df, key, text, RECALL)
    at = F.col("__key").eqNullSafe(F.col("__kept")) & (F.col("__hash") == F.col("__kept_hash"))
    heads = named.select(F.col("head.key").alias("__kept"), F.col("head.hash").alias("__kept_hash")).distinct()
    kept = docs.filter("node IS NOT NULL").select("__key", F.col("hash").alias("__hash")).join(heads, at)
    marks = stored(kept.groupBy("__kept", "__kept_hash").agg(F.count("*").alias("__rows")), "kept_rows")
    wordless = F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(WORD)) == 0
    rows = df.select(F.struct("*").alias("__row"), F.col(key).alias("__key"), _hash(text).alias("__hash"), wordless.alias("__wordless"))
    joined = rows.join(checked_broadcast(marks, BROADCAST_ROWS), at)
    out = joined.filter("__rows = 1").select("__row").union(rows.filter("__wordless").select("__row"))
    if not marks.filter("__rows > 1").isEmpty():
        repeated = joined.filter("__rows > 1").withColumn("__order", F.xxhash64(F.to_json("__row")))
        out = out.union(repeated.groupBy("__kept", "__kept_hash").agg(F.min_by("__row", "__order").alias("__row")).select("__row"))
    return out.select(*[F.col("__row").getField(c).alias(c) for c in df.columns])
