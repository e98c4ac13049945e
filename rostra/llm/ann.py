"""Nearest neighbours by shifted space-filling curves.

Unit vectors are projected on ``DIMS`` random orthogonal directions, shifted, cut to a
grid and numbered along a Hilbert curve, in up to ``ORDERINGS`` independent ways. Each
ordering is cut at quantiles of its keys into cells of about ``CELL_ROWS`` rows (``CELLS``
cells at most, then larger ones). How far a query must look is measured, not set: the exact
neighbours of ``SAMPLE`` queries, found among all rows, tell how many cells away along their
best curve the neighbours of a share ``TARGET`` lie. Of 4, 8 and 16 orderings those are taken
that reach this with the least work. Neighbouring cells form blocks; queries, which are
few, are copied to the blocks that their windows touch, and a task scores the queries of a
block against its rows. The orderings' candidates merge; the best are reranked by the exact
cosine of the original vectors. Curves carry half-precision unit vectors, which only choose.

Every row is dealt to every ordering taken; the sample only sets the reach. So recall holds
at any size, and the work is what the structure of the vectors allows: a small share of
the table where neighbours stay together along some curve, most of it where vectors are
isotropic in many dimensions, since no ordering keeps neighbours together there. Blocks are
split by hash beyond ``BLOCK_ROWS`` rows or ``BLOCK_ASKS`` queries, so memory in a task does
not grow with the table. The driver holds the cuts (at most ``CELLS`` an ordering, or one for
each vector length if those are more) and the vectors of the sample and of its neighbours.

Rows with equal vectors are one node of the curves with their k + 1 smallest ids, which
are all that any query can need; so a vector that a third of all rows have fills no
window, and ties among its copies go to the smaller ids exactly.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components
take no part, nor do rows with a null id; very small and very large components are scaled
by powers of two first; vectors of different lengths are never compared; rows that repeat
an id are one candidate with its best score, however many they are; ties go to the smaller
id; a query with fewer candidates than k gets all. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostra.llm.common import staged

ORDERINGS, DIMS, DEPTH = 16, 6, 7
#: Queries whose exact neighbours set the reach, and the share of these neighbours that must be met.
SAMPLE, TARGET = 256, 0.95
#: Rows of a cell, cells of an ordering, rows and queries of a block.
CELL_ROWS, CELLS, BLOCK_ROWS, BLOCK_ASKS = 128, 4096, 16_384, 65_536
#: What dealing a row to an ordering costs, in scored pairs.
DEAL_COST = 500
#: Bits of the node's hash that follow the curve key, so that rows of one grid cell can be cut too.
_TIE_BITS = 63 - DIMS * DEPTH
_BLOCK = ["ordering", "dim", "block", "slice"]
_DEALT = "ordering int, dim int, block int, slice int, ask boolean, node long, fold long, vector binary"
_FOUND = "query_node long, node long, fold long, score double"

#: Cuts of each ordering, by vector length.
Cuts = dict[tuple[int, int], np.ndarray]


class Size(NamedTuple):
    """Rows and queries of one vector length."""

    rows: int
    asks: int


class Reach(NamedTuple):
    """Cells to look at on either side, and cells of a block."""

    cells: int
    block: int


def hilbert(x: np.ndarray, depth: int) -> np.ndarray:
    """Place on the Hilbert curve of grid points (rows of ``depth``-bit integers), by Skilling's transform."""
    x = x.astype(np.int64).T.copy()
    m = len(x)
    for q in (1 << b for b in range(depth - 1, 0, -1)):
        for i in range(m):
            set_ = (x[i] & q) != 0
            t = np.where(set_, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(set_, q - 1, t)
            x[i] ^= t
    for i in range(1, m):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for q in (1 << b for b in range(depth - 1, 0, -1)):
        t ^= np.where(x[m - 1] & q, q - 1, 0)
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(depth - 1, -1, -1):
        for i in range(m):
            key = key << 1 | (x[i] >> b & 1)
    return key


def curve_keys(unit: np.ndarray, ordering: int) -> np.ndarray:
    """Keys of unit vectors in one ordering."""
    dim = unit.shape[1]
    rng = np.random.default_rng([dim, ordering])
    axes = np.linalg.qr(rng.normal(size=(dim, min(DIMS, dim))))[0]
    y = unit @ axes * dim**0.5
    span, side = 3.0, 1 << DEPTH
    grid = np.floor((y + span / 2 + rng.random(axes.shape[1]) * span / 2) / (1.5 * span) * side)
    return hilbert(np.clip(grid, 0, side - 1), DEPTH)


def _lists(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors (double) of a column of lists, by length; each scaled by a power of two to about 1.

    Rows that are null, empty, zero, or hold null or non-finite components are left out.
    """
    n = np.array(column.value_lengths().fill_null(0))
    starts = np.array(column.offsets)[:-1]
    flat = np.asarray(column.values.to_numpy(zero_copy_only=False), np.float64)
    for dim in np.unique(n[n > 0]).tolist():
        rows = np.flatnonzero(n == dim)
        x = flat[starts[rows][:, None] + np.arange(dim)]
        most = np.abs(x).max(1)
        good = np.isfinite(x).all(1) & (most > 0)
        if good.any():
            yield rows[good], np.ldexp(x[good], -np.frexp(most[good])[1][:, None])


def _nodes(vectors: DataFrame, query: Column, k: int) -> tuple[DataFrame, DataFrame]:
    """The distinct vectors (node, fold, ids, query, embedding), and the queries (query_id, node, embedding)."""
    rows = vectors.where("vec_id is not null and embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(query, F.lit(False)).alias("query"))
    rows = rows.groupBy("vec_id", "embedding").agg(F.max("query").alias("query")).withColumn("node", F.xxhash64("embedding"))
    rows = staged(rows, "vectors")
    first = Window.partitionBy("node", "embedding").orderBy("vec_id")
    ids = rows.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= k + 1).groupBy("node", "embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asks = rows.where("query").select(F.col("vec_id").alias("query_id"), "node", "embedding")
    asked = asks.select("node").distinct().withColumn("query", F.lit(True))
    nodes = ids.join(asked, "node", "left").select("node", F.xxhash64("ids").alias("fold"), "ids", F.coalesce("query", F.lit(False)).alias("query"), "embedding")
    return staged(nodes, "nodes"), asks


def places(unit: np.ndarray, node: np.ndarray, ordering: int) -> np.ndarray:
    """Places of nodes in one ordering: by curve key, then by hash."""
    return curve_keys(unit, ordering) << _TIE_BITS | (node.astype(np.int64) >> (64 - _TIE_BITS)) & ((1 << _TIE_BITS) - 1)


def _units(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and unit vectors of a batch, by vector length, a few thousand at a time."""
    for lo in range(0, batch.num_rows, 2048):
        for rows, x in _lists(batch.column("embedding").slice(lo, 2048)):
            yield rows + lo, x / np.linalg.norm(x, axis=1, keepdims=True)


def _cuts(nodes: DataFrame, sizes: dict[int, Size], orderings: int) -> Cuts:
    """Where the orderings are cut into cells: quantiles of the places of all rows."""
    most = max(1, CELLS // max(1, len(sizes)))
    cells = {dim: max(1, min(most, size.rows // CELL_ROWS)) for dim, size in sizes.items()}
    cuts: Cuts = {(o, dim): np.empty(0, np.int64) for o in range(orderings) for dim in cells}
    fine = max(cells.values(), default=1)
    large = [dim for dim, c in cells.items() if c > 1]
    if not large:
        return cuts

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column("node").to_numpy()
            for rows, unit in _units(batch):
                at = [places(unit, node[rows], o) for o in range(orderings)]
                each = [np.repeat(np.arange(orderings, dtype=np.int32), len(rows)), np.full(orderings * len(rows), unit.shape[1], np.int32), np.concatenate(at)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in each], names=["ordering", "dim", "place"])

    rows = nodes.where(F.size("embedding").isin(large)).select("node", "embedding").mapInArrow(placed, "ordering int, dim int, place long")
    quantiles = F.percentile_approx("place", [i / fine for i in range(1, fine)], 10 * fine).alias("at")
    for r in rows.groupBy("ordering", "dim").agg(quantiles).collect():
        c = cells[r["dim"]]
        cuts[r["ordering"], r["dim"]] = np.array(r["at"], np.int64)[np.arange(1, c) * fine // c - 1]
    return cuts


def _true_pairs(nodes: DataFrame, k: int, sample: int) -> list[tuple[int, np.ndarray, int, np.ndarray]]:
    """Sampled queries and their k exact neighbours among all rows: node and vector of both."""
    asked = nodes.where("query").orderBy(F.xxhash64("node"), "node").limit(sample).select("node", "fold", "embedding").collect()
    if not asked:
        return []
    table = pa.table({"embedding": pa.array([r["embedding"] for r in asked], pa.list_(pa.float64()))}).combine_chunks().to_batches()[0]
    own = {unit.shape[1]: (rows, unit.astype(np.float32)) for rows, unit in _whole_units(table)}
    folds = np.array([r["fold"] for r in asked])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        for batch in batches:
            node, fold = batch.column("node").to_numpy(), batch.column("fold").to_numpy()
            for rows, unit in _units(batch):
                if unit.shape[1] in own:
                    at, q = own[unit.shape[1]]
                    i, j, score = top(q, folds[at], unit.astype(np.float32), fold[rows], k)
                    held = [np.concatenate(c) for c in zip(held, (at[i], node[rows[j]], score), strict=True)]
                    order = np.lexsort((-held[2], held[0]))
                    first = np.searchsorted(held[0][order], held[0][order])
                    held = [c[order[np.arange(len(order)) - first < k]] for c in held]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names=["ask", "node", "score"])

    found = nodes.select("node", "fold", "embedding").mapInArrow(nearest, "ask long, node long, score double")
    best = found.withColumn("_k", F.row_number().over(Window.partitionBy("ask").orderBy(F.col("score").desc(), "node"))).where(F.col("_k") <= k)
    # at most sample x k rows
    pairs = nodes.select("node", "embedding").join(F.broadcast(best.select("ask", "node")), "node").collect()
    return [(asked[r["ask"]]["node"], np.array(asked[r["ask"]]["embedding"]), r["node"], np.array(r["embedding"])) for r in pairs]


def _whole_units(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(rows, x / np.linalg.norm(x, axis=1, keepdims=True)) for rows, x in _lists(batch.column("embedding"))]


def _reaches(pairs: list[tuple[int, np.ndarray, int, np.ndarray]], cuts: Cuts, orderings: int, target: float) -> dict[int, Reach]:
    """By vector length, the cells that queries must look at so that ``target`` of the pairs meet along some curve.

    A length of which no query was sampled is looked at as a whole.
    """
    out = {}
    for dim in {d for _, d in cuts}:
        cells = len(cuts[0, dim]) + 1
        own = [p for p in pairs if len(p[1]) == dim]
        reach = cells
        if own and cells > 1:
            a, x = (np.array([p[0] for p in own]), np.stack([p[1] for p in own])), (np.array([p[2] for p in own]), np.stack([p[3] for p in own]))
            cell = [[np.searchsorted(cuts[o, dim], places(v / np.linalg.norm(v, axis=1, keepdims=True), node, o), "right") for node, v in (a, x)] for o in range(orderings)]
            apart = np.min([np.abs(i - j) for i, j in cell], axis=0)
            reach = max(1, int(np.quantile(apart, target, method="higher")))
        out[dim] = Reach(reach, max(1, -(-min(reach, cells) // 2)))
    return out


def share(reach: Reach, cells: int) -> float:
    """The share of the rows that one ordering shows to a query, on average."""
    return min(1.0, (2 * reach.cells + reach.block) / cells)


def _plan(nodes: DataFrame, k: int, orderings: int, target: float) -> tuple[int, dict[int, Size], Cuts, dict[int, Reach]]:
    """How many orderings are taken, rows and queries by vector length, cuts and reaches."""
    counts = nodes.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("rows"), F.count_if("query").alias("asks"))
    sizes = {r["dim"]: Size(r["rows"], r["asks"]) for r in counts.where("dim > 0").collect()}
    cuts = _cuts(nodes, sizes, orderings)
    pairs = _true_pairs(nodes, k, SAMPLE) if any(map(len, cuts.values())) else []
    tried = {o: _reaches(pairs, cuts, o, target) for o in {min(orderings, t) for t in (4, 8, orderings)}}

    def work(o: int) -> float:
        return o * sum(size.rows * (DEAL_COST + size.asks * share(tried[o][dim], len(cuts[0, dim]) + 1)) for dim, size in sizes.items())

    taken = min(sorted(tried), key=work)
    return taken, sizes, cuts, tried[taken]


def _dealt(nodes: DataFrame, orderings: int, sizes: dict[int, Size], cuts: Cuts, reach: dict[int, Reach]) -> DataFrame:
    """Every row in its block of every ordering, and the queries in all blocks that their windows touch."""
    grid = {}
    for dim, r in reach.items():
        rows = -(-sizes[dim].rows * r.block // (len(cuts[0, dim]) + 1))
        # a block meets the queries of fewer than eight blocks
        grid[dim] = max(1, -(-rows // BLOCK_ROWS)), max(1, -(-min(sizes[dim].asks, 8 * rows) // BLOCK_ASKS))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, query = batch.column("node").to_numpy(), batch.column("query").to_numpy(zero_copy_only=False)
            for rows, unit in _units(batch):
                dim = unit.shape[1]
                half = pa.array([v.tobytes() for v in unit.astype(np.float16)], pa.binary())
                by_row, by_ask = grid[dim]
                deal = node[rows]
                asking = np.flatnonzero(query[rows])
                for o in range(orderings):
                    cell = np.searchsorted(cuts[o, dim], places(unit, deal, o), "right")
                    last = len(cuts[o, dim]) // reach[dim].block
                    lo = np.maximum(cell - reach[dim].cells, 0) // reach[dim].block
                    hi = np.minimum((cell + reach[dim].cells) // reach[dim].block, last)
                    for j in range(by_ask):
                        yield named(o, dim, np.arange(len(rows)), cell // reach[dim].block, deal % by_row * by_ask + j, False, batch, rows, half)
                    if len(asking):
                        for step in range(int((hi - lo)[asking].max()) + 1):
                            to = asking[lo[asking] + step <= hi[asking]]
                            for i in range(by_row):
                                yield named(o, dim, to, lo + step, i * by_ask + deal % by_ask, True, batch, rows, half)

    def named(o: int, dim: int, at: np.ndarray, block: np.ndarray, slice_: np.ndarray, ask: bool, batch: pa.RecordBatch, rows: np.ndarray, half: pa.Array) -> pa.RecordBatch:
        take = pa.array(rows[at])
        whole = [np.full(len(at), o, np.int32), np.full(len(at), dim, np.int32), block[at].astype(np.int32), slice_[at].astype(np.int32), np.full(len(at), ask)]
        columns = [*map(pa.array, whole), batch.column("node").take(take), batch.column("fold").take(take), half.take(pa.array(at))]
        return pa.RecordBatch.from_arrays(columns, names=[*_BLOCK, "ask", "node", "fold", "vector"])

    return nodes.select("node", "fold", "query", "embedding").mapInArrow(dealt, _DEALT)


def _met(keep: int):
    """What a block does: its queries meet its rows, and each keeps its nearest."""

    def met(t: pa.Table) -> pa.Table:
        ask = t.column("ask").to_numpy()
        node, fold = t.column("node").to_numpy(), t.column("fold").to_numpy()
        at, rows = np.flatnonzero(ask), np.flatnonzero(~ask)
        i = j = np.empty(0, np.int64)
        score = np.empty(0)
        if len(at) and len(rows):
            i, j, score = top(_matrix(t.take(at)), fold[at], _matrix(t.take(rows)), fold[rows], keep)
        columns = [node[at][i], node[rows][j], fold[rows][j], score.astype(np.float64)]
        return pa.table(dict(zip(("query_node", "node", "fold", "score"), map(pa.array, columns), strict=True)))

    return met


def top(q: np.ndarray, q_fold: np.ndarray, x: np.ndarray, fold: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in q and in x, and cosines, of the k nearest rows of x for each row of q, by falling cosine.

    Of rows with an equal fold only the nearest counts, so repeats crowd out nothing; rows
    with a query's own fold are left out.
    """
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    by_fold = np.argsort(fold, kind="stable")
    heads = np.flatnonzero(np.concatenate(([True], fold[by_fold][1:] != fold[by_fold][:-1])))
    out = []
    step = max(1, min(256, 2**21 // max(1, len(fold))))
    for lo in range(0, len(q), step):
        part = q[lo : lo + step]
        s = (part / np.linalg.norm(part, axis=1, keepdims=True)) @ u.T
        s[q_fold[lo : lo + step, None] == fold] = -np.inf
        s = s[:, by_fold]
        each = s if len(heads) == len(fold) else np.maximum.reduceat(s, heads, axis=1)
        pick = np.argpartition(-each, k - 1, axis=1)[:, :k] if each.shape[1] > k else np.tile(np.arange(each.shape[1]), (len(part), 1))
        score = np.take_along_axis(each, pick, 1)
        order = np.argsort(-score, axis=1, kind="stable")
        pick, score = np.take_along_axis(pick, order, 1), np.take_along_axis(score, order, 1)
        row, col = np.nonzero(score > -np.inf)
        at = pick[row, col]
        if len(heads) == len(fold):
            where = at
        else:
            ends = np.append(heads[1:], len(fold))
            where = np.array([heads[a] + int(np.argmax(s[r, heads[a] : ends[a]])) for r, a in zip(row, at, strict=True)], np.int64)
        out.append((row + lo, by_fold[where], score[row, col]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def _matrix(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("vector").to_pylist()), np.float16).reshape(t.num_rows, -1).astype(np.float32)


def _cosines(met: DataFrame) -> DataFrame:
    """query_id, ids and the cosine of q and x in double precision."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.full(batch.num_rows, np.nan)
            own = {d: (r, v) for r, v in _lists(batch.column("q")) for d in [v.shape[1]]}
            for rows, x in _lists(batch.column("x")):
                at, q = own.get(x.shape[1], (np.empty(0, np.int64), x[:0]))
                both, i, j = np.intersect1d(rows, at, return_indices=True)
                score[both] = (x[i] * q[j]).sum(1) / (np.sqrt((x[i] * x[i]).sum(1)) * np.sqrt((q[j] * q[j]).sum(1)))
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("ids"), pa.array(score)], names=["query_id", "ids", "score"])

    return met.select("query_id", "ids", "q", "x").mapInArrow(measured, "query_id long, ids array<long>, score double").where(~F.isnan("score"))


def search(vectors: DataFrame, query: Column, k: int = 5, *, orderings: int = ORDERINGS, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for the rows where ``query`` holds.

    At most ``orderings`` curves are taken; ``target`` is the recall that their windows are set for.
    """
    nodes, asks = _nodes(vectors, query, k)
    taken, sizes, cuts, reach = _plan(nodes, k, orderings, target)
    keep = 2 * k
    found = _dealt(nodes, taken, sizes, cuts, reach).groupBy(*_BLOCK).applyInArrow(_met(keep), _FOUND)
    each = found.groupBy("query_node", "fold").agg(F.max_by("node", F.struct("score", "node")).alias("node"), F.max("score").alias("score"))
    near = Window.partitionBy("query_node").orderBy(F.col("score").desc(), "node")
    chosen = each.withColumn("_k", F.row_number().over(near)).where(F.col("_k") <= keep).select("query_node", "node")
    # a query's own vector may have other ids
    chosen = staged(chosen.unionByName(asks.select(F.col("node").alias("query_node"), "node").distinct()), "candidates")
    x = chosen.join(nodes.select("node", "ids", F.col("embedding").alias("x")), "node").select("query_node", "ids", "x")
    met = asks.select("query_id", F.col("node").alias("query_node"), F.col("embedding").alias("q")).join(x, "query_node")
    scored = _cosines(met).select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    best = scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
