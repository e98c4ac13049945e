"""Hard-negative mining with a pivot table.

Every vector x gets one component more, the root of M - |x|^2, where M is the largest squared
norm of the table; anchors get 0 there. The Euclidean distance d of an anchor q to a row x is
then |q|^2 + M - 2 q.x squared, so a large inner product is a small distance. The table stores each
row's distances to ``PIVOTS`` pivots, chosen far from one another in a bounded sample. By the
triangle inequality they bracket d, and with it the inner product, from both sides: rows that
cannot be among an anchor's best positives, or whose scores cannot fall into any of its windows,
are left out unseen; those that survive are checked by the exact integer product.

Rows are ordered by their nearest pivot and their distance to it and written as blocks with
the range of each pivot's distances, so that whole blocks go by the same test. Anchors are
a stated part of the rows; they are taken in chunks of ``CHUNK``, whose vectors alone are broadcast, so the
broadcast has a fixed size. Tasks keep a few candidates for each anchor, and these
alone are shuffled. Where distances are nearly equal, as between random directions, brackets
exclude little and most rows are checked exactly, block by block: nothing is lost then but time.

Defined results: rows with a null id or label, a null vector, or a component that is null, not
finite or of 2^53 or more take no part; rows that repeat an id count once, as that with the smallest label and vector;
vectors of different lengths never meet; scores that a long cannot hold are an error. Higher
scores come first, ties by smaller id. Anchors with fewer rows of their label or in a window get
those that are there. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostra.llm.common import shared_dir, staged

PIVOTS, SAMPLE, BLOCK_ROWS, CHUNK = 16, 4096, 4096, 4096
_BLOCK = "dim int, n int, ids binary, labels binary, vectors binary, distances binary"
_POSITIVE = "anchor_id long, positive_id long, positive_score long"
_NEGATIVE = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"


def usable(df: DataFrame, id_column: str, label: str | Column, vector: str | Column) -> DataFrame:
    """(id, label, vector) of the rows that take part, one for each id; vectors hold whole numbers."""
    rows = df.select(F.col(id_column).cast("long").alias("id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"), (F.col(vector) if isinstance(vector, str) else vector).alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < 2.0**53))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & fine)
    rows = rows.select("id", F.struct("label", F.transform("vector", lambda x: x.cast("double")).alias("vector")).alias("row"))
    return rows.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.label", "row.vector")


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of whole numbers held as doubles, rows of a by rows of b."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.sqrt((a**2).sum(1).max(initial=0) * (b**2).sum(1).max(initial=0)))
    if most < 2**23:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < 2**52:
        return (a @ b.T).astype(np.int64)
    if most >= 2**62:
        raise ValueError("scores are too large for a long")
    return a.astype(np.int64) @ b.astype(np.int64).T


def augmented(x: np.ndarray, largest: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(largest - (x**2).sum(1), 0))])


def far_apart(x: np.ndarray, n: int) -> np.ndarray:
    """n rows, each the farthest from those before it, from the largest on; fewer if there are fewer."""
    if not len(x):
        return x
    at = [int(np.argmax((x**2).sum(1)))]
    near = ((x - x[at[0]]) ** 2).sum(1)
    while len(at) < n and near.max() > 0:
        at.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[at[-1]]) ** 2).sum(1))
    return x[at]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in pivots], 1)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def table(rows: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, dict[int, tuple[float, np.ndarray]]]:
    """The blocks of the pivot table, and for each length of vectors M and the pivots."""
    spark = rows.sparkSession
    largest = {r["dim"]: float(r["m"]) for r in rows.groupBy(F.size("vector").alias("dim")).agg(F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).collect()}
    # a fixed number of rows, whatever the size of the table
    near = Window.partitionBy("dim").orderBy("h", "id")
    picked = rows.select(F.size("vector").alias("dim"), F.xxhash64("id").alias("h"), "id", "vector").withColumn("k", F.row_number().over(near)).where(F.col("k") <= sample)
    held: dict[int, list] = {}
    for r in picked.select("dim", "vector").collect():
        held.setdefault(r["dim"], []).append(r["vector"])
    known = {d: (m, far_apart(augmented(np.array(held[d], float).reshape(len(held[d]), d), m), pivots)) for d, m in largest.items()}
    shared = spark.sparkContext.broadcast(known)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = pa.compute.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                m, p = shared.value[int(d)]
                far = distances(augmented(_matrix(part.column(2), int(d)), m), p)
                near = far.argmin(1)
                columns = [pa.array(np.full(len(far), d, np.int32)), pa.array(near.astype(np.int32)), pa.array(far[np.arange(len(far)), near]), part.column(0), part.column(1), part.column(2), pa.array([r.tobytes() for r in far], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["dim", "near", "far", "id", "label", "vector", "distances"])

    kinds = "dim int, near int, far double, id long, label long, vector array<double>, distances binary"
    n = rows.count()
    keys = ["dim", "near", "far", "id"]
    dealt = rows.select("id", "label", "vector").mapInArrow(place, kinds).repartitionByRange(min(max(1, -(-n // block_rows)), 65_536), *keys).sortWithinPartitions(*keys)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []

        def cut(final: bool) -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(rest).combine_chunks()
            dims = whole.column("dim").to_numpy()
            while len(whole) >= (1 if final else 2 * block_rows):
                k = min(block_rows, int((dims == dims[0]).sum()))
                part, whole, dims = whole.slice(0, k), whole.slice(k), dims[k:]
                vectors = part.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
                far = b"".join(part.column("distances").to_pylist())
                values = [int(part.column("dim")[0].as_py()), k, part.column("id").to_numpy().tobytes(), part.column("label").to_numpy().tobytes(), vectors.astype(np.int64).tobytes(), far]
                yield pa.RecordBatch.from_pylist([dict(zip(names, values, strict=True))], schema=schema)
            rest[:] = whole.to_batches()

        names = [x.split()[0] for x in _BLOCK.split(", ")]
        schema = pa.schema([("dim", pa.int32()), ("n", pa.int32()), *[(x, pa.binary()) for x in names[2:]]])
        for batch in batches:
            rest.append(batch)
            if sum(map(len, rest)) >= 2 * block_rows:
                yield from cut(False)
        if sum(map(len, rest)):
            yield from cut(True)

    return staged(dealt.mapInArrow(block, _BLOCK), "pivots"), known


class Anchors:
    """Anchors of one length with their distances to the pivots; what tasks test blocks against."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, largest: float, pivots: np.ndarray):
        self.ids, self.labels, self.x, self.largest = ids, labels, x, largest
        self.norm = (x**2).sum(1)
        self.far = distances(np.column_stack([x, np.zeros(len(x))]), pivots)
        self.slack = 1 + 1e-9 * (self.norm + largest)

    def score(self, squared: np.ndarray, a: np.ndarray) -> np.ndarray:
        return (self.norm[a, None] + self.largest - squared) / 2

    def block_bounds(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and largest scores that a block can hold, from the range of its distances to each pivot."""
        apart = np.maximum(np.maximum(low - self.far, self.far - high), 0).max(1)
        near = (self.far + high).min(1)
        a = np.arange(len(self.ids))
        return self.score((near**2)[:, None], a)[:, 0] - self.slack, self.score((apart**2)[:, None], a)[:, 0] + self.slack

    def upper(self, a: np.ndarray, far: np.ndarray) -> np.ndarray:
        """The largest scores that rows at these distances can have."""
        apart = np.zeros((len(a), len(far)))
        for k in range(far.shape[1]):
            np.maximum(apart, np.abs(self.far[a, k, None] - far[None, :, k]), out=apart)
        return self.score(apart**2, a) + self.slack[a, None]

    def lower(self, a: np.ndarray, far: np.ndarray) -> np.ndarray:
        near = np.full((len(a), len(far)), np.inf)
        for k in range(far.shape[1]):
            np.minimum(near, self.far[a, k, None] + far[None, :, k], out=near)
        return self.score(near**2, a) - self.slack[a, None]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for dim, n, ids, labels, vectors, far in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield dim, np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64), np.frombuffer(vectors, np.int64).reshape(n, dim).astype(float), np.frombuffer(far, float).reshape(n, -1)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: higher scores, then smaller ids."""
    if len(scores) > 8 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= floor)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


#: Anchors that a task holds scores of at once.
_SLICE = 512


def _positives(found: dict[int, Anchors], k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {d: [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in a.ids] for d, a in found.items()}
        floor = {d: np.full(len(a.ids), -np.inf) for d, a in found.items()}
        for dim, ids, labels, x, far in _blocks(batches):
            if dim not in found:
                continue
            q = found[dim]
            _, most = q.block_bounds(far.min(0), far.max(0))
            open_ = np.flatnonzero((most >= floor[dim]) & np.isin(q.labels, labels))
            for s in range(0, len(open_), _SLICE):
                a = open_[s : s + _SLICE]
                survives = (q.upper(a, far) >= floor[dim][a, None]) & (q.labels[a, None] == labels) & (q.ids[a, None] != ids)
                rows = np.flatnonzero(survives.any(0))
                scores = product(q.x[a], x[rows])
                for i, j in enumerate(a):
                    own = np.flatnonzero(survives[i, rows])
                    if len(own):
                        names, values = np.concatenate([best[dim][j][0], ids[rows[own]]]), np.concatenate([best[dim][j][1], scores[i, own]])
                        top = _best(values, names, k)
                        best[dim][j] = names[top], values[top]
                        if len(top) == k:
                            floor[dim][j] = values[top[-1]]
        for d, lists in best.items():
            anchor = np.repeat(found[d].ids, [len(n) for n, _ in lists])
            if len(anchor):
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(np.concatenate([n for n, _ in lists])), pa.array(np.concatenate([v for _, v in lists]))], names=["anchor_id", "positive_id", "positive_score"])

    return run


def _negatives(found: dict[int, Anchors], windows: dict[int, tuple[np.ndarray, np.ndarray]], k: int, share: tuple[int, int]) -> Callable:
    """``windows``: of each anchor the ids and scores of its positives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        bounds = {}
        for d, q in found.items():
            # a window of a negative positive score is empty, whatever the share
            high = np.array([max((int(x) for x in windows[int(i)][1]), default=-1) if int(i) in windows else -1 for i in q.ids])
            low = np.array([min((int(x) for x in windows[int(i)][1] if x >= 0), default=0) if int(i) in windows else 0 for i in q.ids])
            bounds[d] = low * share[0] / share[1], high
        for dim, ids, labels, x, far in _blocks(batches):
            if dim not in found:
                continue
            q = found[dim]
            low, high = bounds[dim]
            least, most = q.block_bounds(far.min(0), far.max(0))
            open_ = np.flatnonzero((high >= 0) & (most >= low) & (least <= high))
            for s in range(0, len(open_), _SLICE):
                a = open_[s : s + _SLICE]
                survives = (q.labels[a, None] != labels) & (q.ids[a, None] != ids) & (q.upper(a, far) >= low[a, None]) & (q.lower(a, far) <= high[a, None])
                rows = np.flatnonzero(survives.any(0))
                scores = product(q.x[a], x[rows])
                fits = survives[:, rows] & (scores * share[1] >= low[a, None] * share[1] - 1) & (scores <= high[a, None])
                for i, j in enumerate(a):
                    own = np.flatnonzero(fits[i])
                    if not len(own):
                        continue
                    names, values = ids[rows[own]], scores[i, own]
                    for pid, score in zip(*windows[int(q.ids[j])], strict=True):
                        ok = (share[0] * int(score) <= share[1] * values) & (values <= score)
                        if ok.any():
                            had = best.get((int(q.ids[j]), int(pid)), (names[:0], values[:0]))
                            n2, v2 = np.concatenate([had[0], names[ok]]), np.concatenate([had[1], values[ok]])
                            top = _best(v2, n2, k)
                            best[int(q.ids[j]), int(pid)] = n2[top], v2[top]
        score_of = {(int(i), int(p)): int(v) for i, (ps, vs) in windows.items() for p, v in zip(ps, vs, strict=True)}
        rows_ = [(i, p, int(n), score_of[i, p], int(v)) for (i, p), (ns, vs) in best.items() for n, v in zip(ns, vs, strict=True)]
        if rows_:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows_, strict=True)], names=[x.split()[0] for x in _NEGATIVE.split(", ")])

    return run


def _first(df: DataFrame, keys: list[str], score: str, name: str, k: int) -> DataFrame:
    """The first k rows of each key, numbered by ``rank``."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), name)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: Column, k: int = 5, share: tuple[int, int] = (80, 100), pivots: int = PIVOTS, sample: int = SAMPLE, block_rows: int = BLOCK_ROWS, chunk: int = CHUNK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows (id, label, vector) of :func:`usable`.

    ``anchors`` is a condition on them. A negative of a positive has another label than the anchor and a
    score from ``share[0] / share[1]`` of the positive's up to it.
    """
    spark = rows.sparkSession
    rows = staged(rows, "vectors")
    held, known = table(rows, pivots, sample, block_rows)
    asked = rows.where(anchors)
    # anchors in chunks of a fixed size, dealt by a hash, so that a chunk needs no sort of all
    chunks = max(1, -(-asked.count() * 5 // (chunk * 4)))
    asked = staged(asked.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks))), "anchors")
    out = f"{shared_dir(spark).rstrip('/')}/rostra-mined-{uuid.uuid4().hex}"
    final = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], final).write.parquet(f"{out}/chunk=-1")
    for c in range(chunks):
        mine_ = asked.where(F.col("chunk") == c).select("id", "label", "vector").collect()
        found = {}
        for dim in {len(r["vector"]) for r in mine_}:
            own = [r for r in mine_ if len(r["vector"]) == dim]
            m, p = known[dim]
            found[dim] = Anchors(np.array([r["id"] for r in own], np.int64), np.array([r["label"] for r in own], np.int64), np.array([r["vector"] for r in own], float).reshape(len(own), dim), m, p)
        if not found:
            continue
        positives = _first(held.mapInArrow(_sent(spark, _positives, found, k), _POSITIVE), ["anchor_id"], "positive_score", "positive_id", k)
        windows: dict[int, tuple[list, list]] = {}
        for r in positives.collect():  # at most k for each anchor of the chunk
            w = windows.setdefault(r["anchor_id"], ([], []))
            w[0].append(r["positive_id"])
            w[1].append(r["positive_score"])
        near = held.mapInArrow(_sent(spark, _negatives, found, windows, k, share), _NEGATIVE)
        _first(near, ["anchor_id", "positive_id"], "negative_score", "negative_id", k).select(*[x.split()[0] for x in final.split(", ")]).write.parquet(f"{out}/chunk={c}")
    return spark.read.schema(final + ", chunk int").parquet(out).drop("chunk")


def _sent(spark, make: Callable, *values) -> Callable:
    """A function for tasks made from broadcast values."""
    sent = spark.sparkContext.broadcast(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return make(*sent.value)(batches)

    return run


def scaled(vector: str) -> Column:
    """A vector as whole numbers: 256 times each component, rounded down."""
    return F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double")))


def from_embeddings(df: DataFrame, id_column: str = "vec_id", label: str = "label", vector: str = "embedding", **settings) -> DataFrame:
    """Negatives for the ids that 100 divides, with labels moved on by one where 7 divides the id."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    fine = df.where(F.col(vector).isNotNull() & finite)
    moved = F.when(F.col(id_column) % 7 == 0, (F.col(label) + 1) % 10).otherwise(F.col(label))
    return mine(usable(fine, id_column, moved, scaled(vector)), F.col("id") % 100 == 0, **settings)


ORACLE = """WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id AS other, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 5"""
