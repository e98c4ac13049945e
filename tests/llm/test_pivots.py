"""Hard negatives against all pairs, and the brackets against true scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rostra.llm import pivots

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=5):
    own = {}
    for i, v, y in rows:
        if i is None or y is None or v is None or any(x is None or not np.isfinite(np.float32(x)) for x in v):
            continue
        y = (y + 1) % 10 if i % 7 == 0 else y
        x = tuple(int(np.floor(256 * float(np.float32(c)))) for c in v)
        own[i] = min(own.get(i, (y, x)), (y, x))
    out = []
    for a, (label, q) in own.items():
        if a % 100:
            continue
        scored = sorted(((-sum(s * t for s, t in zip(q, x, strict=True)), i, y) for i, (y, x) in own.items() if i != a and len(x) == len(q)))
        for p, i, _ in [s for s in scored if s[2] == label][:k]:
            near = [(s, j) for s, j, y in scored if y != label and 80 * -p <= 100 * -s <= 100 * -p][:k]
            out += [(a, i, n + 1, j, -p, -s) for n, (s, j) in enumerate(near)]
    return sorted(out)


def table(kind, n=1500, dim=8, seed=2):
    rng = np.random.default_rng(seed)
    if kind == "clusters":
        centres = rng.normal(size=(12, dim)) * 3
        x = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, dim)) * 0.1
    elif kind == "ties":
        x = rng.integers(-1, 2, size=(n, dim)) / 4
    else:
        x = rng.normal(size=(n, dim)) / dim**0.5
    return [(i, [float(c) for c in v], int(rng.integers(0, 10))) for i, v in enumerate(x)]


AWKWARD = [
    (None, [1.0] * 8, 1), (5000, None, 1), (5100, [1.0] * 8, None), (5200, [None] + [1.0] * 7, 2), (5300, [float("nan")] * 8, 2), (5400, [float("inf")] * 8, 2),
    (5500, [0.0] * 8, 3), (5600, [], 4), (5601, [], 4), (5602, [], 5), (5700, [0.5] * 3, 4), (5701, [0.25] * 3, 4), (5702, [0.2] * 3, 5), (5800, [0.1] * 8, 6), (5800, [0.1] * 8, 6), (5800, [0.2] * 8, 6), (5900, [-0.7] * 8, 7),
]


@pytest.mark.parametrize("kind", ["clusters", "ties", "isotropic"])
def test_equals_all_pairs(spark, kind):
    rows = table(kind) + AWKWARD
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for c in ("id", "dim", "near", "far", "vector", "row", "chunk", "score"):
        df = df.withColumn(c, F.lit("clash"))
    got = pivots.from_embeddings(df, block_rows=128, chunk=7, sample=300)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_one_vector_for_a_third_of_the_rows(spark):
    rows = [(i, v if i % 3 else [0.5] * 8, y) for i, v, y in table("isotropic", 900)]
    got = pivots.from_embeddings(spark.createDataFrame(rows, SCHEMA), block_rows=100)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_no_rows_and_no_anchors(spark):
    assert pivots.from_embeddings(spark.createDataFrame([], SCHEMA)).collect() == []
    assert pivots.from_embeddings(spark.createDataFrame([(1, [0.5], 1)], SCHEMA)).collect() == []


def known(kind):
    x = np.floor(256 * np.array([v for _, v, _ in table(kind, 600)]))
    largest = float((x**2).sum(1).max())
    y = pivots.augmented(x, largest)
    p = pivots.far_apart(y, 16)
    q = pivots.Anchors(np.arange(20), np.zeros(20), x[:20], largest, p)
    return x, q, pivots.distances(y, p)


@pytest.mark.parametrize("kind", ["clusters", "ties", "isotropic"])
def test_brackets_hold_the_scores(kind):
    x, q, far = known(kind)
    true, a = x[:20] @ x.T, np.arange(20)
    assert (q.lower(a, far) <= true).all() and (true <= q.upper(a, far)).all()
    least, most = q.block_bounds(far[100:200].min(0), far[100:200].max(0))
    assert (least[:, None] <= true[:, 100:200]).all() and (true[:, 100:200] <= most[:, None]).all()


def test_brackets_exclude_most_rows_of_clustered_tables():
    x, q, far = known("clusters")
    floor = np.sort(x[:20] @ x.T, 1)[:, -6]
    assert (q.upper(np.arange(20), far) >= floor[:, None]).mean() < 0.2


def test_products_are_exact_at_every_size():
    for most in (2, 2**12, 2**25, 2**29):
        a = np.random.default_rng(1).integers(-most, most, (5, 8)).astype(float)
        b = [[sum(int(s) * int(t) for s, t in zip(r, c, strict=True)) for c in a] for r in a]
        assert pivots.product(a, a).tolist() == b
    with pytest.raises(ValueError):
        pivots.product(np.full((1, 8), 2.0**40), np.full((1, 8), 2.0**40))
