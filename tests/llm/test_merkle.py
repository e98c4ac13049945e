"""The manifest against a tree built from one list."""

import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rostra.llm import merkle
from rostra.llm.merkle import H, fold, levels, path

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def brute_force(rows, fanout):
    """The same rows from one list."""
    put = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = lambda s: s if s is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    own = defaultdict(list)
    for r in rows:
        tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        own[r[1]].append((r[0], H([put(x) for x in r]), H([put(x) for x in (*r[:4], low(r[4]))]) if tampered else None))
    order = sorted(own, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        own[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {s: levels([x[1] for x in own[s]], fanout) for s in order}
    above = levels([trees[s][-1][0] for s in order], fanout)
    root, out = above[-1][0], []
    for k, s in enumerate(order):
        for i, (doc, leaf, other) in enumerate(own[s]):
            steps = path(trees[s], i, fanout) + path(above, k, fanout)
            folded = fold(other or leaf, steps)
            out.append((doc, leaf, trees[s][-1][0], root, H([u + v for u, v in steps]), folded, folded == root))
    return out


def manifest(df, **settings):
    marked = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return merkle.manifest(df, COLUMNS, "source", "doc_id", F.when(marked, merkle.leaf([*COLUMNS[:-1], merkle.lowered("text")])), **settings)


def made(sizes, seed=1):
    rng = random.Random(seed)
    rows = [(i, s, rng.choice(["en", None]), rng.randrange(99), rng.choice(["Ab É" * rng.randrange(9), "lower only", None, ""])) for s, n in sizes.items() for i in rng.sample(range(100_000), n)]
    rng.shuffle(rows)
    return rows


AWKWARD = [(None, "a", "en", 1, "X"), (None, "a", "en", 1, "Y"), (7, "a", "en", 1, "X"), (7, "a", "en", 1, "X"), (7, None, None, None, None), (8, "", "", 0, ""), (9, "é", "e", 5, "A" * 300_000), (10, "zz", "e", 1, "q"), (11, "Z", "e", 1, "q")]


@pytest.mark.parametrize(
    "sizes, settings",
    [
        ({"a": 1}, {}),
        ({"a": 17, "b": 16, None: 1, "é": 33}, {}),
        ({"hot": 700, "b": 256, "c": 257, **{f"s{i}": i % 5 + 1 for i in range(40)}}, {"range_rows": 100}),
        # two to a run, blocks of four, three nodes at the top: many rounds down to groups, and of groups
        ({"hot": 150, "b": 4, "c": 5, "d": 16, **{f"s{i}": 1 for i in range(30)}}, {"fanout": 2, "depth": 2, "top": 3, "range_rows": 16}),
        ({"only": 70}, {"fanout": 3, "depth": 1, "top": 1, "range_rows": 9}),
    ],
)
def test_equals_a_tree_of_one_list(spark, sizes, settings):
    rows = made(sizes) + (AWKWARD if len(sizes) > 1 else [])
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for c in ("g", "p", "hash", "id", "changed", "nodes", "b", "leaf", "range", "k", "before", "root"):
        df = df.withColumn(c, F.lit("clash"))
    got = [tuple(r) for r in manifest(df, **settings).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(brute_force(rows, settings.get("fanout", 16)), key=key)


def test_only_changed_texts_fail(spark):
    rows = [(i, f"s{i % 3}", "en", 1, "Upper" if i % 2 else "lower") for i in range(100)]
    got = {r["doc_id"]: r["verified"] for r in manifest(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: not (i % 2 and zlib.crc32(str(i).encode()) % 5 == 0) for i in range(100)}


def test_no_rows(spark):
    out = manifest(spark.createDataFrame([], SCHEMA))
    assert out.collect() == [] and out.columns[0] == "doc_id"


def test_a_group_of_equal_rows_is_dealt_over_ranges(spark):
    df = spark.createDataFrame([("h", i % 2) for i in range(1000)], "g string, id int")
    got = merkle.placed(df, "g", ["id"], 100)
    assert sorted((r["id"], r["p"]) for r in got.collect()) == sorted([(i * 2 // 1000, i) for i in range(1000)])
    assert got.select("p").distinct().count() == 1000
