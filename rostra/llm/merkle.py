"""Merkle manifest of a dataset, and proofs for all of its rows.

Leaves are hashed where the rows are, by SQL functions; from there on only hashes travel. They
are sorted by range into (group, key) order, and as only the first group of a range can have
begun before it, a count for each range gives every leaf its place in its group, however many
rows a group has. Blocks of ``FANOUT ** LEVELS`` places are whole subtrees: distributed tasks
reduce each to one node. What is left, at most ``TOP`` nodes, is the top tree: the driver builds
it, and the path from each of its nodes to the root (the siblings before and after it on every
level) is broadcast; tasks then finish the proofs of their blocks and fold every row up to
the root again. While more than ``TOP`` nodes are left, they are reduced by blocks once more, first
within groups, then the groups' own roots, and the paths come down the same way by a join on blocks:
the broadcast never grows with the data.

Defined results: null columns hash as ``-``; a null group comes first, others follow bytewise; in a
group null keys come first, equal keys go by leaf, and equal leaves are leaves each; a group
of one leaf is its own root; a table without rows gives none. A text may have any length.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from rostra.llm.common import staged

FANOUT, LEVELS, TOP = 16, 3, 4096
#: Leaves of a range of the sort, and the most ranges, whose counts the driver adds up.
RANGE_ROWS, MOST_RANGES = 32_768, 16_384
_PATH = "array<struct<before:string,after:string>>"


def H(parts: Sequence[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def field(c: Column | str) -> Column:
    """A column as it is hashed: ``-``, or its count of bytes, ``:`` and its value."""
    text = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: Sequence[Column | str]) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def levels(hashes: list[str], fanout: int = FANOUT) -> list[list[str]]:
    """All levels from the hashes to their root."""
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([H(out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def block_levels(hashes: list[str], whole: bool, depth: int, fanout: int = FANOUT) -> list[list[str]]:
    """The levels of a block. A block that is all of its group ends at the group's root; of others all have ``depth`` levels, also one of a single node."""
    if whole:
        return levels(hashes, fanout)
    out = [hashes]
    for _ in range(depth):
        out.append([H(out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def path(tree: list[list[str]], i: int, fanout: int = FANOUT) -> list[tuple[str, str]]:
    """The siblings before and after node i of the lowest level, on each level below the root."""
    out = []
    for row in tree[:-1]:
        first = i - i % fanout
        out.append(("".join(row[first:i]), "".join(row[i + 1 : first + fanout])))
        i //= fanout
    return out


def fold(node: str, steps: Sequence[tuple[str, str]]) -> str:
    for before, after in steps:
        node = H((before, node, after))
    return node


def placed(rows: DataFrame, group: str, order: Sequence[str], range_rows: int) -> DataFrame:
    """``rows`` with ``p``, their place from 0 in their group, written to the shared folder.

    Rows are dealt by range, equal ones too; a range counts its rows by group in order. The
    counts of its groups that began in it need no other; only that of its first group is
    carried on, one number a range.
    """
    n = rows.count()
    names = rows.columns
    spread = rows.withColumn("_tie", F.monotonically_increasing_id())
    keys = [group, *order, "_tie"]
    dealt = spread.repartitionByRange(min(max(1, -(-n // range_rows)), MOST_RANGES), *keys).sortWithinPartitions(*keys).drop("_tie")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, at, first = TaskContext.get().partitionId(), None, 0, True
        for batch in batches:
            g = np.asarray(batch.column(batch.schema.get_field_index(group)).to_pylist(), object)
            if not len(g):
                continue
            change = np.append(True, g[1:] != g[:-1])
            if g[0] == last:
                change[0] = False
            elif last is not None:
                first, at = False, 0
            began = np.flatnonzero(change)
            place = np.arange(len(g))
            run = np.zeros(len(g), np.int64)
            run[began] = began
            place = place - np.maximum.accumulate(run) + np.where(np.cumsum(change) > change[0], 0, at)
            opening = np.full(len(g), first) & (g == g[0])
            first = first and len(began) <= int(change[0])
            last, at = g[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(g), part, np.int32)), pa.array(place.astype(np.int64)), pa.array(opening)], names=[*names, "range", "k", "opening"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    held = staged(dealt.mapInArrow(count, f"{kinds}, range int, k long, opening boolean"), "placed")
    # per range: its first and last group, and the rows of the last one; a few values a range
    ends = held.groupBy("range").agg(F.min(group).alias("low"), F.max(F.struct(group, "k")).alias("high")).orderBy("range").collect()
    carried, group_now, count_now = [], None, 0
    for r in ends:
        before = count_now if r["low"] == group_now else 0
        carried.append((r["range"], before))
        group_now, count_now = r["high"][group], r["high"]["k"] + 1 + (before if r["high"][group] == r["low"] else 0)
    offsets = rows.sparkSession.createDataFrame(carried, "range int, before long")
    place = F.col("k") + F.when(F.col("opening"), F.col("before")).otherwise(0)
    return held.join(F.broadcast(offsets), "range").select(*names, place.alias("p"))


def blocks(nodes: DataFrame, size: int, *carried: str) -> DataFrame:
    """(g, b, nodes): the nodes (g, p, hash) of each block in order; a block has at most ``size`` of them."""
    one = F.struct("p", "hash", *carried)
    return staged(nodes.groupBy("g", F.expr(f"p div {size}").alias("b")).agg(F.array_sort(F.collect_list(one)).alias("nodes")), "blocks")


def _whole(b: int, n: int, size: int) -> bool:
    """Whether a block is all of its group; one that is full may be as well, with the same result."""
    return b == 0 and n < size


def roots(held: DataFrame, fanout: int, depth: int) -> DataFrame:
    """(g, p, hash): the node that each block comes down to."""
    size = fanout**depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [block_levels(h, _whole(b, len(h), size), depth, fanout)[-1][0] for b, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["g", "p", "hash"])

    return held.select("g", "b", "nodes.hash").mapInArrow(run, "g string, p long, hash string")


def top_tree(rows: Sequence[tuple[str, int, str]], grouped: bool, fanout: int = FANOUT) -> tuple[str, dict]:
    """Root, and of each node (group, place) the group's root and the path to the root of all."""
    own = defaultdict(list)
    for g, p, h in sorted(rows):
        own[g].append((p, h))
    trees = {g: levels([h for _, h in x], fanout) for g, x in own.items()}
    above = levels([t[-1][0] for t in trees.values()], fanout)
    found = {}
    for k, (g, tree) in enumerate(trees.items()):
        rest = path(above, k, fanout) if grouped else []
        found |= {(g, p): (tree[-1][0], path(tree, i, fanout), rest) for i, (p, _) in enumerate(own[g])}
    return above[-1][0], found


def upper(held: DataFrame, grouped: bool, fanout: int, depth: int, top: int, range_rows: int) -> tuple[str, dict | None, DataFrame | None]:
    """Root, and for each block (g, b) of ``held`` its group's root and its path to the root.

    Up to ``top`` blocks: as a dict, built by the driver, to be broadcast. Beyond: as a
    table (g, b, subroot, up, over), ``up`` being the path to the group's root and ``over`` that from there.
    """
    spark = held.sparkSession
    nodes = staged(roots(held, fanout, depth), "nodes")
    n, highest = nodes.agg(F.count(F.lit(1)), F.max("p")).first()
    if n <= top:
        root, found = top_tree([tuple(r) for r in nodes.select("g", "p", "hash").collect()], grouped, fanout)
        return root, found, None
    if highest == 0:
        # every group has come down to its root: these are one group now
        ranked = placed(nodes.select(F.lit("").alias("one"), "g", "hash"), "one", ["g"], range_rows)
        above = blocks(ranked.select(F.col("one").alias("g"), "p", "hash", F.col("g").alias("of")), fanout**depth, "of")
        root, found, table = upper(above, False, fanout, depth, top, range_rows)
        down = _descend(above, found, table, fanout, depth)
        return root, None, down.select(F.col("item.of").alias("g"), F.lit(0).cast("long").alias("b"), F.col("item.hash").alias("subroot"), F.array().cast(_PATH).alias("up"), F.concat("path", "up", "over").alias("over"))
    above = blocks(nodes, fanout**depth)
    root, found, table = upper(above, grouped, fanout, depth, top, range_rows)
    down = _descend(above, found, table, fanout, depth)
    return root, None, down.select("g", F.col("item.p").alias("b"), "subroot", F.concat("path", "up").alias("up"), "over")


def _descend(held: DataFrame, found: dict | None, table: DataFrame | None, fanout: int, depth: int) -> DataFrame:
    """(g, item, path, subroot, up, over): every node of the blocks with its path inside the block and what is known of the block."""
    size = fanout**depth
    item = held.schema["nodes"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, b, nodes in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
                tree = block_levels([x["hash"] for x in nodes], _whole(b, len(nodes), size), depth, fanout)
                steps = [[{"before": u, "after": v} for u, v in path(tree, i, fanout)] for i in range(len(nodes))]
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(nodes), pa.string()), pa.array([b] * len(nodes), pa.int64()), pa.array(nodes, batch.schema.field(2).type.value_type), pa.array(steps, _arrow_path())], names=["g", "b", "item", "path"])

    inside = held.select("g", "b", "nodes").mapInArrow(run, f"g string, b long, item {item}, path {_PATH}")
    if table is None:
        rows = [(g, b, s, [{"before": u, "after": v} for u, v in up], [{"before": u, "after": v} for u, v in over]) for (g, b), (s, up, over) in found.items()]
        table = F.broadcast(held.sparkSession.createDataFrame(rows, f"g string, b long, subroot string, up {_PATH}, over {_PATH}"))
    return inside.join(table, ["g", "b"])


def _arrow_path() -> pa.DataType:
    return pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


_PROOF = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(df: DataFrame, columns: Sequence[str], group: str, key: str, changed: Column | None = None, fanout: int = FANOUT, depth: int = LEVELS, top: int = TOP, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    ``columns`` are hashed into leaves in their order; ``changed`` is the leaf that is checked
    instead of the row's own where it is not null, as of a copy to be audited. ``proof_sha256`` is the hash of
    all siblings on the way to the root.
    """
    g = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit(""))
    id_kind = df.schema[key].dataType
    id_type, proof_kind = to_arrow_type(id_kind), f"id {id_kind.simpleString()}, {_PROOF}"
    leaves = df.select(g.alias("g"), F.col(key).alias("id"), leaf(columns).alias("hash"), (F.lit(None).cast("string") if changed is None else changed).alias("changed"))
    # written once, so that counting, sampling and dealing read hashes and no text
    leaves = staged(leaves, "leaves")
    held = blocks(placed(leaves, "g", ["id", "hash"], range_rows), fanout**depth, "id", "changed")
    if held.limit(1).count() == 0:
        return df.sparkSession.createDataFrame([], proof_kind).withColumnRenamed("id", key)
    root, found, table = upper(held, True, fanout, depth, top, range_rows)
    size = fanout**depth

    def prove(nodes: list[dict], b: int, subroot: str, up: list[tuple[str, str]]) -> pa.RecordBatch:
        tree = block_levels([x["hash"] for x in nodes], _whole(b, len(nodes), size), depth, fanout)
        above = "".join(u + v for u, v in up)
        out = []
        for i, x in enumerate(nodes):
            steps = path(tree, i, fanout)
            proof = sha256(("".join(u + v for u, v in steps) + above).encode()).hexdigest()
            folded = fold(x["changed"] or x["hash"], [*steps, *up])
            out.append((x["id"], x["hash"], subroot, root, proof, folded, folded == root))
        types = [id_type, *[pa.string()] * 5, pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), types, strict=True)], names=["id", *[x.split()[0] for x in _PROOF.split(", ")]])

    if table is None:
        known = df.sparkSession.sparkContext.broadcast(found)

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for g, b, nodes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    subroot, up, over = known.value[g, b]
                    yield prove(nodes, b, subroot, up + over)

        return held.select("g", "b", "nodes").mapInArrow(near, proof_kind).withColumnRenamed("id", key)

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, nodes, subroot, up in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield prove(nodes, b, subroot, [(s["before"], s["after"]) for s in up])

    rows = held.join(table, ["g", "b"]).select("b", "nodes", "subroot", F.concat("up", "over").alias("up"))
    return rows.mapInArrow(far, proof_kind).withColumnRenamed("id", key)


def lowered(column: str = "text") -> Column:
    """A text with A to Z in lower case, and no other change."""
    upper_case = "".join(map(chr, range(65, 91)))
    return F.translate(column, upper_case, upper_case.lower())


def _sql(most: int = 6) -> str:
    """The manifest of documents in SQL: levels unrolled up to ``FANOUT ** most`` rows a group and groups."""
    f = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    whole = " || ".join(f(c) for c in ("doc_id", "source", "lang", "n_chars"))
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # crc32 bit by bit over the digits of the id
    bits = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"xor(list_reduce(list_prepend(4294967295, {bits}), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"
    out = [f"""d AS (SELECT doc_id, source, sha256({whole} || {f('text')}) AS leaf, CASE WHEN coalesce({crc} % 5 = 0, false) THEN sha256({whole} || {f(low)}) END AS changed FROM documents)""",
           "o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM d)",
           "a0 AS (SELECT source AS g, p, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM o)"]
    for t, first in (("a", 0), ("b", 0)):
        if t == "b":
            out.append(f"b0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY CASE WHEN g IS NULL THEN 0 ELSE 1 END, encode(g)) - 1 AS p, h, count(*) OVER () AS n, g AS source FROM a{most})")
        for k in range(most):
            keep = ", source" if t == "b" else ""
            w = "PARTITION BY g, p // 16 ORDER BY p ROWS BETWEEN"
            out.append(f"{t}s{k} AS (SELECT g, p, n, coalesce(string_agg(h, '') OVER ({w} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS u, coalesce(string_agg(h, '') OVER ({w} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS v FROM {t}{k})")
            out.append(f"{t}{k + 1} AS (SELECT g, p // 16 AS p, CASE WHEN n = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY p)) END AS h, CAST(ceil(n / 16) AS BIGINT) AS n FROM {t}{k} GROUP BY g, p // 16, n)")
    joins, proof, node = "", [], "coalesce(o.changed, o.leaf)"
    for k in range(most):
        joins += f" JOIN as{k} ON as{k}.g IS NOT DISTINCT FROM o.source AND as{k}.p = o.p // {16**k}"
        proof.append(f"as{k}.u || as{k}.v")
    joins += f" JOIN a{most} ON a{most}.g IS NOT DISTINCT FROM o.source JOIN b0 ON b0.source IS NOT DISTINCT FROM o.source"
    for k in range(most):
        joins += f" JOIN bs{k} ON bs{k}.p = b0.p // {16**k}"
        proof.append(f"bs{k}.u || bs{k}.v")
    # folding goes level by level, each in a step of its own
    steps = [f"f0 AS (SELECT o.doc_id, o.leaf, a{most}.h AS subroot, b{most}.h AS root, sha256({' || '.join(proof)}) AS proof_sha256, {node} AS x, "
             + ", ".join(f"{t}s{k}.{c} AS {t}{c}{k}" for t in "ab" for k in range(most) for c in "uvn") + f" FROM o{joins}, b{most})"]
    for i, (t, k) in enumerate((t, k) for t in "ab" for k in range(most)):
        steps.append(f"f{i + 1} AS (SELECT * REPLACE (CASE WHEN {t}n{k} = 1 THEN x ELSE sha256({t}u{k} || x || {t}v{k}) END AS x) FROM f{i})")
    return "WITH " + ",\n".join(out + steps) + f"\nSELECT doc_id, leaf, subroot, root, proof_sha256, x AS folded_root, x = root AS verified FROM f{2 * most}"


ORACLE = _sql(4)

