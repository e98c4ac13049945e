"""MinHash near-dedup with b-bit signatures.

A text is the set of its n-word shingles. 160 minima in 32 bands of 5 give candidates:
texts with a similarity of 0.8 meet in a band but for 3 in a million. Of every minimum
the low 4 bits are kept as bit planes; counting equal positions and correcting for
chance collisions (1/16) estimates the similarity, and pairs more than five standard
errors under the threshold go. The others are confirmed on their full sets.

No pair within a group is listed needlessly. Texts with the same set are one node. A
text's shingles that no other candidate has can be in no intersection, which bounds the
similarity of a text, or of a pair, before it is compared; texts and pairs that cannot
reach the threshold go. In a first round every text of a bucket meets only the most
central one, which has the least share of such shingles; confirmed links give components.
In a second round the texts of a bucket that are not in the component most of the bucket
is in meet all texts of other components there, unless what either shares with the
bucket's head, and what else it has in common with anyone, bounds the pair below the
threshold. Pairs that share a bucket are thus linked, known to be connected, compared, or
too far apart for certain.

Defined results: null, empty and blank texts have no shingles and link with nothing; a
text of fewer than n words is one shingle; a null doc_id takes no part and has a null
component; rows that repeat a doc_id are one node. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostra.llm.common import as_long, discard, mix, shingle_set, staged, text_bytes, word_hashes
from rostra.llm.components import components

BANDS, ROWS, BITS = 32, 5, 4
SIMILARITY = 80  # hundredths
_K = BANDS * ROWS
_WORDS = -(-_K // 64)
_rng = np.random.default_rng(20)
_XOR = _rng.integers(0, 2**32, _K, dtype=np.uint32)
_MUL = _rng.integers(0, 2**32, _K, dtype=np.uint32) | np.uint32(1)
_ROWC = _rng.integers(0, 2**64, ROWS, dtype=np.uint64) | np.uint64(1)
_BANDC = _rng.integers(0, 2**64, BANDS, dtype=np.uint64)


def words_of(text: str | None, lower: bool) -> list[bytes]:
    raw = text_bytes(text)
    return (raw.lower() if lower else raw).split()


def minima(shingles: np.ndarray) -> np.ndarray:
    """The 160 smallest hash values of a set of 64-bit shingles."""
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(_K, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(h), 1024):
        y = (h[lo : lo + 1024, None] ^ _XOR) * _MUL
        y ^= y >> np.uint32(15)
        np.minimum(out, y.min(0), out=out)
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    return mix((m.reshape(BANDS, ROWS).astype(np.uint64) * _ROWC).sum(1) + _BANDC)


def planes(m: np.ndarray) -> np.ndarray:
    """Bit planes of the low bits of each minimum: BITS groups of words."""
    low = mix(m.astype(np.uint64))
    out = np.zeros((BITS, _WORDS * 64), np.uint8)
    for b in range(BITS):
        out[b, :_K] = (low >> np.uint64(b)) & np.uint64(1)
    return np.packbits(out, axis=1, bitorder="little").view(np.uint64).ravel()


def signatures(docs: DataFrame, n: int, lower: bool) -> DataFrame:
    """doc_id, n_shingles, key (of the whole set), bands and planes of every row with an id."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, key, bands, bits = [], [], [], []
            for text in batch.column("text"):
                s = shingle_set(word_hashes(words_of(text.as_py(), lower)), n)
                count.append(len(s))
                if not len(s):
                    key.append(None)
                    bands.append(None)
                    bits.append(None)
                    continue
                m = minima(s)
                key.append(xxhash.xxh3_128_digest(s.tobytes()))
                bands.append(as_long(band_keys(m)))
                bits.append(as_long(planes(m)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(key, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "key", "bands", "planes"],
            )

    return docs.select("doc_id", "text").mapInArrow(signed, "doc_id long, n_shingles long, key binary, bands array<long>, planes array<long>")


def shingle_sets(docs: DataFrame, n: int, lower: bool) -> DataFrame:
    """doc_id and the sorted shingle hashes of every row."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                s = [as_long(shingle_set(word_hashes(words_of(t, lower)), n)) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s, pa.list_(pa.int64()))], names=["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(sets, "doc_id long, shingles array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two signatures' bit counts, corrected for chance collisions."""
    differ = F.lit(0)
    for w in range(_WORDS):
        x = F.lit(0).cast("long")
        for p in range(BITS):
            i = p * _WORDS + w
            x = x.bitwiseOR(a[i].bitwiseXOR(b[i]))
        differ = differ + F.bit_count(x)
    chance = 2.0**-BITS
    return ((1 - differ / F.lit(float(_K))) - chance) / (1 - chance)


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets are similar enough."""
    left = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
    both = left.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
    shared = F.size(F.array_intersect("sa", "sb")).cast("long")
    total = F.size("sa").cast("long") + F.size("sb").cast("long") - shared
    return both.where(shared * 100 >= total * similarity).select("a", "b")


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (head, doc_id) with ``inside``, the number of shingles that both have."""
    left = pairs.join(sets.select("doc_id", F.col("shingles").alias("sb")), "doc_id")
    both = left.join(sets.select(F.col("doc_id").alias("head"), F.col("shingles").alias("sa")), "head")
    return both.groupBy("head", "doc_id").agg(F.max(F.size(F.array_intersect("sa", "sb"))).cast("long").alias("inside"))


def _near(pairs: DataFrame, signed: DataFrame, similarity: int) -> DataFrame:
    """Of pairs (a, b), those whose estimate is not five standard errors under the threshold."""
    s = similarity / 100
    least = s - 5 * (s * (1 - s) / _K) ** 0.5
    bits = signed.select("doc_id", "planes")
    return (
        pairs.join(bits.select(F.col("doc_id").alias("b"), F.col("planes").alias("pb")), "b")
        .join(bits.select(F.col("doc_id").alias("a"), F.col("planes").alias("pa")), "a")
        .where(estimate(F.col("pa"), F.col("pb")) >= least)
        .select("a", "b")
    )


def _possible(size: str, common: str, other_size: str, other_common: str, similarity: int) -> Column:
    """Whether two sets can be similar enough, when all they can share are their common shingles."""
    most = F.least(F.col(common), F.col(other_common))
    return most * (100 + similarity) >= (F.col(size) + F.col(other_size)) * similarity


def _bounds(nodes: DataFrame, sets: DataFrame, similarity: int, rounds: int = 2) -> DataFrame:
    """doc_id, size and common (shingles that another of the texts has too) of the texts that can have a link.

    A link needs a share of at least ``similarity`` of either set in common. Texts without
    it can be no one's partner, so the next round counts without them.
    """
    size = nodes.groupBy("doc_id").agg(F.min("n_shingles").alias("size"))
    left, able = sets, None
    for _ in range(rounds):
        before = able
        one = left.select("doc_id", F.explode("shingles").alias("shingle"))
        twice = staged(one.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("shingle"), "shared")
        common = one.join(twice, "shingle").groupBy("doc_id").agg(F.count(F.lit(1)).alias("common"))
        able = staged(common.join(size, "doc_id").where(F.col("common") * 100 >= F.col("size") * similarity), "able")
        discard(twice, *[before] * (before is not None))
        left = sets.join(able.select("doc_id"), "doc_id", "left_semi")
    return able


def groups(docs: DataFrame, n: int = 5, similarity: int = SIMILARITY, lower: bool = True, rounds: int = 2) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest linked doc_id) of every row of ``docs``.

    With ``rounds=1`` only links to the head of a bucket are looked for: every link found is
    proven, but some components may come in parts.
    """
    signed = staged(signatures(docs, n, lower), "signatures")
    filled = signed.where("key is not null and doc_id is not null")
    # texts with the same set become one node, the smallest id; a task sends one row a set
    same = filled.groupBy("key").agg(F.min("doc_id").alias("rep"))
    member = staged(filled.select("key", "doc_id").distinct().join(same, "key").select("doc_id", "rep"), "members")
    nodes = staged(filled.join(member.where("doc_id = rep").select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "key"]), "nodes")

    bands = nodes.select("doc_id", F.explode(F.array_distinct("bands")).alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("bucket")
    met = staged(bands.join(shared, "bucket"), "buckets")  # only buckets of two texts or more

    mates = met.select("doc_id").distinct()
    sets = staged(shingle_sets(docs.where("doc_id is not null").join(mates, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]), n, lower), "sets")
    at = staged(met.join(_bounds(nodes, sets, similarity), "doc_id"), "bounded")

    # the head of a bucket is its most central text: the one with the least share of shingles of its own
    centre = F.struct((F.col("common") / F.col("size")).alias("share"), (-F.col("doc_id")).alias("id"))
    heads = at.groupBy("bucket").agg(F.max_by(F.struct("doc_id", "size", "common"), centre).alias("head"))
    first = (
        at.join(heads, "bucket")
        .where(F.col("doc_id") != F.col("head.doc_id"))
        .where(_possible("size", "common", "head.size", "head.common", similarity))
        .select(F.least("doc_id", "head.doc_id").alias("a"), F.greatest("doc_id", "head.doc_id").alias("b"))
        .distinct()
    )
    linked = staged(_confirmed(_near(first, nodes, similarity), sets, similarity), "links")
    label = staged(components(linked), "trees")
    discard(linked, met)
    if rounds > 1:
        label = _joined(label, _across(at, heads, first, label, nodes, sets, similarity))
    discard(at, sets, nodes)
    # every row's id, then the node of its set, then that node's component
    own = member.join(label.select(F.col("node").alias("rep"), "component"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    return signed.select("doc_id", "n_shingles").join(own, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _across(at: DataFrame, heads: DataFrame, first: DataFrame, label: DataFrame, nodes: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The links (a, b) between texts that share a bucket but not a component."""
    at = at.join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    labels = staged(at.join(heads.select("bucket", F.col("head.doc_id").alias("head")), "bucket"), "labels")
    tally = labels.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("held"), F.min("size").alias("size"))
    mixed = (
        tally.groupBy("bucket")
        .agg(F.max_by("component", F.struct("held", "component")).alias("main"), F.count(F.lit(1)).alias("kinds"), F.min("size").alias("least"))
        .where("kinds > 1")
        .select("bucket", "main", "least")
    )
    # a text that even the smallest set of the bucket is too large for meets no one
    alive = staged(labels.join(mixed, "bucket").where(_possible("size", "common", "least", "common", similarity)), "able")
    inside = staged(_measured(alive.where("doc_id <> head").select("head", "doc_id").distinct(), sets), "inside")
    able = alive.join(inside, ["head", "doc_id"], "left").withColumn("inside", F.coalesce("inside", "size")).join(nodes.select("doc_id", "bands"), "doc_id")
    side = lambda k: [F.col(c).alias(f"{c}_{k}") for c in ("doc_id", "component", "size", "common", "inside", "bands")]
    # two texts share at most what both share with the head, and of the rest what others have too
    most = F.least("inside_x", "inside_y") + F.least(F.col("common_x") - F.col("inside_x"), F.col("common_y") - F.col("inside_y"))
    second = (
        able.where("component <> main").select("bucket", *side("x"))
        .join(able.select("bucket", *side("y")), "bucket")
        .where("component_x <> component_y")
        .where(most * (100 + similarity) >= (F.col("size_x") + F.col("size_y")) * similarity)
        # only in the first band that both have, so that a pair is listed once
        .where("bucket = element_at(filter(bands_x, (k, i) -> k = bands_y[i]), 1)")
        .select(F.least("doc_id_x", "doc_id_y").alias("a"), F.greatest("doc_id_x", "doc_id_y").alias("b"))
        .distinct()
        .join(first, ["a", "b"], "left_anti")
    )
    more = staged(_confirmed(_near(second, nodes, similarity), sets, similarity), "links")
    discard(labels, alive, inside)
    return more


def _joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """``label`` (node, component) with the components that ``links`` connect made one.

    Only the components meet, each as one node, so the graph is far smaller than that of the texts.
    """
    of = lambda k: label.select(F.col("node").alias(k), F.col("component").alias(f"c{k}"))
    met = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    over = staged(components(met).withColumnRenamed("node", "part").withColumnRenamed("component", "whole"), "trees")
    known = label.join(over.withColumnRenamed("part", "component"), "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    return known.unionByName(over.join(label.select(F.col("node").alias("part")), "part", "left_anti").select(F.col("part").alias("node"), F.col("whole").alias("component")))


def keep_one(docs: DataFrame, n: int = 5, similarity: int = SIMILARITY, lower: bool = True, rounds: int = 2) -> DataFrame:
    """``docs`` with one document, the smallest id, of each group; rows without an id stay."""
    found = groups(docs, n, similarity, lower, rounds)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 80 * (a.k + b.k - shared)),
u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT u.y, r.root FROM r JOIN u ON u.x = r.node WHERE r.root < u.y)
SELECT d.doc_id, CAST(coalesce(n.k, 0) AS BIGINT) AS n_shingles, m.root AS component_id, d.doc_id = m.root AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(root) AS root FROM r GROUP BY node) m ON m.node = d.doc_id
"""
