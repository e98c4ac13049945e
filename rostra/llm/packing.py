"""Best-fit packing by a grouping genetic algorithm on islands.

Texts become token pieces of at most ``CAPACITY`` tokens; pieces go into sequences of
that size, as few as can be had. Full pieces are sequences by themselves. The others are
dealt by hash into blocks of about ``BLOCK`` pieces. Every block is evolved by ``ISLANDS``
populations apart from one another: a chromosome tells each piece's bin, and the founders
place the pieces best-fit in random order. Crossover injects whole well-filled bins of one
parent into the other, bins that hold a duplicate go, and the displaced pieces are placed
best-fit, largest first. After each epoch the best chromosome of an island moves to the
next one. An island stops early only at the block's lower bound. In a second round the bins of all blocks that are less than full enough are emptied, dealt
anew into fewer blocks and packed again, so the last bins of blocks are not wasted.

Only lengths and piece names move; texts are read once and never shuffled.

Defined results: a null or empty text is the one closing token; repeated rows are packed
each for themselves; a null doc_id is carried as it is; an empty table gives no rows.
Special-token strings in a text are read as the tokenizer file says. Other columns are
ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostra.llm.common import staged

CAPACITY = 2048
#: Pieces that evolve together; islands for each block; epochs between which the best move.
BLOCK, ISLANDS, EPOCHS = 4096, 3, 3
#: Chromosomes of an island and generations of an epoch.
POPULATION, GENERATIONS = 5, 6
#: Tasks of an epoch at most.
MOST_TASKS = 10_000
#: Bins under this fill are dealt anew in the second round.
FULL_ENOUGH = 0.995


def tokenizer(path: str | None = None):
    """Ids of a text by the byte-level BPE file (by default the public 50k one).

    The rank file of the same vocabulary gives the same ids several times faster; texts
    that spell a special token go to the tokenizer itself.
    """
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
    special = [t.content for t in whole.get_added_tokens_decoder().values()]
    if path is not None:
        return lambda text: np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return fast.encode_to_numpy(text, disallowed_special=())

    return ids


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all full but the first."""
    head = n - (n - 1) // capacity * capacity
    return [(0, head), *((s, capacity) for s in range(head, n, capacity))]


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every text."""

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = tokenizer(path)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                ids = np.append(ids_of(text.as_py() or ""), 0).astype("<u4")
                for k, (s, n) in enumerate(cut(len(ids), capacity)):
                    row.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(ids[s : s + n]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(tokenize, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(bin_of: np.ndarray, room: list[int], items: np.ndarray, size: np.ndarray, capacity: int) -> None:
    """Place items in the given order, each where the least room is left; opens bins as needed."""
    free = sorted((r, b) for b, r in enumerate(room) if r)
    for i, n in zip(items.tolist(), size[items].tolist(), strict=True):
        at = bisect.bisect_left(free, (n, -1))
        if at < len(free):
            left, b = free.pop(at)
        else:
            left, b = capacity, len(room)
            room.append(capacity)
        bin_of[i] = b
        room[b] = left - n
        if room[b]:
            bisect.insort(free, (room[b], b))


def _falling(items: np.ndarray, size: np.ndarray) -> np.ndarray:
    return items[np.lexsort((items, -size[items]))]


def fills(bin_of: np.ndarray, size: np.ndarray) -> np.ndarray:
    """What each bin holds."""
    return np.bincount(bin_of, weights=size).astype(np.int64)


def fitness(bin_of: np.ndarray, size: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then the more unequal fill, which leaves room that can be used."""
    fill = fills(bin_of, size) / capacity
    return (-len(fill), float((fill * fill).sum()))


def crossover(a: np.ndarray, b: np.ndarray, size: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Inject well-filled bins of b into a, drop the bins that hold one of their items, best-fit the rest."""
    fill = fills(b, size)
    good = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    taken = rng.choice(good, max(1, len(good) // 2), replace=False)
    at = np.full(len(fill), -1)
    at[taken] = np.arange(len(taken))
    injected = at[b]
    inside = injected >= 0
    hit = np.zeros(int(a.max()) + 1, bool)
    hit[a[inside]] = True
    child = np.where(inside, injected, len(taken) + (np.cumsum(~hit) - 1)[a])
    loose = np.flatnonzero(~inside & hit[a])
    child[loose] = -1
    return _refilled(child, loose, size, capacity)


def mutate(a: np.ndarray, size: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Empty the worst bins and a few others, and place their items anew."""
    fill = fills(a, size)
    n = max(1, len(fill) // 10)
    hit = np.zeros(len(fill), bool)
    hit[np.argsort(fill, kind="stable")[:n]] = True
    hit[rng.choice(len(fill), n)] = True
    child = (np.cumsum(~hit) - 1)[a]
    loose = np.flatnonzero(hit[a])
    child[loose] = -1
    return _refilled(child, loose, size, capacity)


def _refilled(child: np.ndarray, loose: np.ndarray, size: np.ndarray, capacity: int) -> np.ndarray:
    there = child >= 0
    room = (capacity - fills(child[there], size[there])).tolist() if there.any() else []
    best_fit(child, room, _falling(loose, size), size, capacity)
    return child.astype(np.int32)


def evolve(size: np.ndarray, population: list[np.ndarray], rng: np.random.Generator, capacity: int, generations: int) -> list[np.ndarray]:
    """Generations of one island, best first; stops at the bins that the sum of sizes needs."""
    least = -(-int(size.sum()) // capacity)
    best_first = lambda x: sorted(x, key=lambda p: p[0], reverse=True)
    scored = best_first((fitness(a, size, capacity), a) for a in population)
    for _ in range(generations):
        if -scored[0][0][0] <= least:
            break
        young = []
        for k in range(1, len(scored)):
            child = mutate(crossover(scored[0][1], scored[k][1], size, capacity, rng), size, capacity, rng)
            young.append((fitness(child, size, capacity), child))
        scored = best_first([*scored, *young])[: len(population)]
    return [a for _, a in scored]


def founders(size: np.ndarray, rng: np.random.Generator, capacity: int, n: int) -> list[np.ndarray]:
    """Best-fit of the items in random orders."""
    out = []
    for _ in range(n):
        bin_of = np.empty(len(size), np.int32)
        best_fit(bin_of, [], rng.permutation(len(size)), size, capacity)
        out.append(bin_of)
    return out


_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]


def _pack_blocks(items: DataFrame, capacity: int, block: int, first_id: int) -> DataFrame:
    """``items`` with block, bin and fill, each block packed by its islands."""
    n = items.count()
    blocks = max(1, -(-n // block))
    dealt = items.withColumn("block", F.pmod(F.xxhash64(*_NAMES), F.lit(blocks)) + F.lit(first_id))
    # one row a block: the sorted sizes; the pieces themselves stay out of the evolution
    order = F.array_sort(F.collect_list(F.struct("length", *[c for c in _NAMES if c != "length"])))
    rows = staged(dealt.groupBy("block").agg(order.alias("items")), "blocks")
    sizes = rows.select("block", F.col("items.length").alias("sizes"))
    state = sizes.select("block", "sizes", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.lit(None).cast("array<binary>").alias("chromosomes"))
    # islands are small in bytes and long in work, so their tasks are counted, not measured
    tasks = min(blocks * ISLANDS, MOST_TASKS)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        size = np.asarray(r["sizes"], np.int64)
        rng = np.random.default_rng([int(r["block"]), int(r["island"]), int(r["epoch"])])
        if r["chromosomes"] is None:
            population = founders(size, rng, capacity, POPULATION)
        else:
            population = [np.frombuffer(c, np.int32) for c in r["chromosomes"]]
        evolved = evolve(size, population, rng, capacity, GENERATIONS)
        count, even = fitness(evolved[0], size, capacity)
        return pdf.assign(chromosomes=[[a.astype(np.int32).tobytes() for a in evolved]], n_bins=-count, even=-even)

    for epoch in range(EPOCHS):
        held = state.withColumn("epoch", F.lit(epoch)).repartition(tasks, "block", "island")
        evolved = staged(held.groupBy("block", "island").applyInPandas(run, "block long, sizes array<long>, island int, chromosomes array<binary>, epoch int, n_bins int, even double"), "islands")
        if epoch < EPOCHS - 1:
            # the best of each island takes the place of the worst of the next
            moving = evolved.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.element_at("chromosomes", 1).alias("elite"))
            state = evolved.join(moving, ["block", "island"]).select("block", "sizes", "island", F.concat(F.slice("chromosomes", 1, POPULATION - 1), F.array("elite")).alias("chromosomes"))
    winner = evolved.groupBy("block").agg(F.min_by(F.element_at("chromosomes", 1), F.struct("n_bins", "even", "island")).alias("bins"))

    def placed(held: pa.Table) -> pa.Table:
        flat = held.column("items").combine_chunks().flatten()
        size = flat.field("length").to_numpy(zero_copy_only=False).astype(np.int64)
        bin_of = np.frombuffer(held.column("bins")[0].as_py(), np.int32)
        order = np.argsort(bin_of, kind="stable")
        before = np.cumsum(size[order]) - size[order]
        heads = np.flatnonzero(np.diff(bin_of[order], prepend=-1))
        offset = np.empty(len(size), np.int64)
        offset[order] = before - np.repeat(before[heads], np.diff(np.append(heads, len(size))))
        fill = np.bincount(bin_of, weights=size).astype(np.int64)[bin_of]
        names = (held.column("block")[0].as_py() << 32) + bin_of.astype(np.int64)
        return pa.table([*(flat.field(c) for c in _NAMES), pa.array(names), pa.array(offset), pa.array(fill)], names=[*_NAMES, "sequence_id", "offset", "fill"])

    return (
        rows.join(winner, "block")
        .groupBy("block")
        .applyInArrow(placed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, fill long")
    )


def pack(items: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """``pieces`` with sequence_id and offset."""
    items = staged(items.select(*_NAMES), "pieces")
    part = items.where(F.col("length") < capacity)
    # a full piece fills a sequence: its number is negative and its own
    full = items.where(F.col("length") >= capacity).select(*_NAMES, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    once = staged(_pack_blocks(part, capacity, block, 0), "packed")
    good = F.col("fill") >= int(capacity * FULL_ENOUGH)
    again = _pack_blocks(once.where(~good).select(*_NAMES), capacity, block, 1 << 30)
    names = [*_NAMES, "sequence_id", "offset"]
    return full.unionByName(once.where(good).select(*names)).unionByName(again.select(*names))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    return pack(pieces(docs, capacity, path), capacity)
