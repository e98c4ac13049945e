"""LM scoring by cross-entropy difference.

Two bigram models, one of a target corpus and one of the background (all documents),
share one vocabulary: the V distinct words of both. With add-k smoothing a token's loss is
-log(c(v w) + k) + log(c(v) + k V), a bigram term and a context term. A document's score
is the mean over its tokens of target loss less background loss: the lower, the more it
reads like the target.

Since both terms belong to one n-gram each, a loss needs no second look-up: n-grams are
dealt by hash to shards, a shard counts its n-grams in both corpora and at once returns
each document's share of the sum. Every n-gram of every text is counted; nothing is
capped or sampled. One shuffle carries the n-grams, packed by blocks of documents: each
distinct n-gram of a block once (five bytes, which with the shard's number make a hash
whose collisions stay under one in 100,000 at any size), then documents and counts. A
block sends a row to the shards that it has n-grams of and to no other, so rows grow with
the text and not with blocks times shards. A very common n-gram is one entry for each block. A second, smaller shuffle adds the
shares by block. Shards hold a bounded number of characters, so their number grows with
the corpus and their memory does not.

``docs`` should be a scan or a staged table, since blocks are cut by input partition.

Defined results: null, empty and blank texts have 0 tokens and null losses; repeated rows
are counted and scored each; a null doc_id is carried as it is; an empty target leaves
its counts at zero. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostra.llm.common import count_hint, mix, odd_constants, text_bytes, word_hashes

#: Characters of text whose n-grams one shard holds, tokens in a block, the smoothing count.
SHARD_CHARS, BLOCK_TOKENS, SMOOTHING = 4_000_000, 400_000, 0.001
_A, _B, _C = odd_constants(3, 5)
_START = np.uint64(0x5BD1E9955BD1E995)
_LOW = np.uint64((1 << 40) - 1)
_SHARDED = "shard int, block long, target boolean, high binary, low binary, many binary, doc binary, count binary, ids array<long>, tokens array<long>"
_SHARES = "block long, doc binary, target_share binary, background_share binary, ids array<long>, tokens array<long>"


def _block(texts: list[list[bytes]], shards: int) -> list[dict]:
    """Packed n-grams of a block of documents, one entry for each shard that has some."""
    n = [len(t) for t in texts]
    w = word_hashes([x for t in texts for x in t])
    doc = np.repeat(np.arange(len(texts), dtype=np.uint64), n)
    before = np.empty_like(w)
    before[1:] = w[:-1]
    before[np.flatnonzero(np.diff(doc, prepend=np.uint64(len(texts))))] = _START
    one = np.uint64(1)
    h = np.concatenate([mix(before * _A + w * _B) & ~one, mix(before * _C) | one])
    doc = np.concatenate([doc, doc])
    # the kind stays the lowest bit; shard and rest come from the other 63
    shard, rest = (h >> one) % np.uint64(shards), ((h >> one) // np.uint64(shards) << one | (h & one)) & _LOW
    key = shard << np.uint64(40) | rest
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    new_key = np.concatenate(([True], key[1:] != key[:-1]))
    cut = np.flatnonzero(new_key | np.concatenate(([True], doc[1:] != doc[:-1])))
    count = np.diff(np.append(cut, len(key))).astype(np.uint32)
    doc = doc[cut].astype(np.uint32)
    heads = np.flatnonzero(new_key[cut])
    keys = key[cut][heads]
    many = np.diff(np.append(heads, len(cut))).astype(np.uint32)
    at = np.append(heads, len(cut))
    first = np.flatnonzero(np.diff((keys >> np.uint64(40)).astype(np.int64), prepend=-1))
    out = []
    for a, b in zip(first, np.append(first[1:], len(keys)), strict=True):
        part = keys[a:b] & _LOW
        out.append({"shard": int(keys[a] >> np.uint64(40)), "high": (part >> np.uint64(8)).astype(np.uint32).tobytes(), "low": part.astype(np.uint8).tobytes(), "many": many[a:b].tobytes(), "doc": doc[at[a] : at[b]].tobytes(), "count": count[at[a] : at[b]].tobytes()})
    return out


def _sharded(docs: DataFrame, target: bool, shards: int) -> DataFrame:
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 32
        schema = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("target", pa.bool_()), *((c, pa.binary()) for c in ("high", "low", "many", "doc", "count")), ("ids", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64()))])
        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                texts: list[list[bytes]] = []
                held = 0
                while lo + len(texts) < batch.num_rows and held < BLOCK_TOKENS:
                    texts.append(text_bytes(batch.column("text")[lo + len(texts)].as_py()).lower().split())
                    held += len(texts[-1])
                rows = _block(texts, shards) if held else [{"shard": 0, "high": b"", "low": b"", "many": b"", "doc": b"", "count": b""}]
                for r in rows:
                    r |= {"block": serial, "target": target, "ids": None, "tokens": None}
                if not target:
                    rows[0] |= {"ids": batch.column("doc_id")[lo : lo + len(texts)].to_pylist(), "tokens": [len(t) for t in texts]}
                yield from pa.Table.from_pylist(rows, schema=schema).to_batches()
                serial += 1
                lo += len(texts)

    return docs.mapInArrow(packed, _SHARDED)


def _shares(vocabulary: int, k: float):
    """What a shard does: count its n-grams in both corpora, and sum each document's terms."""

    def counted(held: pa.Table) -> pa.Table:
        columns = {c: held.column(c).to_pylist() for c in ("target", "high", "low", "many", "doc", "count")}
        keys, sums = [], []
        for high, low, many, count in zip(columns["high"], columns["low"], columns["many"], columns["count"], strict=True):
            keys.append(np.frombuffer(high, np.uint32).astype(np.uint64) << np.uint64(8) | np.frombuffer(low, np.uint8))
            at = np.cumsum(np.concatenate(([0], np.frombuffer(many, np.uint32).astype(np.int64))))
            total = np.concatenate(([0], np.cumsum(np.frombuffer(count, np.uint32).astype(np.int64))))
            sums.append(total[at[1:]] - total[at[:-1]])
        every, index = np.unique(np.concatenate(keys), return_inverse=True)
        parts = np.split(index, np.cumsum([len(x) for x in keys])[:-1])
        of = {True: np.zeros(len(every)), False: np.zeros(len(every))}
        for part, s, target in zip(parts, sums, columns["target"], strict=True):
            of[target][part] += s
        context = (every & np.uint64(1)).astype(bool)
        term = {t: np.where(context, np.log(c + k * vocabulary), -np.log(c + k)) for t, c in of.items()}
        out = []
        for i, part in enumerate(parts):
            if columns["target"][i]:
                continue
            doc = np.frombuffer(columns["doc"][i], np.uint32)
            count = np.frombuffer(columns["count"][i], np.uint32)
            gram = np.repeat(part, np.frombuffer(columns["many"][i], np.uint32))
            n = int(doc.max()) + 1 if len(doc) else 0
            there = np.flatnonzero(np.bincount(doc, minlength=n)) if n else np.empty(0, np.int64)
            share = {t: np.bincount(doc, weights=term[t][gram] * count, minlength=n)[there].astype(np.float32) for t in term} if n else {t: np.empty(0, np.float32) for t in term}
            out.append((held.column("block")[i].as_py(), there.astype(np.uint32).tobytes(), share[True].tobytes(), share[False].tobytes(), held.column("ids")[i].as_py(), held.column("tokens")[i].as_py()))
        types = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        names = ["block", "doc", "target_share", "background_share", "ids", "tokens"]
        return pa.table([pa.array([r[j] for r in out], t) for j, t in enumerate(types)], names=names)

    return counted


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    """The scores of the documents of one block."""
    named = pdf[pdf["ids"].notna()].iloc[0]
    tokens = np.asarray(named["tokens"], np.int64)
    loss = {"target_share": np.zeros(len(tokens)), "background_share": np.zeros(len(tokens))}
    for r in pdf.sort_values("doc").itertuples():
        at = np.frombuffer(r.doc, np.uint32)
        for c, total in loss.items():
            total[at] += np.frombuffer(getattr(r, c), np.float32)
    with np.errstate(invalid="ignore", divide="ignore"):
        t, b = (np.where(tokens > 0, x / tokens, np.nan) for x in loss.values())
    ids = pd.array([None if i is None or i != i else int(i) for i in named["ids"]], dtype="Int64")
    return pd.DataFrame({"doc_id": ids, "n_tokens": tokens, "target_loss": t, "background_loss": b, "score": t - b})


def vocabulary_size(*corpora: DataFrame) -> int:
    """Distinct words of all corpora together, estimated within two hundredths."""
    words = None
    for df in corpora:
        low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        part = df.select(F.explode(F.split(low, r"[\x20\x09-\x0D]+")).alias("w")).where("w <> ''")
        words = part if words is None else words.unionByName(part)
    return max(1, int(words.agg(F.approx_count_distinct("w", 0.02)).first()[0] or 0))


def score(docs: DataFrame, target: DataFrame, smoothing: float = SMOOTHING, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score of every row of ``docs``."""
    _, chars = count_hint(docs)
    shards = max(1, math.ceil(chars / shard_chars))
    v = vocabulary_size(docs, target)
    packed = _sharded(docs.select("doc_id", "text"), False, shards).unionByName(_sharded(target.select("text"), True, shards))
    shares = packed.groupBy("shard").applyInArrow(_shares(v, smoothing), _SHARES)
    out = shares.groupBy("block").applyInPandas(_added, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
    columns = [F.when(F.col("n_tokens") > 0, F.col(c)).alias(c) for c in ("target_loss", "background_loss", "score")]
    return out.select("doc_id", "n_tokens", *columns)
