"""Substring dedup with repeated-phrase automata.

A window is ``window`` consecutive words of a document. Words of a window whose word
sequence starts earlier somewhere (in a document of smaller id, or earlier in the same
one) are removed; windows are judged on the input.

Of every window the ``PHRASE``-word phrase with the smallest hash is its anchor, so equal
windows have equal anchors and an anchor serves many windows. Anchors are counted over
all documents; those that occur more than once confirm recurring passages, whose phrases
are dealt to shards by the first document that has them. A shard compiles its phrases into
one Aho-Corasick automaton, and every document that has a phrase of the shard is streamed
through it, which locates all occurrences. A window whose anchor is located is a candidate:
its hash is grouped with the others, and each group's first place decides. A passage that
very many documents share makes a busy shard: its documents are dealt to as many parts as
their words need, each with a copy of the automaton.

Exact copies of a whole text need no windows: all words of a later copy go. Counts are
combined before a shuffle, recurring anchors and first places are staged, so that joins
on a hot passage can be split. An automaton has about ``SHARD_PHRASES`` phrases, a part
about ``PART_WORDS`` words. Equality of windows is that of 64-bit hashes of their words.

Defined results: null and empty texts have no words and nothing to remove; texts under
``window`` words keep all; rows with a null doc_id have no place in the order, keep all
words and take none from others; rows that repeat a doc_id count as the same document,
so equal places in them are no copies of each other. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostra.llm.common import as_long, discard, gram_hashes, staged, text_bytes, word_hashes

WINDOW, PHRASE = 20, 10
#: Phrases of one automaton, and words of text that one task streams through it.
SHARD_PHRASES, PART_WORDS = 20_000, 500_000
_NONE = np.uint64(2**64 - 1)


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every n consecutive values."""
    width, m = 1, x
    while width * 2 <= n:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    return np.minimum(m[: len(x) - n + 1], m[n - width :]) if n > width else m


def anchors(w: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """Phrase hashes by start, and each window's anchor."""
    g = gram_hashes(w, phrase)
    return g, sliding_min(g, window - phrase + 1) if len(w) >= window else g[:0]


def _stats(docs: DataFrame) -> DataFrame:
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, n, sha = [], [], []
            for text in batch.column("text"):
                words = text_bytes(text.as_py()).split()
                whole = b" ".join(words)
                key.append(xxhash.xxh3_128_digest(whole))
                n.append(len(words))
                sha.append(hashlib.sha256(whole).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(key, pa.binary()), pa.array(n, pa.int64()), pa.array(sha)], names=["doc_id", "key", "n_words", "sha"])

    return docs.mapInArrow(counted, "doc_id long, key binary, n_words long, sha string")


def _anchored(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """doc_id and its anchors; one that the text repeats is given twice."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text"):
                g, m = anchors(word_hashes(text_bytes(text.as_py()).split()), window, phrase)
                if not len(m):
                    out.append(None)
                    continue
                every, count = np.unique(g, return_counts=True)
                own = np.unique(m)
                out.append(as_long(np.repeat(own, np.minimum(count[np.searchsorted(every, own)], 2))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "anchors"])

    return docs.mapInArrow(found, "doc_id long, anchors array<long>")


def _phrases(texts: DataFrame, phrase: int) -> DataFrame:
    """(shard, phrase): the words of the recurring anchors that a document is the first to have, blanks on both sides."""

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, out = [], []
            for text, own, at in zip(*(batch.column(c).to_pylist() for c in ("text", "own", "source_shard")), strict=True):
                words = text_bytes(text).split()
                g = gram_hashes(word_hashes(words), phrase)
                found = {b" ".join([b"", *words[p : p + phrase], b""]) for p in np.flatnonzero(np.isin(g, np.array(own, np.int64).view(np.uint64)))}
                out += found
                shard += [at] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(out, pa.binary())], names=["shard", "phrase"])

    return texts.where("own is not null").select("text", "own", "source_shard").mapInArrow(spelled, "shard long, phrase binary")


def located(words: list[bytes], machine: ahocorasick.Automaton, phrase: int) -> np.ndarray:
    """Starts of the places where a phrase of the automaton occurs in a text."""
    line = b" ".join([b"", *words, b""]).decode("latin-1")
    ends = np.fromiter((e for e, _ in machine.iter(line)), np.int64)
    # the blank that ends word i is at place[i]; a hit's end is the blank after its last word
    place = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    return np.searchsorted(place, ends) - phrase + 1


def _streamed(window: int, phrase: int):
    """What a part of a shard does: compile the phrases, stream the texts, give the candidate windows."""

    def found(texts: pa.Table, phrases: pa.Table) -> pa.Table:
        machine = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for p in phrases.column("phrase").to_pylist():
            machine.add_word(p.decode("latin-1"))
        ids, at, hashes = [], [], []
        if len(machine):
            machine.make_automaton()
            for i, text in zip(texts.column("doc_id").to_pylist(), texts.column("text"), strict=True):
                words = text_bytes(text.as_py()).split()
                start = located(words, machine, phrase)
                if not len(start) or len(words) < window:
                    continue
                w = word_hashes(words)
                g, m = anchors(w, window, phrase)
                held = np.full(len(g), _NONE)
                held[start] = g[start]
                # a window counts where its own anchor is among the places found
                mine = np.flatnonzero(sliding_min(held, window - phrase + 1) == m)
                if len(mine):
                    ids.append(i)
                    at.append(mine.astype(np.int32))
                    hashes.append(as_long(gram_hashes(w, window)[mine]))
        return pa.table([pa.array(ids, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(hashes, pa.list_(pa.int64()))], names=["doc_id", "starts", "hashes"])

    return found


def _candidates(texts: DataFrame, parts: DataFrame, window: int, phrase: int) -> DataFrame:
    """doc_id, starts and hashes of the windows whose anchor an automaton locates."""
    visits = texts.select("doc_id", "text", F.explode("visits").alias("v")).select("v.shard", "v.part", "doc_id", "text")
    # every part of a shard gets the shard's phrases
    machines = _phrases(texts, phrase).join(parts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "phrase")
    return visits.groupBy("shard", "part").cogroup(machines.groupBy("shard", "part")).applyInArrow(_streamed(window, phrase), "doc_id long, starts array<int>, hashes array<long>")


def covered(n: int, starts: list[int], window: int) -> np.ndarray:
    """Which of n words the windows at the starts cover."""
    mark = np.zeros(n + 1, np.int64)
    at = np.asarray(starts, np.int64)
    np.add.at(mark, at[at + window <= n], 1)
    np.add.at(mark, at[at + window <= n] + window, -1)
    return np.cumsum(mark)[:-1] > 0


def _removed(marked: DataFrame, window: int) -> DataFrame:
    """doc_id, key, n_removed, kept_text of the documents that lose words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, n, kept = [], [], []
            for text, starts in zip(batch.column("text").to_pylist(), batch.column("marked").to_pylist(), strict=True):
                words = text_bytes(text).split()
                gone = covered(len(words), starts, window)
                key.append(xxhash.xxh3_128_digest(b" ".join(words)))
                n.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(key, pa.binary()), pa.array(n, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "key", "n_removed", "kept_text"])

    return marked.mapInArrow(cut, "doc_id long, key binary, n_removed long, kept_text string")


def changes(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> tuple[DataFrame, DataFrame]:
    """(facts, changed): doc_id, key, n_words, sha, copy of every row; and the documents that lose some words."""
    docs = docs.select("doc_id", "text")
    facts = staged(_stats(docs), "facts")
    placed = facts.where("doc_id is not null")
    # a copy is a later text of one id whose words are all those of a smaller id
    first = placed.groupBy("key").agg(F.min("doc_id").alias("first_id"))
    single = placed.groupBy("doc_id").agg(F.min("key").alias("key"), F.max("key").alias("other"), F.min("n_words").alias("n_words")).where("key = other")
    copies = staged(single.where(F.col("n_words") >= window).join(first, "key").where("doc_id > first_id").select("doc_id"), "copies")

    named = docs.where("doc_id is not null")
    held = staged(_anchored(named, window, phrase), "held")
    rows = held.select("doc_id", F.explode("anchors").alias("anchor"))
    recurring = staged(rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("source")).where("n > 1").select("anchor", "source"), "anchors")
    shard = F.pmod(F.xxhash64("source"), F.lit(max(1, -(-recurring.count() // SHARD_PHRASES))))
    visits = staged(rows.join(recurring, "anchor").select("doc_id", shard.alias("shard")).distinct().join(copies, "doc_id", "left_anti"), "visits")
    words = placed.groupBy("doc_id").agg(F.sum("n_words").alias("n"))
    parts = staged(visits.join(words, "doc_id").groupBy("shard").agg(F.ceil(F.sum("n") / PART_WORDS).cast("int").alias("parts")), "parts")
    at = F.struct("shard", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"))
    plan = visits.join(parts, "shard").groupBy("doc_id").agg(F.collect_list(at).alias("visits"))
    own = recurring.groupBy(F.col("source").alias("doc_id")).agg(F.collect_list("anchor").alias("own"), F.first(shard).alias("source_shard"))
    texts = staged(named.join(plan.join(own, "doc_id", "left"), "doc_id"), "texts")
    discard(held, recurring, visits)
    seen = staged(_candidates(texts, parts, window, phrase), "windows")

    places = seen.select("doc_id", F.explode(F.arrays_zip("starts", "hashes")).alias("w")).select(F.col("w.hashes").alias("hash"), "doc_id", F.col("w.starts").alias("start"))
    firsts = staged(
        places.groupBy("hash").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("hash", F.col("first.doc_id").alias("first_id"), F.col("first.start").alias("first_start")),
        "firsts",
    )
    later = places.join(firsts, "hash").where((F.col("doc_id") > F.col("first_id")) | ((F.col("doc_id") == F.col("first_id")) & (F.col("start") > F.col("first_start"))))
    marked = texts.select("doc_id", "text").join(later.groupBy("doc_id").agg(F.collect_set("start").alias("marked")), "doc_id")
    flags = copies.withColumn("copy", F.lit(True))
    return facts.join(flags, "doc_id", "left").withColumn("copy", F.coalesce("copy", F.lit(False))), _removed(marked, window)


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of ``docs``."""
    facts, changed = changes(docs, window)
    small = changed.select("doc_id", "key", "n_removed", F.sha2("kept_text", 256).alias("kept_sha")).dropDuplicates(["doc_id", "key"])
    both = facts.join(small, ["doc_id", "key"], "left")
    return both.select(
        "doc_id",
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
    )


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS s FROM w WHERE len(ws) >= 20),
g AS (SELECT p.doc_id, s, array_to_string(ws[s:s + 19], ' ') AS x FROM p JOIN w USING (doc_id)),
l AS (SELECT doc_id, s, x, row_number() OVER (PARTITION BY x ORDER BY doc_id, s) AS k FROM g),
c AS (SELECT DISTINCT doc_id, s + i AS pos FROM l, range(0, 20) t(i) WHERE k > 1),
a AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS pos FROM w),
r AS (SELECT a.doc_id, count(c.pos) AS gone, coalesce(string_agg(x, ' ' ORDER BY a.pos) FILTER (c.pos IS NULL), '') AS kept
  FROM a LEFT JOIN c ON a.doc_id = c.doc_id AND a.pos = c.pos GROUP BY a.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)
"""
