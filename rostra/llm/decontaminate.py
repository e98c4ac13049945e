"""Benchmark decontamination by the q-gram lemma.

An item of m bytes that occurs in a text with at most k edits shares at least
m + 1 - q - k*q of its q-grams with that place, on diagonals (position in the text less
position in the item) that differ by at most k. Shared q-grams are counted in bands of
2(k+1) diagonals that overlap by half, so one band holds any such place whole; bands that
reach the bound are verified by alignment of the whole item inside the band, widened by k
diagonals on either side for edits at the ends.

Texts and items are compared as UTF-8 with A-Z in lower case and ASCII white space as
blanks; positions are bytes of that form, which are bytes of the text. The edit budget k
is a tenth of the item's bytes, and less for items under about 56 bytes, of which the
lemma must still ask ``LEAST`` shared q-grams: 2 edits for 30 bytes, none under 20.

A q-gram that more than ``COMMON`` items of a group have would send every text to all of
them. The commonest of these are left out of the index, and the bound of an item falls by
the number of its q-grams left out, so that nothing is lost; no bound falls under ``LEAST``.
Items under ``SHORT`` bytes are found only as whole words, and those without a q-gram (under
8 bytes) only verbatim; both are marked ``short``, as they are little evidence, and no
document is dropped for them.

Documents are never shuffled. Items go to the tasks in groups of at most ``GROUP_BYTES``;
a larger benchmark takes more passes over the documents, one a group. An index takes
about 20 times its text, 80 MB at most, and texts are looked at in steps of ``_STEP`` bytes.

Defined results: null and empty texts match nothing; null and empty items match nothing;
very long texts are searched whole; repeated documents give repeated rows; items with the
same text each match. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostra.llm.common import text_bytes

Q, LEAST = 8, 4
EDIT_SHARE = 0.1
SHORT = 24
COMMON = 64
GROUP_BYTES = 4_000_000
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz     ")
_BITS = 24
_MULT = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text that one vectorised step looks at.
_STEP = 1 << 21
#: Text and item pairs that are counted in a dense array; more are sorted.
_CELLS = 1 << 21


def fold(text: str | None) -> bytes:
    return text_bytes(text).translate(_FOLD)


def _grams(b: np.ndarray) -> np.ndarray:
    """The Q bytes from each position as one number."""
    x = b.astype(np.uint64)
    for width in (1, 2, 4):
        x = x[:-width] | (x[width:] << np.uint64(8 * width)) if len(x) > width else x[:0]
    return x


def budget(m: int, share: float = EDIT_SHARE) -> int:
    """Edits allowed in m bytes; never so many that the lemma would ask for under ``LEAST`` q-grams."""
    return max(0, min(int(m * share), (m + 1 - Q - LEAST) // Q))


@dataclass
class Index:
    """Items with q-grams: their postings by q-gram; and the items without, as words to look up."""

    ids: list
    texts: list[bytes]
    edits: np.ndarray
    need: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    item: np.ndarray
    pos: np.ndarray
    filled: np.ndarray
    tiny: dict[str, list[int]]

    @staticmethod
    def of(rows: list[tuple[object, bytes]]) -> Index:
        rows = sorted(((i, t.strip(b" ")) for i, t in rows if t.strip(b" ")), key=lambda r: (str(r[0]), r[1]))
        texts = [t for _, t in rows]
        grams = [_grams(np.frombuffer(t, np.uint8)) for t in texts]
        every = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        count = np.array([len(g) for g in grams], np.int64)
        item = np.repeat(np.arange(len(texts), dtype=np.int32), count)
        pos = np.concatenate([np.arange(len(g), dtype=np.int32) for g in grams]) if grams else np.empty(0, np.int32)
        edits = np.array([budget(len(t)) for t in texts], np.int64)
        need = count - Q * edits
        # q-grams of very many items are left out, the commonest first, as far as an item's bound allows
        _, inverse = np.unique(every, return_inverse=True)
        holders = np.zeros(inverse.max() + 1 if len(inverse) else 0, np.int64)
        pair = np.unique(np.stack([inverse, item]), axis=1) if len(inverse) else np.empty((2, 0), np.int64)
        np.add.at(holders, pair[0], 1)
        count_of = holders[inverse]
        ranked = np.lexsort((-count_of, item))
        rank = np.empty(len(every), np.int64)
        rank[ranked] = np.arange(len(every)) - np.repeat(np.cumsum(count) - count, count)
        drop = (count_of > COMMON) & (rank < (need - LEAST)[item]) if len(texts) else np.zeros(0, bool)
        need = need - np.bincount(item[drop], minlength=len(texts))
        every, item, pos = every[~drop], item[~drop], pos[~drop]
        order = np.argsort(every, kind="stable")
        keys, first = np.unique(every[order], return_index=True)
        filled = np.zeros(1 << _BITS, bool)
        filled[(keys * _MULT) >> np.uint64(64 - _BITS)] = True
        tiny: dict[str, list[int]] = {}
        for i, t in enumerate(texts):
            if len(t) < Q:
                tiny.setdefault((b" " + t + b" ").decode("latin-1"), []).append(i)
        return Index([i for i, _ in rows], texts, edits, need, keys, np.append(first, len(every)), item[order], pos[order], filled, tiny)

    def short(self, i: int) -> bool:
        return len(self.texts[i]) < SHORT

    def words(self) -> ahocorasick.Automaton | None:
        """The items without q-grams, to be found between blanks."""
        if not self.tiny:
            return None
        machine = ahocorasick.Automaton()
        for word, items in self.tiny.items():
            machine.add_word(word, (len(word) - 2, items))
        machine.make_automaton()
        return machine


_FAR = np.int64(1 << 40)


def align(item: bytes, text: bytes, most: int, low: int | None = None, high: int | None = None) -> tuple[int, int, int] | None:
    """Fewest edits between the whole item and a stretch of the text, its start and end; None above ``most``.

    Only paths on the diagonals from ``low`` to ``high`` (place in the text less place in the
    item) are looked at: for each byte of the item one step over the band's width.
    """
    n, m = len(text), len(item)
    low, high = max(-m, -m if low is None else low), min(n, n if high is None else high)
    if high < low:
        return None
    # most places are verbatim; the first on these diagonals is the best path
    at = text.find(item, max(0, low), high + m)
    if at >= 0:
        return 0, at, at + m
    wide = high - low + 1
    t = np.full(n + m + wide + 1, -1, np.int64)
    t[m : m + n] = np.frombuffer(text, np.uint8)  # the text with room before and behind
    # cost and start of the best path share one number, so that the running minimum carries both
    unit = np.int64(n + m + 2)
    at = np.arange(low, high + 1)
    steps = np.arange(wide) * unit
    state = np.where((at >= 0) & (at <= n), at, _FAR * unit)
    for i, c in enumerate(item):
        cross = state + (t[m + i + low : m + i + low + wide] != c) * unit
        cross[:-1] = np.minimum(cross[:-1], state[1:] + unit)
        cross = np.minimum.accumulate(cross - steps) + steps
        there = at + i + 1
        state = np.where((there >= 0) & (there <= n), cross, _FAR * unit)
        if state.min() // unit > most:
            return None
    end = int(np.argmin(state // unit))
    cost = int(state[end] // unit)
    return (cost, int(state[end] % unit), int(at[end]) + m) if cost <= most else None


def search(index: Index, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
    """(text, item, edits, start, end) of every place; overlapping places of one item keep the best."""
    if not index.texts:
        return []
    found: list[tuple[int, int, int, int, int]] = []
    machine = index.words()
    if machine is not None:
        for d, t in enumerate(texts):
            for end, (n, items) in machine.iter(f" {t.decode('latin-1')} "):
                found += [(d, i, 0, end - 1 - n, end - 1) for i in items]
    lo = 0
    while lo < len(texts):
        hi, held = lo, 0
        while hi < len(texts) and (hi == lo or held + len(texts[hi]) <= _STEP):
            held += len(texts[hi]) + Q
            hi += 1
        found += _search(index, texts, lo, hi)
        lo = hi
    return found


def _whole(text: bytes, start: int, end: int) -> bool:
    """Whether no letter or digit goes on over either end of a stretch."""
    inside = lambda k: 0 < k < len(text) and all(chr(c).isalnum() or c > 127 for c in text[k - 1 : k + 1])
    return not inside(start) and not inside(end)


def _search(index: Index, texts: list[bytes], lo: int, hi: int) -> list[tuple[int, int, int, int, int]]:
    joined = (b"\0" * Q).join(texts[lo:hi])
    x = _grams(np.frombuffer(joined, np.uint8))
    at = np.flatnonzero(index.filled[(x * _MULT) >> np.uint64(64 - _BITS)])
    k = np.searchsorted(index.keys, x[at])
    k[k == len(index.keys)] = 0
    good = index.keys[k] == x[at]
    at, k = at[good], k[good]
    if not len(at):
        return []
    many = index.first[k + 1] - index.first[k]
    place = np.repeat(at, many)
    entry = np.repeat(index.first[k] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
    item = index.item[entry]
    begins = np.cumsum([0, *(len(t) + Q for t in texts[lo:hi])])
    doc = np.repeat(np.searchsorted(begins, at, "right") - 1, many)
    # no band can reach the bound where the whole text does not
    pair, cells = doc * len(index.texts) + item, (hi - lo) * len(index.texts)
    if cells <= _CELLS:
        count = np.bincount(pair, minlength=cells)
    else:
        _, pair, count = np.unique(pair, return_inverse=True, return_counts=True)
    good = count[pair] >= index.need[item]
    if not good.any():
        return []
    place, entry, item, doc = place[good], entry[good], item[good], doc[good]
    band = (place - index.pos[entry]) // (index.edits[item] + 1)
    # each shared q-gram counts in its band and in the one before, which overlaps it
    rows = np.stack([np.tile(doc, 2), np.tile(item, 2), np.concatenate([band, band - 1])])
    order = np.lexsort(rows[::-1])
    rows = rows[:, order]
    cut = np.flatnonzero(np.concatenate(([True], (rows[:, 1:] != rows[:, :-1]).any(0))))
    count = np.diff(np.append(cut, rows.shape[1]))
    keep = cut[count >= index.need[rows[1, cut]]]
    out: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for d, i, j in rows[:, keep].T.tolist():
        edits, m = int(index.edits[i]), len(index.texts[i])
        low, high = j * (edits + 1) - edits - int(begins[d]), (j + 2) * (edits + 1) - 1 + edits - int(begins[d])
        text = texts[lo + d]
        left = max(0, low)
        hit = align(index.texts[i], text[left : max(0, high + m)], edits, low - left, high - left)
        if hit and (m >= SHORT or _whole(text, hit[1] + left, hit[2] + left)):
            out.setdefault((d, i), []).append((hit[0], hit[1] + left, hit[2] + left))
    found = []
    for (d, i), hits in out.items():
        taken: list[tuple[int, int]] = []
        for edits, a, b in sorted(set(hits)):
            if all(b <= s or a >= e for s, e in taken):
                taken.append((a, b))
                found.append((lo + d, i, edits, a, b))
    return found


def item_groups(benchmark: DataFrame, group_bytes: int = GROUP_BYTES) -> Iterator[Index]:
    """Indexes of the items, each of at most about ``group_bytes``, by hash of the item."""
    items = benchmark.select("item_id", "text").where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + int(size) // group_bytes
    for g in range(n):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == g) if n > 1 else items
        yield Index.of([(r["item_id"], fold(r["text"])) for r in part.collect()])


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every place of a benchmark item in a document: doc_id, item_id, edits, start, length (bytes), short."""
    spark = docs.sparkSession
    out = None
    for index in item_groups(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def places(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                hits = search(index, [fold(t) for t in batch.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array([h[0] for h in hits], pa.int64())),
                        pa.array([index.ids[h[1]] for h in hits], pa.int64()),
                        pa.array([h[2] for h in hits], pa.int32()),
                        pa.array([h[3] for h in hits], pa.int64()),
                        pa.array([h[4] - h[3] for h in hits], pa.int64()),
                        pa.array([index.short(h[1]) for h in hits], pa.bool_()),
                    ],
                    names=["doc_id", "item_id", "edits", "start", "length", "short"],
                )

        part = docs.select("doc_id", "text").mapInArrow(places, "doc_id long, item_id long, edits int, start long, length long, short boolean")
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents in which an item occurs that is not short."""
    spark = docs.sparkSession
    for index in item_groups(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                hit = {h[0] for h in search(index, [fold(t) for t in batch.column("text").to_pylist()]) if not index.short(h[1])}
                yield batch.filter(pa.array([i not in hit for i in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
