"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Every passage is encoded as the histogram
of its character-class pairs and a few repetition figures; a tanh layer embeds it, gated
attention (tanh and sigmoid branches multiplied) weighs the passages of a bag, and a
logistic unit scores the weighted sum. Labels exist only for documents; the attention
learns from them which passages speak.

Fitting uses at most ``MAX_BAGS`` labelled documents of each class, those with the
smallest hash of (seed, doc_id), and of these at most ``MAX_BYTES`` of whole texts a class;
one task fits, and only the weights reach the driver. Scoring reads every whole text once,
without a shuffle.

Defined results: null or empty text is a bag with one empty passage and gets a score;
a null doc_id is scored, is never held out and never used to learn; repeated rows get
the same score; labels that repeat count once with their smallest value, and of rows that
repeat a labelled id the smallest text; without labels of both classes every score is 1.0.
Very long texts have as many passages as they need. Other columns of the inputs are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rostra.llm.common import text_bytes

#: Labelled documents of each class that a fit may use, and bytes of their texts.
MAX_BAGS, MAX_BYTES = 1500, 16_000_000
#: Words in a passage.
PASSAGE = 64
KEEP = 0.3

_GROUPS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r\x0b\x0c", b".", b",;:", b"!?", b"$", b"*", b"%", b"&", b"#", b"|<>[]{}_=+~^@/\\", b"'\"()-`"]
_CLASS = np.full(256, 15, np.int64)
for _i, _g in enumerate(_GROUPS):
    _CLASS[np.frombuffer(_g, np.uint8)] = _i
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
#: Class pairs, then: words like the one before, distinct words, mean word length, fill.
WIDTH = 256 + 4


def encode(text: str | None) -> np.ndarray:
    """One row for each passage of a text, in order; one row for a text without words."""
    raw = text_bytes(text)
    words = raw.split()
    if not words:
        return np.zeros((1, WIDTH), np.float32)
    b = np.frombuffer(raw, np.uint8)
    blank = _BLANK[b]
    starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))[::PASSAGE]
    n = len(starts)
    sizes = np.diff(np.concatenate(([0], starts[1:], [len(b)])))
    c = _CLASS[b]
    pairs = np.repeat(np.arange(n) * 256, sizes)
    pairs[1:] += c[:-1] * 16 + c[1:]
    hist = np.bincount(pairs[1:], minlength=n * 256).reshape(n, 256).astype(np.float32)
    out = np.empty((n, WIDTH), np.float32)
    out[:, :256] = np.sqrt(hist / np.maximum(hist.sum(1, keepdims=True), 1))
    same = np.fromiter(map(eq, words, [None, *words[:-1]]), np.float32, len(words))
    at = np.arange(0, len(words), PASSAGE)
    held = np.minimum(PASSAGE, len(words) - at)
    out[:, 256] = np.add.reduceat(same, at) / held
    out[:, 257] = [len(set(words[i : i + PASSAGE])) for i in at] / held
    out[:, 258] = np.minimum(sizes / held / 20, 1)
    out[:, 259] = held / PASSAGE
    return out


@dataclass
class Model:
    """Parameters of the network; ``None`` in ``u`` marks a fit without both classes."""

    mean: np.ndarray
    scale: np.ndarray
    e: np.ndarray
    eb: np.ndarray
    a: np.ndarray
    g: np.ndarray
    w: np.ndarray
    u: np.ndarray | None
    c: float

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        if self.u is None:
            return np.ones(len(bags))
        if not bags:
            return np.empty(0)
        at = np.cumsum([0, *map(len, bags)])[:-1]
        return _forward(self, (np.concatenate(bags) - self.mean) / self.scale, at)[-1]


def _forward(m: Model, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    h = np.tanh(x @ m.e + m.eb)
    t, s = np.tanh(h @ m.a), 1 / (1 + np.exp(-(h @ m.g)))
    logit = (t * s) @ m.w
    sizes = np.diff(np.append(at, len(x)))
    up = np.exp(logit - np.repeat(np.maximum.reduceat(logit, at), sizes))
    alpha = up / np.repeat(np.add.reduceat(up, at), sizes)
    z = np.add.reduceat(h * alpha[:, None], at)
    return h, t, s, alpha, sizes, z, 1 / (1 + np.exp(-np.clip(z @ m.u + m.c, -30, 30)))


def fit(bags: list[np.ndarray], labels: np.ndarray, *, hidden: int = 16, gate: int = 8, rounds: int = 60, batch: int = 128, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Model:
    """Adam on the logistic loss; classes weigh the same. The order of bags is fixed by the caller."""
    rng = np.random.default_rng(seed)
    if len(np.unique(labels)) < 2:
        return Model(np.zeros(WIDTH), np.ones(WIDTH), *[np.zeros(0)] * 5, None, 0.0)
    every = np.concatenate(bags)
    mean, scale = every.mean(0, dtype=np.float64), every.std(0, dtype=np.float64) + 0.02
    del every
    m = Model(mean, scale, rng.normal(0, WIDTH**-0.5, (WIDTH, hidden)), np.zeros(hidden), rng.normal(0, 0.3, (hidden, gate)), rng.normal(0, 0.3, (hidden, gate)), rng.normal(0, 0.3, gate), rng.normal(0, 0.3, hidden), 0.0)
    bags = [((x - mean) / scale).astype(np.float32) for x in bags]
    weight = np.where(labels == 1, 0.5 / max((labels == 1).mean(), 1e-9), 0.5 / max((labels == 0).mean(), 1e-9))
    names = ("e", "eb", "a", "g", "w", "u", "c")
    first = {k: 0.0 for k in names}
    second = {k: 0.0 for k in names}
    step = 0
    for _ in range(rounds):
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), batch):
            pick = order[lo : lo + batch]
            x = np.concatenate([bags[i] for i in pick])
            at = np.cumsum([0, *(len(bags[i]) for i in pick)])[:-1]
            h, t, s, alpha, sizes, z, p = _forward(m, x, at)
            d = (p - labels[pick]) * weight[pick] / len(pick)
            dz = np.repeat(d, sizes)[:, None] * m.u
            dalpha = (dz * h).sum(1)
            dlogit = alpha * (dalpha - np.repeat(np.add.reduceat(alpha * dalpha, at), sizes))
            dt, ds = dlogit[:, None] * m.w * s * (1 - t * t), dlogit[:, None] * m.w * t * s * (1 - s)
            dh = (dz * alpha[:, None] + dt @ m.a.T + ds @ m.g.T) * (1 - h * h)
            grads = {"e": x.T @ dh, "eb": dh.sum(0), "a": h.T @ dt, "g": h.T @ ds, "w": (dlogit[:, None] * t * s).sum(0), "u": z.T @ d, "c": d.sum()}
            step += 1
            for k in names:
                v = getattr(m, k)
                grad = grads[k] + decay * v
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                setattr(m, k, v - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8))
    return m


def held_out(doc_id: str = "doc_id"):
    """Rows whose crc32 of the id as text is divisible by 5 never teach the model."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_bags: int = MAX_BAGS, seed: int = 7) -> Model:
    """Fit on the bounded sample of labelled rows that are not held out."""
    known = (
        labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
        .where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .withColumn("_h", F.xxhash64(F.lit(seed), F.col("doc_id")))
    )
    # orderBy with limit keeps the smallest hashes of each task only; 2 * max_bags small rows in all
    sample = [known.where(F.col("quality") == q).orderBy("_h", "doc_id").limit(max_bags) for q in (0, 1)]
    ids = sample[0].unionByName(sample[1])
    texts = (
        docs.select("doc_id", "text")
        .join(F.broadcast(ids), "doc_id")
        .groupBy("doc_id", "quality", "_h")
        .agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
        .withColumn("size", F.octet_length("text"))
    )
    # whole texts by rising hash, as long as they fit; the first always does
    so_far = F.sum("size").over(Window.partitionBy("quality").orderBy("_h", "doc_id"))
    texts = texts.withColumn("upto", so_far).where((F.col("upto") <= MAX_BYTES) | (F.col("upto") == F.col("size"))).select("doc_id", "quality", "text")

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(i, q, encode(t)) for batch in batches for i, q, t in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "quality", "text")), strict=True)]
        rows.sort(key=lambda r: r[0])
        model = fit([x for _, _, x in rows], np.array([q for _, q, _ in rows], float), seed=seed)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    row = texts.coalesce(1).mapInArrow(fitted, "model binary").first()
    return pickle.loads(row["model"]) if row else fit([], np.empty(0), seed=seed)


def _scores(model: Model, text: pa.Array) -> np.ndarray:
    """Scores of a column of texts, 256 bags at a time."""
    s = np.empty(len(text))
    for lo in range(0, len(s), 256):
        s[lo : lo + 256] = model.score([encode(t) for t in text[lo : lo + 256].to_pylist()])
    return s


def score(docs: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """The input's other columns with ``score`` and ``predicted``; one pass, no shuffle."""
    schema = docs.drop("score", "predicted").schema
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _scores(shared.value, batch.column("text"))
            more = [pa.array(s), pa.array((s >= keep).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "score", "predicted"])

    return docs.select(*schema.fieldNames()).mapInArrow(scored, T.StructType([*schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def classify(docs: DataFrame, labels: DataFrame, max_bags: int = MAX_BAGS, keep: float = KEEP) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    model = train(docs, labels, max_bags)
    out = score(docs.select("doc_id", "text", held_out().alias("held_out")), model, keep)
    return out.select("doc_id", "held_out", "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, max_bags: int = MAX_BAGS, keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_bags))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(shared.value, batch.column("text")) >= keep))

    return docs.mapInArrow(kept, docs.schema)
