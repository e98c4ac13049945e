"""Phrase search with BM25 ranking and pages."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostra.functions import text as X
from rostra.operators.histogram import in_range
from rostra.operators.index import Index, bm25_score, places

K1, B = 1.2, 0.75
FIELDS = ("title", "speaker", "content")


def field_filters(fields: dict[str, str], mode: str = "compat") -> dict[str, str]:
    """Column and phrase of the fields that may be searched and are not empty.

    No column is called speaker: in compat mode such a search finds nothing, in intent mode
    it looks into the speakers.
    """
    kept = {k: v for k, v in fields.items() if k in FIELDS and v}
    if "speaker" in kept and mode == "intent":
        kept["speakers"] = kept.pop("speaker")
    return kept


def _column(docs: DataFrame, name: str) -> Column | None:
    if name not in docs.columns:
        return None
    return F.concat_ws(" ", name) if docs.schema[name].dataType.typeName() == "array" else F.col(name)


def phrase_filter(docs: DataFrame, fields: dict[str, str], mode: str = "compat") -> DataFrame:
    """Documents in which every field has its phrase."""
    tests = [F.lit(False) if (c := _column(docs, k)) is None else X.has_phrase(c, v) for k, v in field_filters(fields, mode).items()]
    return docs.where(reduce(lambda a, b: a & b, tests)) if tests else docs


def bm25(docs: DataFrame, phrase: str, content: str = "content") -> DataFrame:
    """``docs`` with ``score``; statistics cover all rows of ``docs``.

    A phrase's weight is the sum of its words' inverse document frequencies. The
    statistics are one row and are joined as such.
    """
    words = X.analyzed_words(phrase)
    if not words:
        return docs.withColumn("score", F.lit(0.0))
    found = docs.withColumn("_words", X.analyze(F.coalesce(F.col(content), F.lit(""))))
    n = F.count(F.lit(1)).cast("double")
    df = [F.count_if(F.array_contains("_words", w)).cast("double").alias(f"_df{i}") for i, w in enumerate(words)]
    stats = found.agg(n.alias("_n"), F.avg(F.size("_words")).alias("_avg"), *df)
    idf = reduce(lambda a, b: a + b, [F.log(1 + (F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5)) for i in range(len(words))])
    tf = X.phrase_count(content, phrase, F.col("_words")).cast("double")
    score = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.size("_words") / F.greatest("_avg", F.lit(1e-9))))
    return found.crossJoin(F.broadcast(stats)).withColumn("score", F.coalesce(score, F.lit(0.0))).drop("_words", "_n", "_avg", *[f"_df{i}" for i in range(len(words))])


def page(df: DataFrame, size: int = 10, offset: int = 0, key: str = "crec_id") -> DataFrame:
    """One page by falling score, ties by key."""
    return df.orderBy(F.col("score").desc(), key).offset(int(offset)).limit(int(size))


def search(docs: DataFrame, fields: dict[str, str], start: dt.date, end: dt.date, size: int = 10, offset: int = 0, mode: str = "compat", index: Index | None = None) -> DataFrame:
    """A page of the documents of the range whose fields have the phrases, best first.

    With an index of the contents no text is read but those of the page: the index finds and
    ranks, other fields narrow its hits by their own columns, and the page's rows alone are fetched.
    """
    phrase = " ".join(v for k, v in field_filters(fields, mode).items() if k == "content")
    if index is not None and phrase:
        return _from_index(docs, index, phrase, {k: v for k, v in fields.items() if k != "content"}, start, end, size, offset, mode)
    ranked = bm25(docs, phrase) if phrase else docs.withColumn("score", F.lit(1.0))
    return page(phrase_filter(in_range(ranked, start, end), fields, mode), size, offset)


def _from_index(docs: DataFrame, index: Index, phrase: str, others: dict[str, str], start: dt.date, end: dt.date, size: int, offset: int, mode: str, key: str = "crec_id") -> DataFrame:
    found = index.hits(phrase, start, end).select(F.col("key").alias(key), "score")
    own = in_range(docs, start, end)
    if field_filters(others, mode):
        found = found.join(phrase_filter(own, others, mode).select(key), key, "left_semi")
    # a page has ``size`` rows, so it may be broadcast to where its documents are
    best = page(found, size, offset, key)
    return own.join(F.broadcast(best), key).select(*docs.columns, "score").orderBy(F.col("score").desc(), key)


def hits(df: DataFrame) -> DataFrame:
    """Documents of a page with their day as text."""
    return df.withColumn("date_issued", F.date_format("date_issued", "yyyy-MM-dd"))


def postings(docs: DataFrame, key: str = "crec_id", content: str = "content", keep: Sequence[str] = ()) -> DataFrame:
    """(term, key, tf, positions, length) of every word of every document, with the columns ``keep`` of the document.

    Keys are taken as unique. Positions start at 0; length is the document's number of words.
    """
    found = docs.select(key, *keep, X.analyze(content).alias("_words"))
    words = found.select(key, *keep, F.size("_words").alias("length"), F.posexplode("_words").alias("pos", "term"))
    return words.groupBy("term", key, *keep, "length").agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def statistics(docs: DataFrame, content: str = "content") -> DataFrame:
    """One row: the number of documents and their average number of words; a null text has none."""
    length = F.size(X.analyze(F.coalesce(F.col(content), F.lit(""))))
    return docs.agg(F.count(F.lit(1)).alias("n"), F.avg(length).alias("avg_length"))


def phrase_hits(found: DataFrame, stats: DataFrame, phrase: str, key: str = "crec_id", keep: Sequence[str] = ()) -> DataFrame:
    """(key, keep, tf, score) of the documents that hold the phrase, from postings; no text is read.

    Scores are those of :func:`bm25`. The words of a phrase meet in one shuffle by key, in
    which a document has as many rows as the phrase has different words.
    """
    words = X.analyzed_words(phrase)
    distinct = list(dict.fromkeys(words))
    rows = found.where(F.col("term").isin(distinct))
    df = rows.agg(*[F.count_if(F.col("term") == w).cast("double").alias(f"_df{i}") for i, w in enumerate(words)]) if words else None
    held = rows.groupBy(key, *keep, "length").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("_at"))
    if df is None:
        return held.select(key, *keep, F.lit(0).alias("tf"), F.lit(0.0).alias("score"))
    hits = held.where(F.size("_at") == len(distinct)).withColumn("tf", places(words)).where("tf > 0")
    one = df.crossJoin(stats)
    return hits.crossJoin(F.broadcast(one)).select(key, *keep, "tf", bm25_score(len(words), F.col("n"), F.col("avg_length"), K1, B).alias("score"))
