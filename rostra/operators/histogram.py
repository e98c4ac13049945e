"""Daily counts of a term over dated documents, zero-filled, and compared with the period before."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rostra.constants import TOKEN_LIMIT
from rostra.functions import text as X
from rostra.operators.index import Index


def date_range(start: str | None = None, end: str | None = None, days_ago: int = 30, as_of: dt.date | None = None) -> tuple[dt.date, dt.date]:
    """Both dates if both are given, else the ``days_ago`` days up to ``as_of`` (today, UTC)."""
    if start and end:
        return dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    last = as_of or dt.datetime.now(dt.UTC).date()
    return last - dt.timedelta(days=days_ago), last


def in_range(docs: DataFrame, start: dt.date, end: dt.date, day: str = "date_issued") -> DataFrame:
    """Documents of the days from start to end, both included; reaches the scan as a filter."""
    return docs.where(F.col(day).between(F.lit(start), F.lit(end)))


def _matches(content: str, term: str, mode: str) -> Column:
    return X.has_phrase(content, term) if mode == "intent" else X.has_term(content, term)


def _count(content: str, term: str, limit: int | None, mode: str) -> Column:
    """Occurrences; the limit on tokens is historical behaviour, so intent mode counts the whole text."""
    limit = None if mode == "intent" else limit
    if mode == "intent" and len(X.analyzed_words(term)) > 1:
        return X.phrase_count(content, term)
    return X.token_count(content, term, limit)


def term_counts(docs: DataFrame | Index, term: str, start: dt.date, end: dt.date, limit: int | None = TOKEN_LIMIT, mode: str = "compat") -> DataFrame:
    """(date, count): tokens equal to the term, by day, in documents whose words include it.

    In compat mode a term of several words occurs nowhere; in intent mode it is a phrase. From
    an index the counts of its days are read, and no text.
    """
    if isinstance(docs, Index):
        return docs.term_counts(term, start, end, limit, mode)
    hits = in_range(docs, start, end).where(_matches("content", term, mode))
    return hits.groupBy(F.col("date_issued").alias("date")).agg(F.sum(_count("content", term, limit, mode)).cast("long").alias("count"))


def calendar(spark, start: dt.date, end: dt.date) -> DataFrame:
    """One row for each day from start to end; none if they are reversed."""
    if end < start:
        return spark.createDataFrame([], "date date")
    return spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("date"))


def _session(docs: DataFrame | Index) -> SparkSession:
    return docs.spark if isinstance(docs, Index) else docs.sparkSession


def dense_term_counts(docs: DataFrame | Index, term: str, start: dt.date, end: dt.date, limit: int | None = TOKEN_LIMIT, mode: str = "compat") -> DataFrame:
    """The histogram with every day of the range, in order."""
    days = calendar(_session(docs), start, end)
    return days.join(term_counts(docs, term, start, end, limit, mode), "date", "left").select("date", F.coalesce("count", F.lit(0)).cast("long").alias("count")).orderBy("date")


def periods(start: dt.date, end: dt.date, days_ago: int = 30) -> dict[str, tuple[dt.date, dt.date]]:
    """The current period and the same one ``days_ago`` days earlier; they may share days."""
    back = dt.timedelta(days=days_ago)
    return {"current": (start, end), "previous": (start - back, end - back)}


def period_breakdown(docs: DataFrame | Index, term: str, start: dt.date, end: dt.date, days_ago: int = 30, mode: str = "compat", limit: int | None = TOKEN_LIMIT) -> DataFrame:
    """(period, date, count) of both periods; one scan, as days of both periods are counted once."""
    p = periods(start, end, days_ago)
    days = None
    for name, (a, b) in p.items():
        part = calendar(_session(docs), a, b).select(F.lit(name).alias("period"), "date")
        days = part if days is None else days.unionByName(part)
    counts = term_counts(docs, term, min(a for a, _ in p.values()), max(b for _, b in p.values()), limit, mode)
    return days.join(counts, "date", "left").select("period", "date", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def period_delta(docs: DataFrame | Index, term: str, start: dt.date, end: dt.date, days_ago: int = 30, limit: int | None = TOKEN_LIMIT, mode: str = "compat") -> DataFrame:
    """One row: totals of both periods and the change in per cent, cut towards zero; one scan."""
    p = periods(start, end, days_ago)
    low, high = min(a for a, _ in p.values()), max(b for _, b in p.values())
    if isinstance(docs, Index):
        hits = docs.term_counts(term, low, high, limit, mode).select(F.col("date").alias("date_issued"), F.col("count").alias("n"))
    else:
        hits = in_range(docs, low, high).where(_matches("content", term, mode)).select("date_issued", _count("content", term, limit, mode).alias("n"))
    total = {k: F.coalesce(F.sum(F.when(F.col("date_issued").between(F.lit(a), F.lit(b)), F.col("n"))), F.lit(0)).cast("long") for k, (a, b) in p.items()}
    return hits.agg(total["current"].alias("current_total"), total["previous"].alias("previous_total")).withColumn(
        "delta", (100 * ((F.col("current_total") - F.col("previous_total")) / F.greatest("previous_total", F.lit(1)))).cast("int")
    )
