"""The result page: both periods, the change, and a page of enriched hits."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostra.constants import TOKEN_LIMIT
from rostra.functions import text as X
from rostra.operators import histogram, people, search
from rostra.operators.index import Index


def enriched(hits: DataFrame, phrase: str) -> DataFrame:
    """Hits with the number of mentions, the phrase, a readable date and a snippet."""
    return hits.withColumns({"mentions": X.mentions("content", phrase), "search_phrase": F.lit(phrase), "human_date": X.human_date("date_issued"), "snippet": X.snippet("content", phrase)})


def result_page(docs: DataFrame, persons: DataFrame, terms: DataFrame, phrase: str, start: dt.date, end: dt.date, days_ago: int = 30, size: int = 10, offset: int = 0, mode: str = "compat", limit: int | None = TOKEN_LIMIT, index: Index | None = None) -> dict[str, DataFrame]:
    """The parts of a page as DataFrames: breakdown, totals, docs; with an index of the contents, from that."""
    q = phrase.strip().lower()
    hits = enriched(search.search(docs, {"content": q}, start, end, size, offset, mode, index), q)
    counted = docs if index is None else index
    return {
        "breakdown": histogram.period_breakdown(counted, q, start, end, days_ago, mode, limit),
        "totals": histogram.period_delta(counted, q, start, end, days_ago, limit, mode),
        "docs": people.match_speakers(hits, persons, terms, mode=mode) if "speakers" in docs.columns else hits,
    }


def envelope(rows: DataFrame, status: str | None = "success") -> DataFrame:
    """One JSON text of all rows, which a page bounds, with or without a status."""
    data = rows.agg(F.collect_list(F.struct(*rows.columns)).alias("data"))
    parts = [F.lit(status).alias("status")] if status else []
    return data.select(F.to_json(F.struct(*parts, "data")).alias("json"))


def list_items(docs: DataFrame) -> DataFrame:
    """Hits under the names a list of results uses."""
    return docs.select(F.col("crec_id").alias("id"), F.col("human_date").alias("displayDate"), F.col("mentions").alias("mentionCount"), "title", F.col("html_url").alias("docUrl"), "snippet")
