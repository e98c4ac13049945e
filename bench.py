"""Headline queries on the tables at $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Each query is run once to warm up and then ``BENCH_RUNS`` times (default 3); its figure is
the median of the time to write its whole result to the no-op sink. The metric is the sum.
Beside it stand the same searches and histograms from a kept index, which is written once.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import sys
import time
from collections.abc import Callable
from statistics import median

from pyspark.sql import DataFrame

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["term_counts_dense", "bm25_topk", "phrase_search", "period_delta", "snippet", "top_mentions_speakers", "people_current", "people_chained_join", "person_nested", "speaker_segments", "preprocess_chain", "entity_counts_by_type"]


def timed(runs: int, f: Callable[[], DataFrame]) -> float:
    """Median seconds of ``runs`` whole results after one to warm up."""
    times = []
    for _ in range(runs + 1):
        began = time.perf_counter()
        f().write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - began)
    return round(median(times[1:]), 3)


def indexed(spark, sf: str, runs: int) -> dict[str, float]:
    """Seconds to write an index of the documents once, and of searches and histograms that read it, opening it included."""
    from rostra.operators import histogram, search
    from rostra.operators.index import Index, add
    from rostra.plans import catalogue, roles
    from rostra.sources import shared

    docs, path = roles.docs(spark, sf), shared.fresh(spark, "bench")
    began = time.perf_counter()
    add(docs, path)
    found = {"write": round(time.perf_counter() - began, 3)}
    start, end = catalogue.START, catalogue.END
    queries = {
        "bm25_topk": lambda: search.page(Index(spark, path).hits(catalogue.PHRASE, start, end), key="key"),
        "search_page": lambda: search.search(docs, {"content": catalogue.PHRASE}, start, end, index=Index(spark, path)),
        "term_counts_dense": lambda: histogram.dense_term_counts(Index(spark, path), catalogue.TERM, start, dt.date(2017, 5, 1)),
        "period_delta": lambda: histogram.period_delta(Index(spark, path), catalogue.TERM, start, end),
    }
    return found | {name: timed(runs, f) for name, f in queries.items()}


def main() -> None:
    from pyspark.sql import SparkSession

    from rostra.plans import catalogue

    cpus = os.environ.get("BENCH_CPUS", "8")
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        # one small file a table: cut it, so that all cores scan
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = {}
    for name in HEADLINE:
        found[name] = timed(runs, lambda name=name: catalogue.queries()[name](spark, sf))
    kept = indexed(spark, sf, runs)
    print(json.dumps({"metric": "sum of median seconds of the headline queries", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "index": kept, "sf": sf}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
