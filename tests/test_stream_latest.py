"""Keep-last as a stateful stream: late rows, repeats, restarts and expiry."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from rostra.streaming import ingest, latest

SCHEMA = "k string, seq long, ts timestamp, v string"


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


class Source:
    def __init__(self, spark, path):
        self.spark, self.path, self.n = spark, str(path / "in"), 0

    def put(self, *rows):
        self.n += 1
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
        for f in os.scandir(self.path):  # files are taken by age
            if f.name.endswith(".parquet") and f.stat().st_mtime > 1e9 + 10_000:
                os.utime(f.path, (1e9 + self.n, 1e9 + self.n))

    def stream(self):
        return self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(self.path)


@pytest.fixture
def source(spark, tmp_path):
    return Source(spark, tmp_path)


def rows(spark, path):
    return sorted((r["k"], r["seq"], r["v"]) for r in spark.read.schema(SCHEMA).parquet(path).collect())


def test_newer_rows_pass_and_older_do_not(spark, tmp_path, source):
    sink, check = str(tmp_path / "sink"), str(tmp_path / "check")
    source.put(("a", 1, at(1), "a1"), ("a", 3, at(1), "a3"), ("b", 5, at(1), "b5"), (None, 1, at(1), "x"))
    source.put(("a", 2, at(2), "late"), ("b", 6, at(2), "b6"), ("b", 6, at(2), "b6"))
    latest.run_available(latest.keep_last(source.stream(), "k", "seq"), sink, check)
    assert rows(spark, sink) == [("a", 3, "a3"), ("b", 5, "b5"), ("b", 6, "b6")]
    # a restart goes on with the state it had
    source.put(("a", 3, at(3), "same number"), ("a", 4, at(3), "a4"), ("b", 1, at(3), "old"), ("c", 0, at(3), "c0"))
    latest.run_available(latest.keep_last(source.stream(), "k", "seq"), sink, check)
    assert rows(spark, sink) == [("a", 3, "a3"), ("a", 4, "a4"), ("b", 5, "b5"), ("b", 6, "b6"), ("c", 0, "c0")]
    held = latest.by_key(spark, sink, source.stream().schema, "k", "seq")
    assert sorted((r["k"], r["v"]) for r in held.collect()) == [("a", "a4"), ("b", "b6"), ("c", "c0")]


def test_quiet_keys_expire_and_late_rows_are_dropped(spark, tmp_path, source):
    sink, check = str(tmp_path / "sink"), str(tmp_path / "check")
    source.put(("a", 9, at(1), "a9"))
    source.put(("b", 1, at(20), "b1"))  # the watermark goes to the 19th: a has been quiet for over five days
    source.put(("b", 0, at(20), "old"))
    source.put(("a", 1, at(21), "a again"), ("c", 1, at(2), "too late"))
    latest.run_available(latest.keep_last(source.stream(), "k", "seq", "ts", "5 days"), sink, check)
    assert rows(spark, sink) == [("a", 1, "a again"), ("a", 9, "a9"), ("b", 1, "b1")]


def test_daily_counts_leave_late_rows_out(spark, tmp_path, source):
    source.put(("a", 1, at(1, 5), "x"), ("a", 2, at(2, 5), "x"))
    source.put(("a", 3, at(5, 5), "x"))
    source.put(("a", 7, at(5, 5), "x"))
    source.put(("a", 4, at(1, 6), "x"), ("a", 5, at(5, 6), "x"))  # the first day closed when the fifth came
    source.put(("a", 6, at(9), "x"))
    counts = ingest.daily_counts(source.stream().withColumn("event_type", F.col("v")))
    sink = str(tmp_path / "days")
    q = counts.writeStream.format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["date"].day: r["n"] for r in spark.read.parquet(sink).collect()} == {1: 1, 2: 1, 5: 3}


def test_a_key_costs_one_read_and_at_most_one_write_of_its_state():
    from pyspark.sql import Row

    class State:
        calls, value = (), None

        def get(self):
            self.calls += ("get",)
            return self.value

        def update(self, value):
            self.calls, self.value = (*self.calls, "update"), value

    keep = latest.KeepLast(False, None)
    keep.last = state = State()
    make = Row("k", "v", "order_seq", "order_digest", "order_ms")
    out = list(keep.handleInputRows(("a",), iter([make("a", "old", 1, 5, None), make("a", "new", 2, 1, None), make("a", None, 2, 0, None)]), None))
    assert out == [Row(k="a", v="new")] and state.calls == ("get", "update") and state.value == (2, 0)
    assert list(keep.handleInputRows(("a",), iter([make("a", "same", 2, 9, None)]), None)) == []
    assert state.calls == ("get", "update", "get")
