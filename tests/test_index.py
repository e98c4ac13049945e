"""The kept index against the texts it was made from."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from rostra.operators import histogram, page, search
from rostra.operators.index import Index, add, compact

DAY = dt.date
SCHEMA = "crec_id long, title string, content string, date_issued date"
TEXTS = ["a a a b", "b a a", None, "", "c a b a b a b", "a", "It's a b's a b", "A, a. a-b"] * 3
RANGE = (DAY(2017, 1, 1), DAY(2017, 1, 4))
PHRASES = ["a a", "a b a", "a nowhere", "it's A", " . ", "A."]


def made(spark, texts, first=0, days=5):
    return spark.createDataFrame([(first + i, f"t{i % 3}", t, DAY(2017, 1, i % days + 1)) for i, t in enumerate(texts)], SCHEMA)


def scores(rows, key):
    return {r[key]: round(r["score"], 9) for r in rows.collect()}


def from_texts(docs, phrase, start=None, end=None):
    rows = search.phrase_filter(search.bm25(docs, phrase), {"content": phrase}) if phrase.strip(" .") else docs.limit(0).withColumn("score", F.lit(0.0))
    return scores(histogram.in_range(rows, start, end) if start else rows, "crec_id")


def equal(spark, path, docs):
    ix = Index(spark, path)
    assert ix.documents == docs.count()
    assert scores(ix.hits("a b"), "key") == from_texts(docs, "a b")
    assert scores(ix.hits("a", *RANGE), "key") == from_texts(docs, "a", *RANGE)
    one, two = (sorted(map(tuple, histogram.term_counts(x, "a", *RANGE).collect())) for x in (ix, docs))
    assert one == two


def test_one_run_equals_the_texts(spark, tmp_path):
    docs = made(spark, TEXTS)
    add(docs, str(tmp_path), buckets=4)
    equal(spark, str(tmp_path), docs)
    ix = Index(spark, str(tmp_path))
    for phrase in PHRASES:
        assert scores(ix.hits(phrase, *RANGE), "key") == from_texts(docs, phrase, *RANGE), phrase
        for mode, limit in (("compat", 4999), ("intent", None)):
            one, two = (sorted(map(tuple, histogram.term_counts(x, phrase, *RANGE, limit=limit, mode=mode).collect())) for x in (ix, docs))
            assert one == two, (phrase, mode)


def test_days_come_one_by_one_and_are_replaced(spark, tmp_path):
    path, docs = str(tmp_path), made(spark, TEXTS)
    for d in range(1, 6):
        add(docs.where(F.dayofmonth("date_issued") == d).withColumn("content", F.lit("a b a wrong")), path, buckets=4)
    files = {str(f): f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet")}
    for d in (2, 3):
        add(docs.where(F.dayofmonth("date_issued") == d), path)
    half = docs.where(F.dayofmonth("date_issued").isin(2, 3)).unionByName(docs.where(~F.dayofmonth("date_issued").isin(2, 3)).withColumn("content", F.lit("a b a wrong")))
    equal(spark, path, half)
    # nothing that was there has been written again
    assert {str(f): f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet") if str(f) in files} == files
    add(docs.where(~F.dayofmonth("date_issued").isin(2, 3)), path)
    equal(spark, path, docs)
    compact(spark, path)
    equal(spark, path, docs)


def test_days_are_emptied_and_null_days_count(spark, tmp_path):
    path, docs = str(tmp_path), made(spark, TEXTS)
    undated = made(spark, ["a b", "c"], 100).withColumn("date_issued", F.lit(None).cast("date"))
    add(docs.unionByName(undated), path, buckets=4)
    equal(spark, path, docs.unionByName(undated))
    add(docs.limit(0), path, days=[DAY(2017, 1, 2)])
    add(undated.limit(1), path)
    equal(spark, path, docs.where("date_issued <> DATE '2017-01-02'").unionByName(undated.limit(1)))


def test_a_run_without_its_days_has_never_been(spark, tmp_path):
    path, docs = str(tmp_path), made(spark, TEXTS)
    add(docs, path, buckets=4)
    add(docs.withColumn("content", F.lit("a a wrong")), path)
    for f in (tmp_path / "days/run=1").iterdir():
        f.unlink()
    (tmp_path / "days/run=1").rmdir()
    equal(spark, path, docs)
    add(docs.where(F.dayofmonth("date_issued") == 1), path)  # takes the failed run's number and place
    equal(spark, path, docs)


def test_nothing_indexed(spark, tmp_path):
    ix = Index(spark, str(tmp_path / "none"))
    assert ix.hits("a b").count() == ix.hits("a", *RANGE).count() == ix.term_counts("a", *RANGE).count() == 0
    add(made(spark, TEXTS).limit(0), str(tmp_path / "empty"))
    assert Index(spark, str(tmp_path / "empty")).hits("a").count() == 0


def test_reads_only_the_buckets_and_runs_it_needs(spark, tmp_path):
    path, docs = str(tmp_path), made(spark, TEXTS)
    for d in (1, 2):
        add(docs.where(F.dayofmonth("date_issued") == d), path, buckets=4)
    ix = Index(spark, path)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    text = plan(ix.postings(["a"], DAY(2017, 1, 2), DAY(2017, 1, 2)))
    filters = text.split("PartitionFilters: [")[1].split("]")[0]
    assert "run" in filters and "bucket" in filters and "IsNotNull(term)" in text.split("PushedFilters")[1]
    assert "positions" not in plan(ix.term_counts("a", *RANGE))
    with pytest.raises(ValueError):
        ix.term_counts("a", *RANGE, limit=7)


@pytest.mark.parametrize("fields", [{"content": "a b"}, {"content": "a", "title": "t1"}, {"content": "a", "title": "nowhere"}, {"title": "t1"}])
def test_a_search_through_the_index_is_the_same_search(spark, tmp_path, fields):
    docs = made(spark, TEXTS)
    add(docs, str(tmp_path), buckets=4)
    ix = Index(spark, str(tmp_path))
    for offset in (0, 3):
        one, two = ([(r["crec_id"], r["content"], round(r["score"], 9)) for r in search.search(docs, fields, *RANGE, size=3, offset=offset, index=x).collect()] for x in (ix, None))
        assert one == two


def test_a_result_page_through_the_index(spark, tmp_path):
    docs = made(spark, TEXTS)
    add(docs, str(tmp_path), buckets=4)
    one, two = (page.result_page(docs, None, None, " A ", *RANGE, days_ago=2, index=x) for x in (Index(spark, str(tmp_path)), None))
    for part in ("totals", "breakdown", "docs"):
        rows = [[tuple(r) for r in x[part].drop("score").collect()] for x in (one, two)]
        assert rows[0] == rows[1] if part == "docs" else sorted(rows[0]) == sorted(rows[1])


def test_a_document_is_inverted_once(spark):
    from rostra.operators.index import postings

    plan = postings(made(spark, TEXTS), "crec_id", "content", "date_issued")._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "transform" in line]


def bytes_under(path, part=""):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(path) for f in files if part in f)


def test_disk_holds_little_more_than_one_index(spark, tmp_path, monkeypatch):
    from rostra.operators import index

    path = str(tmp_path)
    words = F.transform(F.sequence(F.lit(1), F.lit(150)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", i), F.lit(3000)).cast("string")))
    docs = spark.range(3000).select(F.col("id").alias("crec_id"), F.array_join(words, " ").alias("content"), F.date_add(F.lit(DAY(2017, 1, 1)), F.pmod("id", F.lit(5)).cast("int")).alias("date_issued"))
    blocks = [d.toString() for d in spark._jsc.sc().env().blockManager().diskBlockManager().localDirs()]
    shuffled = lambda: sum(bytes_under(d, "shuffle_") for d in blocks)
    spark._jvm.System.gc()
    put, seen, before = index._put, [], shuffled()

    def watched(*args, **more):
        put(*args, **more)
        for _ in range(100):  # files go soon after
            if shuffled() <= before:
                break
            time.sleep(0.05)
        seen.append(bytes_under(path, ".parquet") + max(0, shuffled() - before))

    monkeypatch.setattr(index, "_put", watched)
    monkeypatch.setattr(index, "STEP", 60_000, raising=False)
    add(docs, path, buckets=8)
    whole, seen[:] = bytes_under(path, ".parquet"), []
    compact(spark, path)
    assert max(seen) < 1.5 * whole
    assert bytes_under(path, ".parquet") < 1.2 * whole
    assert shuffled() <= before
    ix = Index(spark, path)
    assert sum(r["places"] for r in ix.all_counts().collect()) == 3000 * 150 and ix.documents == 3000


def test_postings_are_written_without_a_shuffle(spark, tmp_path):
    from rostra.operators import index

    rows = index.postings(made(spark, TEXTS), "crec_id", "content", "date_issued")
    before = spark._jsc.sc().newShuffleId()
    index._put(rows, str(tmp_path), 0, 4)
    assert spark._jsc.sc().newShuffleId() == before + 1


@pytest.mark.parametrize("at", [2, 3])
def test_a_compaction_that_fails_midway_loses_nothing(spark, tmp_path, monkeypatch, at):
    from rostra.operators import index

    path, docs = str(tmp_path), made(spark, TEXTS)
    undated = made(spark, ["a b", "c"], 100).withColumn("date_issued", F.lit(None).cast("date"))
    wrong = docs.where(F.dayofmonth("date_issued").isin(2, 3)).withColumn("content", F.lit("a b a wrong"))
    add(docs.where(~F.dayofmonth("date_issued").isin(2, 3)).unionByName(wrong).unionByName(undated), path, buckets=4)
    add(docs.where(F.dayofmonth("date_issued").isin(2, 3)), path)
    put, calls = index._put, []

    def failing(*args, **more):
        calls.append(args)
        if len(calls) == at:
            raise OSError("disk")
        put(*args, **more)

    with monkeypatch.context() as m:
        m.setattr(index, "STEP", 20)
        m.setattr(index, "_put", failing)
        with pytest.raises(OSError, match="disk"):
            compact(spark, path)
    equal(spark, path, docs.unionByName(undated))
    # days are replaced and emptied while some buckets are moved and some are not
    add(wrong.limit(0), path, days=[DAY(2017, 1, 4)])
    add(docs.where(F.dayofmonth("date_issued") == 1).withColumn("content", F.lit("b a b")), path)
    held = docs.where(~F.dayofmonth("date_issued").isin(1, 4)).unionByName(docs.where(F.dayofmonth("date_issued") == 1).withColumn("content", F.lit("b a b"))).unionByName(undated)
    equal(spark, path, held)
    compact(spark, path)
    equal(spark, path, held)
