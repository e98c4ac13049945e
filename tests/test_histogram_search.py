import datetime as dt

import pytest
from pyspark.sql import functions as F

from rostra.operators import histogram, page, search

DAY = dt.date


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(f"d{i:02d}", str(i), "foo bar baz Foo", DAY(2017, 1, i % 5 + 1)) for i in range(20)]
    return spark.createDataFrame(rows, "crec_id string, title string, content string, date_issued date")


def counts(df):
    return {r["date"]: r["count"] for r in df.collect()}


def test_one_day(docs):
    assert counts(histogram.term_counts(docs, "foo", DAY(2017, 1, 1), DAY(2017, 1, 1))) == {DAY(2017, 1, 1): 8}


@pytest.mark.parametrize("term", ["foo", "FOO", " foo "])
def test_buckets_whatever_the_case(docs, term):
    got = counts(histogram.term_counts(docs, term, DAY(2017, 1, 1), DAY(2017, 1, 30)))
    assert got == {DAY(2017, 1, d): 8 for d in range(1, 6)}


def test_dense(docs):
    got = counts(histogram.dense_term_counts(docs, "foo", DAY(2017, 1, 1), DAY(2017, 1, 31)))
    assert len(got) == 31 and sum(got.values()) == 40
    assert all(n == (8 if d.day <= 5 else 0) for d, n in got.items())


def test_days_ago(docs):
    a, b = histogram.date_range(days_ago=30, as_of=DAY(2017, 1, 31))
    assert (a, b) == (DAY(2017, 1, 1), DAY(2017, 1, 31))
    assert len(counts(histogram.dense_term_counts(docs, "foo", a, b))) == 31
    assert histogram.date_range("2017-02-01", "2017-02-03") == (DAY(2017, 2, 1), DAY(2017, 2, 3))
    with pytest.raises(ValueError):
        histogram.date_range("2017-2-1x", "2017-02-03")


def test_reversed_range_is_empty(docs):
    assert histogram.dense_term_counts(docs, "foo", DAY(2017, 2, 1), DAY(2017, 1, 1)).collect() == []


def test_words_of_a_term(docs):
    args = (DAY(2017, 1, 1), DAY(2017, 1, 31))
    assert counts(histogram.term_counts(docs, "foo bar", *args)) == {}
    assert sum(counts(histogram.term_counts(docs, "foo bar", *args, mode="intent")).values()) == 20


def test_token_limit(spark):
    long = spark.createDataFrame([("a", "x " * 4999 + "foo", DAY(2017, 1, 1))], "crec_id string, content string, date_issued date")
    day = (DAY(2017, 1, 1), DAY(2017, 1, 1))
    assert counts(histogram.term_counts(long, "foo", *day)) == {DAY(2017, 1, 1): 0}
    assert counts(histogram.term_counts(long, "foo", *day, limit=None)) == {DAY(2017, 1, 1): 1}


def test_periods_share_a_day_and_delta_is_cut(docs):
    r = histogram.period_delta(docs, "foo", DAY(2017, 1, 5), DAY(2017, 1, 7), days_ago=2).first()
    assert (r["current_total"], r["previous_total"], r["delta"]) == (8, 24, -66)
    r = histogram.period_delta(docs, "foo", DAY(2017, 1, 1), DAY(2017, 1, 5), days_ago=30).first()
    assert (r["current_total"], r["previous_total"], r["delta"]) == (40, 0, 4000)


def extra(spark, docs, *rows):
    return docs.unionByName(spark.createDataFrame([(f"x{i}", *r) for i, r in enumerate(rows)], docs.schema))


ALL = (DAY(2017, 1, 1), DAY(2017, 1, 30))


def test_title_and_content(spark, docs):
    more = extra(spark, docs, ("foo", "blah", DAY(2017, 1, 1)))
    for fields in ({"title": "foo"}, {"content": "blah"}):
        assert [(r["title"], r["content"]) for r in search.search(more, fields, *ALL).collect()] == [("foo", "blah")]


def test_date_filter(spark, docs):
    more = extra(spark, docs, ("in", "blah", DAY(2017, 1, 1)), ("out", "blah", DAY(2016, 1, 1)))
    assert [r["title"] for r in search.search(more, {"content": "blah"}, *ALL).collect()] == ["in"]


def test_fields_are_anded(spark, docs):
    more = extra(spark, docs, ("foo", "bar", DAY(2017, 1, 1)), ("foo", "baz", DAY(2017, 1, 1)))
    got = search.search(more, {"content": "bar", "title": "foo"}, *ALL).collect()
    assert [(r["title"], r["content"]) for r in got] == [("foo", "bar")]


def test_pages(docs):
    one, two = (search.search(docs, {"content": "foo"}, *ALL, offset=o).collect() for o in (0, 10))
    assert len(one) == len(two) == 10 and not {r["crec_id"] for r in one} & {r["crec_id"] for r in two}
    assert all(r["score"] is not None for r in one + two) and min(r["score"] for r in one) >= max(r["score"] for r in two)


def test_page_is_a_bounded_sort(docs):
    plan = search.page(search.bm25(docs, "foo"))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_speaker_field_by_mode(spark):
    d = spark.createDataFrame([("a", "t", "c", DAY(2017, 1, 1), ["Ann Lee"])], "crec_id string, title string, content string, date_issued date, speakers array<string>")
    assert search.search(d, {"speaker": "ann lee"}, *ALL).count() == 0
    assert search.search(d, {"speaker": "ann lee"}, *ALL, mode="intent").count() == 1


def test_result_page(spark, docs):
    people = spark.createDataFrame([("B1", "Ann Lee")], "bioguide_id string, official_full string")
    terms = spark.createDataFrame([("B1", DAY(2001, 1, 1), DAY(2003, 1, 1), "Democrat"), ("B1", DAY(2003, 1, 1), DAY(2005, 1, 1), "Republican")], "bioguide_id string, start_date date, end_date date, party string")
    spoken = docs.withColumn("speakers", F.lit("nobody,Ann Lee"))
    parts = page.result_page(spoken, people, terms, " Bar ", *ALL)
    assert parts["totals"].first()["current_total"] == 20 and parts["breakdown"].count() == 60
    row = parts["docs"].first()
    assert (row["mentions"], row["snippet"], row["human_date"][-4:]) == (1, "foo bar baz Foo", "2017")
    assert [(m["party"], m["bio_page_url"]) for m in row["matched"]] == [("Republican", "https://www.congress.gov/member/ann-lee/B1")]
    assert page.envelope(parts["totals"]).first()["json"].startswith('{"status":"success","data":[{"current_total":20')


def test_postings(docs):
    r = search.postings(docs.limit(1)).where("term = 'foo'").first()
    assert (r["tf"], r["positions"]) == (2, [0, 3])
