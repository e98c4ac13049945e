import datetime as dt

import pytest
from pyspark.sql import functions as F

from rostra.operators import people as P

D = dt.date


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([("A", "Ann Lee", "F"), ("B", "Bob Ray", "M"), ("C", "Cy Dow, Jr.", "M")], "bioguide_id string, official_full string, gender string")


@pytest.fixture(scope="module")
def terms(spark):
    rows = [
        ("A", "sen", "OH", "Democrat", D(2001, 1, 1), D(2007, 1, 1)),
        ("A", "rep", "TX", "Republican", D(2006, 1, 1), D(2009, 1, 1)),
        ("B", "rep", "OH", "Democrat", D(2001, 1, 1), D(2003, 1, 1)),
        ("B", "rep", "OH", "Democrat", D(2003, 1, 1), D(2005, 1, 1)),
    ]
    return spark.createDataFrame(rows, "bioguide_id string, type string, state string, party string, start_date date, end_date date")


def ids(df):
    return sorted(r["bioguide_id"] for r in df.collect())


def test_chained_filters_multiply_rows(people, terms):
    assert ids(P.search_people(people, terms, state="OH", party="Democrat")) == ["A", "B", "B", "B", "B"]
    assert ids(P.search_people(people, terms, state="OH", party="Republican")) == ["A"]
    assert ids(P.search_people(people, terms, state="OH", party="Republican", mode="intent")) == []
    assert ids(P.search_people(people, terms, state="OH", party="Democrat", mode="intent")) == ["A", "B"]


def test_equality_and_unknown_type(people, terms):
    assert ids(P.search_people(people, terms, gender="M")) == ["B", "C"]
    assert ids(P.search_people(people, terms, term_type="mayor")) == ["A", "B", "C"]
    assert ids(P.search_people(people, terms, term_type="sen")) == ["A"]
    assert ids(P.search_people(people, terms, person_id="C", gender="F")) == ["C"]
    with pytest.raises(LookupError):
        P.by_id(people, "Z")


def test_current_once_a_term(people, terms):
    assert ids(P.current(people, terms, D(2006, 6, 1))) == ["A", "A"]
    assert ids(P.current(people, terms, D(2006, 6, 1), state="OH")) == ["A", "A"]
    assert ids(P.current(people, terms, D(2006, 6, 1), state="OH", mode="intent")) == ["A"]


def test_latest_and_as_of(spark, terms):
    got = {r["bioguide_id"]: r["party"] for r in P.latest_term(terms).collect()}
    assert got == {"A": "Republican", "B": "Democrat"}
    docs = spark.createDataFrame([("A", D(2002, 1, 1)), ("A", D(2006, 6, 1)), ("A", D(1999, 1, 1))], "bioguide_id string, date_issued date")
    assert [r["party"] for r in P.term_at(docs, terms).orderBy("date_issued").collect()] == [None, "Democrat", "Republican"]


def test_nesting_does_not_multiply(spark, people, terms):
    ext = spark.createDataFrame([("A", "wiki", "1"), ("A", "gov", "2")], "bioguide_id string, type string, value string")
    rows = {r["bioguide_id"]: (len(r["terms"]), [e["type"] for e in r["external_ids"]]) for r in P.nested(people, terms, ext).collect()}
    assert rows == {"A": (2, ["gov", "wiki"]), "B": (2, []), "C": (0, [])}
    assert ids(P.by_external_id(people, ext, "1", "wiki")) == ["A"]


def test_speakers(spark, people, terms):
    docs = spark.createDataFrame([(1, "Bob Ray,nobody,Ann Lee"), (2, "Cy Dow, Jr."), (3, None)], "crec_id int, speakers string")
    got = {r["crec_id"]: [m["im_url"][-5] for m in r["matched"]] for r in P.match_speakers(docs, people, terms).collect()}
    assert got == {1: ["B", "A"], 2: [], 3: []}
    named = docs.withColumn("speakers", F.array("speakers"))
    got = {r["crec_id"]: len(r["matched"]) for r in P.match_speakers(named, people, terms, mode="intent").collect()}
    assert got[2] == 1


def test_upsert_keeps_last_value(spark):
    old = spark.createDataFrame([("A", 1, "x", "old"), ("B", 1, "y", None)], "k string, seq int, v string, w string")
    new = spark.createDataFrame([("A", 2, "z", None)], old.schema)
    assert sorted(map(tuple, P.upsert(old, new, ["k"], "seq").collect())) == [("A", 2, "z", "old"), ("B", 1, "y", None)]
    assert [r["v"] for r in P.keep_last(old.unionByName(new), ["k"], "seq").orderBy("k").collect()] == ["z", "y"]


def test_urls(people):
    r = P.with_urls(people).where("bioguide_id = 'A'").first()
    assert r["image_sm"] == "https://theunitedstates.io/images/congress/225x275/A.jpg" and r["bio_page_url"].endswith("/ann-lee/A")


def test_filter_reaches_the_scan(spark, people, tmp_path):
    people.write.parquet(str(tmp_path / "p"))
    plan = P.filter_people(spark.read.parquet(str(tmp_path / "p")), gender="M")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(gender,M)" in plan


def test_records_of_a_yaml_file_are_read_one_at_a_time():
    import io

    import yaml

    from rostra.sources.people import _items

    body = b"# c\n- id: &a {x: 1}\n" + b"- id: {x: '2\n\n  3'}\n  bio: |\n    - no item\n" * 20_000 + b"- *a\n"
    stream = io.BytesIO(body)
    found = _items(stream)
    assert next(found) == {"id": {"x": "1"}} and stream.tell() < len(body) // 4
    rest = list(found)
    assert len(rest) == 20_001 and rest[0] == {"id": {"x": "2\n3"}, "bio": "- no item\n"} and rest[-1] == {"x": "1"}
    for text in (b"", b"# c\n", b"[]", b"{}", b"---\n- a: ~\n...\n"):
        assert list(_items(io.BytesIO(text))) == (yaml.load(text, Loader=yaml.BaseLoader) or [])
    with pytest.raises(yaml.YAMLError):
        list(_items(io.BytesIO(b"- a: 1\n---\n- b: 2\n")))
