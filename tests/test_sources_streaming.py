import datetime as dt
import zipfile

import pytest
from pyspark.sql import functions as F

from rostra.sources import archive, documents, people
from rostra.streaming import ingest

MODS = """<mods xmlns="http://www.loc.gov/mods/v3">
<originInfo><dateIssued>2017-01-20</dateIssued></originInfo>
<relatedItem type="constituent" ID="id-CREC-2017-01-20-pt1-PgS348-2">
 <titleInfo><title>NOMINATIONS</title><partName>Senate</partName></titleInfo>
 <location><url displayLabel="PDF rendition">a.pdf</url><url displayLabel="HTML rendition">a.htm</url></location>
 <part type="article"><extent><start>S348</start><end>S349</end></extent></part>
 <name type="personal"><namePart>Richard Roe</namePart></name><name type="corporate"><namePart>X</namePart></name>
 <extension><congMember role="SPEAKING" bioGuideId="D1"><name type="parsed">Mr. ROE of Ohio</name></congMember>
  <congMember role="SPEAKING" bioGuideId="D2"><name type="parsed">Mr. ROE of Iowa</name></congMember>
  <congMember role="MENTIONED" bioGuideId="D3"><name type="parsed">Mr. DOE</name></congMember></extension>
</relatedItem>
<relatedItem type="other" ID="id-x"/>
<relatedItem type="constituent" ID="id-CREC-2017-01-20-pt1-PgD12"><titleInfo><title>DIGEST</title></titleInfo></relatedItem>
</mods>"""


def test_archive_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    with zipfile.ZipFile(tmp_path / "in/CREC-2017-01-20.zip", "w") as z:
        z.writestr("a/mods.xml", MODS)
        z.writestr("a/CREC-2017-01-20-pt1-PgS348-2.htm", "<pre>\nTHE SENATE MET. Mr. ROE. I rise.</pre>")
        for noise in ("a/x.pdf", "a/y.html", "a/z.txt"):
            z.writestr(noise, "")
    (tmp_path / "in/CREC-2017-01-21.zip").write_bytes(b"broken")
    rows = archive.members(spark, str(tmp_path / "in"))
    log = {r["date"]: (r["success"], r["num_files"]) for r in archive.audit(rows).collect()}
    assert log == {dt.date(2017, 1, 20): (True, 1), dt.date(2017, 1, 21): (False, 0)}
    for _ in range(2):  # a day that is staged again is replaced
        archive.stage(rows, str(tmp_path / "out"))
    staged = spark.read.parquet(str(tmp_path / "out")).withColumn("body", F.col("content").cast("string"))
    assert sorted(r["name"] for r in staged.collect()) == ["CREC-2017-01-20-pt1-PgS348-2.htm", "mods.xml"]

    docs = documents.constituents(staged.where("name = 'mods.xml'").withColumnRenamed("body", "xml"))
    kept = docs.where(~documents.skippable())
    loaded, bad = documents.split_quarantine(documents.with_bodies(kept, staged))
    row = loaded.first()
    assert (row["crec_id"], row["date_issued"], row["title_part"]) == ("id-CREC-2017-01-20-pt1-PgS348-2", dt.date(2017, 1, 20), "Senate")
    assert (row["pdf_url"], row["html_url"], row["page_start"], row["page_end"]) == ("a.pdf", "a.htm", "S348", "S349")
    assert (row["speakers"], row["speaker_ids"]) == (["Richard Roe"], {"Mr. ROE": "D2"})
    assert row["clean"].startswith("THE SENATE MET") and docs.count() == 2 and bad.count() == 0
    assert documents.split_quarantine(documents.with_bodies(docs.where(documents.skippable()), staged))[1].first()["reason"] == "no body"


def test_no_data_counts_as_success(spark):
    assert archive.no_data(spark, "2017-01-22").first()["success"] is True


def test_days_are_half_open(spark):
    assert archive.days(spark, "2017-01-01", "2017-01-03").count() == 2
    assert archive.days(spark, "2017-01-03", "2017-01-03").count() == 0


YAML = """
- id: {bioguide: A1, votes: [1, 2], n: 7}
  name: {first: Ann, last: Lee, official_full: Ann Lee}
  bio: {gender: F}
  terms:
  - {type: sen, start: 2001-01-01, end: 2007-01-01, state: OH, party: Democrat, class: 1}
"""
LATER = YAML.replace("gender: F", "gender: F, birthday: 1950-05-05").replace("party: Democrat, class: 1", "phone: 555")


def test_people_from_yaml(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text(YAML)
    (tmp_path / "b.yaml").write_text(LATER)
    one = people.load_yaml(spark, str(tmp_path / "a.yaml"))
    assert people.persons(one).first()["birthday"] == dt.date(1776, 7, 4)
    both = people.load_yaml(spark, str(tmp_path / "a.yaml"), str(tmp_path / "b.yaml"))
    p = people.persons(both).collect()
    assert len(p) == 1 and p[0]["birthday"] == dt.date(1950, 5, 5) and p[0]["official_full"] == "Ann Lee"
    t = people.terms(both).collect()
    assert len(t) == 1 and (t[0]["party"], t[0]["phone"], t[0]["district"], t[0]["election_class"]) == ("Democrat", "555", -1, "1")
    assert sorted((r["type"], r["value"]) for r in people.external_ids(both).collect()) == [("bioguide", "A1"), ("n", "7"), ("votes", '["1", "2"]')]
    assert people.states(spark).count() == 60 and people.bill_types(spark).count() == 8


def test_stream_is_restartable(spark, tmp_path):
    src, sink, check = (str(tmp_path / x) for x in ("src", "sink", "check"))
    rows = spark.createDataFrame([("a", dt.date(2017, 1, 1), "x"), ("b", dt.date(2017, 1, 2), "y")], "crec_id string, date_issued date, content string")
    rows.write.parquet(src)
    for _ in range(2):
        ingest.run_once(spark, src, rows.schema, sink, check)
    assert spark.read.parquet(sink).count() == 2
    rows.limit(1).withColumn("content", F.lit("new")).write.mode("append").parquet(src)
    ingest.run_once(spark, src, rows.schema, sink, check)
    assert {r["crec_id"]: r["content"] for r in ingest.latest(spark, sink).collect()} == {"a": "new", "b": "y"}


def test_stream_counts_equal_table_counts(spark, tmp_path):
    data = [(dt.datetime(2024, 1, d, h), k) for d in (1, 2, 3) for h in (1, 23) for k in ("a", "b")]
    e = spark.createDataFrame(data, "ts timestamp, event_type string")
    e.write.parquet(str(tmp_path / "e"))
    stream = ingest.daily_counts(spark.readStream.schema(e.schema).parquet(str(tmp_path / "e")))
    q = stream.writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("daily").collect())) == sorted(map(tuple, ingest.daily_counts(e).collect()))


def test_yaml_files_go_by_name_and_place(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "y").mkdir()
    for name, party in (("b", "last"), ("a", "first")):
        (tmp_path / f"y/{name}.yaml").write_text(f"- id: {{bioguide: A1}}\n  name: {{first: {party}1}}\n- id: {{bioguide: A1}}\n  name: {{first: {party}2}}\n")
    assert people.persons(people.load_yaml(spark, str(tmp_path / "y"))).first()["first"] == "last2"


@pytest.fixture
def derby(spark, tmp_path):
    jvm = spark.sparkContext._jvm
    try:
        jvm.java.lang.Class.forName("org.apache.derby.iapi.jdbc.AutoloadedDriver")
    except Exception:
        pytest.skip("no Derby")
    return f"jdbc:derby:{tmp_path}/db;create=true"


def test_a_table_of_a_database_is_read_in_parts(spark, derby):
    from rostra.operators import people as P

    rows = [(i, f"B{i % 50}", dt.date(1990 + i % 20, 1, 1), dt.date(1996 + i % 20, 1, 1)) for i in range(1, 501)]
    terms = spark.createDataFrame([*rows, (None, "B1", dt.date(1997, 1, 1), dt.date(1999, 1, 1))], "term_id long, bioguide_id string, start_date date, end_date date")
    persons = spark.createDataFrame([(f"B{i}", f"N{i}") for i in range(50)], "bioguide_id string, official_full string")
    for name, df in (("terms", terms), ("persons", persons)):
        df.coalesce(1).write.format("jdbc").options(url=derby, dbtable=name, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").save()
    read = lambda name, column: people.jdbc(spark, derby, name, column, rows=100, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    t = read("terms", "term_id")
    assert t.rdd.getNumPartitions() == 6 and t.count() == 501
    plan = t.where("term_id > 400").select("bioguide_id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(TERM_ID,400)" in plan.upper().replace("GREATERTHAN", "GreaterThan") and "START_DATE" not in plan.upper().split("READSCHEMA")[1]
    as_of = dt.date(1998, 6, 1)
    one, two = (sorted(map(tuple, P.current(a, b, as_of).select("bioguide_id", "official_full").collect())) for a, b in ((persons, terms), (read("persons", None), t)))
    assert one == two and len(one) > 50
    assert read("(SELECT * FROM terms WHERE \"term_id\" < 0) x", "term_id").count() == 0
