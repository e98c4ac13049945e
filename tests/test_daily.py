"""Archives as a data source, and the daily job under failures."""

import datetime as dt
import re
import tracemalloc
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rostra.operators.index import Index
from rostra.sources import archive, daily, documents

DAY = dt.date


def mods(day, *items):
    rows = "".join(f'<relatedItem type="constituent" ID="id-{i}"><titleInfo><title>T</title></titleInfo><extension>{who}</extension></relatedItem>' for i, who in items)
    return f'<mods xmlns="http://www.loc.gov/mods/v3"><originInfo><dateIssued>{day}</dateIssued></originInfo>{rows}<relatedItem type="other" ID="x"/></mods>'


def member(name, who):
    return f'<congMember role="SPEAKING" bioGuideId="{who}"><name type="parsed">{name}</name></congMember>'


def put(path, day, files):
    path.mkdir(exist_ok=True)
    with zipfile.ZipFile(path / f"CREC-{day}.zip", "w") as z:
        for name, body in files.items():
            z.writestr(name, body)


WHO = member("Mr. LEE of Ohio", "L1") + member("Mr. ROE", "R1") + member("Mr. LEE of Iowa", "L2")


def day_files(day, text):
    return {"a/mods.xml": mods(day, ("PgS1", WHO), ("PgS2", "")), "a/PgS1.htm": f"THE SENATE MET. {text} Mr. ROE yields to Mr. LEE now.", "a/x.pdf": "no"}


def test_partitions_are_days_and_options_choose_them(spark, tmp_path):
    for d in range(1, 6):
        put(tmp_path / "in", f"2017-01-0{d}", {"a/y.htm": str(d), "z.txt": "no"})
    put(tmp_path / "in", "2017-01-06", {"z.txt": "no"})
    (tmp_path / "in/CREC-2017-01-07.zip").write_bytes(b"PK")
    (tmp_path / "in/notes.txt").write_text("x")
    rows = archive.members(spark, str(tmp_path / "in"), DAY(2017, 1, 1), DAY(2017, 1, 9))
    got = sorted((r["date"].day, r["member"], r["error"]) for r in rows.collect())
    assert got == [(d, "a/y.htm", None) for d in range(1, 6)] + [(6, None, None), (7, None, "unreadable archive"), (8, None, "no data")]
    assert rows.rdd.getNumPartitions() == 8
    some = archive.members(spark, str(tmp_path / "in"), DAY(2017, 1, 3), DAY(2017, 1, 5))
    assert rows.where(F.col("date") == DAY(2017, 1, 3)).count() == 1
    assert some.rdd.getNumPartitions() == 2 and some.count() == 2
    log = {r["date"].day: (r["success"], r["num_files"]) for r in archive.audit(rows).collect()}
    assert log == {**{d: (True, 1) for d in range(1, 6)}, 6: (True, 0), 7: (False, 0), 8: (True, 0)}
    assert archive.members(spark, f"file:{tmp_path}/in").count() == 7
    assert archive.members(spark, str(tmp_path / "none")).count() == 0


def test_members_come_in_bounded_batches(spark, tmp_path, monkeypatch):
    put(tmp_path / "in", "2017-01-01", {f"{i}.htm": "x" * 1000 for i in range(50)})
    monkeypatch.setattr(archive, "_BATCH_BYTES", 4000)
    reader = archive.ArchiveReader({"path": str(tmp_path / "in")})
    sizes = [b.num_rows for b in reader.read(reader.partitions()[0])]
    assert sum(sizes) == 50 and max(sizes) == 4


def test_archives_written_are_archives_read(spark, tmp_path):
    rows = [(DAY(2017, 1, d), f"a/{k}.htm", f"{d}-{k}" * 100) for d in range(1, 8) for k in range(20)] + [(None, "x.htm", "no day")]
    df = spark.createDataFrame(rows, "date date, member string, content string").repartition(5)
    assert {r["date"].day: r["members"] for r in archive.write_archives(df, str(tmp_path / "out")).collect()} == {d: 20 for d in range(1, 8)}
    back = archive.members(spark, str(tmp_path / "out")).select("date", "member", F.col("content").cast("string").alias("content"))
    assert sorted(map(tuple, back.collect())) == sorted(r for r in rows if r[0])
    assert not [f for f in (tmp_path / "out").iterdir() if f.suffix == ".part"]


def test_no_batch_is_larger_than_its_bound_or_one_member(spark, tmp_path, monkeypatch):
    sizes = {"a.htm": 3000, "b.htm": 3000, "c.htm": 500, "d.htm": 0, "mods.xml": 9000, "n.htm": 100}
    put(tmp_path / "in", "2017-01-01", {name: name[0] * n for name, n in sizes.items()})
    monkeypatch.setattr(archive, "_BATCH_BYTES", 4000)
    monkeypatch.setattr(archive, "_PART_BYTES", 64, raising=False)
    reader = archive.ArchiveReader({"path": str(tmp_path / "in")})
    batches = list(reader.read(reader.partitions()[0]))
    assert [b["member"].to_pylist() for b in batches] == [["a.htm"], ["b.htm", "c.htm", "d.htm"], ["mods.xml"], ["n.htm"]]
    assert {m: c for b in batches for m, c in zip(b["member"].to_pylist(), b["content"].to_pylist(), strict=True)} == {name: name[:1].encode() * n for name, n in sizes.items()}


def test_a_large_member_is_held_once(spark, tmp_path):
    big = 32 << 20
    put(tmp_path / "in", "2017-01-01", {"mods.xml": "x" * big})
    reader = archive.ArchiveReader({"path": str(tmp_path / "in")})
    (part,) = reader.partitions()
    arrow = pa.total_allocated_bytes()
    tracemalloc.start()
    (batch,) = reader.read(part)
    held = tracemalloc.get_traced_memory()[1] + pa.total_allocated_bytes() - arrow
    tracemalloc.stop()
    assert batch.num_rows == 1 and len(batch["content"][0].as_buffer()) == big and held < 1.5 * big


def test_large_members_reach_the_writer_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archive, "_PART_BYTES", 10, raising=False)
    rows = [(DAY(2017, 1, d), f"{n}.htm", "é" * n) for d in (1, 2) for n in (0, 1, 5, 6, 10, 5000)] + [(DAY(2017, 1, 3), "mods.xml", "one" * 9), (DAY(2017, 1, 3), "mods.xml", "two" * 9)]
    df = spark.createDataFrame(rows, "date date, member string, content string")
    written = archive.write_archives(df, str(tmp_path / "out"))
    plan = written._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"MapInArrow.*Generate posexplode.*Sort \[", plan, re.S)
    assert {r["date"].day: r["members"] for r in written.collect()} == {1: 6, 2: 6, 3: 2}
    for d in (1, 2, 3):
        with zipfile.ZipFile(tmp_path / f"out/CREC-2017-01-0{d}.zip") as z:
            held = sorted((i.filename, z.open(i).read().decode(), i.compress_type) for i in z.infolist())
        assert held == sorted((n, c, zipfile.ZIP_DEFLATED) for day, n, c in rows if day.day == d)


def test_a_constituent_does_not_carry_its_file(spark):
    files = spark.createDataFrame([(DAY(2017, 1, 2), mods("2017-01-01", *((f"PgS{i}", WHO) for i in range(3)))), (DAY(2017, 1, 3), "<mods/>")], "date date, xml string")
    rows = documents.constituents(files)
    assert sorted((r["crec_id"], r["date"], r["date_issued"]) for r in rows.collect()) == [(f"id-PgS{i}", DAY(2017, 1, 2), DAY(2017, 1, 1)) for i in range(3)]
    carried = re.findall(r"Generate explode\(.*?\), \[(.*?)\]", rows._jdf.queryExecution().executedPlan().toString())
    assert [re.sub(r"#\d+", "", c) for c in carried] == ["date, date_issued"]


def test_the_reason_is_known_without_the_clean_up(spark):
    docs = spark.createDataFrame([("a", None), ("b", ""), ("c", "no heading"), ("d", "x THE SENATE MET. y"), ("e", "." * 12), ("f", "_" * 12)], "crec_id string, content string")
    rows = documents.with_reason(docs)
    assert {r["crec_id"]: r["reason"] for r in rows.collect()} == {"a": "no body", "b": "no heading", "c": "no heading", "d": None, "e": None, "f": None}
    assert "regexp_replace" not in rows.where("reason IS NOT NULL").select("crec_id", "reason")._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def store(spark, tmp_path):
    return str(tmp_path / "store")


def texts(spark, store):
    return {r["date"].day: r["content"][16:17] for r in daily.loaded(spark, store).where("reason IS NULL").collect()}


def test_runs_replace_days_and_failures_change_nothing(spark, tmp_path, store):
    for d in range(1, 4):
        put(tmp_path / "in", f"2017-01-0{d}", day_files(f"2017-01-0{d}", "A."))
    source = str(tmp_path / "in")
    assert daily.pending(spark, store, DAY(2017, 1, 1), DAY(2017, 1, 4)) == [DAY(2017, 1, d) for d in (1, 2, 3)]
    daily.scrape(spark, source, store, DAY(2017, 1, 1), DAY(2017, 1, 3))
    assert daily.load(spark, store, buckets=4) == [DAY(2017, 1, 1), DAY(2017, 1, 2)]
    assert daily.load(spark, store) == []
    assert texts(spark, store) == {1: "A", 2: "A"}
    bad = {(r["crec_id"], r["reason"]) for r in daily.loaded(spark, store).where("reason IS NOT NULL").collect()}
    assert bad == {("id-PgS2", "no body")}

    # a run stops after it was started: its day is not done, and the next run takes it up
    put(tmp_path / "in", "2017-01-02", day_files("2017-01-02", "B."))
    real = archive.audit
    try:
        archive.audit = lambda rows: (_ for _ in ()).throw(RuntimeError("lost"))
        with pytest.raises(RuntimeError):
            daily.scrape(spark, source, store, DAY(2017, 1, 2), DAY(2017, 1, 4))
    finally:
        archive.audit = real
    log = {r["date"].day: (r["success"], r["message"]) for r in daily.audit(spark, store).collect()}
    assert log[3] == (False, daily.STARTED) and log[1][0]
    assert daily.load(spark, store) == [] and texts(spark, store) == {1: "A", 2: "A"}
    assert daily.pending(spark, store, DAY(2017, 1, 1), DAY(2017, 1, 4)) == [DAY(2017, 1, 3)]

    daily.scrape(spark, source, store, DAY(2017, 1, 2), DAY(2017, 1, 4))
    daily.load(spark, store)
    assert texts(spark, store) == {1: "A", 2: "B", 3: "A"}
    ix = Index(spark, f"{store}/index")
    assert {r["day"].day for r in ix.hits("senate met").collect()} == {1, 2, 3} and {r["day"].day for r in ix.hits("b").collect()} == {2}

    # an archive that has become unreadable keeps what the day had
    (tmp_path / "in/CREC-2017-01-01.zip").write_bytes(b"PK")
    daily.scrape(spark, source, store, DAY(2017, 1, 1), DAY(2017, 1, 2))
    assert daily.load(spark, store) == [] and texts(spark, store)[1] == "A"
    assert not daily.audit(spark, store).where("date = DATE '2017-01-01'").first()["success"]

    # a day that has no archive any more has no documents
    (tmp_path / "in/CREC-2017-01-03.zip").unlink()
    daily.scrape(spark, source, store, DAY(2017, 1, 3), DAY(2017, 1, 4))
    assert daily.load(spark, store) == [DAY(2017, 1, 3)]
    assert texts(spark, store) == {1: "A", 2: "B"}
    assert {r["day"].day for r in Index(spark, f"{store}/index").hits("senate met").collect()} == {1, 2}


def test_a_name_given_twice_is_tried_first(spark, tmp_path, store):
    put(tmp_path / "in", "2017-01-01", day_files("2017-01-01", "A."))
    daily.scrape(spark, str(tmp_path / "in"), store, DAY(2017, 1, 1), DAY(2017, 1, 2))
    daily.load(spark, store)
    row = daily.loaded(spark, store).where("reason IS NULL").first()
    assert list(row["speaker_ids"].items()) == [("Mr. LEE", "L2"), ("Mr. ROE", "R1")]
    assert [(s["speaker"], s["bioguide_id"]) for s in row["segments"]] == [(None, None), ("Mr. LEE", "L2")]


def test_bodies_of_one_name_stay_with_their_days(spark):
    rows = [(DAY(2017, 1, d), "mods.xml", mods(f"2017-01-0{d}", ("PgS1", ""))) for d in (1, 2)] + [(DAY(2017, 1, d), "PgS1.htm", f"THE SENATE MET. {d}") for d in (1, 2)]
    docs, bad = documents.load(spark.createDataFrame(rows, "date date, name string, content string"))
    assert sorted((r["date_issued"].day, r["content"]) for r in docs.collect()) == [(1, "THE SENATE MET. 1"), (2, "THE SENATE MET. 2")] and bad.count() == 0
