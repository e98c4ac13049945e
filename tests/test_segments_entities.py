import datetime as dt

from pyspark.sql import functions as F

from rostra.constants import generic_speakers
from rostra.operators import entities as E
from rostra.operators import segments as S

TEXT = "The Senate met at noon. Mr. UDALL. I rise today. It is late. The PRESIDING OFFICER. The Senator is recognized. Mr. TESTER. Thank you. Mr. TESTER goes on."


def docs(spark):
    return spark.createDataFrame([("d", TEXT, {"Mr. UDALL": "U1", "Mr. TESTER": "T1"}, dt.date(2017, 1, 1)), ("e", "", {}, dt.date(2017, 1, 2))], "crec_id string, content string, speaker_ids map<string,string>, date_issued date")


def test_islands(spark):
    row = S.document_segments(docs(spark), mode="intent").where("crec_id = 'd'").first()
    got = [(s["id"], s["speaker"], s["bioguide_id"]) for s in row["segments"]]
    assert got == [("d-1", None, None), ("d-2", "Mr. UDALL", "U1"), ("d-3", "The PRESIDING OFFICER", None), ("d-4", "Mr. TESTER", "T1")]
    assert " ".join(s["text"] for s in row["segments"]) == TEXT


def test_priority_and_modes(spark):
    own = F.array(F.lit("Mr. B"), F.lit("Mr. A"))
    df = spark.createDataFrame([("Mr. A and Mr. B speak",), ("The SPEAKER rose",), ("x",)], "s string")
    intent = [r[0] for r in df.select(S.first_contained(F.col("s"), S.candidates(own, "intent"))).collect()]
    compat = [r[0] for r in df.select(S.first_contained(F.col("s"), S.candidates(own, "compat"))).collect()]
    assert intent == ["Mr. B", "The SPEAKER", None] and compat == ["Mr. B", None, None]
    assert len(generic_speakers("intent")) == len(generic_speakers("compat")) + 1


def test_fuzzy(spark):
    assert S.weighted_ratio("Mr. GALEGO", "Mr. GALLEGO") > 90
    assert S.weighted_ratio("Mr. GALLEGO said a long thing", "Mr. GALLEGO") == 0
    df = spark.createDataFrame([("Mr. GALEGO.", ["Mr. SMITH", "Mr. GALLEGO"]), ("Nothing alike", ["Mr. SMITH"]), (None, ["a"]), ("x", None)], "s string, o array<string>")
    assert [r["m"] for r in S.fuzzy_match(df, "s", "o", "m").collect()] == ["Mr. GALLEGO", None, None, None]


def rows(spark):
    data = [(1, 0, "Acme", "ORG"), (1, 1, "Acme", "GPE"), (1, 2, "Bare", None), (1, 3, "BOB RAY", "PERSON"), (1, 4, "Bob Ray", "PERSON"), (1, 5, "Bob Ray", "PERSON")]
    return spark.createDataFrame(data, "crec_id int, pos int, entity string, label string")


def test_modes_and_maps(spark):
    types = {r["entity"]: r["type"] for r in E.entity_types(rows(spark)).collect()}
    assert types == {"Acme": "ORG", "Bare": "", "BOB RAY": "PERSON", "Bob Ray": "PERSON"}
    m = E.entity_maps(rows(spark)).first()["named_entity_counts"]
    assert m == {"": {"Bare": 1}, "ORG": {"Acme": 2}, "PERSON": {"BOB RAY": 1, "Bob Ray": 2}}


def test_annotation_to_speaker_rows(spark):
    d = docs(spark)
    a = E.annotate(d)
    ents = E.entity_rows(a)
    chunks = E.chunk_counts(a, ents)
    assert {r["n"] for r in chunks.collect()} == {1}
    out = E.speaker_word_counts(d, E.entity_maps(ents), chunks)
    assert sorted(r["bioguide_id"] for r in out.collect()) == ["T1", "U1"]
    assert E.speaker_word_counts(d, E.entity_maps(ents), chunks, mode="intent").count() == 2


def test_annotations_of_a_batch_come_in_slices():
    import pyarrow as pa

    texts = ["x" * 400_000, None, "y" * 700_000, "", "z" * 3_000_000, "w", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["crec_id", "content"])
    got = [s.column(0).to_pylist() for s in E._slices(batch)]
    assert got == [[0, 1, 2], [3, 4], [5, 6]]
    assert list(E._slices(batch.slice(0, 0))) == []
