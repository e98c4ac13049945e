"""Abbreviations found by their periods, and sentences cut with them."""

import random

from pyspark.sql import functions as F

from rostra.operators import abbreviations, segments

TITLES = ["Mr", "Dr", "St", "Gov", "Sen", "Rep", "U.S"]


def text(rng):
    words = "senate house member budget road river town council vote day bill act law tax".split()
    out = []
    for _ in range(rng.randrange(3, 9)):
        s = rng.choices(words, k=rng.randrange(4, 12))
        s.insert(rng.randrange(len(s)), f"{rng.choice(TITLES)}. Lee")
        out.append(" ".join(s).capitalize() if rng.random() < 0 else " ".join(s) + ".")
    return " ".join(x[0].upper() + x[1:] for x in out), len(out)


def test_titles_are_found_and_end_no_sentence(spark):
    rng = random.Random(8)
    made = [text(rng) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(made)], "crec_id int, content string, n int")
    found = abbreviations.found(docs)
    assert set(found) == {t.lower() for t in TITLES}
    learned = docs.select("n", F.size(segments.sentence_array(F.col("content"), abbreviations.not_ends(found))).alias("m"))
    listed = docs.select("n", F.size(segments.sentence_array(F.col("content"))).alias("m"))
    assert learned.where("n = m").count() == 300 and listed.where("n = m").count() < 100


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([(1, None), (2, ""), (3, "no periods here")], "crec_id int, content string")
    assert abbreviations.found(none) == [] and abbreviations.scores(none.limit(0)).count() == 0
    one = spark.createDataFrame([("A. B. Lee spoke. He left.",)], "content string")
    assert [len(r[0]) for r in one.select(segments.sentence_array(F.col("content"), abbreviations.not_ends([]))).collect()] == [2]
