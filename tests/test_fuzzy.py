"""Bounds before the scorer lose no match; near joins equal all pairs; islands equal a loop."""

import random

import pytest
from pyspark.sql import functions as F

from rostra.operators import fuzzy, segments

NAMES = ["Mr. GALLEGO", "Mrs. LEE of Ohio", "The PRESIDING OFFICER", "Ms. O'NEIL", "é à", "Mr. VAN HOLLEN", "a", "", "The ACTING PRESIDENT pro tempore"]


def distorted(rng, s):
    words = s.split()
    kind = rng.randrange(6)
    if kind == 0:
        rng.shuffle(words)
        return " ".join(words)
    if kind == 1:
        return s + " " + rng.choice(["and", "speaks", "x"])
    if kind == 2 and words:
        return " ".join(words + words[:1])
    chars = list(s.upper() if kind == 3 else s)
    for _ in range(rng.randrange(4)):
        at = rng.randrange(len(chars) + 1)
        chars[at : at + rng.randrange(2)] = rng.choice(["", "x", " ", "."])
    return "".join(chars)


@pytest.mark.parametrize("least", [70, 90])
def test_no_pair_that_scores_is_left_out(spark, least):
    rng = random.Random(4)
    pairs = [(distorted(rng, rng.choice(NAMES)), rng.choice(NAMES)) for _ in range(3000)]
    df = spark.createDataFrame(pairs, "a string, b string")
    kept = {(r["a"], r["b"]) for r in df.where(fuzzy.could_score(fuzzy.normal("a"), fuzzy.normal("b"), least)).collect()}
    good = {p for p in pairs if fuzzy.weighted_ratio(*p) > least}
    assert len(good) > 100 and good <= kept


def test_few_pairs_of_sentences_reach_the_scorer(spark):
    rng = random.Random(5)
    words = "the senate met and yielded to mr lee who spoke of budgets at noon on a long day".split()
    df = spark.createDataFrame([(" ".join(rng.choices(words, k=rng.randrange(2, 25))),) for _ in range(500)], "s string").crossJoin(spark.createDataFrame([(n,) for n in NAMES], "n string"))
    assert df.where(fuzzy.could_score(fuzzy.normal("s"), fuzzy.normal("n"))).count() < 0.01 * 500 * len(NAMES)


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("least, q", [(80, 2), (90, 3), (60, 2)])
def test_near_join_equals_all_pairs(spark, least, q):
    rng = random.Random(6)
    base = ["".join(rng.choices("abc ", k=rng.randrange(0, 30))) for _ in range(60)] + ["ab", "abc", "x", "", "aaaaaaaaaa"]
    other = [distorted(rng, s) for s in base for _ in range(2)]
    left, right = (spark.createDataFrame([(s, "x") for s in [*side, side[0], None]], "s string, key string") for side in (base, other))
    got = sorted(map(tuple, fuzzy.near_join(left, right, "s", "s", least, q).collect()))
    want = []
    for a in set(base):
        for b in set(other):
            n = max(len(a), len(b))
            score = 100 if n == 0 else int((100 * n - 100 * lev(a, b)) // n)
            if score > least:
                want.append((a, b, score))
    assert got == sorted(want)


def test_no_strings(spark):
    none = spark.createDataFrame([], "s string")
    assert fuzzy.near_join(none, none, "s", "s").count() == 0


def loop(sentences, hits):
    out, now = [], None
    for s, h in zip(sentences, hits, strict=True):
        speaker = h if h is not None else now
        if out and speaker == now:
            out[-1][1].append(s)
        else:
            out.append((speaker, [s]))
        now = speaker
    return [(k, " ".join(v)) for k, v in out] or None


def test_islands_equal_a_loop(spark):
    rng = random.Random(7)
    rows = [([f"s{i}" for i in range(n)], [rng.choice([None, None, "A", "B"]) for _ in range(n)]) for n in [0, 1, 1, 2, 2, 3] + [rng.randrange(30) for _ in range(60)]]
    df = spark.createDataFrame(rows, "s array<string>, h array<string>")
    got = [[tuple(x) for x in r["i"]] if r["i"] is not None else None for r in df.select(segments.islands(F.col("s"), F.col("h")).alias("i")).collect()]
    assert got == [loop(*r) for r in rows]


def test_documents_are_cut_in_their_rows(spark):
    docs = spark.createDataFrame([("d", "Mr. LEE. I rise. Mr. ROOE. So do I. Thanks.", {"Mr. LEE": "L", "Mr. ROE": "R"}), ("e", None, {}), ("f", "", None)], "crec_id string, content string, speaker_ids map<string,string>")
    for fuzzy_ in (False, True):
        out = segments.document_segments(docs.repartition(2), fuzzy=fuzzy_, mode="intent")
        plan = segments.document_segments(docs, fuzzy=fuzzy_)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        got = {r["crec_id"]: r["segments"] for r in out.collect()}
        assert got["e"] is None and got["f"] is None
        assert [(s["speaker"], s["bioguide_id"]) for s in got["d"]] == ([("Mr. LEE", "L"), ("Mr. ROE", "R")] if fuzzy_ else [("Mr. LEE", "L")])
        assert " ".join(s["text"] for s in got["d"]) == "Mr. LEE. I rise. Mr. ROOE. So do I. Thanks."


def test_a_long_text_takes_time_in_proportion(spark):
    import time

    took = []
    for n in (20_000, 80_000):
        df = spark.createDataFrame([("d", "Mr. A says so. Mr. B does not. " * (n // 2), {"Mr. A": "a", "Mr. B": "b"})], "crec_id string, content string, speaker_ids map<string,string>")
        began = time.time()
        assert segments.document_segments(df, fuzzy=False).select(F.size("segments")).first()[0] == n
        took.append(time.time() - began)
    assert took[1] < 8 * took[0] + 2
