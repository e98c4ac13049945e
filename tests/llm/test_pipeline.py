"""Stages of the pipeline on the small tables: each on what its predecessor kept."""

import os

import pytest

import corpus_pipeline
from rostra.llm import decontaminate, minhash
from tests.llm.test_operators import sets_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        out.append(f(spark, out[-1], SF).cache())
    return out


def test_columns_and_order(stages):
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "benchmark", "packed"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_clean_labelled_documents_stay(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    bad = {r["doc_id"] for r in labels.where("quality = 0").collect()}
    kept = {r["doc_id"] for r in stages[1].collect()}
    assert len(good & kept) >= 0.98 * len(good) and len(bad & kept) <= 0.1 * len(bad)


def test_lines_change_texts_only(stages):
    before = {r["doc_id"]: r for r in stages[1].collect()}
    after = {r["doc_id"]: r for r in stages[2].collect()}
    assert set(before) == set(after)
    for i, r in after.items():
        if r["text"] != before[i]["text"]:
            left = iter(before[i]["text"].split("\n"))
            assert all(x in left for x in r["text"].split("\n")) and r["n_chars"] == len(r["text"])


def test_line_with_the_fingerprint_goes(spark):
    """Every site counts, also where the line holds the first long word; sites of copies do not."""
    notice, words = "(c)2024-2025 Example Media", lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    rows = [(i, f"Ordinary {words(i)}\n{notice}", f"site{i}") for i in range(12)]
    rows += [(100 + i, f"Article {words(99)}\nand its end, told again", f"site{i}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, docs, SF).collect()}
    assert got == {i: t.replace("\n" + notice, "") for i, t, _ in rows}


def test_short_page_loses_its_menu(spark):
    """Boilerplate goes also where it is most of a page, or all of it."""
    menu = "Home and all the other pages\nRead more about this on our site\nWritten by the editors of Example Media"
    rows = [(i, f"{menu}\n" + " ".join(f"w{i}x{j}" for j in range(30 if i < 12 else 2)), f"site{i}") for i in range(13)]
    rows.append((13, menu, "site13"))
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), SF).collect()}
    assert got == {i: t.removeprefix(menu).lstrip("\n") for i, t, _ in rows}


def test_one_of_each_group_stays(stages):
    texts = {r["doc_id"]: sets_of(r["text"], 5) for r in stages[2].collect()}
    kept = sorted(r["doc_id"] for r in stages[3].collect())
    for k, i in enumerate(kept):
        for j in kept[k + 1 :]:
            a, b = texts[i], texts[j]
            assert not (a and b and 100 * len(a & b) >= minhash.SIMILARITY * len(a | b))


def test_no_item_is_left(spark, stages):
    items = [decontaminate.fold(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {r["doc_id"]: decontaminate.fold(r["text"]) for r in stages[4].collect()}
    before = {r["doc_id"]: decontaminate.fold(r["text"]) for r in stages[3].collect()}
    assert not any(x in t for t in left.values() for x in items)
    assert {i for i, t in before.items() if any(x in t for x in items)} <= set(before) - set(left)


def test_all_that_is_left_is_packed(stages):
    assert {r["doc_id"] for r in stages[5].collect()} == {r["doc_id"] for r in stages[4].collect()}
