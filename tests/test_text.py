import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rostra import constants as K
from rostra.functions import text as X


def run(spark, values, expression):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r["x"] for r in rows.select("i", expression("t").alias("x")).orderBy("i").collect()]


WORDS = ["o'brien", "MC DONALD", "john of the west", "x-ray's ß", "", "naïve élan", "3rd a1b"]


def test_title_is_pythons(spark):
    assert run(spark, WORDS, X.title) == [w.title() for w in WORDS]


def python_camel(s, force):
    words = s.split()
    if force:
        return " ".join(w.title() for w in words) if len(words) > 1 else s.title() if len(s) > 4 else s
    return " ".join(w if w.isupper() else w.title() for w in words)


@pytest.mark.parametrize("force", [True, False])
def test_camel_case(spark, force):
    values = ["WBUR", "NATIONAL", "new  york", "NPR News", "o'brien LLC", "a"]
    assert run(spark, values, lambda c: X.camel_case(c, force)) == [python_camel(v, force) for v in values]


def python_clean(s):
    strip = str.strip
    for pattern, to, ends in X.CLEANUP:
        s = re.sub(pattern.replace("(?U)", ""), to, s)
        s = strip(s) if ends else s
    return s


DIRTY = ["E X T E N S I O N  O F  R E M A R K S\n\nHON. ANN LEE\nof ohio", "a____b<b>c</b>\n\n\nd", "x   y....z. . of it. in", "one. of two", "", "  \n "]


def test_cleanup_steps(spark):
    assert run(spark, DIRTY, lambda c: X.clean(c, heading=False)) == [python_clean(s) for s in DIRTY]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab .\n_<>HON[]- ", max_size=40), min_size=20, max_size=20))
def test_cleanup_on_any_text(spark, values):
    assert run(spark, values, lambda c: X.clean(c, heading=False)) == [python_clean(s) for s in values]


def test_heading(spark):
    assert run(spark, ["x y THE SENATE MET today", "none here", "A[B]C^D_E~F!"], X.from_heading) == [" THE SENATE MET today", None, "A[B]C^D_E~F!"]


def test_remove_punct(spark):
    got = run(spark, ["import-export  banks, (inc.)", "...U.S. [x]\\y^z"], lambda c: X.remove_punct(c, leading=K.LEADING_MARKS))
    assert got == ["import export banks inc.", "U.S. xyz"]


def test_entities(spark):
    got = run(spark, ["HON", "hon", "Senate Sine Die Adjournment", "U.S. SENATE", "NPR", "Madam"], X.clean_entity)
    # the blacklist is asked for the word in title case, so HON goes as Hon does
    assert got == [None, None, "Senate", "U.S. Senate", "NPR", None]


def test_trailing_tags(spark):
    def tagged(*pairs):
        return F.array(*[F.struct(F.lit(t).alias("text"), F.lit(g).alias("tag")) for t, g in pairs])

    cases = {
        "The Senate": tagged(("The", "DT"), ("Senate", "NNP"), ("votes", "VBZ")),
        "Ohio": tagged(("Ohio", "NNP"), ("do", "VBP"), ("not", "RB")),
        "Lee": tagged(("Lee", "NNP"), ("and", "CC"), ("in", "IN")),
        "a running": tagged(("a", "DT"), ("running", "VBG")),
        None: tagged(("is", "VBZ")),
    }
    row = spark.range(1).select(*[F.array_join(F.transform(X.without_trailing_tags(c), lambda w: w["text"]), " ").alias(str(k)) for k, c in cases.items()]).first()
    assert [row[str(k)] for k in cases] == list(cases)


def test_occurrences(spark):
    values = ["The the THE, other", "aaaa", "", "say the word, the Word"]
    assert run(spark, values, lambda c: X.mentions(c, "the")) == [v.lower().count("the") for v in values]
    assert run(spark, values, lambda c: X.mentions(c, "")) == [v.count("") for v in values]
    assert run(spark, values, lambda c: X.token_count(c, "the")) == [2, 0, 0, 2]
    assert run(spark, values, lambda c: X.has_phrase(c, "THE word")) == [False, False, False, True]
    assert run(spark, ["a b a b a", "ab ab"], lambda c: X.phrase_count(c, "a b")) == [2, 0]


def test_snippet(spark):
    long = "x" * 150 + "Foo" + "y" * 300
    assert run(spark, [long, "foo at once", "no", "a foo"], lambda c: X.snippet(c, "foo")) == [long[50:350], None, None, "a foo"]


def test_nulls(spark):
    rows = spark.createDataFrame([(None,)], "t string")
    out = rows.select(X.clean("t"), X.title("t"), X.snippet("t", "x"), X.camel_case("t"), X.remove_punct("t")).first()
    assert all(v is None for v in out)


def test_the_steps_of_an_entity_are_bound_once():
    plan = str(X.clean_entity("surface"))
    assert plan.count("surface") == 1
