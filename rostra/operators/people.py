"""People, their terms of office and external ids: filters, joins, nesting and upserts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostra.functions import text as X

PERSON_FIELDS = ("official_full", "last", "gender", "religion")
TERM_TYPES = ("sen", "rep")
# Where portraits and biographies are found.
IMAGE = "https://theunitedstates.io/images/congress/{}/{}.jpg"
BIO_PAGE = "https://www.congress.gov/member/{}/{}"


def filter_people(people: DataFrame, **equal: str | None) -> DataFrame:
    """People whose named columns equal the given values; empty values are ignored."""
    for name, value in equal.items():
        if value:
            people = people.where(F.col(name) == value)
    return people


def by_terms(people: DataFrame, terms: DataFrame, tests: Iterable[Column], key: str = "bioguide_id", mode: str = "compat") -> DataFrame:
    """People by predicates on terms.

    Compat: one inner join a predicate, so rows multiply and predicates may hold for
    different terms. Intent: each person once, if one term meets all predicates.
    """
    tests = list(tests)
    if mode == "intent":
        one = terms
        for t in tests:
            one = one.where(t)
        return people.join(one.select(key), key, "left_semi") if tests else people
    for t in tests:
        people = people.join(terms.where(t).select(key), key)
    return people


def term_tests(state: str | None = None, party: str | None = None, term_type: str | None = None) -> list[Column]:
    """Predicates of a people search; an unknown type of term is ignored."""
    tests = []
    if state:
        tests.append(F.col("state") == state)
    if party:
        tests.append(F.col("party") == party)
    if term_type in TERM_TYPES:
        tests.append(F.col("type") == term_type)
    return tests


def search_people(people: DataFrame, terms: DataFrame, name: str | None = None, last_name: str | None = None, gender: str | None = None, religion: str | None = None, state: str | None = None, party: str | None = None, term_type: str | None = None, person_id: str | None = None, mode: str = "compat") -> DataFrame:
    """People by all given criteria, by full name; an id overrides everything else."""
    if person_id:
        return by_id(people, person_id)
    found = by_terms(people, terms, term_tests(state, party, term_type), mode=mode)
    return filter_people(found, official_full=name, last=last_name, gender=gender, religion=religion).orderBy("official_full", "bioguide_id")


def by_id(people: DataFrame, person_id: str) -> DataFrame:
    """The person of an id; a LookupError if there is none."""
    found = people.where(F.col("bioguide_id") == person_id)
    if found.isEmpty():
        raise LookupError(person_id)
    return found


def by_external_id(people: DataFrame, ids: DataFrame, value: str, kind: str = "bioguide") -> DataFrame:
    """The person of the first external id of a kind and value."""
    first = ids.where((F.col("type") == kind) & (F.col("value") == value)).orderBy("bioguide_id").limit(1)
    return people.join(first.select("bioguide_id"), "bioguide_id")


def current(people: DataFrame, terms: DataFrame, as_of: dt.date, state: str | None = None, key: str = "bioguide_id", mode: str = "compat") -> DataFrame:
    """People with a term that covers the day, once a term; intent mode honours the state."""
    serving = terms.where(F.lit(as_of).between(F.col("start_date"), F.col("end_date")))
    if state and mode == "intent":
        serving = serving.where(F.col("state") == state)
    return people.join(serving.select(key), key)


def latest_term(terms: DataFrame, key: str = "bioguide_id", order: tuple[str, ...] = ("start_date", "end_date")) -> DataFrame:
    """Each person's last term by start; ties by the further columns."""
    columns = [c for c in terms.columns if c != key]
    best = terms.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("t"))
    return best.select(key, "t.*")


def term_at(docs: DataFrame, terms: DataFrame, key: str = "bioguide_id", day: str = "date_issued") -> DataFrame:
    """Documents with the term that covered their day: the latest started, null columns if none did.

    Each person and day is looked up once, however many documents they have.
    """
    columns = [c for c in terms.columns if c != key]
    asked = docs.select(key, day).distinct()
    met = asked.join(terms, key).where(F.col(day).between(F.col("start_date"), F.col("end_date")))
    best = met.groupBy(key, day).agg(F.max_by(F.struct(*columns), F.struct("start_date", "end_date")).alias("t"))
    return docs.join(best, [key, day], "left").select(*docs.columns, *[F.col(f"t.{c}").alias(c) for c in columns])


def nested(people: DataFrame, terms: DataFrame, ids: DataFrame, key: str = "bioguide_id", term_columns: tuple[str, ...] | None = None) -> DataFrame:
    """People with arrays of their terms, by start, and external ids; empty arrays if none.

    Each side is gathered by person before it is joined, so the sides do not multiply.
    """
    columns = list(term_columns or [c for c in terms.columns if c not in (key, "start_date")])
    ts = terms.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start_date", *[c for c in columns if c != "start_date"]))).alias("terms"))
    es = ids.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("type", "value"))).alias("external_ids"))
    out = people.join(ts, key, "left").join(es, key, "left")
    return out.withColumn("terms", F.coalesce("terms", F.array().cast(ts.schema["terms"].dataType))).withColumn("external_ids", F.coalesce("external_ids", F.array().cast(es.schema["external_ids"].dataType)))


def with_urls(people: DataFrame, key: str = "bioguide_id", name: str = "official_full") -> DataFrame:
    """People with the addresses of their portraits and biography."""
    k = F.col(key).cast("string")
    large, small = (IMAGE.format(size, "%s") for size in ("450x550", "225x275"))
    return people.withColumns({"image_lg": F.format_string(large, k), "image_sm": F.format_string(small, k), "bio_page_url": F.format_string(BIO_PAGE.format("%s", "%s"), X.slug(name), k)})


def with_state(terms: DataFrame, states: DataFrame, code: str = "state") -> DataFrame:
    """Terms with the name of their state; terms of unknown states are left out."""
    return terms.join(states.select(F.col("short").alias(code), F.col("name").alias("state_name")), code)


def unknown_states(terms: DataFrame, states: DataFrame, code: str = "state") -> DataFrame:
    return terms.join(states.select(F.col("short").alias(code)), code, "left_anti")


def keep_last(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last row of each key by ``seq``."""
    w = Window.partitionBy(*keys).orderBy(F.col(seq).desc())
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def folded(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row a key; a column keeps its last value by ``seq`` that is not null."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in rest])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Old and new rows as one a key; a column keeps its last value that is not null, a new one before an old."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rows = both.withColumn("_order", F.struct("_new", seq)).drop("_new")
    return folded(rows, keys, "_order").drop("_order")


def delete_keys(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` without the keys of ``gone``; apply it to children as well to cascade."""
    return df.join(gone.select(*keys), keys, "left_anti")


def match_speakers(docs: DataFrame, people: DataFrame, terms: DataFrame, key: str = "crec_id", speakers: str = "speakers", mode: str = "compat") -> DataFrame:
    """``docs`` with ``matched``: portrait, party and biography of each speaker of a comma-joined list.

    Speakers are matched by full name with one person each and keep their order; those
    without a person are left out. Compat cuts at every comma, so names with one never
    match; intent takes an array of names as it is.
    """
    kind = docs.schema[speakers].dataType.typeName()
    names = F.split(F.concat_ws(",", speakers), ",") if mode == "compat" or kind != "array" else F.col(speakers)
    one = people.groupBy("official_full").agg(F.min("bioguide_id").alias("bioguide_id"))
    facts = with_urls(one).join(latest_term(terms).select("bioguide_id", "party"), "bioguide_id", "left").select(F.col("official_full").alias("_name"), F.struct(F.col("image_sm").alias("im_url"), "party", "bio_page_url").alias("_fact"))
    rows = docs.select(key, F.posexplode(names).alias("_pos", "_name")).join(facts, "_name")
    got = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_pos", "_fact"))).alias("_got")).select(key, F.transform("_got", lambda x: x["_fact"]).alias("matched"))
    out = docs.join(got, key, "left")
    return out.withColumn("matched", F.coalesce("matched", F.array().cast(got.schema["matched"].dataType)))


def party_colour(party: Column | str) -> Column:
    p = X.col(party)
    return F.when(p == "Democrat", "democrat").when(p == "Republican", "republican").otherwise("independent")
