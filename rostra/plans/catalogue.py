"""Registered queries of the engine and the SQL that must give the same rows.

The driver's tables stand in for the engine's (see :mod:`rostra.plans.roles`). Every query
runs over whole tables; limits stand only where a page is what is asked for.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rostra.constants import BILL_TYPES, STATES
from rostra.functions import text as X
from rostra.operators import abbreviations, entities, fuzzy, histogram, index, people, search, segments
from rostra.operators import page as pages
from rostra.plans import roles
from rostra.sources import archive, daily, documents, shared
from rostra.sources import people as people_source
from rostra.streaming import ingest, latest

START, END = dt.date(2017, 2, 1), dt.date(2017, 3, 3)
TERM, PHRASE, SECOND = "the", "of the", "src1"

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}

_D = """d AS (SELECT doc_id AS crec_id, text AS content, source AS title, lang AS title_part,
  DATE '2017-01-01' + CAST(doc_id % 90 AS INTEGER) AS date_issued FROM documents)"""
_TOK = r"list_filter(regexp_split_to_array(lower(content), '[ \t\n\r\f]+'), lambda x: x <> '')"
_ANA = r"regexp_extract_all(lower(content), '[\p{L}\p{N}]+(?:[''’][\p{L}\p{N}]+)*')"
_HAS = f"list_contains({_ANA}, 'the')"
_PHR = f"contains(' ' || array_to_string({_ANA}, ' ') || ' ', ' of the ')"
_PERSON = "p AS (SELECT c_custkey AS bioguide_id, c_name AS official_full, c_mktsegment AS religion FROM customer)"
_TERMS = """t AS (SELECT o_custkey AS bioguide_id, o_orderkey AS term_id, CAST(o_orderdate AS DATE) AS start_date,
  CAST(o_orderdate AS DATE) + 365 AS end_date, o_orderstatus AS type, o_orderpriority AS party FROM orders)"""


def query(sql: str | None = None):
    def keep(f: Callable) -> Callable:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


# -- histograms ------------------------------------------------------------------------


@query(f"""WITH {_D} SELECT date_issued AS date, CAST(sum(len(list_filter(list_slice({_TOK}, 1, 4999), lambda x: x = 'the'))) AS BIGINT) AS count
FROM d WHERE date_issued BETWEEN DATE '2017-02-01' AND DATE '2017-03-03' AND {_HAS} GROUP BY 1""")
def term_counts_by_day(spark, d) -> DataFrame:
    return histogram.term_counts(roles.docs(spark, d), TERM, START, END)


@query(f"""WITH {_D}, c AS (SELECT date_issued AS date, sum(len(list_filter(list_slice({_TOK}, 1, 4999), lambda x: x = 'the'))) AS n
FROM d WHERE date_issued BETWEEN DATE '2017-02-01' AND DATE '2017-05-01' AND {_HAS} GROUP BY 1),
s AS (SELECT CAST(unnest(generate_series(DATE '2017-02-01', DATE '2017-05-01', INTERVAL 1 DAY)) AS DATE) AS date)
SELECT s.date, CAST(coalesce(n, 0) AS BIGINT) AS count FROM s LEFT JOIN c USING (date)""")
def term_counts_dense(spark, d) -> DataFrame:
    return histogram.dense_term_counts(roles.docs(spark, d), TERM, START, dt.date(2017, 5, 1))


@query(f"""WITH {_D} SELECT date_issued AS date, CAST(sum(len(list_filter({_TOK}, lambda x: x = 'the'))) AS BIGINT) AS count
FROM d WHERE date_issued BETWEEN DATE '2017-02-01' AND DATE '2017-03-03' AND {_HAS} GROUP BY 1""")
def term_counts_uncapped(spark, d) -> DataFrame:
    return histogram.term_counts(roles.docs(spark, d), TERM, START, END, limit=None)


@query(rf"""WITH {_D}, a AS (SELECT date_issued AS date, '  ' || array_to_string({_ANA}, '   ') || '  ' AS w FROM d
WHERE date_issued BETWEEN DATE '2017-02-01' AND DATE '2017-03-03')
SELECT date, CAST(sum((length(w) - length(replace(w, '  of   the  ', ''))) // 13) AS BIGINT) AS count FROM
(SELECT date, replace(w, '   ', '    ') AS w FROM a WHERE contains(w, '  of   the  ')) z GROUP BY 1""".replace("'  of   the  ', ''))) // 13", "'  of    the  ', ''))) // 13"))
def phrase_counts_by_day(spark, d) -> DataFrame:
    return histogram.term_counts(roles.docs(spark, d), PHRASE, START, END, mode="intent")


@query(f"""WITH {_D}, n AS (SELECT date_issued, len(list_filter(list_slice({_TOK}, 1, 4999), lambda x: x = 'the')) AS n FROM d WHERE {_HAS}),
s AS (SELECT coalesce(sum(n) FILTER (date_issued BETWEEN DATE '2017-02-01' AND DATE '2017-03-03'), 0) AS c,
coalesce(sum(n) FILTER (date_issued BETWEEN DATE '2017-01-02' AND DATE '2017-02-01'), 0) AS p FROM n)
SELECT CAST(c AS BIGINT) AS current_total, CAST(p AS BIGINT) AS previous_total, CAST(trunc(100 * ((c - p) / CAST(greatest(p, 1) AS DOUBLE))) AS INTEGER) AS delta FROM s""")
def period_delta(spark, d) -> DataFrame:
    return histogram.period_delta(roles.docs(spark, d), TERM, START, END)


@query(f"""WITH {_D}, c AS (SELECT date_issued AS date, sum(len(list_filter(list_slice({_TOK}, 1, 4999), lambda x: x = 'the'))) AS n FROM d WHERE {_HAS} GROUP BY 1),
s AS (SELECT 'current' AS period, CAST(unnest(generate_series(DATE '2017-02-01', DATE '2017-03-03', INTERVAL 1 DAY)) AS DATE) AS date
UNION ALL SELECT 'previous', CAST(unnest(generate_series(DATE '2017-01-02', DATE '2017-02-01', INTERVAL 1 DAY)) AS DATE))
SELECT period, s.date, CAST(coalesce(n, 0) AS BIGINT) AS count FROM s LEFT JOIN c USING (date)""")
def period_breakdown(spark, d) -> DataFrame:
    return histogram.period_breakdown(roles.docs(spark, d), TERM, START, END)


# -- search ------------------------------------------------------------------------------


@query(f"WITH {_D} SELECT crec_id FROM d WHERE {_HAS}")
def analyzed_term_docs(spark, d) -> DataFrame:
    return roles.docs(spark, d).where(X.has_term("content", TERM)).select("crec_id")


@query(f"WITH {_D} SELECT crec_id, date_issued FROM d WHERE {_PHR} AND date_issued BETWEEN DATE '2017-02-01' AND DATE '2017-03-03'")
def phrase_search(spark, d) -> DataFrame:
    rows = histogram.in_range(roles.docs(spark, d), START, END)
    return search.phrase_filter(rows, {"content": PHRASE}).select("crec_id", "date_issued")


@query(f"WITH {_D} SELECT crec_id FROM d WHERE {_PHR} AND title = 'src1'")
def search_two_fields_and(spark, d) -> DataFrame:
    return search.phrase_filter(roles.docs(spark, d), {"content": PHRASE, "title": SECOND, "page": "ignored"}).select("crec_id")


_BM25 = rf"""WITH {_D}, w AS (SELECT crec_id, date_issued, {_ANA} AS a FROM d),
s AS (SELECT count(*) AS n, avg(len(a)) AS m, count(*) FILTER (list_contains(a, 'of')) AS d1, count(*) FILTER (list_contains(a, 'the')) AS d2 FROM w),
f AS (SELECT crec_id, len(a) AS dl, len(list_filter(range(1, len(a)), lambda i: a[i] = 'of' AND a[i + 1] = 'the')) AS tf FROM w
WHERE date_issued BETWEEN DATE '2017-02-01' AND DATE '2017-03-03'),
r AS (SELECT crec_id, round((ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) + ln(1 + (n - d2 + 0.5) / (d2 + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / m)), 6) AS score
FROM f, s WHERE tf > 0)
SELECT crec_id, score FROM r ORDER BY score DESC, crec_id LIMIT 10 OFFSET """


def _ranked(spark, d, offset: int) -> DataFrame:
    rows = search.bm25(roles.docs(spark, d), PHRASE)
    hits = search.phrase_filter(histogram.in_range(rows, START, END), {"content": PHRASE})
    return search.page(hits.select("crec_id", F.round("score", 6).alias("score")), 10, offset)


@query(_BM25 + "0")
def bm25_topk(spark, d) -> DataFrame:
    return _ranked(spark, d, 0)


@query(_BM25 + "10")
def page_two_offset(spark, d) -> DataFrame:
    return _ranked(spark, d, 10)


@query(_BM25.split("SELECT crec_id, score FROM r")[0] + "SELECT crec_id, score FROM r")
def postings_search(spark, d) -> DataFrame:
    """Every hit of the phrase with its score, from postings and not from texts."""
    docs = roles.docs(spark, d)
    hits = search.phrase_hits(search.postings(docs, keep=["date_issued"]), search.statistics(docs), PHRASE, keep=["date_issued"])
    return histogram.in_range(hits, START, END).select("crec_id", F.round("score", 6).alias("score"))


@query(rf"""WITH {_D} SELECT term, CAST(count(DISTINCT crec_id) AS BIGINT) AS docs, CAST(count(*) AS BIGINT) AS places
FROM (SELECT crec_id, unnest({_ANA}) AS term FROM d) GROUP BY term""")
def postings_summary(spark, d) -> DataFrame:
    p = search.postings(roles.docs(spark, d))
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("tf").cast("long").alias("places"))


def _indexed(spark, d) -> index.Index:
    """An index of the documents, written day by day.

    Some days are first written with other texts and with documents that are none, and then replaced;
    one day, outside the documents, is written and emptied. Part of it is then compacted.
    """
    docs, path = roles.docs(spark, d).select("crec_id", "content", "date_issued"), shared.fresh(spark, "index")
    wrong = F.dayofmonth("date_issued") % 10 == 7
    stale = docs.where(wrong).select((-1 - F.col("crec_id")).alias("crec_id"), F.lit("of the of the").alias("content"), "date_issued")
    index.add(docs.withColumn("content", F.when(wrong, F.lit("the of the")).otherwise(F.col("content"))).unionByName(stale), path, buckets=8)
    gone = docs.where("date_issued = DATE '2017-01-07'").withColumn("date_issued", F.lit(dt.date(2017, 12, 1)))
    index.add(docs.where(wrong).unionByName(gone), path)
    index.compact(spark, path)
    index.add(gone.limit(0), path, days=[dt.date(2017, 12, 1)])
    return index.Index(spark, path)


@query(_BM25.split("SELECT crec_id, score FROM r")[0] + "SELECT crec_id, score FROM r")
def index_search(spark, d) -> DataFrame:
    """Every hit of the phrase in the range with its score, from a written index whose days were in part replaced."""
    return _indexed(spark, d).hits(PHRASE, START, END).select(F.col("key").alias("crec_id"), F.round("score", 6).alias("score"))


@query(_BM25 + "10")
def index_page(spark, d) -> DataFrame:
    """The second page of a search through the index, with the texts of its documents fetched."""
    rows = search.search(roles.docs(spark, d), {"content": PHRASE}, START, END, offset=10, index=_indexed(spark, d))
    return rows.where("content IS NOT NULL").select("crec_id", F.round("score", 6).alias("score"))


@query(_SQL["term_counts_dense"])
def index_term_counts(spark, d) -> DataFrame:
    """Ninety days of a term from the daily counts of the index."""
    return histogram.dense_term_counts(_indexed(spark, d), TERM, START, dt.date(2017, 5, 1))


@query(_SQL["phrase_counts_by_day"])
def index_phrase_counts(spark, d) -> DataFrame:
    return histogram.term_counts(_indexed(spark, d), PHRASE, START, END, mode="intent")


@query(rf"""WITH {_D}, w AS (SELECT date_issued AS day, crec_id, unnest({_ANA}) AS term FROM d), k AS (SELECT date_issued AS day, unnest({_TOK}) AS term FROM d),
a AS (SELECT day, term, count(DISTINCT crec_id) AS docs, count(*) AS places FROM w GROUP BY 1, 2), b AS (SELECT day, term, count(*) AS tokens FROM k GROUP BY 1, 2)
SELECT coalesce(a.day, b.day) AS day, coalesce(a.term, b.term) AS term, CAST(coalesce(docs, 0) AS BIGINT) AS docs, CAST(coalesce(places, 0) AS BIGINT) AS places, CAST(coalesce(tokens, 0) AS BIGINT) AS tokens
FROM a FULL JOIN b ON a.day = b.day AND a.term = b.term""")
def index_daily_counts(spark, d) -> DataFrame:
    """The whole rollup of a written index: what is kept of every word and token of every day."""
    return _indexed(spark, d).all_counts().select("day", "term", "docs", "places", "tokens")


@query(f"WITH {_D} SELECT crec_id, CAST((length(content) - length(replace(lower(content), 'of the', ''))) // 6 AS INTEGER) AS mentions FROM d")
def mentions(spark, d) -> DataFrame:
    return roles.docs(spark, d).select("crec_id", X.mentions("content", PHRASE).alias("mentions"))


_SNIP = """CASE WHEN p > 1 THEN substring(content, greatest(1, p - 100), least(length(content), p - 1 + 200) - greatest(0, p - 1 - 100)) END"""


@query(f"WITH {_D}, s AS (SELECT crec_id, content, instr(lower(content), 'of the') AS p FROM d) SELECT crec_id, {_SNIP} AS snippet FROM s")
def snippet(spark, d) -> DataFrame:
    return roles.docs(spark, d).select("crec_id", X.snippet("content", PHRASE).alias("snippet"))


@query("SELECT event_id, strftime(ts, '%b %d, %Y') AS human_date FROM events")
def human_date(spark, d) -> DataFrame:
    return roles.read(spark, d, "events").select("event_id", X.human_date("ts").alias("human_date"))


@query(f"""WITH {_D}, s AS (SELECT *, instr(lower(content), 'of the') AS p FROM d WHERE {_PHR})
SELECT crec_id AS id, strftime(date_issued, '%b %d, %Y') AS "displayDate", CAST((length(content) - length(replace(lower(content), 'of the', ''))) // 6 AS INTEGER) AS "mentionCount",
title, CAST(NULL AS VARCHAR) AS "docUrl", {_SNIP} AS snippet FROM s""")
def list_items(spark, d) -> DataFrame:
    rows = search.phrase_filter(roles.docs(spark, d).withColumn("html_url", F.lit(None).cast("string")), {"content": PHRASE})
    return pages.list_items(pages.enriched(rows, PHRASE))


@query(f"""WITH {_D}, {_TERMS}, n AS (SELECT crec_id, pos, CASE pos WHEN 0 THEN 'Customer#' || lpad(CAST(crec_id % 150 AS VARCHAR), 9, '0') ELSE 'Customer#' || lpad(CAST(crec_id * 7 % 150 AS VARCHAR), 9, '0') END AS name
FROM d, (VALUES (0), (2)) v(pos)),
one AS (SELECT c_name AS name, min(c_custkey) AS id FROM customer GROUP BY 1),
l AS (SELECT bioguide_id, arg_max(party, (start_date, end_date)) AS party FROM (SELECT bioguide_id, start_date, end_date, max(party) AS party FROM t GROUP BY ALL) GROUP BY 1),
m AS (SELECT crec_id, pos, 'https://www.congress.gov/member/' || lower(name) || '/' || id || '|' || coalesce(party, '') AS x FROM n JOIN one USING (name) LEFT JOIN l ON l.bioguide_id = id)
SELECT crec_id, coalesce(string_agg(x, ';' ORDER BY pos), '') AS matched FROM d LEFT JOIN m USING (crec_id) GROUP BY crec_id""")
def top_mentions_speakers(spark, d) -> DataFrame:
    held = roles.terms(spark, d).groupBy("bioguide_id", "start_date", "end_date").agg(F.max("party").alias("party"))
    out = people.match_speakers(roles.docs(spark, d), roles.people(spark, d), held)
    flat = F.array_join(F.transform("matched", lambda m: F.concat(m["bio_page_url"], F.lit("|"), F.coalesce(m["party"], F.lit("")))), ";")
    return out.select("crec_id", flat.alias("matched"))


# -- people --------------------------------------------------------------------------------


@query(f"WITH {_PERSON}, {_TERMS} SELECT p.bioguide_id, official_full FROM p JOIN t USING (bioguide_id) WHERE DATE '1998-06-01' BETWEEN start_date AND end_date")
def people_current(spark, d) -> DataFrame:
    return people.current(roles.people(spark, d), roles.terms(spark, d), roles.AS_OF).select("bioguide_id", "official_full")


@query(f"WITH {_PERSON}, {_TERMS} SELECT p.bioguide_id, official_full FROM p JOIN t a USING (bioguide_id) JOIN t b USING (bioguide_id) WHERE a.type = 'O' AND b.party = '1-URGENT' AND religion = 'BUILDING'")
def people_chained_join(spark, d) -> DataFrame:
    tests = [F.col("type") == "O", F.col("party") == "1-URGENT"]
    rows = people.by_terms(roles.people(spark, d), roles.terms(spark, d), tests)
    return people.filter_people(rows, religion="BUILDING", official_full=None).select("bioguide_id", "official_full")


@query(f"WITH {_PERSON}, {_TERMS} SELECT bioguide_id, official_full FROM p WHERE EXISTS (SELECT 1 FROM t WHERE t.bioguide_id = p.bioguide_id AND type = 'O' AND party = '1-URGENT')")
def people_semi(spark, d) -> DataFrame:
    tests = [F.col("type") == "O", F.col("party") == "1-URGENT"]
    return people.by_terms(roles.people(spark, d), roles.terms(spark, d), tests, mode="intent").select("bioguide_id", "official_full")


@query(f"""WITH {_PERSON}, {_TERMS}, ts AS (SELECT bioguide_id, string_agg(CAST(start_date AS VARCHAR) || ':' || type || ':' || term_id, ';' ORDER BY start_date, type, term_id) AS terms FROM t GROUP BY 1),
es AS (SELECT s_nationkey, string_agg('supplier:' || s_suppkey, ';' ORDER BY CAST(s_suppkey AS VARCHAR)) AS ids FROM supplier GROUP BY 1)
SELECT p.bioguide_id, coalesce(terms, '') AS terms, coalesce(ids, '') AS external_ids FROM p LEFT JOIN ts USING (bioguide_id) LEFT JOIN es ON s_nationkey = p.bioguide_id""")
def person_nested(spark, d) -> DataFrame:
    s = roles.read(spark, d, "supplier")
    ids = s.select(F.col("s_nationkey").cast("long").alias("bioguide_id"), F.lit("supplier").alias("type"), F.col("s_suppkey").cast("string").alias("value"))
    ts = roles.terms(spark, d)
    out = people.nested(roles.people(spark, d), ts, ids, term_columns=("type", "term_id"))
    one = F.array_join(F.transform("terms", lambda t: F.concat_ws(":", t["start_date"].cast("string"), t["type"], t["term_id"].cast("string"))), ";")
    return out.select("bioguide_id", one.alias("terms"), F.array_join(F.transform("external_ids", lambda e: F.concat_ws(":", e["type"], e["value"])), ";").alias("external_ids"))


@query(f"WITH {_TERMS} SELECT bioguide_id, start_date, type, party FROM t QUALIFY row_number() OVER (PARTITION BY bioguide_id ORDER BY start_date DESC, term_id DESC) = 1")
def person_latest_term(spark, d) -> DataFrame:
    return people.latest_term(roles.terms(spark, d), order=("start_date", "term_id")).select("bioguide_id", "start_date", "type", "party")


@query(f"""WITH {_TERMS}, e AS (SELECT event_id, user_id AS bioguide_id, CAST(ts AS DATE) - 9500 + CAST(event_id % 1500 AS INTEGER) AS day FROM events)
SELECT event_id, term_id FROM e LEFT JOIN t ON t.bioguide_id = e.bioguide_id AND day BETWEEN start_date AND end_date
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY start_date DESC, end_date DESC, term_id DESC) = 1""")
def party_at_speech(spark, d) -> DataFrame:
    e = roles.read(spark, d, "events").select("event_id", F.col("user_id").alias("bioguide_id"), F.date_add(F.date_sub(F.to_date("ts"), 9500), F.pmod("event_id", F.lit(1500)).cast("int")).alias("day"))
    one = roles.terms(spark, d).groupBy("bioguide_id", "start_date", "end_date").agg(F.max("term_id").alias("term_id"))
    return people.term_at(e, one, day="day").select("event_id", "term_id")


@query(f"""WITH {_PERSON} SELECT bioguide_id, 'https://theunitedstates.io/images/congress/450x550/' || bioguide_id || '.jpg' AS image_lg,
'https://theunitedstates.io/images/congress/225x275/' || bioguide_id || '.jpg' AS image_sm, 'https://www.congress.gov/member/' || lower(official_full) || '/' || bioguide_id AS bio_page_url FROM p""")
def person_urls(spark, d) -> DataFrame:
    return people.with_urls(roles.people(spark, d)).select("bioguide_id", "image_lg", "image_sm", "bio_page_url")


@query(f"WITH {_PERSON} SELECT bioguide_id, official_full FROM p WHERE bioguide_id = (SELECT min(s_nationkey) FROM supplier WHERE s_name = 'Supplier#000000007')")
def external_id_lookup(spark, d) -> DataFrame:
    ids = roles.read(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("bioguide_id"), F.lit("name").alias("type"), F.col("s_name").alias("value"))
    return people.by_external_id(roles.people(spark, d), ids, "Supplier#000000007", "name").select("bioguide_id", "official_full")


def _nations(spark, d) -> DataFrame:
    return roles.read(spark, d, "nation").where("n_nationkey <> 3").select(F.col("n_nationkey").alias("short"), F.col("n_name").alias("name"))


@query("SELECT c_custkey AS bioguide_id, n_name AS state_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_nationkey <> 3")
def state_lookup(spark, d) -> DataFrame:
    return people.with_state(roles.people(spark, d), _nations(spark, d), "nation").select("bioguide_id", "state_name")


@query("SELECT c_custkey AS bioguide_id, c_nationkey AS nation FROM customer WHERE c_nationkey = 3")
def state_orphans(spark, d) -> DataFrame:
    return people.unknown_states(roles.people(spark, d), _nations(spark, d), "nation").select("bioguide_id", "nation")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def term_upsert_keep_last(spark, d) -> DataFrame:
    return people.keep_last(roles.read(spark, d, "orders"), ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("""WITH o AS (SELECT o_custkey, o_orderkey AS seq, o_orderkey % 2 AS new, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS party FROM orders)
SELECT o_custkey, coalesce(arg_max(party, seq) FILTER (new = 1 AND party IS NOT NULL), arg_max(party, seq) FILTER (new = 0 AND party IS NOT NULL)) AS party,
coalesce(max(seq) FILTER (new = 1), max(seq)) AS seq FROM o GROUP BY 1""")
def upsert_columns(spark, d) -> DataFrame:
    """Orders of odd keys put into those of even keys: a new value wins whatever its number, a null never."""
    o = roles.read(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("party"))
    return people.upsert(o.where("seq % 2 = 0"), o.where("seq % 2 = 1"), ["o_custkey"], "seq").select("o_custkey", "party", "seq")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def delete_cascade(spark, d) -> DataFrame:
    gone = roles.read(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return people.delete_keys(roles.read(spark, d, "orders"), gone, ["o_custkey"]).select("o_orderkey", "o_custkey")


@query("SELECT 1 AS seq, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 2, s_suppkey, s_name FROM supplier")
def union_sources(spark, d) -> DataFrame:
    c = roles.read(spark, d, "customer").select(F.lit(1).alias("seq"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    s = roles.read(spark, d, "supplier").select(F.lit(2).alias("seq"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return c.unionByName(s)


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'democrat' WHEN 'F' THEN 'republican' ELSE 'independent' END AS colour FROM orders")
def party_colours(spark, d) -> DataFrame:
    o = roles.read(spark, d, "orders").withColumn("party", F.expr("CASE o_orderstatus WHEN 'O' THEN 'Democrat' WHEN 'F' THEN 'Republican' ELSE o_orderstatus END"))
    return o.select("o_orderkey", people.party_colour("party").alias("colour"))


# -- text --------------------------------------------------------------------------------


@query(r"SELECT page_id, regexp_replace(html, '<[^<]+?>', '', 'g') AS body FROM pages")
def strip_tags(spark, d) -> DataFrame:
    return roles.read(spark, d, "pages").select("page_id", X.strip_tags("html").alias("body"))


@query(r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def page_title(spark, d) -> DataFrame:
    return roles.read(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


def _cleanup_sql(column: str) -> str:
    strip = lambda s: rf"regexp_replace({s}, '^\s+|\s+$', '', 'g')"
    for pattern, to, ends in X.CLEANUP:
        to = to.replace("\n", "' || chr(10) || '")
        column = f"regexp_replace({column}, '{pattern.replace('(?U)', '')}', '{to}', 'g')"
        column = strip(column) if ends else column
    return column


@query(f"SELECT page_id, {_cleanup_sql('html')} AS body FROM pages")
def preprocess_chain(spark, d) -> DataFrame:
    return roles.read(spark, d, "pages").select("page_id", X.clean("html", heading=False).alias("body"))


@query(r"""WITH h AS (SELECT page_id, html, regexp_extract(html, '(?s)^(.*?)[A-Z!"#$%&''()*+,\-./:;<=>?@\[\]\^_`{|}~ ]{10,}', 1) AS before,
regexp_matches(html, '[A-Z!"#$%&''()*+,\-./:;<=>?@\[\]\^_`{|}~ ]{10,}') AS m FROM pages)
SELECT page_id, CASE WHEN m THEN substring(html, length(before) + 1) END AS body FROM h""")
def from_heading(spark, d) -> DataFrame:
    return roles.read(spark, d, "pages").select("page_id", X.from_heading("html").alias("body"))


@query(r"""SELECT doc_id, array_to_string(list_transform(list_filter(regexp_split_to_array(source || ' ' || upper(lang) || ' mc' || lang || '''s Ab-cD', '\s+'), lambda x: x <> ''),
lambda w: CASE WHEN upper(w) = w AND lower(w) <> w THEN w ELSE array_to_string(list_transform(regexp_extract_all(w, '[\p{L}]+|[^\p{L}]+'), lambda r: upper(r[1:1]) || lower(r[2:])), '') END), ' ') AS name FROM documents""")
def camel_case(spark, d) -> DataFrame:
    text = F.concat_ws(" ", "source", F.upper("lang"), F.concat(F.lit("mc"), F.col("lang"), F.lit("'s Ab-cD")))
    return roles.read(spark, d, "documents").select("doc_id", X.camel_case(text).alias("name"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(replace(text, '-', ' '), '  ', ' '), '^\s+|\s+$', '', 'g'), '^[-!"#$%&''()*+,./:;<=>?@\[\\\]\^_`{|}~ ]+', ''),
'[-!"#$%&''()*+,/:;<=>?@\[\\\]\^_`{|}~]+', '', 'g') AS body FROM documents""")
def remove_punct(spark, d) -> DataFrame:
    from rostra.constants import LEADING_MARKS

    return roles.read(spark, d, "documents").select("doc_id", X.remove_punct("text", leading=LEADING_MARKS).alias("body"))


# -- documents and archives -----------------------------------------------------------------


_IDS = "CASE doc_id % 4 WHEN 0 THEN 'id-CREC-2017-01-20-pt1-PgD' || doc_id WHEN 1 THEN 'id-CREC-2017-01-20-pt1-PgD' || doc_id || '-2' WHEN 2 THEN 'id-CREC-2017-01-20-FrontMatter' ELSE 'id-CREC-2017-01-20-pt1-PgS' || doc_id END"


@query(f"WITH i AS (SELECT doc_id, lang, {_IDS} AS id FROM documents) SELECT doc_id, (doc_id % 4 <> 3 OR lang = 'fr') AS skip, trim(id, 'id-') || '.htm' AS body_name FROM i")
def skip_filter(spark, d) -> DataFrame:
    r = roles.read(spark, d, "documents").withColumn("id", F.expr(_IDS))
    part = F.when(F.col("lang") == "fr", "Daily Digest/Index").otherwise(F.col("lang"))
    return r.select("doc_id", documents.skippable("id", part).alias("skip"), documents.body_name("id").alias("body_name"))


@query("SELECT doc_id, 'crec/' || strftime(DATE '2017-01-01' + CAST(doc_id % 90 AS INTEGER), '%Y/%m/%d') || '/f' || doc_id || '.htm' AS key, 'CREC-' || strftime(DATE '2017-01-01' + CAST(doc_id % 90 AS INTEGER), '%Y-%m-%d') || '.zip' AS archive FROM documents")
def partition_key(spark, d) -> DataFrame:
    day = F.date_add(F.lit(dt.date(2017, 1, 1)), F.pmod("doc_id", F.lit(90)).cast("int"))
    name = F.concat(F.lit("a/b/f"), F.col("doc_id"), F.lit(".htm"))
    return roles.read(spark, d, "documents").select("doc_id", archive.staged_key(name, day).alias("key"), archive.archive_name(day).alias("archive"))


@query("SELECT page_id, (url LIKE '%htm' OR url LIKE '%mods.xml') AS relevant FROM pages")
def member_filter(spark, d) -> DataFrame:
    return roles.read(spark, d, "pages").select("page_id", archive.relevant("url").alias("relevant"))


@query("""WITH u AS (SELECT user_id, CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) AS b FROM events GROUP BY 1)
SELECT user_id, CAST(unnest(generate_series(a, b - 1, INTERVAL 1 DAY)) AS DATE) AS date FROM u WHERE a < b""")
def scrape_days(spark, d) -> DataFrame:
    """The days from each user's first event up to, not including, that of the last."""
    u = roles.read(spark, d, "events").groupBy("user_id").agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b"))
    return u.select("user_id", F.explode(archive.day_span("a", "b")).alias("date"))


_MEMBER = "CASE doc_id % 3 WHEN 0 THEN 'a/mods.xml' ELSE 'a/b/f' || doc_id || '.htm' END"


@query(f"""WITH m AS (SELECT doc_id, DATE '2017-01-01' + CAST(doc_id % 90 AS INTEGER) AS date, {_MEMBER} AS member FROM documents),
k AS (SELECT date, member, 'crec/' || strftime(date, '%Y/%m/%d') || '/' || regexp_extract(member, '[^/]+$') AS key FROM m),
b AS (SELECT date, bool_and(date <> DATE '2017-01-08') AS success, string_agg(key, chr(10) ORDER BY key) AS keys, count(*) FILTER (member LIKE '%.htm') AS n FROM k GROUP BY 1)
SELECT date, success, CASE WHEN success THEN keys ELSE 'unreadable archive' END AS message, CAST(n AS INTEGER) AS num_files FROM b""")
def audit_counts(spark, d) -> DataFrame:
    """The audit of days whose members are named after documents; one day has an unreadable archive."""
    rows = _members(spark, d)
    broken = rows.where("date = DATE '2017-01-08'").select("date").distinct().withColumn("member", F.lit(None).cast("string"))
    return archive.audit(rows.select("date", "member").unionByName(broken))


def _members(spark, d) -> DataFrame:
    return roles.read(spark, d, "documents").select(F.date_add(F.lit(dt.date(2017, 1, 1)), F.pmod("doc_id", F.lit(90)).cast("int")).alias("date"), F.expr(_MEMBER).alias("member"))


@query("""WITH h AS (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events WHERE event_id % 3 = 0), r AS (SELECT min(date) AS a, max(date) AS b FROM h),
c AS (SELECT CAST(unnest(generate_series(a, b + 4, INTERVAL 1 DAY)) AS DATE) AS date FROM r)
SELECT date, true AS success, 'no data' AS message, 0 AS num_files FROM c WHERE date NOT IN (SELECT date FROM h)""")
def no_data_day(spark, d) -> DataFrame:
    """The audit of the days, to four after the last, on which a third of the events has none: each is a success without files."""
    have = roles.read(spark, d, "events").where("event_id % 3 = 0").select(F.to_date("ts").alias("date"))
    span = have.agg(F.min("date").alias("a"), F.date_add(F.max("date"), 5).alias("b")).select(F.explode(archive.day_span("a", "b")).alias("date"))
    missing = span.join(have, "date", "left_anti").select("date", F.lit(None).cast("string").alias("member"), F.lit(archive.NO_DATA).alias("error"))
    return archive.audit(missing)


_XML_ID = "'id-CREC-' || strftime(date_issued, '%Y-%m-%d') || '-pt1-Pg' || CASE crec_id % 7 WHEN 0 THEN 'D' ELSE 'S' END || crec_id"


@query(rf"""WITH {_D}, x AS (SELECT *, {_XML_ID} AS id FROM d WHERE crec_id % 7 <> 0 AND content IS NOT NULL),
c AS (SELECT *, ' MET AND ADJOURNED. ' || content || '. Mr. DOE yields to Mr. ROE now.' AS body FROM x WHERE crec_id % 11 <> 0)
SELECT id AS crec_id, date_issued, title, title_part, 'p' || crec_id || '.pdf' AS pdf_url, CASE WHEN crec_id % 5 = 0 THEN '' ELSE 'h' || crec_id || '.htm' END AS html_url,
'S' || crec_id AS page_start, '' AS page_end, 'Roe ' || crec_id % 3 || ';Doe' AS speakers, 'D' || crec_id % 4 AS roe_id, 'Mr. ROE,Mr. DOE' AS named, id || '-1::;' || id || '-2:Mr. ROE:D' || crec_id % 4 AS segments, md5(__CLEAN__) AS content_md5 FROM c""")
def load_job(spark, d) -> DataFrame:
    """The load job over a table of metadata files and bodies made of the documents: every field of the XML, the cleaned body and its segments.

    A name that is given twice is tried where it first stands, and has the id it is last given.
    """
    loaded, _ = documents.load(_staged(spark, d), fuzzy=False)
    return _fields(loaded)


def _fields(loaded: DataFrame) -> DataFrame:
    one = F.array_join(F.transform("segments", lambda s: F.concat_ws(":", s["id"], F.coalesce(s["speaker"], F.lit("")), F.coalesce(s["bioguide_id"], F.lit("")))), ";")
    return loaded.withColumns({"named": F.array_join(F.map_keys("speaker_ids"), ","), "segments": one}).select("crec_id", "date_issued", "title", "title_part", "pdf_url", "html_url", "page_start", "page_end", F.array_join("speakers", ";").alias("speakers"), F.col("speaker_ids")["Mr. ROE"].alias("roe_id"), "named", "segments", F.md5("content").alias("content_md5"))


@query(rf"""WITH {_D} SELECT {_XML_ID} AS crec_id, 'no body' AS reason FROM d WHERE crec_id % 7 <> 0 AND (crec_id % 11 = 0 OR content IS NULL)""")
def load_quarantine(spark, d) -> DataFrame:
    return documents.load(_staged(spark, d), fuzzy=False)[1]


def _staged(spark, d) -> DataFrame:
    """(date, name, content): a metadata file a day that names its documents, and their bodies."""
    ids = _XML_ID.replace("strftime(date_issued, '%Y-%m-%d')", "date_format(date_issued, 'yyyy-MM-dd')")
    rows = roles.docs(spark, d).withColumn("id", F.expr(ids))
    one = F.expr("""'<relatedItem type="constituent" ID="' || id || '"><titleInfo><title>' || title || '</title><partName>' || title_part || '</partName></titleInfo><location>'
|| '<url displayLabel="PDF rendition">p' || crec_id || '.pdf</url>' || CASE WHEN crec_id % 5 = 0 THEN '' ELSE '<url displayLabel="HTML rendition">h' || crec_id || '.htm</url>' END
|| '</location><part type="article"><extent><start>S' || crec_id || '</start></extent></part><name type="personal"><namePart>Roe ' || crec_id % 3 || '</namePart></name>'
|| '<name type="corporate"><namePart>X</namePart></name><name type="personal"><namePart>Doe</namePart></name>'
|| '<extension><congMember role="SPEAKING" bioGuideId="Z"><name type="parsed">Mr. ROE of Iowa</name></congMember>'
|| '<congMember role="SPEAKING" bioGuideId="U"><name type="parsed">Mr. DOE of Utah</name></congMember>'
    || '<congMember role="SPEAKING" bioGuideId="D' || crec_id % 4 || '"><name type="parsed">Mr. ROE of Ohio</name></congMember>'
|| '<congMember role="MENTIONED" bioGuideId="M"><name type="parsed">Mr. ROE</name></congMember></extension></relatedItem>'""")
    head = F.concat(F.lit('<mods xmlns="http://www.loc.gov/mods/v3"><originInfo><dateIssued>'), F.date_format("date_issued", "yyyy-MM-dd"), F.lit('</dateIssued></originInfo><relatedItem type="other" ID="x"/>'))
    files = rows.groupBy("date_issued").agg(F.array_join(F.collect_list(one), "").alias("items")).select(F.col("date_issued").alias("date"), F.lit("mods.xml").alias("name"), F.concat(head, "items", F.lit("</mods>")).alias("content"))
    bodies = rows.where("crec_id % 11 <> 0").select(F.col("date_issued").alias("date"), documents.body_name("id").alias("name"), F.concat(F.lit("x MET AND ADJOURNED. "), "content", F.lit(". Mr. DOE yields to Mr. ROE now.")).alias("content"))
    return files.unionByName(bodies.where("content IS NOT NULL"))


def _archives(spark, d, days: int = 90) -> str:
    """A folder of archives, one a day, with the metadata and bodies of the documents and members that are left out."""
    path = shared.fresh(spark, "archives")
    rows = _staged(spark, d).where(F.col("date") < F.date_add(F.lit(dt.date(2017, 1, 1)), days)).select("date", F.concat(F.lit("a/b/"), "name").alias("member"), "content")
    noise = rows.select("date").distinct().select("date", F.lit("a/x.pdf").alias("member"), F.lit("noise").alias("content"))
    archive.write_archives(rows.unionByName(noise), path).collect()  # a row a day
    return path


@query(rf"""WITH {_D}, x AS (SELECT *, {_XML_ID} AS id FROM d WHERE crec_id % 11 <> 0 AND content IS NOT NULL)
SELECT date_issued AS date, 'a/b/' || trim(id, 'id-') || '.htm' AS member, md5('x MET AND ADJOURNED. ' || content || '. Mr. DOE yields to Mr. ROE now.') AS content_md5, CAST(NULL AS VARCHAR) AS error FROM x
WHERE date_issued BETWEEN DATE '2017-02-01' AND DATE '2017-03-31' UNION ALL SELECT DATE '2017-04-01', NULL, NULL, 'no data'""")
def archive_members(spark, d) -> DataFrame:
    """Archives of all documents, written a day at a time and read by the data source: the bodies of two months and of a day without an archive."""
    rows = archive.members(spark, _archives(spark, d, 90), dt.date(2017, 2, 1), dt.date(2017, 4, 2))
    return rows.where("member LIKE '%.htm' OR member IS NULL").select("date", "member", F.md5("content").alias("content_md5"), "error")


def _run_days(spark, d) -> str:
    """A store after a week's runs.

    A run has stopped half way; one day is run twice; one day's archive is unreadable when it is first
    read and another's when it is read again, which keeps what it had; one day has no archive.
    """
    archives, store = _archives(spark, d, 6), shared.fresh(spark, "store")
    day = lambda n: dt.date(2017, 1, n)
    broken = shared.fresh(spark, "broken")
    for n in (3, 4):
        archive.put(f"{broken}/CREC-2017-01-0{n}.zip", b"PK no archive")
    spark.range(0).write.parquet(f"{store}/staged/run=0")  # what a run leaves that stops before its audit
    daily.scrape(spark, archives, store, day(1), day(3))
    daily.load(spark, store, fuzzy=False, buckets=4)
    daily.scrape(spark, broken, store, day(3), day(4))
    daily.scrape(spark, archives, store, day(2), day(8))
    daily.load(spark, store, fuzzy=False, buckets=4)
    daily.scrape(spark, broken, store, day(4), day(5))
    daily.load(spark, store, fuzzy=False, buckets=4)
    return store


@query(_SQL["load_job"].replace("__CLEAN__", _cleanup_sql("body")) + " WHERE date_issued < DATE '2017-01-07'")
def daily_load(spark, d) -> DataFrame:
    """The daily job over a week of archives, by two runs that share a day: each document once, with its segments."""
    return _fields(daily.loaded(spark, _run_days(spark, d)).where("reason IS NULL"))


@query(rf"""WITH {_D}, x AS (SELECT *, {_XML_ID} AS id FROM d), b AS (SELECT date_issued AS date, 'crec/' || strftime(date_issued, '%Y/%m/%d') || '/' || trim(id, 'id-') || '.htm' AS key FROM x WHERE crec_id % 11 <> 0 AND content IS NOT NULL
UNION ALL SELECT DISTINCT date_issued, 'crec/' || strftime(date_issued, '%Y/%m/%d') || '/mods.xml' FROM d)
SELECT date, true AS success, string_agg(key, chr(10) ORDER BY key) AS message, CAST(count(*) FILTER (key LIKE '%.htm') AS INTEGER) AS num_files, CASE WHEN date = DATE '2017-01-01' THEN 0 ELSE 2 END AS run, 'ended' AS state FROM b WHERE date < DATE '2017-01-07' AND date <> DATE '2017-01-04' GROUP BY 1
UNION ALL SELECT DATE '2017-01-07', true, 'no data', 0, 2, 'ended' UNION ALL SELECT DATE '2017-01-04', false, 'unreadable archive', 0, 3, 'ended'""")
def daily_audit(spark, d) -> DataFrame:
    """The last audit row of each day after those runs."""
    return daily.audit(spark, _run_days(spark, d))


@query(rf"""WITH {_D}, x AS (SELECT {_XML_ID} AS crec_id, {_ANA.replace("content", "(' MET AND ADJOURNED. ' || content)")} AS a FROM d WHERE date_issued < DATE '2017-01-07' AND crec_id % 7 <> 0 AND crec_id % 11 <> 0 AND content IS NOT NULL),
t AS (SELECT crec_id, CAST(len(list_filter(range(1, len(a)), lambda i: a[i] = 'of' AND a[i + 1] = 'the')) AS INTEGER) AS tf FROM x) SELECT crec_id, tf FROM t WHERE tf > 0""")
def daily_index(spark, d) -> DataFrame:
    """How often the phrase stands in each document of the week, from the index that the daily job keeps."""
    return index.Index(spark, f"{_run_days(spark, d)}/index").hits(PHRASE).select(F.col("key").alias("crec_id"), "tf")


@query(f"WITH {_D} SELECT crec_id, CASE WHEN crec_id % 3 = 0 THEN 'new' ELSE title END AS title, title_part FROM d UNION ALL SELECT -1, 'new', 'added'")
def document_upsert(spark, d) -> DataFrame:
    old = roles.docs(spark, d).select("crec_id", "title", "title_part")
    new = old.where("crec_id % 3 = 0").withColumn("title", F.lit("new"))
    return documents.merged(old, new.unionByName(spark.createDataFrame([(-1, "new", "added")], "crec_id long, title string, title_part string")))


@query("SELECT CAST(ts AS DATE) AS date, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def daily_events(spark, d) -> DataFrame:
    return ingest.daily_counts(roles.read(spark, d, "events"))


@query("""WITH b AS (SELECT doc_id AS crec_id, (doc_id * 7 + v * 5) % 11 AS seq, v AS batch, lang || v AS title FROM documents, (VALUES (0), (1), (2)) t(v) WHERE (doc_id + v) % 4 <> 3),
w AS (SELECT *, max(seq) OVER (PARTITION BY crec_id ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS had FROM b)
SELECT crec_id, seq, title FROM w WHERE had IS NULL OR seq > had""")
def stream_newest(spark, d) -> DataFrame:
    """Documents as a stream of three versions each, not in order: the rows that were newer than all before them."""
    source, sink, checkpoint = (shared.fresh(spark, x) for x in ("stream", "sink", "state"))
    docs = roles.read(spark, d, "documents")
    for v in range(3):
        rows = docs.where((F.col("doc_id") + v) % 4 != 3).select(F.col("doc_id").alias("crec_id"), F.pmod(F.col("doc_id") * 7 + v * 5, F.lit(11)).alias("seq"), F.concat("lang", F.lit(v)).alias("title"))
        rows.write.parquet(f"{source}/v={v}")
        stream = spark.readStream.schema(rows.schema).parquet(f"{source}/v=*")
        latest.run_available(latest.keep_last(stream, "crec_id", "seq"), sink, checkpoint)
    return spark.read.schema(rows.schema).parquet(sink).drop("batch")


@query("""WITH b AS (SELECT doc_id AS crec_id, (doc_id * 7 + v * 5) % 11 AS seq, v, lang || v AS title FROM documents, (VALUES (0), (1), (2)) t(v) WHERE (doc_id + v) % 4 <> 3)
SELECT crec_id, max(seq) AS seq, arg_max(title, (seq, -v)) AS title FROM b GROUP BY 1""")
def stream_latest(spark, d) -> DataFrame:
    """The last row of each document after that stream."""
    rows = stream_newest(spark, d)
    return rows.groupBy("crec_id").agg(F.max("seq").alias("seq"), F.max_by("title", "seq").alias("title"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_extract(spark, d) -> DataFrame:
    return roles.read(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


_CODES = list(STATES)
_KINDS = [*BILL_TYPES, "other"]


@query("WITH s AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{v}')" for i, v in enumerate(STATES.values())) + f") s(k, name)) SELECT c_custkey, name FROM customer JOIN s ON k = c_custkey % {len(STATES)}")
def states(spark, d) -> DataFrame:
    """The name of the state of every customer, by a code made of the key."""
    codes = F.array(*map(F.lit, _CODES))
    c = roles.read(spark, d, "customer").select("c_custkey", F.get(codes, (F.col("c_custkey") % len(_CODES)).cast("int")).alias("short"))
    return c.join(people_source.states(spark), "short").select("c_custkey", "name")


@query("WITH s AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{v}')" for i, v in enumerate(BILL_TYPES.values())) + f") s(k, label)) SELECT o_orderkey, label FROM orders LEFT JOIN s ON k = o_orderkey % {len(BILL_TYPES) + 1}")
def bill_types(spark, d) -> DataFrame:
    """The label of a kind of bill for every order, by a code made of the key; an unknown kind has none."""
    codes = F.array(*map(F.lit, _KINDS))
    o = roles.read(spark, d, "orders").select("o_orderkey", F.get(codes, (F.col("o_orderkey") % len(_KINDS)).cast("int")).alias("code"))
    return o.join(people_source.bill_types(spark), "code", "left").select("o_orderkey", "label")


_SQL["load_job"] = _SQL["load_job"].replace("__CLEAN__", _cleanup_sql("body"))


_REC = """r AS (SELECT c_custkey AS seq, 'B' || c_custkey // 2 AS id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS official_full, c_mktsegment AS religion,
CASE WHEN c_custkey % 5 = 0 THEN '19' || (50 + c_custkey % 40) || '-02-03' END AS birthday, c_nationkey FROM customer)"""


def _records(spark, d) -> DataFrame:
    """People as YAML files give them, two records for each id."""
    c = roles.read(spark, d, "customer")
    text = lambda *kv: F.map_filter(F.create_map(*[x if i % 2 else F.lit(x) for i, x in enumerate(kv)]), lambda _, v: v.isNotNull())
    bid = F.concat(F.lit("B"), F.expr("c_custkey div 2"))
    born = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("19"), 50 + F.col("c_custkey") % 40, F.lit("-02-03")))
    term = text("type", F.lit("rep"), "start", F.lit("2001-01-03"), "end", F.lit("2003-01-03"), "state", F.col("c_nationkey").cast("string"), "district", F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string")), "party", F.col("c_mktsegment"))
    return c.select(
        F.col("c_custkey").cast("long").alias("seq"),
        F.struct(
            text("bioguide", bid, "govtrack", F.col("c_custkey").cast("string")).alias("id"),
            text("official_full", F.when(F.col("c_custkey") % 3 != 0, F.col("c_name"))).alias("name"),
            text("religion", F.col("c_mktsegment"), "birthday", born).alias("bio"),
            F.array(term).alias("terms"),
        ).alias("record"),
    )


@query(f"""WITH {_REC} SELECT id AS bioguide_id, arg_max(official_full, seq) FILTER (official_full IS NOT NULL) AS official_full, arg_max(religion, seq) AS religion,
coalesce(CAST(arg_max(birthday, seq) FILTER (birthday IS NOT NULL) AS DATE), DATE '1776-07-04') AS birthday FROM r GROUP BY 1""")
def load_persons(spark, d) -> DataFrame:
    return people_source.persons(_records(spark, d)).select("bioguide_id", "official_full", "religion", "birthday")


def _yaml(spark, d) -> list[str]:
    """Two YAML files' folders made of customers: odd keys first, then even ones, whose values come later."""
    c = roles.read(spark, d, "customer").where("c_custkey IS NOT NULL")
    born = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("\n    birthday: '19"), 50 + F.col("c_custkey") % 40, F.lit("-02-03'"))).otherwise("")
    named = F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("\n  name:\n    official_full: '"), "c_name", F.lit("'"))).otherwise("")
    person = F.concat(F.lit("- id:\n    bioguide: B"), F.expr("c_custkey div 2"), F.lit("\n    govtrack: "), "c_custkey", named, F.lit("\n  bio:\n    religion: "), "c_mktsegment", born)
    paths = []
    for k in (1, 0):
        paths.append(shared.fresh(spark, "yaml"))
        c.where(F.col("c_custkey") % 2 == k).repartitionByRange(3, "c_custkey").sortWithinPartitions("c_custkey").select(person.alias("value")).write.text(paths[-1])
    return paths


@query(f"""WITH {_REC}, o AS (SELECT *, seq + CASE WHEN seq % 2 = 0 THEN 1000000000 ELSE 0 END AS k FROM r) SELECT id AS bioguide_id, arg_max(official_full, k) FILTER (official_full IS NOT NULL) AS official_full,
arg_max(religion, k) AS religion, coalesce(CAST(arg_max(birthday, k) FILTER (birthday IS NOT NULL) AS DATE), DATE '1776-07-04') AS birthday FROM o GROUP BY 1""")
def yaml_persons(spark, d) -> DataFrame:
    """People read from YAML files that were written from customers: the last file that has a value counts."""
    return people_source.persons(people_source.load_yaml(spark, *_yaml(spark, d))).select("bioguide_id", "official_full", "religion", "birthday")


@query(f"WITH {_REC} SELECT DISTINCT id AS bioguide_id, unnest(['bioguide', 'govtrack']) AS type, unnest([id, CAST(seq AS VARCHAR)]) AS value FROM r")
def load_external_ids(spark, d) -> DataFrame:
    return people_source.external_ids(_records(spark, d))


@query(f"""WITH {_REC} SELECT id AS bioguide_id, CAST(c_nationkey AS VARCHAR) AS state, DATE '2001-01-03' AS start_date, DATE '2003-01-03' AS end_date, 'rep' AS type,
coalesce(arg_max(seq, seq) FILTER (seq % 2 = 0), -1) AS district, arg_max(religion, seq) AS party FROM r GROUP BY id, c_nationkey""")
def load_terms(spark, d) -> DataFrame:
    return people_source.terms(_records(spark, d)).select("bioguide_id", "state", "start_date", "end_date", "type", F.col("district").cast("long").alias("district"), "party")


# -- the result page and the people pages -------------------------------------------------------


_PAGE_BM25 = rf"""WITH {_D}, w AS (SELECT *, {_ANA} AS a FROM d),
s AS (SELECT count(*) AS n, avg(len(a)) AS m, count(*) FILTER (list_contains(a, 'the')) AS d1 FROM w),
f AS (SELECT *, len(a) AS dl, len(list_filter(a, lambda x: x = 'the')) AS tf, instr(lower(content), 'the') AS p FROM w WHERE date_issued BETWEEN DATE '2017-02-01' AND DATE '2017-03-03'),
r AS (SELECT *, round(ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / m)), 6) AS score FROM f, s WHERE tf > 0),
t AS (SELECT * FROM r ORDER BY score DESC, crec_id LIMIT 10)
SELECT crec_id, score, CAST((length(content) - length(replace(lower(content), 'the', ''))) // 3 AS INTEGER) AS mentions, 'the' AS search_phrase, strftime(date_issued, '%b %d, %Y') AS human_date, {_SNIP} AS snippet,
(SELECT CAST(count(*) AS INTEGER) FROM (VALUES (crec_id % 150), (crec_id * 7 % 150)) v(k) WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = k AND k > 0)) AS matched FROM t"""


def _result_page(spark, d) -> dict[str, DataFrame]:
    held = roles.terms(spark, d).groupBy("bioguide_id", "start_date", "end_date").agg(F.max("party").alias("party"))
    return pages.result_page(roles.docs(spark, d), roles.people(spark, d), held, " The ", START, END)


@query(_PAGE_BM25)
def result_page(spark, d) -> DataFrame:
    """The hits of a result page with all that is shown of them."""
    docs = _result_page(spark, d)["docs"]
    return docs.select("crec_id", F.round("score", 6).alias("score"), "mentions", "search_phrase", "human_date", "snippet", F.size("matched").alias("matched"))


@query(_PAGE_BM25)
def index_result_page(spark, d) -> DataFrame:
    """The hits of a result page, found and ranked through a written index."""
    held = roles.terms(spark, d).groupBy("bioguide_id", "start_date", "end_date").agg(F.max("party").alias("party"))
    docs = pages.result_page(roles.docs(spark, d), roles.people(spark, d), held, " The ", START, END, index=_indexed(spark, d))["docs"]
    return docs.select("crec_id", F.round("score", 6).alias("score"), "mentions", "search_phrase", "human_date", "snippet", F.size("matched").alias("matched"))


@query(_SQL["period_delta"])
def index_totals(spark, d) -> DataFrame:
    return histogram.period_delta(_indexed(spark, d), TERM, START, END)


@query(_SQL["period_breakdown"])
def result_page_breakdown(spark, d) -> DataFrame:
    return _result_page(spark, d)["breakdown"]


@query(_SQL["period_delta"])
def result_page_totals(spark, d) -> DataFrame:
    return _result_page(spark, d)["totals"]


@query("""SELECT to_json({'status': 'success', 'data': list({'k': n_nationkey, 'name': n_name} ORDER BY n_nationkey)}) AS json FROM nation""")
def page_envelope(spark, d) -> DataFrame:
    rows = roles.read(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return pages.envelope(rows.orderBy("k").coalesce(1))


@query(f"WITH {_D} SELECT crec_id, strftime(date_issued, '%Y-%m-%d') AS date_issued FROM d")
def search_hits(spark, d) -> DataFrame:
    return search.hits(roles.docs(spark, d).select("crec_id", "date_issued"))


@query(rf"WITH {_D} SELECT crec_id FROM d WHERE crec_id % 150 = 7 OR crec_id * 7 % 150 = 7")
def search_speaker_intent(spark, d) -> DataFrame:
    return search.phrase_filter(roles.docs(spark, d), {"speaker": "Customer#000000007"}, mode="intent").select("crec_id")


@query("""WITH m AS (SELECT CAST(max(ts) AS DATE) AS m FROM events), e AS (SELECT event_id, CAST(ts AS DATE) AS day, m FROM events, m)
SELECT event_id, day BETWEEN m - 30 AND m AS recent, day BETWEEN m - 3 AND m AS last_days, day BETWEEN DATE '2024-01-05' AND DATE '2024-01-09' AS named FROM e""")
def range_arguments(spark, d) -> DataFrame:
    """Whether each event is of the usual range up to the last day of all, of a shorter one, and of one that is named."""
    e = roles.read(spark, d, "events").select("event_id", F.to_date("ts").alias("day"))
    last = e.agg(F.max("day")).first()[0] or dt.date(1970, 1, 1)
    ranges = {"recent": histogram.date_range(as_of=last), "last_days": histogram.date_range(days_ago=3, as_of=last), "named": histogram.date_range("2024-01-05", "2024-01-09", as_of=last)}
    return e.select("event_id", *[F.col("day").between(F.lit(a), F.lit(b)).alias(k) for k, (a, b) in ranges.items()])


_OFFICE = """p AS (SELECT c_custkey AS bioguide_id, c_name AS official_full, regexp_extract(c_name, '[0-9]+') AS last, CASE c_custkey % 2 WHEN 0 THEN 'F' ELSE 'M' END AS gender, c_mktsegment AS religion FROM customer),
t AS (SELECT o_custkey AS bioguide_id, CAST(o_orderdate AS DATE) AS start_date, CAST(o_orderdate AS DATE) + 365 AS end_date, CASE o_orderstatus WHEN 'O' THEN 'sen' ELSE 'rep' END AS type, o_orderpriority AS party,
CASE o_orderkey % 3 WHEN 0 THEN 'OH' WHEN 1 THEN 'IA' ELSE 'WY' END AS state FROM orders)"""


def _office(spark, d) -> tuple[DataFrame, DataFrame]:
    p = roles.people(spark, d).withColumns({"last": F.regexp_extract("official_full", "[0-9]+", 0), "gender": F.when(F.col("bioguide_id") % 2 == 0, "F").otherwise("M")})
    t = roles.terms(spark, d)
    state = F.element_at(F.array(F.lit("OH"), F.lit("IA"), F.lit("WY")), (F.col("term_id") % 3 + 1).cast("int"))
    return p, t.withColumns({"type": F.when(F.col("type") == "O", "sen").otherwise("rep"), "state": state})


@query(f"""WITH {_OFFICE} SELECT p.bioguide_id, official_full FROM p JOIN t a USING (bioguide_id) JOIN t b USING (bioguide_id) JOIN t c USING (bioguide_id)
WHERE a.state = 'OH' AND b.party = '1-URGENT' AND c.type = 'sen' AND gender = 'F' AND religion = 'BUILDING'""")
def people_search(spark, d) -> DataFrame:
    p, t = _office(spark, d)
    return people.search_people(p, t, gender="F", religion="BUILDING", state="OH", party="1-URGENT", term_type="sen").select("bioguide_id", "official_full")


@query(f"""WITH {_OFFICE} SELECT bioguide_id, official_full FROM p WHERE last LIKE '%7' AND last = '000000007' AND EXISTS (SELECT 1 FROM t WHERE t.bioguide_id = p.bioguide_id AND state = 'IA' AND type = 'rep')""")
def people_search_intent(spark, d) -> DataFrame:
    """All criteria on one term; an unknown type of term would be ignored."""
    p, t = _office(spark, d)
    return people.search_people(p, t, last_name="000000007", state="IA", term_type="rep", mode="intent").select("bioguide_id", "official_full")


@query(f"WITH {_OFFICE} SELECT bioguide_id, official_full FROM p WHERE bioguide_id = 11")
def person_by_id(spark, d) -> DataFrame:
    p, t = _office(spark, d)
    return people.search_people(p, t, name="overridden", person_id=11).select("bioguide_id", "official_full")


@query(f"WITH {_OFFICE} SELECT p.bioguide_id, official_full FROM p JOIN t USING (bioguide_id) WHERE DATE '1998-06-01' BETWEEN start_date AND end_date AND state = 'WY'")
def serving_in_state(spark, d) -> DataFrame:
    p, t = _office(spark, d)
    return people.current(p, t, roles.AS_OF, state="WY", mode="intent").select("bioguide_id", "official_full")


@query("SELECT s_suppkey, regexp_replace(s_name, '0', 'Roe') AS name FROM supplier")
def short_names(spark, d) -> DataFrame:
    s = roles.read(spark, d, "supplier")
    return s.select("s_suppkey", X.short_name(F.concat(F.regexp_replace("s_name", "^(.*?)0", "$1Roe"), F.lit(" of Ohio and of Iowa"))).alias("name"))


# -- segments --------------------------------------------------------------------------------


def _turns(spark, d) -> DataFrame:
    c = roles.read(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("crec_id"), F.col("turn").alias("pos"), F.col("text").alias("sentence"), F.when(F.col("role") != "user", F.col("role")).alias("hit"))


_SEG = """WITH c AS (SELECT conv_id, turn, text, last_value(CASE WHEN role <> 'user' THEN role END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS sp FROM conversations),
g AS (SELECT *, CASE WHEN lag(sp) OVER w IS DISTINCT FROM sp OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS f FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
n AS (SELECT *, sum(f) OVER (PARTITION BY conv_id ORDER BY turn) AS number FROM g),
s AS (SELECT conv_id AS crec_id, CAST(number AS BIGINT) AS number, any_value(sp) AS speaker, string_agg(text, ' ' ORDER BY turn) AS text FROM n GROUP BY 1, 2) """


@query(_SEG + "SELECT crec_id, number, speaker, text FROM s")
def speaker_segments(spark, d) -> DataFrame:
    return segments.segments(_turns(spark, d))


@query(_SEG + "SELECT crec_id || '-' || number AS id, CASE speaker WHEN 'system' THEN 'S000001' END AS bioguide_id FROM s")
def segment_lookup(spark, d) -> DataFrame:
    known = F.create_map(F.lit("system"), F.lit("S000001"))
    found = segments.segments(_turns(spark, d))
    return found.select(F.concat_ws("-", "crec_id", "number").alias("id"), F.try_element_at(known, F.coalesce("speaker", F.lit(""))).alias("bioguide_id"))


_SENT = r"""s0 AS (SELECT doc_id AS crec_id, regexp_replace(regexp_replace(regexp_replace(text, __TITLE__), __TITLE__), '([.!?])\s+', '\1' || chr(2), 'g') AS t FROM documents WHERE text IS NOT NULL),
s1 AS (SELECT crec_id, unnest(list_filter(list_transform(string_split(t, chr(2)), lambda x: replace(x, chr(1), '.')), lambda x: x <> '')) AS sentence,
unnest(range(len(list_filter(string_split(t, chr(2)), lambda x: x <> '')))) AS pos FROM s0)""".replace("__TITLE__", r"""'(^|[^\p{L}\p{N}_])(Mr|Mrs|Ms|Dr|Jr|Sr|St|No|[A-Z])\.\s', '\1\2' || chr(1) || ' ', 'g'""")  # twice, as neighbouring titles share a blank


@query(f"WITH {_SENT} SELECT crec_id, CAST(pos AS INTEGER) AS pos, md5(sentence) AS sentence FROM s1")
def sentences(spark, d) -> DataFrame:
    return segments.sentences(roles.docs(spark, d)).select("crec_id", "pos", F.md5("sentence").alias("sentence"))


@query(f"""WITH {_SENT}, h AS (SELECT *, CASE WHEN contains(sentence, ' the ') THEN ' the ' WHEN contains(sentence, ' que ') THEN ' que ' END AS hit FROM s1),
c AS (SELECT *, last_value(hit IGNORE NULLS) OVER (PARTITION BY crec_id ORDER BY pos) AS sp FROM h),
g AS (SELECT *, CASE WHEN lag(sp) OVER w IS DISTINCT FROM sp OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS f FROM c WINDOW w AS (PARTITION BY crec_id ORDER BY pos)),
n AS (SELECT *, sum(f) OVER (PARTITION BY crec_id ORDER BY pos) AS number FROM g)
SELECT crec_id || '-' || CAST(number AS BIGINT) AS id, any_value(sp) AS speaker, CASE any_value(sp) WHEN ' the ' THEN 'T1' END AS bioguide_id, md5(string_agg(sentence, ' ' ORDER BY pos)) AS text FROM n GROUP BY crec_id, number""")
def document_segments(spark, d) -> DataFrame:
    """The segments of every document, by two speakers of its own of whom one has an id."""
    docs = roles.docs(spark, d).where("content IS NOT NULL").withColumn("speaker_ids", F.create_map(F.lit(" the "), F.lit("T1"), F.lit(" que "), F.lit(None).cast("string")))
    one = segments.document_segments(docs, fuzzy=False).select(F.explode("segments").alias("s"))
    return one.select("s.id", "s.speaker", "s.bioguide_id", F.md5("s.text").alias("text"))


_ABBREVIATED = r"""WITH t AS (SELECT regexp_replace(regexp_replace(unnest(regexp_split_to_array(lower(__TEXT__), '\s+')), '^[^\p{L}\p{N}]+', ''), '[^\p{L}\p{N}.]+$', '') AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT regexp_replace(t, '\.$', '') AS word, count(*) FILTER (t LIKE '%.') AS a, count(*) FILTER (t NOT LIKE '%.') AS b FROM t WHERE regexp_matches(t, '\p{L}') GROUP BY 1),
s AS (SELECT word, a, b, sum(a) OVER () / sum(a + b) OVER () AS p, length(word) - length(replace(word, '.', '')) AS i FROM c)
SELECT word, a AS with_period, b AS without, round(-2 * (a * ln(p) + CASE WHEN b > 0 THEN b * ln(1 - p) ELSE 0 END - a * ln(0.99) - b * ln(1 - 0.99)) * exp(-(length(word) - i)) * (i + 1) * pow(length(word) - i, -b), 6) + 0.0 AS score FROM s WHERE a > 0"""


@query(_ABBREVIATED.replace("__TEXT__", "replace(text, ' ', CASE doc_id % 3 WHEN 0 THEN ' mr. ' ELSE ' ' END)"))
def abbreviations_found(spark, d) -> DataFrame:
    """How likely every word of the collection is an abbreviation, by its periods; a title stands between the words of every third text."""
    docs = roles.docs(spark, d).where("content IS NOT NULL").withColumn("content", F.replace("content", F.lit(" "), F.when(F.col("crec_id") % 3 == 0, " mr. ").otherwise(" ")))
    return abbreviations.scores(docs).withColumn("score", F.round("score", 6) + 0.0)


_NAMES = ["tion", "the", "que", "eneux", "sch"]


@query("SELECT conv_id, turn, list_filter(['tion', 'the', 'que', 'eneux', 'sch'], lambda c: contains(text, c))[1] AS hit FROM conversations")
def generic_speaker_match(spark, d) -> DataFrame:
    names = F.array(*[F.lit(n) for n in _NAMES])
    return roles.read(spark, d, "conversations").select("conv_id", "turn", segments.first_contained(F.col("text"), names).alias("hit"))


@query()
def fuzzy_best_match(spark, d) -> DataFrame:
    s = roles.read(spark, d, "supplier").select("s_suppkey", F.regexp_replace("s_name", "0", "O").alias("name"), F.array(F.lit("SupplierOOOOOOO1"), F.col("s_name"), F.lit("Supplier#OOOOOOOO7")).alias("options"))
    return segments.fuzzy_match(s, "name", "options", "best").select("s_suppkey", "name", "best")


_PARTS = """n AS (SELECT DISTINCT p_name || ' ' || p_type AS b FROM part), o AS (SELECT DISTINCT substring(p_name || ' ' || p_type, 1, 1 + p_partkey % 12) || substring(p_name || ' ' || p_type, 3 + p_partkey % 12) AS a FROM part)"""


@query(f"""WITH {_PARTS}, s AS (SELECT a, b, 100 - 100 * levenshtein(a, b) / greatest(length(a), length(b)) AS x FROM o, n)
SELECT a, b, CAST(floor(x) AS INTEGER) AS score FROM s WHERE floor(x) > 85""")
def fuzzy_near_names(spark, d) -> DataFrame:
    """Names of parts with a letter lost, and all names of parts that are more than 85 per cent like them."""
    name = F.concat_ws(" ", "p_name", "p_type")
    p = roles.read(spark, d, "part").select(name.alias("b"), (F.col("p_partkey") % 12).cast("int").alias("k"))
    lost = p.select(F.concat(F.substring("b", F.lit(1), F.col("k") + 1), F.substring(F.col("b"), F.col("k") + 3, F.lit(1 << 20))).alias("a"))
    return fuzzy.near_join(lost, p, "a", "b", 85)


# -- entities --------------------------------------------------------------------------------


def _mentions(spark, d) -> DataFrame:
    e = roles.read(spark, d, "events")
    return e.select(F.col("user_id").alias("crec_id"), F.col("event_id").alias("pos"), F.concat(F.lit("Entity "), F.pmod("event_id", F.lit(7)).cast("string")).alias("entity"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("label"))


_ENT = """WITH m AS (SELECT user_id AS crec_id, event_id AS pos, 'Entity ' || (event_id % 7) AS entity, CASE WHEN event_type <> 'view' THEN event_type END AS label FROM events),
c AS (SELECT crec_id, entity, label, count(*) AS n, min(pos) AS first FROM m WHERE label IS NOT NULL GROUP BY ALL),
t AS (SELECT crec_id, entity, label FROM c QUALIFY row_number() OVER (PARTITION BY crec_id, entity ORDER BY n DESC, first) = 1),
k AS (SELECT crec_id, entity, count(*) AS n FROM m GROUP BY ALL), y AS (SELECT k.*, coalesce(label, '') AS type FROM k LEFT JOIN t USING (crec_id, entity)) """


@query(_ENT + "SELECT crec_id, entity, type FROM y")
def entity_mode(spark, d) -> DataFrame:
    return entities.entity_types(_mentions(spark, d))


@query(_ENT + "SELECT crec_id, type, entity, n FROM y")
def entity_counts_by_type(spark, d) -> DataFrame:
    return entities.entity_counts(_mentions(spark, d)).select("crec_id", "type", "entity", "n")


@query("""WITH m AS (SELECT c_nationkey AS crec_id, c_custkey AS pos, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN lower(c_mktsegment) ELSE upper(c_mktsegment[1:1]) || lower(c_mktsegment[2:]) END AS entity FROM customer),
c AS (SELECT crec_id, entity, count(*) AS n, min(pos) AS pos FROM m GROUP BY 1, 2), k AS (SELECT *, CASE WHEN entity = upper(entity) THEN entity ELSE upper(entity[1:1]) || lower(entity[2:]) END AS name FROM c)
SELECT crec_id, 'PERSON' AS type, name AS entity, arg_max(n, pos) AS n FROM k GROUP BY crec_id, name""")
def person_recasing(spark, d) -> DataFrame:
    """People's names in three cases: those that are one when their case is set count as the one last seen."""
    s = F.col("c_mktsegment")
    entity = F.when(F.col("c_custkey") % 3 == 0, s).when(F.col("c_custkey") % 3 == 1, F.lower(s)).otherwise(F.initcap(s))
    rows = roles.read(spark, d, "customer").select(F.col("c_nationkey").alias("crec_id"), F.col("c_custkey").alias("pos"), entity.alias("entity"), F.lit("PERSON").alias("label"))
    return entities.entity_counts(rows).select("crec_id", "type", "entity", "n")


@query(_ENT + "SELECT crec_id, type, CAST(count(*) AS BIGINT) AS names, CAST(sum(n) AS BIGINT) AS n FROM y GROUP BY 1, 2")
def entity_maps(spark, d) -> DataFrame:
    maps = entities.entity_maps(_mentions(spark, d)).select("crec_id", F.explode("named_entity_counts").alias("type", "m"))
    return maps.select("crec_id", "type", F.size("m").cast("long").alias("names"), F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))


_MARKS_SQL = r"""regexp_replace(regexp_replace(replace(replace(x, '-', ' '), '  ', ' '), '^\s+|\s+$', '', 'g'), '[!"#$%&''()*+,\-/:;<=>?@\[\\\]\^_`{|}~]+', '', 'g')"""
_CHUNKS = rf"""c AS (SELECT conv_id AS crec_id, unnest(list_filter(regexp_split_to_array(text, '[ \t\n\r\f]+'), lambda x: x <> '')) AS x, role FROM conversations),
k AS (SELECT crec_id, regexp_replace(lower({_MARKS_SQL}), '(^|[^\p{{L}}])ß', '\1ss', 'g') AS chunk, x, role FROM c WHERE NOT regexp_matches(lower(x), 'who|where|when|what|behalf|somebody|anybody')),
e AS (SELECT DISTINCT crec_id, lower(x) AS chunk FROM c WHERE regexp_matches(x, '^[A-Z]')) """


def _annotated(spark, d) -> tuple[DataFrame, DataFrame]:
    """Words of conversations as noun chunks, and those with a capital as entities."""
    c = roles.read(spark, d, "conversations").select(F.col("conv_id").alias("crec_id"), F.filter(F.split("text", r"[ \t\n\r\f]+"), lambda x: x != "").alias("w"))
    chunks = c.select("crec_id", F.transform("w", lambda x: F.struct(x.alias("text"), F.lower(x).alias("lemma"))).alias("chunks"))
    return chunks, c.select("crec_id", F.explode("w").alias("entity")).where(F.col("entity").rlike("^[A-Z]"))


@query(f"WITH {_CHUNKS} SELECT DISTINCT crec_id, chunk, CAST(1 AS BIGINT) AS n FROM k ANTI JOIN e USING (crec_id, chunk)")
def noun_minus_entity(spark, d) -> DataFrame:
    return entities.chunk_counts(*_annotated(spark, d))


@query(f"WITH {_CHUNKS} SELECT crec_id, chunk, count(*) AS n FROM k ANTI JOIN e USING (crec_id, chunk) GROUP BY 1, 2")
def chunk_counts_intent(spark, d) -> DataFrame:
    return entities.chunk_counts(*_annotated(spark, d), mode="intent")


@query(_ENT + """, d AS (SELECT doc_id AS crec_id, DATE '2017-01-01' + CAST(doc_id % 90 AS INTEGER) AS date FROM documents),
s AS (SELECT crec_id, date, unnest(['A' || crec_id % 10, 'B' || crec_id % 3]) AS bioguide_id FROM d),
l AS (SELECT bioguide_id, max((date, crec_id)) AS m FROM s GROUP BY 1),
z AS (SELECT crec_id, count(DISTINCT type) AS types FROM y GROUP BY 1)
SELECT bioguide_id, m[2] AS crec_id, m[1] AS date, CAST(coalesce(types, 0) AS INTEGER) AS types, 1 AS chunks FROM l LEFT JOIN z ON z.crec_id = m[2]""")
def speaker_word_counts(spark, d) -> DataFrame:
    docs = roles.docs(spark, d).select("crec_id", "date_issued", F.create_map(F.lit("x"), F.concat(F.lit("A"), F.col("crec_id") % 10), F.lit("y"), F.concat(F.lit("B"), F.col("crec_id") % 3)).alias("speaker_ids"))
    chunks = docs.select("crec_id", F.lit("chunk").alias("chunk"), F.lit(2).cast("long").alias("n"))
    out = entities.speaker_word_counts(docs, entities.entity_maps(_mentions(spark, d)), chunks)
    size = lambda c, kind: F.size(F.map_keys(F.from_json(c, kind)))
    return out.select("bioguide_id", "crec_id", "date", size("named_entities", "map<string,map<string,bigint>>").alias("types"), size("noun_chunks", "map<string,bigint>").alias("chunks"))


#: Surfaces with tags, labels, and the entity that must come of them (null: dropped).
_SURFACES = [
    ("the Senate votes", "DT NNP VBZ", "ORG", "Senate"),
    ("Ohio do not", "NNP VBP RB", "GPE", "Ohio"),
    ("Mr. LEE and", "NNP NNP CC", "PERSON", "Mr. Lee"),
    ("U.S. SENATE's", "NNP NNP POS", "ORG", None),
    ("HON", "NNP", "PERSON", None),
    ("NPR", "NNP", "ORG", "NPR"),
    ("three", "CD", "CARDINAL", None),
    ("x", "NN", "ORG", None),
    ("is", "VBZ", "ORG", None),
    ("import-export BANK", "NN NN", "ORG", "Import Export Bank"),
    ("SENATE Sine Die Adjournment", "NNP NNP NNP NNP", "ORG", "Senate"),
]


@query("SELECT c_custkey AS crec_id, entity FROM customer, (VALUES " + ", ".join(f"('{e}')" for *_, e in _SURFACES if e) + ") v(entity)")
def entity_cleanup(spark, d) -> DataFrame:
    """Trailing tags, determiners, numeric types, the blacklist and the case of names, once for each customer."""
    kept = [(s, n, list(zip(s.split(), t.split(), strict=True))) for s, t, n, e in _SURFACES if e or not s.endswith("'s")]
    fixed = spark.createDataFrame([(kept,)], f"e {entities.ANNOTATION.split(', chunks')[0].removeprefix('entities ')}")
    rows = roles.read(spark, d, "customer").select(F.col("c_custkey").alias("crec_id")).crossJoin(F.broadcast(fixed)).withColumnRenamed("e", "entities")
    return entities.entity_rows(rows).select("crec_id", "entity")


@query()
def annotated_entities(spark, d) -> DataFrame:
    rows = entities.entity_rows(entities.annotate(roles.docs(spark, d)))
    return entities.entity_counts(rows)


@query("SELECT c_nationkey AS nation, c_custkey AS id, c_acctbal AS balance FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) = 1")
def top_one(spark, d) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy(F.col("c_acctbal").desc(), "c_custkey")
    c = roles.read(spark, d, "customer").withColumn("k", F.row_number().over(w)).where("k = 1")
    return c.select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))


def queries() -> dict[str, Callable]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
