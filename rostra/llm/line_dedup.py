"""Line dedup: lines that many distinct sites carry are boilerplate and go.

Each line hash gets a HyperLogLog sketch of the distinct sites of all rows that have the
line; sketches merge by aggregation. Lines whose estimate is near the threshold get an
exact distinct count. A line with the spread goes from every document, whatever is left
of it. Where copies of a document on many sites shall not make its lines boilerplate,
``counted`` names the rows whose sites count: the pipeline gives what near-duplicate
removal keeps.

Lines are cut at line feeds and compared without leading and trailing blanks, tabs and
carriage returns; blank lines stay. Hot lines shrink to one row for each task and site
before the shuffle, so a line in a third of all rows does no harm.

Defined results: null text stays null and has no lines; an empty text has one blank
line; a null site is a site of its own ('' ); rows with a null doc_id are counted but
never changed; repeated doc_ids are changed alike; lines of any length are hashed whole.
Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostra.llm.common import discard, staged

#: Distinct sites from which on a line is boilerplate.
MIN_SITES = 10


def _key(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def carried(counted: DataFrame, site: str = "source") -> DataFrame:
    """(line_hash, site): every distinct site of every line of ``counted``."""
    return (
        counted.select(F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), F.explode(F.split("text", "\n")).alias("line"))
        .select("site", _key(F.col("line")).alias("line"))
        .where("line <> ''")
        .select(F.xxhash64("line").alias("line_hash"), "site")
        .distinct()
    )


def boilerplate(seen: DataFrame, min_sites: int = MIN_SITES, lg_k: int = 12) -> DataFrame:
    """line_hash and sites of the lines that have at least ``min_sites`` among the distinct rows (line_hash, site)."""
    spread = (
        seen.groupBy("line_hash")
        .agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"))
        .select("line_hash", F.hll_sketch_estimate("sketch").alias("sites"))
    )
    # three standard errors of the sketch, and one site for rounding
    slack = 3 * 1.04 / 2 ** (lg_k / 2) * min_sites + 1
    sure = spread.where(F.col("sites") > min_sites + slack).select("line_hash", "sites")
    near = spread.where(F.col("sites").between(F.lit(min_sites - slack), F.lit(min_sites + slack)))
    exact = (
        seen.join(near.select("line_hash"), "line_hash", "left_semi")
        .groupBy("line_hash")
        .agg(F.count(F.lit(1)).alias("sites"))
        .where(F.col("sites") >= min_sites)
    )
    return sure.unionByName(exact)


def _stripped(docs: DataFrame, site: str, min_sites: int, counted: DataFrame | None = None) -> DataFrame:
    """(row, lines, kept): each row whole, its lines, and those that stay."""
    seen = staged(carried(docs if counted is None else counted, site), "carried")
    # a table of its own, so that Spark can split the join on a hot line
    common = staged(boilerplate(seen, min_sites).select("line_hash"), "boilerplate")
    discard(seen)
    marked = (
        docs.where(F.col("doc_id").isNotNull())
        .select("doc_id", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), lambda x: F.xxhash64(_key(x))))).alias("line_hash"))
        .join(common, "line_hash")
        .groupBy("doc_id")
        .agg(F.collect_set("line_hash").alias("marked"))
    )
    # the input's columns stay inside one struct, where their names meet no others
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", F.split("text", "\n").alias("lines"))
    left = F.filter("lines", lambda x: ~F.array_contains(F.col("marked"), F.xxhash64(_key(x))))
    return rows.join(marked, "doc_id", "left").select("row", "lines", F.when(F.col("marked").isNull(), F.col("lines")).otherwise(left).alias("kept"))


def strip_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """doc_id, the text without boilerplate lines, and how many lines it had and lost."""
    return _stripped(docs, site, min_sites).select(
        F.col("row")["doc_id"].alias("doc_id"),
        F.array_join("kept", "\n").alias("text"),
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("lines") - F.size("kept"), F.lit(0)).cast("long").alias("n_removed"),
    )


def clean(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, counted: DataFrame | None = None) -> DataFrame:
    """``docs``, all columns, without boilerplate lines; ``n_chars``, if there, follows the text.

    With ``counted``, lines are judged by the sites of its rows.
    """
    text = F.array_join("kept", "\n")
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    out = _stripped(docs, site, min_sites, counted)
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


ORACLE = rf"""
WITH l AS (SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS key FROM l),
b AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT site) >= {MIN_SITES})
SELECT doc_id, count(*) AS n_lines, count(b.key) AS n_removed,
  md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (b.key IS NULL), '')) AS kept_md5
FROM k LEFT JOIN b USING (key) GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, md5(NULL) FROM documents WHERE text IS NULL
"""
