"""Documents from metadata and bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostra.functions import text as X
from rostra.operators.segments import document_segments

_CONSTITUENT = """struct<`_ID`:string,`_type`:string,
 titleInfo:struct<title:string,partName:string>,
 location:struct<url:array<struct<`_VALUE`:string,`_displayLabel`:string>>>,
 part:array<struct<`_type`:string,extent:struct<start:string,end:string>>>,
 name:array<struct<`_type`:string,namePart:string>>,
 extension:array<struct<congMember:array<struct<`_role`:string,`_bioGuideId`:string,name:array<struct<`_VALUE`:string,`_type`:string>>>>>>>"""
_MODS = f"originInfo struct<dateIssued:string>, relatedItem array<{_CONSTITUENT}>"


def _first(array: Column, test, field) -> Column:
    return F.coalesce(field(F.try_element_at(F.filter(array, test), F.lit(1))), F.lit(""))


def constituents(metadata: DataFrame, xml: str = "xml") -> DataFrame:
    """One row for each constituent of metadata files, whose whole text is in column ``xml``.

    Missing texts are ''. ``date_issued`` is the file's own; the ``date`` under which a file was staged is
    carried along. Of the members, those speaking give ``speaker_ids``; a name given twice keeps its
    first place and its last id.
    """
    carried = [c for c in ("date",) if c in metadata.columns]
    parsed = metadata.select(*carried, F.from_xml(xml, _MODS, {"attributePrefix": "_", "valueTag": "_VALUE"}).alias("m"))
    # the day and the items part before the items become rows, so that none of these carries the whole file
    parted = parsed.select(*carried, F.to_date("m.originInfo.dateIssued").alias("date_issued"), F.filter("m.relatedItem", lambda r: r["_type"] == "constituent").alias("items"))
    rows = parted.select(*carried, "date_issued", F.explode("items").alias("r"))
    url = lambda label: _first(F.col("r.location.url"), lambda u: u["_displayLabel"] == label, lambda u: u["_VALUE"])
    extent = lambda end: _first(F.col("r.part"), lambda p: p["_type"] == "article", lambda p: p["extent"][end])
    members = F.filter(F.flatten(F.transform("r.extension", lambda e: F.coalesce(e["congMember"], F.array().cast("array<struct<_role:string,_bioGuideId:string,name:array<struct<_VALUE:string,_type:string>>>>")))), lambda m: m["_role"] == "SPEAKING")
    pairs = F.transform(members, lambda m: F.struct(X.short_name(_first(m["name"], lambda n: n["_type"] == "parsed", lambda n: n["_VALUE"])).alias("key"), m["_bioGuideId"].alias("value")))
    # a name given twice stands where it is first given, with the id that it is last given
    named = X.let(pairs, lambda all_: F.transform(F.array_distinct(F.transform(all_, lambda p: p["key"])), lambda k: F.struct(k.alias("key"), F.element_at(F.filter(all_, lambda p: p["key"] == k), -1)["value"].alias("value"))))
    return rows.select(
        *carried,
        F.coalesce("r._ID", F.lit("")).alias("crec_id"),
        "date_issued",
        F.coalesce("r.titleInfo.title", F.lit("")).alias("title"),
        F.coalesce("r.titleInfo.partName", F.lit("")).alias("title_part"),
        url("PDF rendition").alias("pdf_url"),
        url("HTML rendition").alias("html_url"),
        extent("start").alias("page_start"),
        extent("end").alias("page_end"),
        F.coalesce(F.transform(F.filter("r.name", lambda n: n["_type"] == "personal"), lambda n: n["namePart"]), F.array().cast("array<string>")).alias("speakers"),
        F.coalesce(F.map_from_entries(named), F.create_map().cast("map<string,string>")).alias("speaker_ids"),
    )


def body_name(crec_id: Column | str) -> Column:
    """The body's file name; the characters of 'id-' go from both ends."""
    return F.concat(F.btrim(X.col(crec_id), F.lit("id-")), F.lit(".htm"))


def with_bodies(docs: DataFrame, bodies: DataFrame, name: str = "name", body: str = "body") -> DataFrame:
    """``docs`` with ``content``, null where no body has the name; where both sides have the ``date`` they were staged under, of the same day."""
    keys = ["date"] if "date" in docs.columns and "date" in bodies.columns else []
    one = bodies.groupBy(*keys, F.col(name).alias("_name")).agg(F.min(body).alias("content"))
    return docs.drop("content").withColumn("_name", body_name("crec_id")).join(one, [*keys, "_name"], "left").drop("_name")


def is_digest(crec_id: Column | str, title_part: Column | str) -> Column:
    """Daily digests: by the last or last but one part of the id, or by the title."""
    parts = F.split(X.col(crec_id), "-")
    named = lambda k: F.startswith(F.coalesce(F.try_element_at(parts, F.lit(k)), F.lit("")), F.lit("PgD"))
    return named(-1) | named(-2) | F.startswith(F.coalesce(X.col(title_part), F.lit("")), F.lit("Daily Digest"))


def is_front_matter(crec_id: Column | str) -> Column:
    return F.startswith(F.coalesce(F.try_element_at(F.split(X.col(crec_id), "-"), F.lit(-1)), F.lit("")), F.lit("FrontMatter"))


def skippable(crec_id: Column | str = "crec_id", title_part: Column | str = "title_part") -> Column:
    return is_digest(crec_id, title_part) | is_front_matter(crec_id)


def split_quarantine(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents that can be loaded, and those without a body or a heading, with the reason."""
    marked = with_reason(docs)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL").select("crec_id", "reason")


def with_reason(docs: DataFrame) -> DataFrame:
    """``docs`` with ``clean``, the text from its heading on, and the ``reason`` why one cannot be loaded, or null."""
    # no step of the clean-up makes a text null but that to the heading: the reason needs no other
    reason = F.when(F.col("content").isNull(), "no body").when(X.from_heading("content").isNull(), "no heading")
    return docs.withColumns({"clean": X.clean("content"), "reason": reason})


def prepared(members: DataFrame, mode: str = "compat", fuzzy: bool = True) -> DataFrame:
    """Every document of staged members (date, name, content) that is not left out, with the ``reason`` of those that cannot be loaded.

    Metadata gives the constituents, digests and front matter are left out, bodies are matched
    by name and day, cleaned from their heading on, and cut into speakers' segments. One pass: a sink
    writes it once and splits it by the reason.
    """
    text = members.withColumn("content", F.col("content").cast("string"))
    docs = constituents(text.where(F.endswith("name", F.lit("mods.xml"))), "content")
    bodies = text.where(F.endswith("name", F.lit(".htm"))).withColumnRenamed("content", "body")
    marked = with_reason(with_bodies(docs.where(~skippable()), bodies))
    return document_segments(marked.drop("content").withColumnRenamed("clean", "content"), mode=mode, fuzzy=fuzzy)


def load(members: DataFrame, mode: str = "compat", fuzzy: bool = True) -> tuple[DataFrame, DataFrame]:
    """The load job: (documents, quarantine) of staged members (date, name, content)."""
    rows = prepared(members, mode, fuzzy)
    return rows.where("reason IS NULL").drop("reason", "date"), rows.where("reason IS NOT NULL").select("crec_id", "reason")


def merged(old: DataFrame, new: DataFrame, key: str = "crec_id") -> DataFrame:
    """``old`` with the documents of ``new`` put in by id: a document that is there is replaced whole."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def write(docs: DataFrame, path: str) -> None:
    """Write documents by day; running a day again replaces it."""
    docs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date_issued").parquet(path)
