"""Schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


SEGMENT = T.StructType(_strings("id", "speaker", "text", "bioguide_id"))

DOCUMENT = T.StructType(
    [
        *_strings("crec_id", "title", "title_part", "content", "pdf_url", "html_url", "page_start", "page_end"),
        T.StructField("date_issued", T.DateType()),
        T.StructField("speakers", T.ArrayType(T.StringType())),
        T.StructField("speaker_ids", T.MapType(T.StringType(), T.StringType())),
        T.StructField("segments", T.ArrayType(SEGMENT)),
    ]
)

PERSON = T.StructType(
    [
        *_strings("bioguide_id", "first", "middle", "last", "suffix", "nickname", "official_full", "religion", "gender"),
        T.StructField("birthday", T.DateType()),
    ]
)

TERM = T.StructType(
    [
        *_strings("bioguide_id", "type", "state"),
        T.StructField("start_date", T.DateType()),
        T.StructField("end_date", T.DateType()),
        T.StructField("district", T.IntegerType()),
        *_strings("election_class", "state_rank", "party", "caucus", "address", "office", "phone", "fax", "contact_form", "rss_url", "url"),
    ]
)

EXTERNAL_ID = T.StructType(_strings("bioguide_id", "type", "value"))

AUDIT = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("message", T.StringType()),
        T.StructField("num_files", T.IntegerType()),
    ]
)
