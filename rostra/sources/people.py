"""People from YAML files, and constant dimensions."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostra.constants import BILL_TYPES, STATES
from rostra.operators.people import folded
from rostra.schemas import PERSON, TERM

DEFAULT_BIRTHDAY = "1776-07-04"
_RECORD = "id map<string,string>, name map<string,string>, bio map<string,string>, terms array<map<string,string>>"


#: Records of a file that a task holds at a time.
_RECORDS = 1000


def _items(stream) -> Iterator:
    """The items of a YAML file's list, one at a time, so that a file's tree is never whole in memory; anchors hold through the file."""
    import yaml
    from yaml.composer import Composer, ComposerError

    class Fast(Composer, yaml.CBaseLoader if yaml.__with_libyaml__ else yaml.BaseLoader):
        """Events of libyaml where it is there; nodes are composed from them here, as it gives whole documents only."""

        def __init__(self, stream):
            super(Composer, self).__init__(stream)
            Composer.__init__(self)

    loader = Fast(stream)
    try:
        loader.get_event()  # the stream starts
        if loader.check_event(yaml.StreamEndEvent):
            return
        loader.get_event()  # the document starts
        if loader.check_event(yaml.SequenceStartEvent):
            loader.get_event()
            while not loader.check_event(yaml.SequenceEndEvent):
                yield loader.construct_document(loader.compose_node(None, None))
            loader.get_event()
        else:
            yield from loader.construct_document(loader.compose_node(None, None)) or []
        loader.get_event()  # the document ends
        if not loader.check_event(yaml.StreamEndEvent):
            raise ComposerError("expected a single document in the stream", None, "but found another document", loader.get_event().start_mark)
    finally:
        loader.dispose()


def load_yaml(spark: SparkSession, *paths: str) -> DataFrame:
    """(seq, record) of all persons; ``seq`` orders them by the paths as given, by the files of a path, and within a file."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v) if isinstance(v, (list, dict)) else str(v)
        plain = lambda d: {k: text(v) for k, v in (d or {}).items()}
        for batch in batches:
            for at, body in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                people, n = _items(pa.BufferReader(body.as_buffer())), 0
                while some := list(islice(people, _RECORDS)):
                    rows = [json.dumps({"id": plain(p.get("id")), "name": plain(p.get("name")), "bio": plain(p.get("bio")), "terms": [plain(t) for t in p.get("terms") or []]}) for p in some]
                    yield pa.RecordBatch.from_arrays([pa.array([at] * len(rows), pa.string()), pa.array(range(n, n + len(rows)), pa.int64()), pa.array(rows, pa.string())], names=["path", "n", "json"])
                    n += len(rows)

    parts = []
    for k, path in enumerate(paths):
        raw = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, "path string, n long, json string")
        parts.append(raw.select(F.struct(F.lit(k).alias("source"), "path", "n").alias("seq"), F.from_json("json", _RECORD).alias("record")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def persons(records: DataFrame) -> DataFrame:
    """People: names and biography together, the biography's value winning; the last record of an id counts column by column."""
    both = records.select("seq", F.col("record.id")["bioguide"].alias("bioguide_id"), F.col("record.name").alias("n"), F.col("record.bio").alias("b")).where("bioguide_id IS NOT NULL")
    columns = [F.coalesce(F.col("b")[f.name], F.col("n")[f.name]).alias(f.name) for f in PERSON if f.name not in ("bioguide_id", "birthday")]
    rows = both.select("seq", "bioguide_id", *columns, F.try_to_date(F.col("b")["birthday"]).alias("birthday"))
    merged = folded(rows, ["bioguide_id"], "seq").drop("seq")
    return merged.withColumn("birthday", F.coalesce("birthday", F.to_date(F.lit(DEFAULT_BIRTHDAY)))).select(*PERSON.fieldNames())


def external_ids(records: DataFrame) -> DataFrame:
    rows = records.select(F.col("record.id")["bioguide"].alias("bioguide_id"), F.explode("record.id").alias("type", "value"))
    return rows.dropDuplicates(["bioguide_id", "type", "value"])


def terms(records: DataFrame) -> DataFrame:
    """Terms, one for each person, state, start, end and type; later records fill in the other columns."""
    t = F.col("t")
    rows = records.select("seq", F.col("record.id")["bioguide"].alias("bioguide_id"), F.posexplode("record.terms").alias("p", "t"))
    names = {"election_class": "class"}
    text = [t[names.get(f.name, f.name)].alias(f.name) for f in TERM if f.name not in ("bioguide_id", "start_date", "end_date", "district")]
    flat = rows.select(F.struct("seq", "p").alias("seq"), "bioguide_id", F.to_date(t["start"]).alias("start_date"), F.to_date(t["end"]).alias("end_date"), t["district"].try_cast("int").alias("district"), *text)
    keys = ["bioguide_id", "state", "start_date", "end_date", "type"]
    out = folded(flat, keys, "seq").drop("seq")
    return out.withColumn("district", F.coalesce("district", F.lit(-1))).select(*TERM.fieldNames())


def states(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(STATES.items()), "short string, name string")


def bill_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(BILL_TYPES.items()), "code string, label string")


def jdbc(spark: SparkSession, url: str, name: str, column: str | None = None, rows: int = 100_000, most: int = 256, **options: str) -> DataFrame:
    """A table of an external database, read in parts of about ``rows`` rows by a numeric or date column.

    The bounds are the column's least and greatest values, asked of the database; every row is read,
    also those without a value. Filters and columns reach the database with every part; ``most`` bounds the
    connections at a time. Without a column one task reads all.
    """
    reader = spark.read.format("jdbc").options(url=url, **options)
    if column is None:
        return reader.option("dbtable", name).load()
    quoted = spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(column)
    low, high, n = spark.read.format("jdbc").options(url=url, query=f"SELECT min({quoted}) AS a, max({quoted}) AS b, count(*) AS n FROM {name}", **options).load().first()
    if low is None:
        return reader.option("dbtable", name).load()
    parts = min(most, max(1, -(-n // rows)))
    return reader.options(dbtable=name, partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts)).load()
