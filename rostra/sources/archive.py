"""Daily archives: names, members, staged keys, the data source that reads them, and the sink that writes them."""

from __future__ import annotations

import datetime as dt
import re
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rostra.functions.text import col
from rostra.schemas import AUDIT

NO_DATA, UNREADABLE = "no data", "unreadable archive"
#: Bytes of members that a reader gives to Spark together; a larger member goes alone.
_BATCH_BYTES = 8 << 20
#: Bytes of a member that are packed or unpacked at once.
_PART_BYTES = 1 << 20
_NAME = re.compile(r"CREC-(\d{4}-\d{2}-\d{2})\.zip$")


def archive_name(day: Column | str) -> Column:
    """The name of a day's archive."""
    return F.concat(F.lit("CREC-"), F.date_format(col(day), "yyyy-MM-dd"), F.lit(".zip"))


def day_span(start: Column | str, end: Column | str) -> Column:
    """The days from start up to, not including, end; null if there are none."""
    a, b = col(start), col(end)
    return F.when(a < b, F.sequence(a, F.date_sub(b, 1)))


def days(spark: SparkSession, start: str, end: str | None = None) -> DataFrame:
    """The days from start up to, not including, end (today if none)."""
    last = F.to_date(F.lit(end)) if end else F.current_date()
    return spark.range(1).select(F.explode(day_span(F.to_date(F.lit(start)), last)).alias("date"))


def basename(path: Column | str) -> Column:
    return F.regexp_extract(col(path), r"[^/]+$", 0)


def relevant(name: Column | str) -> Column:
    """Members that are kept: bodies and metadata."""
    return F.endswith(col(name), F.lit("htm")) | F.endswith(col(name), F.lit("mods.xml"))


def staged_key(name: Column | str, day: Column | str, prefix: str = "crec") -> Column:
    return F.concat_ws("/", F.lit(prefix), F.date_format(col(day), "yyyy/MM/dd"), basename(name))


# -- the data source -------------------------------------------------------------------------


@dataclass
class Archive(InputPartition):
    """A day's archive; without a path there is none."""

    day: dt.date | None
    path: str | None


def _store(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    # file:/x, as Hadoop writes it, is file:///x
    uri = re.sub(r"^file:/(?!/)", "file:///", path)
    return fs.FileSystem.from_uri(uri)


class ArchiveReader(DataSourceReader):
    """A partition a day. Members are unpacked by parts into the batch that Spark gets, so a task holds
    ``_BATCH_BYTES`` of them, or one that is larger, and no archive.

    With days given, every one of them has a row at least: days without an archive, or with one that
    cannot be read, say so in ``error``. Days are chosen by the options alone, before any archive is opened:
    a pushed-down filter would stay with the reader, which all queries on one DataFrame share.
    """

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.start, self.end = (dt.date.fromisoformat(options[k]) if options.get(k) else None for k in ("start", "end"))

    def _wanted(self, day: dt.date | None) -> bool:
        if day is None:
            return self.start is None and self.end is None
        return (self.start is None or self.start <= day) and (self.end is None or day < self.end)

    def partitions(self) -> list[Archive]:
        from pyarrow import fs

        store, root = _store(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        held = [Archive(dt.date.fromisoformat(m[1]) if (m := _NAME.search(f.path)) else None, f.path) for f in found if f.type == fs.FileType.File and f.path.endswith(".zip")]
        if self.start is not None and self.end is not None:
            there = {a.day for a in held}
            span = (self.start + dt.timedelta(days=k) for k in range((self.end - self.start).days))
            held += [Archive(d, None) for d in span if d not in there]
        return [a for a in held if self._wanted(a.day)]

    def read(self, partition: Archive | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are no archives
            return

        def rows(members: list[str | None], contents: pa.Array, error: str | None) -> pa.RecordBatch:
            n = len(members)
            return pa.RecordBatch.from_arrays([pa.array([partition.day] * n, pa.date32()), pa.array([partition.path] * n, pa.string()), pa.array(members, pa.string()), contents, pa.array([error] * n, pa.string())], names=["date", "path", "member", "content", "error"])

        def joined(bodies: bytearray, ends: list[int]) -> pa.Array:
            # Arrow takes the bytes as they lie, without a copy
            return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.array(ends, pa.int32()).buffers()[1], pa.py_buffer(bodies)])

        none = pa.nulls(1, pa.binary())
        if partition.path is None:
            yield rows([None], none, NO_DATA)
            return
        store, _ = _store(self.path)
        names, bodies, ends, n = [], bytearray(), [0], 0
        try:
            with store.open_input_file(partition.path) as file, zipfile.ZipFile(file) as z:
                for name in z.namelist():
                    if name.endswith(("htm", "mods.xml")):
                        if names and len(bodies) + z.getinfo(name).file_size > _BATCH_BYTES:
                            yield rows(names, joined(bodies, ends), None)
                            names, bodies, ends = [], bytearray(), [0]
                        with z.open(name) as member:
                            while part := member.read(_PART_BYTES):
                                bodies += part
                        names.append(name)
                        ends.append(len(bodies))
                        n += 1
        except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, ValueError):
            # what is wrong with the archive; a store that fails is the task's fault, and it is tried again.
            # Members read before the fault came stay out of the day by its error
            yield rows([None], none, UNREADABLE)
            return
        if names or not n:
            yield rows(names, joined(bodies, ends), None) if names else rows([None], none, None)


class ArchiveSource(DataSource):
    """``spark.read.format("rostra_archives")``; options path, and start and end as half-open days."""

    @classmethod
    def name(cls) -> str:
        return "rostra_archives"

    def schema(self) -> str:
        return "date date, path string, member string, content binary, error string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def members(spark: SparkSession, path: str, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """(date, path, member, content, error) of the relevant members of the archives under a path.

    An archive that cannot be read gives a row with an error and no member; so does a day from start up to,
    not including, end without an archive. An archive without relevant members gives a row without either.
    """
    spark.dataSource.register(ArchiveSource)
    reader = spark.read.format("rostra_archives").option("path", path)
    for k, v in (("start", start), ("end", end)):
        reader = reader.option(k, v.isoformat()) if v is not None else reader
    return reader.load()


def put(path: str, body: bytes) -> None:
    """Write a small file."""
    store, at = _store(path)
    store.create_dir(at.rpartition("/")[0], recursive=True)
    with store.open_output_stream(at) as out:
        out.write(body)


def write_archives(rows: DataFrame, path: str) -> DataFrame:
    """Write rows (date, member, content) as an archive a day; gives (date, members) of what has been written.

    A day streams through one task, sorted by member and in parts of ``_PART_BYTES``, so neither an archive nor
    a large member is held in Python; it gets its name when it is whole, so a task that is lost leaves nothing that counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(path)
        store.create_dir(root, recursive=True)
        context = TaskContext.get()
        day, out, z, entry, n, done = None, None, None, None, 0, []

        def close() -> None:
            entry.close()
            z.close()
            out.close()
            store.move(at, f"{root}/CREC-{day.isoformat()}.zip")
            done.append((day, n))

        at = ""
        for batch in batches:
            for d, name, size, part, body in zip(*batch.columns, strict=True):
                if part.as_py() == 0:
                    if d.as_py() != day:
                        if z is not None:
                            close()
                        day, n, entry = d.as_py(), 0, None
                        at = f"{root}/.{day.isoformat()}-{context.taskAttemptId()}.part"
                        out = store.open_output_stream(at)
                        z = zipfile.ZipFile(out, "w")
                    if entry is not None:
                        entry.close()
                    info = zipfile.ZipInfo(name.as_py())
                    info.compress_type, info.file_size = zipfile.ZIP_DEFLATED, size.as_py()
                    entry = z.open(info, "w")
                    n += 1
                entry.write(memoryview(body.as_buffer()))
        if z is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in done], pa.date32()), pa.array([k for _, k in done], pa.int64())], names=["date", "members"])

    ordered = rows.where("date IS NOT NULL").select("date", "member", F.col("content").cast("binary").alias("content")).repartition("date").sortWithinPartitions("date", "member")
    size = F.octet_length("content")
    starts = F.sequence(F.lit(1), size, F.lit(_PART_BYTES))
    parts = F.when(size > _PART_BYTES, F.transform(starts, lambda k: F.substring("content", k, F.lit(_PART_BYTES)))).otherwise(F.array("content"))
    # parts come after the sort, so those of a member stay together even where a name is given twice
    ordered = ordered.select("date", "member", size.alias("size"), F.posexplode(parts).alias("part", "content"))
    return ordered.mapInArrow(run, "date date, members long")


# -- the audit -------------------------------------------------------------------------------


def audit(rows: DataFrame) -> DataFrame:
    """One row for each day: whether it could be read, the keys it gave, and how many bodies.

    Of rows with an ``error`` that counts; a null member without one is an archive that cannot be read, unless
    the table tells errors apart. A day without an archive is a success.
    """
    told = "error" in rows.columns
    error = F.max("error") if told else F.max(F.when(F.col("member").isNull(), UNREADABLE))
    keys = F.array_join(F.array_sort(F.collect_list(F.when(F.col("member").isNotNull(), staged_key("member", "date")))), "\n")
    day = rows.groupBy("date").agg(error.alias("_error"), keys.alias("_keys"), F.count_if(F.endswith("member", F.lit(".htm"))).cast("int").alias("num_files"))
    return day.select("date", (F.coalesce("_error", F.lit(NO_DATA)) == NO_DATA).alias("success"), F.coalesce("_error", "_keys").alias("message"), "num_files")


def no_data(spark: SparkSession, day: str, message: str = NO_DATA) -> DataFrame:
    """The audit row of a day without an archive, which counts as a success."""
    return spark.range(1).select(F.to_date(F.lit(day)).alias("date"), F.lit(True).alias("success"), F.lit(message).alias("message"), F.lit(0).alias("num_files")).to(AUDIT)


def stage(rows: DataFrame, path: str) -> None:
    """Write members by day; running a day again replaces it."""
    out = rows.where("member IS NOT NULL").select("date", basename("member").alias("name"), "content")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)
