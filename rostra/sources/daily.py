"""The daily job: archives are staged, documents loaded and indexed, and every step audited.

A store is a folder of tables that only grow. A run takes some days through three steps, each written
under the run's number and recorded when it is whole:

* ``audit`` says of each day that it was started, and then how reading its archive ended;
* ``staged`` holds the members, and ``documents`` the documents, those that cannot be loaded with the reason;
* ``loads`` records the runs whose documents are written and indexed.

What counts of a day is the last run that read it successfully. So a run that failed at any point
has changed nothing: days it had started show no success and are taken up again by :func:`pending`, staged days that
were not loaded are loaded by the next :func:`load`. Running a day again replaces it, a day whose archive
has become unreadable keeps what it had, and nothing is ever written twice or overwritten.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegerType, StringType, StructField, StructType

from rostra.operators import index
from rostra.schemas import DOCUMENT
from rostra.sources import archive, documents

_AUDIT = "date date, success boolean, message string, num_files int, run int, state string"
_STAGED = "date date, name string, content binary, error string, run int"
_DOCUMENTS = StructType([StructField("date", DateType()), *DOCUMENT.fields, StructField("reason", StringType()), StructField("run", IntegerType())])
STARTED = "Job started."


def _table(spark: SparkSession, store: str, name: str, schema: str | StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(f"{store}/{name}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def audits(spark: SparkSession, store: str) -> DataFrame:
    """Every audit row: (date, success, message, num_files, run, state), state being started or ended."""
    return _table(spark, store, "audit", _AUDIT)


def audit(spark: SparkSession, store: str) -> DataFrame:
    """The last audit row of each day; of a run that did not come to its end that it was started."""
    row = F.struct("success", "message", "num_files", "run", "state")
    return audits(spark, store).groupBy("date").agg(F.max_by(row, F.struct("run", F.col("state") == "ended")).alias("r")).select("date", F.col("r.success"), F.col("r.message"), F.col("r.num_files"), F.col("r.run"), F.col("r.state"))


def current(spark: SparkSession, store: str) -> dict[dt.date, int]:
    """The run that counts of each day: the last that read it. A day without an archive counts too; the calendar bounds the result."""
    ended = audits(spark, store).where("state = 'ended' AND success").groupBy("date").agg(F.max("run").alias("run"))
    return {r["date"]: r["run"] for r in ended.collect()}


def pending(spark: SparkSession, store: str, start: dt.date, end: dt.date) -> list[dt.date]:
    """The days from start up to, not including, end that no run has read."""
    done = current(spark, store)
    return [d for d in (start + dt.timedelta(days=k) for k in range((end - start).days)) if d not in done]


def scrape(spark: SparkSession, archives: str, store: str, start: dt.date, end: dt.date) -> int:
    """Stage the archives of the days from start up to, not including, end; the number of the run.

    Each archive is read once; the audit is taken from what was staged.
    """
    last = audits(spark, store).agg(F.max("run")).first()[0]
    run = 0 if last is None else last + 1
    began = archive.days(spark, start.isoformat(), end.isoformat()).select("date", F.lit(False).alias("success"), F.lit(STARTED).alias("message"), F.lit(0).alias("num_files"))
    began.coalesce(1).write.mode("overwrite").parquet(f"{store}/audit/run={run}/state=started")
    rows = archive.members(spark, archives, start, end)
    rows.select("date", archive.basename("member").alias("name"), "content", "error").write.mode("overwrite").parquet(f"{store}/staged/run={run}")
    ended = archive.audit(_of(_table(spark, store, "staged", _STAGED), {d: run for d in _span(start, end)}).select("date", F.col("name").alias("member"), "error"))
    ended.write.mode("overwrite").parquet(f"{store}/audit/run={run}/state=ended")
    return run


def _span(start: dt.date, end: dt.date) -> list[dt.date]:
    return [start + dt.timedelta(days=k) for k in range((end - start).days)]


def _of(rows: DataFrame, wanted: dict[dt.date, int]) -> DataFrame:
    """Rows of the runs that count of each day: partitions of other runs are not read."""
    if not wanted:
        return rows.where(F.lit(False))
    by_run: dict[int, list[dt.date]] = {}
    for day, run in wanted.items():
        by_run.setdefault(run, []).append(day)
    test = F.lit(False)
    for run, days in by_run.items():
        test = test | ((F.col("run") == run) & F.col("date").isin(days))
    return rows.where(F.col("run").isin(list(by_run)) & test)


def load(spark: SparkSession, store: str, mode: str = "compat", fuzzy: bool = True, buckets: int = index.BUCKETS) -> list[dt.date]:
    """Write and index the documents of days that were staged since they were loaded last; those days.

    All of them go through one pass, which writes documents and quarantine together. The index takes the loaded
    ones, and days that have none any more.
    """
    loads = _table(spark, store, "loads", "date date, run int, load int")
    have = {r["date"]: r["run"] for r in loads.groupBy("date").agg(F.max_by("run", "load").alias("run")).collect()}
    due = {d: r for d, r in current(spark, store).items() if have.get(d) != r}
    if not due:
        return []
    number = (loads.agg(F.max("load")).first()[0] or 0) + 1
    members = _of(_table(spark, store, "staged", _STAGED), due).where("name IS NOT NULL")
    rows = documents.prepared(members.select("date", "name", "content"), mode, fuzzy)
    columns = [f.name for f in _DOCUMENTS if f.name != "run"]
    rows.select(*columns).write.mode("overwrite").parquet(f"{store}/documents/run={number}")
    held = spark.read.schema(StructType([f for f in _DOCUMENTS.fields if f.name != "run"])).parquet(f"{store}/documents/run={number}")
    index.add(held.where("reason IS NULL"), f"{store}/index", day="date", days=list(due), buckets=buckets)
    spark.createDataFrame([(d, r, number) for d, r in due.items()], "date date, run int, load int").coalesce(1).write.mode("overwrite").parquet(f"{store}/loads/part={number}")
    return sorted(due)


def loaded(spark: SparkSession, store: str) -> DataFrame:
    """Documents and quarantine of every day as last loaded, with ``date``, the archive's day, and ``reason``."""
    last = _table(spark, store, "loads", "date date, run int, load int").groupBy("date").agg(F.max("load").alias("load"))
    return _of(_table(spark, store, "documents", _DOCUMENTS), {r["date"]: r["load"] for r in last.collect()}).drop("run")
