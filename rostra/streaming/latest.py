"""The newest row of each key of an endless stream, kept as state that expires."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = StructType([StructField("seq", LongType()), StructField("timer", LongType())])


class KeepLast(StatefulProcessor):
    """Gives a row when it is newer than all rows of its key so far, and forgets keys that have been quiet.

    The state of a key is a number and a time, whatever its rows hold. Of equal numbers the first that came
    stays; of those that come together, that with the largest digest, so that a batch that is repeated
    gives the same rows.
    """

    def __init__(self, event_time: bool, expire_ms: int | None):
        self.event_time, self.expire_ms = event_time, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", _STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        best = order = latest = None
        for row in rows:
            *_, seq, digest, t = row
            if self.event_time and t is not None:
                latest = t if latest is None else max(latest, t)
            if order is None or (seq, digest) > order:
                best, order = row, (seq, digest)
        # each call on the state goes to the JVM and back: none that is not needed
        have = self.last.get()
        timer = None if have is None else have[1]
        moved = self.expire_ms is not None and latest is not None and (timer is None or latest + self.expire_ms > timer)
        if moved:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = latest + self.expire_ms
            self.handle.registerTimer(timer)
        newer = have is None or order[0] > have[0]
        if newer or moved:
            self.last.update((order[0] if newer else have[0], timer if timer is not None else 0))
        if newer:
            yield Row(*best.__fields__[:-3])(*best[:-3])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def keep_last(stream: DataFrame, key: str, seq: str, event_time: str | None = None, expire: str | None = None, late: str = "1 day") -> DataFrame:
    """Rows of a stream that are newer, by ``seq``, than every row of their key before them.

    With ``event_time`` rows later than the watermark are dropped, and a key that has had no row for
    ``expire`` is forgotten, so the state follows the keys in use and not all keys ever seen. A sink that takes rows
    by key then holds the last row of each. Rows without a key or number are left out.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = stream.where(F.col(key).isNotNull() & F.col(seq).isNotNull())
    columns = rows.columns
    if event_time:
        rows = rows.withWatermark(event_time, late)
    order_ms = F.unix_millis(event_time) if event_time else F.lit(None).cast("long")
    rows = rows.withColumns({"order_seq": F.col(seq).cast("long"), "order_digest": F.xxhash64(F.to_json(F.struct(*columns))), "order_ms": order_ms})
    expire_ms = None
    if event_time:
        expire_ms = int(spark.sql(f"SELECT INTERVAL {expire or '30 days'}").first()[0].total_seconds() * 1000)
    kept = StructType([f for f in stream.schema.fields])
    return rows.groupBy(key).transformWithState(KeepLast(event_time is not None, expire_ms), kept, "Update", "EventTime" if event_time else "None")


def run_available(out: DataFrame, sink: str, checkpoint: str) -> None:
    """Take what there is, and write each batch under its number, so that a repeat replaces its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    query = out.writeStream.option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()


def by_key(spark: SparkSession, sink: str, schema: StructType, key: str, seq: str) -> DataFrame:
    """The last row of each key of what :func:`run_available` wrote."""
    rows = spark.read.schema(schema).parquet(sink)
    rest = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col(seq), "batch")).alias("r")).select(key, "r.*")
