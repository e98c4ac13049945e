"""Shared helpers: table access, staging in the shared folder, word splitting, hashing."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but blank and the ASCII controls 9 to 13; ``bytes.split()`` cuts there too.
WORD = r"[^\x20\x09-\x0D]+"

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one of the input tables."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. A local session (tests) may do without one; a cluster may not."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    have = spark.sparkContext._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rostra-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def staged(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write to a new folder of the shared one and read back.

    A lost executor costs only tasks of the current job. The folder goes with :func:`discard`
    or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/rostra-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _staged[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove staged tables that no later job reads."""
    for df in tables:
        path = getattr(df, "_staged_at", None)
        if path in _staged:
            _remove(_staged.pop(path), path)


_staged: dict[str, SparkSession] = {}


@atexit.register
def _remove_all() -> None:
    for path, spark in _staged.items():
        _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None:
        return
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every bit."""
    x = x ^ (x >> _S33)
    x = x * _M1
    x = x ^ (x >> _S33)
    x = x * _M2
    return x ^ (x >> _S33)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, the same in every process."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def odd_constants(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n word hashes, by start; empty if there are fewer words."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(m, np.uint64)
    for i, c in enumerate(odd_constants(n, 1000 + n)):
        total += words[i : i + m] * c
    return mix(total)


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Distinct n-word shingle hashes, sorted; a shorter text is one shingle, no words none."""
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(words, n if len(words) >= n else len(words)))


def text_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def as_long(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's signed long."""
    return np.ascontiguousarray(x).view(np.int64)


def count_hint(df: DataFrame, column: str = "text") -> tuple[int, int]:
    """Rows, and characters of a column: two numbers that set the degree of splitting."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(column)).alias("c")).first()
    return int(row["n"] or 0), int(row["c"] or 0)
