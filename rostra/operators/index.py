"""A kept index of documents by day: positions of words, and daily counts of words and tokens.

An index is three Parquet tables under one path. ``postings`` holds (term, day, key, tf, positions,
length) and ``counts`` (term, day, docs, places, tokens, capped), both by run and bucket of terms and
sorted by term; ``days`` says for each run which days it holds, with their documents and words.

:func:`add` indexes some days as a new run and changes nothing that is there: the last run that names
a day is the one that counts, so days are replaced whole, other days stay as they are, and
a run that failed before it wrote its days has never been. One writer at a time. :func:`compact` brings
the current days of all runs into one, some buckets after the other, and removes what they replace; ``moved``
names the buckets that are done, so a compaction that fails midway loses nothing.

Disk is bounded: postings are written where their documents are read, without a shuffle; counts are summed and runs
are compacted some buckets at a time, and what that leaves in shuffles or in old runs goes before the next buckets come.

A search reads the buckets of its words, and of the positions only the days asked for: how many
documents hold a word is the sum of daily counts, and the statistics of the collection are the
sum of the days'. Histograms need no positions but for phrases.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rostra.constants import TOKEN_LIMIT
from rostra.functions import text as X
from rostra.sources import shared

BUCKETS = 32
#: Postings whose counts are summed, and words that are compacted, at a time at least; rows of a file that is compacted or summed.
STEP, FILE = 4_000_000, 500_000
#: Bytes of a file that a task reads for writing; a row group is read whole.
PART = "16m"
_COUNTS = "term string, day date, docs long, places long, tokens long, capped long, run int, bucket int"
_DAYS = "day date, docs long, words long, buckets int, schema string, run int"


class Day(NamedTuple):
    run: int
    docs: int
    words: int


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _or(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _steps(buckets: int, size: int) -> list[list[int]]:
    """The buckets in groups of about STEP of the size each, if one bucket is not larger."""
    n = max(1, min(buckets, -(-size // STEP)))
    return [list(range(k, buckets, n)) for k in range(n)]


@contextmanager
def _set(spark: SparkSession, **conf: str) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _put(rows: DataFrame, path: str, run: int, buckets: int, mode: str = "overwrite") -> None:
    """Write rows by bucket, each task a file for each bucket that it has, sorted by term.

    Its files are open at once, so that rows sort by term and not by bucket before. Files are read in small parts,
    as what is sorted takes many times their bytes. What was shuffled for the rows goes when they are
    written, not when the driver happens to collect its garbage.
    """
    out = rows.sortWithinPartitions("term", "day").withColumn("bucket", _bucket(F.col("term"), buckets))
    conf = {"spark.sql.maxConcurrentOutputFileWriters": str(buckets), "spark.sql.files.maxPartitionBytes": PART, "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    with _set(rows.sparkSession, **conf):
        out.write.mode(mode).option("partitionOverwriteMode", "static").option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/run={run}")


def postings(docs: DataFrame, key: str, content: str, day: str) -> DataFrame:
    """(term, day, key, tf, positions, length) of every word of every document; positions start at 0.

    A document is inverted in its own row, without a shuffle: its words sort with their places, and
    each stretch of equal words is a posting. Time follows the words but for the sort.
    """
    found = docs.select(F.col(key).alias("key"), F.col(day).alias("day"), X.analyze(content).alias("_words"))
    at = found.select("key", "day", F.size("_words").alias("length"), F.sort_array(F.transform("_words", lambda w, i: F.struct(w.alias("w"), i.alias("i")))).alias("_at"))
    new = lambda i: (i == 0) | (F.get("_at", i)["w"] != F.get("_at", i - 1)["w"])
    heads = at.withColumn("_heads", F.when(F.col("length") > 0, F.filter(F.sequence(F.lit(0), F.col("length") - 1), new)))
    # posexplode would first ask whether there is anything to give, and so cut each document twice
    words = heads.select("*", F.posexplode_outer("_heads").alias("_j", "_h")).where("_h IS NOT NULL")
    n = F.coalesce(F.get("_heads", F.col("_j") + 1), F.col("length")) - F.col("_h")
    return words.select(F.get("_at", F.col("_h"))["w"].alias("term"), "day", "key", n.cast("long").alias("tf"), F.slice("_at", F.col("_h") + 1, n)["i"].alias("positions"), "length")


def _tokens(docs: DataFrame, content: str, day: str) -> DataFrame:
    """Daily counts of tokens: all, and those a text has before the limit."""
    tokens = docs.select(F.col(day).alias("day"), F.posexplode_outer(X.tokens(content)).alias("i", "term")).where("term IS NOT NULL")
    return tokens.groupBy("term", "day").agg(F.count(F.lit(1)).alias("tokens"), F.count_if(F.col("i") < TOKEN_LIMIT).alias("capped"))


def _counts(held: DataFrame, tokens: DataFrame) -> DataFrame:
    """Daily counts of words, from their postings, beside those of tokens."""
    both = held.select("term", "day", F.lit(1).cast("long").alias("docs"), F.col("tf").alias("places")).unionByName(tokens, allowMissingColumns=True)
    return both.groupBy("term", "day").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("docs", "places", "tokens", "capped")])


def _put_counts(spark: SparkSession, path: str, run: int, buckets: int) -> None:
    """Sum the counts of a run whose postings and tokens are written, some buckets at a time."""
    held = spark.read.schema("term string, day date, tf long, bucket int").parquet(f"{path}/postings/run={run}")
    tokens = spark.read.schema("term string, day date, tokens long, capped long, bucket int").parquet(f"{path}/tokens/run={run}")
    n = held.count()
    steps = _steps(buckets, n)
    for k, some in enumerate(steps):
        rows = _counts(*[x.where(F.col("bucket").isin(some)).drop("bucket") for x in (held, tokens)])
        _put(rows.coalesce(1 + n // len(steps) // FILE), f"{path}/counts", run, buckets, "append" if k else "overwrite")


def _runs(spark: SparkSession, path: str) -> DataFrame:
    """The table of days; empty where nothing has been indexed."""
    try:
        return spark.read.schema(_DAYS).parquet(f"{path}/days")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _DAYS)


def _moved(spark: SparkSession, path: str) -> dict[int, int]:
    """The run that the last compaction to reach a bucket has moved it to."""
    try:
        rows = spark.read.schema("bucket int, run int").parquet(f"{path}/moved")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    return {r["bucket"]: r["run"] for r in rows.groupBy("bucket").agg(F.max("run").alias("run")).collect()}


def add(docs: DataFrame, path: str, key: str = "crec_id", content: str = "content", day: str = "date_issued", days: Sequence[dt.date] | None = None, buckets: int = BUCKETS) -> None:
    """Index ``docs`` as a new run; it replaces the days that they have, and those of ``days`` whether they have documents or not.

    Keys are taken as unique. A null text is a document without words; a null day is a day of its own,
    which no range of days finds.
    """
    spark = docs.sparkSession
    last = _runs(spark, path).agg(F.max("run"), F.max_by("buckets", "run")).first()
    run, buckets = (0, buckets) if last[0] is None else (max([last[0], *_moved(spark, path).values()]) + 1, last[1])
    # tokens come first and lie by bucket until the counts are made: what is shuffled for them has gone when postings come
    _put(_tokens(docs, content, day), f"{path}/tokens", run, buckets)
    rows = postings(docs, key, content, day)
    _put(rows, f"{path}/postings", run, buckets)
    _put_counts(spark, path, run, buckets)
    shared.remove(spark, f"{path}/tokens/run={run}")
    # the words of a day are the places of its terms: texts are not read for them again
    words = spark.read.schema(_COUNTS).parquet(f"{path}/counts/run={run}").select("day", F.lit(0).cast("long").alias("docs"), F.col("places").alias("words"))
    own = docs.select(F.col(day).alias("day"), F.lit(1).cast("long").alias("docs"), F.lit(0).cast("long").alias("words")).unionByName(words).groupBy("day").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words"))
    if days:
        none = spark.createDataFrame([(d, 0, 0) for d in days], "day date, docs long, words long")
        own = own.unionByName(none).groupBy("day").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words"))
    _commit(own, path, run, buckets, rows.schema)


def _commit(own: DataFrame, path: str, run: int, buckets: int, schema: StructType) -> None:
    own.coalesce(1).withColumns({"buckets": F.lit(buckets), "schema": F.lit(schema.json())}).write.mode("overwrite").parquet(f"{path}/days/run={run}")


class Index:
    """What is current of an index when it is opened; later runs are seen by those who open it later.

    A compaction removes what it replaces, so an index that was opened before it must be opened again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        runs = _runs(spark, path)
        # a row a day: the calendar bounds what the driver holds
        latest = runs.groupBy("day").agg(F.max_by(F.struct("run", "docs", "words", "buckets", "schema"), "run").alias("r"), F.collect_set("run").alias("runs")).collect()
        self.days = {r["day"]: Day(r["r"]["run"], r["r"]["docs"], r["r"]["words"]) for r in latest}
        self._old: dict[int, list[dt.date | None]] = {}
        for r in latest:
            for run in r["runs"]:
                if run != r["r"]["run"]:
                    self._old.setdefault(run, []).append(r["day"])
        self.buckets = max((r["r"]["buckets"] for r in latest), default=BUCKETS)
        self._schema = StructType.fromJson(json.loads(latest[0]["r"]["schema"])) if latest else None
        # a compaction that has ended stands among the days; one that has not holds some buckets of all days before it
        done = {run for r in latest for run in r["runs"]}
        self._moved = _moved(spark, path)
        self._last = max([*done, *self._moved.values()], default=-1)
        self._moved = {b: run for b, run in self._moved.items() if run not in done}

    @property
    def documents(self) -> int:
        return sum(d.docs for d in self.days.values())

    @property
    def mean_length(self) -> float:
        return sum(d.words for d in self.days.values()) / max(1, self.documents)

    def _current(self, table: str, schema: StructType | str, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
        """Rows of the runs and days that count; of days outside the range none."""
        within = {d: x.run for d, x in self.days.items() if x.docs and (start is None or d is not None and start <= d <= end)}
        if not within:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{table}")
        if start is not None:
            rows = rows.where(F.col("day").between(F.lit(start), F.lit(end)))
        if not self._moved:
            return rows.where(self._counting(within, self._old, start, end))
        tests = [~F.col("bucket").isin(list(self._moved)) & self._counting(within, self._old, start, end)]
        for to in sorted(set(self._moved.values())):
            old = self._old | {to: [d for d, x in self.days.items() if x.run > to]}
            tests.append(F.col("bucket").isin([b for b, run in self._moved.items() if run == to]) & self._counting({d: max(run, to) for d, run in within.items()}, old, start, end))
        return rows.where(_or(tests))

    @staticmethod
    def _counting(within: dict[dt.date | None, int], old: dict[int, list[dt.date | None]], start: dt.date | None, end: dt.date | None) -> Column:
        """Whether a row stands in a run that counts, and not in one that is old for its day."""
        runs = sorted(set(within.values()))
        test = F.col("run").isin(runs)
        for run in runs:
            gone = [d for d in old.get(run, []) if start is None or d is not None and start <= d <= end]
            if gone:
                hit = _or([F.col("day").eqNullSafe(F.lit(d).cast("date")) for d in gone if d is None] + ([F.coalesce(F.col("day").isin([d for d in gone if d]), F.lit(False))] if any(gone) else []))
                test = test & ~((F.col("run") == run) & hit)
        return test

    def _of(self, rows: DataFrame, terms: Sequence[str]) -> DataFrame:
        """Rows of terms, from their buckets."""
        return rows.where(_or([F.col("bucket") == _bucket(F.lit(t), self.buckets) for t in terms]) & F.col("term").isin(list(terms)))

    def postings(self, terms: Sequence[str], start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
        schema = StructType.fromDDL("term string, day date, key string, tf long, positions array<int>, length int") if self._schema is None else self._schema
        return self._of(self._current("postings", StructType([*schema.fields, *StructType.fromDDL("run int, bucket int").fields]), start, end), terms).drop("run", "bucket")

    def counts(self, terms: Sequence[str], start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
        """(term, day, docs, places, tokens, capped) of terms; a day has a row in one run alone."""
        return self._of(self._current("counts", _COUNTS, start, end), terms).drop("run", "bucket")

    def all_counts(self, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
        """The counts of every term."""
        return self._current("counts", _COUNTS, start, end).drop("run", "bucket")

    def frequencies(self, words: Sequence[str]) -> DataFrame:
        """One row: in how many documents of the whole index each word stands, as _df0, _df1 and so on."""
        rows = self.counts(list(dict.fromkeys(words)))
        return rows.agg(*[F.coalesce(F.sum(F.when(F.col("term") == w, F.col("docs"))), F.lit(0)).cast("double").alias(f"_df{i}") for i, w in enumerate(words)])

    def phrase_places(self, words: Sequence[str], start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
        """(key, day, length, tf) of the documents in which the words stand together."""
        distinct = list(dict.fromkeys(words))
        rows = self.postings(distinct, start, end)
        if len(words) == 1:
            return rows.select("key", "day", "length", F.col("tf").cast("int").alias("tf"))
        held = rows.groupBy("key", "day", "length").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("_at"))
        return held.where(F.size("_at") == len(distinct)).withColumn("tf", places(words)).where("tf > 0").drop("_at")

    def hits(self, phrase: str, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
        """(key, day, tf, score) of the documents of the range that hold the phrase, scored as by the texts of all days."""
        words = X.analyzed_words(phrase)
        if not words:
            return self.postings([""], start, end).select("key", "day", F.lit(0).alias("tf"), F.lit(0.0).alias("score"))
        found = self.phrase_places(words, start, end).crossJoin(F.broadcast(self.frequencies(words)))
        score = bm25_score(len(words), F.lit(float(self.documents)), F.lit(float(self.mean_length)))
        return found.select("key", "day", "tf", score.alias("score"))

    def term_counts(self, term: str, start: dt.date, end: dt.date, limit: int | None = TOKEN_LIMIT, mode: str = "compat") -> DataFrame:
        """(date, count) as counted from the texts; limits other than the usual one and none are not kept."""
        if limit not in (None, TOKEN_LIMIT):
            raise ValueError(f"the index keeps counts up to {TOKEN_LIMIT} tokens and of all")
        token, words = term.strip().lower(), X.analyzed_words(term)
        if mode == "intent" and len(words) > 1:
            return self.phrase_places(words, start, end).groupBy(F.col("day").alias("date")).agg(F.sum("tf").cast("long").alias("count"))
        if mode == "intent" and not words:
            return self.spark.createDataFrame([], "date date, count long")
        word = words[0] if mode == "intent" else token
        n = "tokens" if limit is None or mode == "intent" else "capped"
        rows = self.counts(list(dict.fromkeys([word, token])), start, end)
        out = rows.groupBy(F.col("day").alias("date")).agg(F.coalesce(F.sum(F.when(F.col("term") == token, F.col(n))), F.lit(0)).cast("long").alias("count"), F.sum(F.when(F.col("term") == word, F.col("docs"))).alias("_docs"))
        return out.where("_docs > 0").drop("_docs")


def bm25_score(n_words: int, n: Column, mean: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    """The score of columns tf, length and _df0, _df1 and so on."""
    idf = reduce(lambda a, c: a + c, [F.log(1 + (n - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5)) for i in range(n_words)])
    tf = F.col("tf").cast("double")
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.greatest(mean, F.lit(1e-9))))


def places(words: Sequence[str]) -> Column:
    """Non-overlapping places of the phrase, from the map ``_at`` of a document's positions by word."""
    def starts_of(i: int) -> Column:
        return F.transform(F.col("_at")[words[i]], lambda x: x - i)

    starts = F.array_sort(reduce(F.array_intersect, [starts_of(i) for i in range(len(words))]))
    step = lambda s, x: F.when(x >= s["next"], F.struct((s["n"] + 1).alias("n"), (x + len(words)).alias("next"))).otherwise(s)
    return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("next")), step, lambda s: s["n"])


def compact(spark: SparkSession, path: str) -> None:
    """Bring the current days of all runs into one new run; what is read does not change, but the files become few.

    Some buckets are written, named as moved and removed from the runs before, then the next. Nothing is shuffled:
    the files of a bucket are read together and sorted again. An index that was opened before must be opened again.
    """
    now = Index(spark, path)
    if not now.days:
        return
    run, words = now._last + 1, sum(d.words for d in now.days.values())
    extra = StructType.fromDDL("run int, bucket int").fields
    for k, some in enumerate(_steps(now.buckets, words)):
        for table, schema in (("postings", StructType([*now._schema.fields, *extra])), ("counts", _COUNTS)):
            rows = now._current(table, schema)
            each = [rows.where(F.col("bucket") == b).drop("run", "bucket").coalesce(1 + words // now.buckets // FILE) for b in some]
            _put(reduce(DataFrame.unionByName, each), f"{path}/{table}", run, now.buckets, "append" if k else "overwrite")
        spark.createDataFrame([(b,) for b in some], "bucket int").coalesce(1).write.mode("append").parquet(f"{path}/moved/run={run}")
        for table in ("postings", "counts"):
            for old in shared.names(spark, f"{path}/{table}"):
                if old != f"run={run}":
                    for b in some:
                        shared.remove(spark, f"{path}/{table}/{old}/bucket={b}")
    own = spark.createDataFrame([(d, x.docs, x.words) for d, x in now.days.items()], "day date, docs long, words long")
    _commit(own, path, run, now.buckets, now._schema)
