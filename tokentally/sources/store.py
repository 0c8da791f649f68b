"""Versioned snapshot tables on a shared file system.

Parquet tables cannot MERGE, and a path being read must never be
overwritten.  Each write goes to a new version folder; a small JSON log
names the versions, written and read through Spark's file systems, so the table
works on any that Spark can write (HDFS, object stores, local).  A version is logged
only after its data write committed; a lost task or executor leaves at most
an unreferenced folder.  Writing a version also cuts the lineage of the
incremental jobs (no localCheckpoint anywhere).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokentally.session import scratch_dir
from tokentally.sources.literal import empty_table

#: File sets of which a version of a table that is appended to consists at most.
MOST_SETS = 64

LOG_SCHEMA = T.StructType([
    T.StructField("version", T.LongType()),
    T.StructField("paths", T.ArrayType(T.StringType())),
    T.StructField("batch_id", T.LongType()),
    T.StructField("stream", T.StringType()),
])


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """While it lasts, a listing of many paths takes some tasks a core, each with its share of the paths, and not a
    task a path.  The session's own lower setting stays."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    own = spark.conf.get(key)
    spark.conf.set(key, str(min(int(own), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(key, own)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on any file system that Spark reads; other errors rise."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return fs.exists(hadoop_path)


def write_line(spark: SparkSession, path: str, line: str) -> None:
    """A small file of one line, on any file system that Spark writes, without a job.  Until it is whole it has a
    hidden name, which Spark does not list."""
    whole = spark._jvm.org.apache.hadoop.fs.Path(path)
    hidden = spark._jvm.org.apache.hadoop.fs.Path(whole.getParent(), f".{whole.getName()}")
    fs = whole.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    out = fs.create(hidden)
    try:
        out.write(bytearray(f"{line}\n".encode()))
    finally:
        out.close()
    if not fs.rename(hidden, whole):
        raise OSError(f"{path} could not be written")


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave the query of a checkpoint folder: a new checkpoint is a new stream,
    whose batch numbers start again and must not be taken for those of an earlier one."""
    return spark.read.text(f"{checkpoint}/metadata").select(F.get_json_object("value", "$.id")).first()[0]


def materialized(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once below the shared checkpoint folder and read back."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class SnapshotTable:
    """A table stored as immutable versions ``v-<n>-<id>`` under ``root``."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType,
                 partition_by: list[str] | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.schema = schema
        self.partition_by = partition_by or []
        self._cur: dict | None = None
        self._known = False
        self._batches: dict[str, int] = {}

    @property
    def _log(self) -> str:
        return f"{self.root}/_log"

    def current(self, refresh: bool = False) -> dict | None:
        """Latest logged version.  One writer per table is assumed (the
        stream's driver or the sync job), so the pointer is cached after the
        first read and updated by ``write``."""
        if self._known and not refresh:
            return self._cur
        self._cur, self._batches = None, {}
        if path_exists(self.spark, self._log):
            log = self.spark.read.schema(LOG_SCHEMA).json(self._log)
            top = log.orderBy(F.col("version").desc()).limit(1).collect()
            self._cur = top[0].asDict() if top else None
            # one row a stream that ever wrote to the table
            self._batches = {r["stream"]: r["b"] for r in log.where("batch_id is not null").groupBy(
                F.coalesce("stream", F.lit("")).alias("stream")).agg(F.max("batch_id").alias("b")).collect()}
        self._known = True
        return self._cur

    def read(self) -> DataFrame:
        """Current version, or an empty table of the schema when none."""
        cur = self.current()
        if cur is None:
            return empty_table(self.spark, self.schema)
        with few_listing_tasks(self.spark):
            return self.spark.read.schema(self.schema).parquet(*cur["paths"])

    def write(self, df: DataFrame, batch_id: int | None = None, stream: str = "") -> DataFrame:
        """Write ``df`` as the next version (replacing the table), log it."""
        self._commit(df, batch_id, [], stream)
        return self.read()

    def append(self, df: DataFrame, batch_id: int | None = None, stream: str = "") -> DataFrame:
        """Next version = current files + ``df``'s new files; nothing is rewritten, but every ``MOST_SETS`` versions
        the file sets are written as one, so that no version lists more than that."""
        self.extend(df, batch_id, stream)
        return self.read()

    def extend(self, df: DataFrame, batch_id: int | None = None, stream: str = "") -> None:
        """``append`` without the listing of the new version."""
        cur = self.current()
        if cur is not None and len(cur["paths"]) >= MOST_SETS:
            self._commit(self.read().unionByName(df.select([f.name for f in self.schema.fields])), batch_id, [], stream)
        else:
            self._commit(df, batch_id, [] if cur is None else list(cur["paths"]), stream)

    def compact(self) -> DataFrame:
        """Maintenance: rewrite the current file sets as one."""
        self._commit(self.read(), None, [])
        return self.read()

    def _commit(self, df: DataFrame, batch_id: int | None, keep: list[str], stream: str = "") -> None:
        cur = self.current()
        n = 0 if cur is None else cur["version"] + 1
        path = f"{self.root}/v-{n:06d}-{uuid.uuid4().hex[:8]}"
        w = df.select([f.name for f in self.schema.fields]).write.mode("errorifexists")
        if self.partition_by:
            w = w.partitionBy(*self.partition_by)
        w.parquet(path)
        paths = keep + [path]
        entry = {"version": n, "paths": paths, "batch_id": batch_id, "stream": stream}
        write_line(self.spark, f"{self._log}/{n:06d}-{uuid.uuid4().hex[:8]}.json", json.dumps(entry))
        self._cur, self._known = entry, True
        if batch_id is not None:
            self._batches[stream] = max(batch_id, self._batches.get(stream, batch_id))

    def applied(self, batch_id: int, stream: str = "") -> bool:
        """True when a version already holds the effect of ``batch_id`` of ``stream``."""
        self.current()
        return self._batches.get(stream, -1) >= batch_id
