"""Transcript sync as a file stream (T4).

New files start a micro-batch; what it imports are the files of all sessions
that the ledger does not hold, as in the batch sync (``UsageStore.sync_folder``).
So a session first seen without tokens is read again, whole, at a later batch,
and synced files are not opened.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tokentally.plans.sync import UsageStore
from tokentally.sources.schemas import LINES
from tokentally.sources.store import stream_id

BINARY = "path string, modificationTime timestamp, length long, content binary"


def transcript_stream(spark: SparkSession, path: str) -> DataFrame:
    """Names of new ``*.jsonl`` files under ``path``; their content is read by the sync."""
    return (spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "*.jsonl").load(path).select("path"))


def line_table_stream(spark: SparkSession, path: str) -> DataFrame:
    """Transcript lines already stored as a parquet table (session, pos,
    value), e.g. landed by another job; new files only."""
    return spark.readStream.schema(LINES).parquet(path)


def start_sync(lines: DataFrame, store: UsageStore, as_of: int, checkpoint: str, path: str | None = None,
               available_now: bool = True) -> StreamingQuery:
    """Run the sync: of a line table stream, or (``path``) of the folder whose new files ``lines`` reports."""
    spark = lines.sparkSession

    def apply(batch: DataFrame, batch_id: int) -> None:
        stream = stream_id(spark, checkpoint)
        if path is None:
            store.sync(batch, as_of, batch_id, stream)
        else:
            store.sync_folder(path, as_of, batch_id, stream)

    w = lines.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
