"""Live usage ingest as Structured Streaming (T1 ingest, T2 totals, T3 ring).

Source: JSON lines, one live usage event per line, with the arrival stamp
``ts`` (epoch s) and an ``id`` added by the collector.  Every micro-batch is
applied through ``foreachBatch`` with the batch functions of the library, and
each effect is idempotent per (stream, ``batch_id``), so a replayed batch
(after a lost executor or driver restart) changes nothing, and a second stream
(a new checkpoint) into the same sink adds to what is there.  Files that a new
checkpoint reads again are new events to the sink:

* facts   append-only table; batch <n> of a stream owns folder ``stream=<id>/batch_id=<n>`` (overwritten on replay)
* rollup  runs of per-session deltas (additive policy, ``streaming.rollup``), skipped when already applied
* ring    versioned snapshot of the last 50 pairs, skipped when applied
* summary (``summary=True``) sums by day, model and bucket, for period reports that read few facts
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tokentally.constants import HISTORY_KEEP
from tokentally.operators.history import history_last, recorded
from tokentally.operators.joins import anti_join
from tokentally.operators.pruning import dt_of
from tokentally.operators.merge import keyed_delta
from tokentally.plans.live import live_rows
from tokentally.sources.live import decode_records
from tokentally.sources.schemas import CHATS, LIVE_EVENT, TOKENS
from tokentally.sources.store import SnapshotTable, path_exists, stream_id
from tokentally.streaming.rollup import RingRuns, RollupRuns, UsageSummary

ENVELOPE = T.StructType([T.StructField("id", T.LongType()), T.StructField("ts", T.LongType())]
                        + list(LIVE_EVENT.fields))

_KEY = T.StructType([T.StructField("ts", T.LongType()), T.StructField("id", T.LongType())])
LIVE_CHATS = T.StructType(list(CHATS.fields) + [T.StructField(k, _KEY) for k in
                                                ("k_first", "k_last", "k_model", "k_ctx")])

RING = T.StructType([
    T.StructField("pos", T.LongType()), T.StructField("ts", T.LongType()), T.StructField("id", T.LongType()),
    T.StructField("input", T.LongType()), T.StructField("output", T.LongType()),
])


def rows_session(session: str | None):
    from tokentally.plans.live import live_session_key
    return F.lit(session) if session else live_session_key()


def live_source(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Streaming JSON file source of enveloped live events, decoded with the
    recorder's defaults.  A missing arrival stamp is the processing time."""
    r = spark.readStream.schema(ENVELOPE)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    parsed = r.json(path)
    parsed = parsed.withColumn("ts", F.coalesce("ts", F.unix_seconds(F.current_timestamp())))
    return decode_records(parsed)


@dataclass
class LiveSink:
    """Fact table, rollup and ring under ``root`` (a shared folder)."""
    spark: SparkSession
    root: str
    session: str | None = None
    record: bool = True
    summary: bool = False

    def __post_init__(self):
        self.facts_path = f"{self.root}/tokens_live"
        self.chats = RollupRuns(self.spark, f"{self.root}/chats", LIVE_CHATS)
        self.ring = SnapshotTable(self.spark, f"{self.root}/history", RING)
        self.sums = UsageSummary(self.spark, f"{self.root}/summary")

    def rollup(self) -> DataFrame:
        """The live per-session rollup in the chats schema."""
        return self.chats.rollup()

    def facts(self) -> DataFrame:
        schema = T.StructType(list(TOKENS.fields) + [T.StructField("dt", T.StringType())])
        if not path_exists(self.spark, self.facts_path):    # no batch written yet
            from tokentally.sources.literal import empty_table
            return empty_table(self.spark, schema)
        full = T.StructType(list(schema.fields) + [T.StructField("stream", T.StringType()),
                                                   T.StructField("batch_id", T.LongType())])
        return self.spark.read.schema(full).parquet(self.facts_path).select(*[f.name for f in schema.fields])

    def apply(self, batch: DataFrame, batch_id: int, stream: str = "0") -> None:
        # the decoded batch feeds three writes: parse the JSON once
        batch = batch.persist()
        try:
            rows = live_rows(batch, self.session, self.record).withColumn("dt", dt_of("ts"))
            # each batch of a stream owns its folder (dt partitions inside):
            # a replay overwrites exactly that folder, nothing else is touched
            (rows.write.mode("overwrite").partitionBy("dt")
                 .parquet(f"{self.facts_path}/stream={stream}/batch_id={batch_id}"))
            if self.record:
                # order-independent additive merge: batches may arrive out of
                # event-time order (files landed together, replays)
                delta = keyed_delta(batch.filter((F.col("input") > 0) | (F.col("output") > 0))
                                    .withColumn("session", rows_session(self.session)))
                self.chats.add(delta, batch_id, stream)
                if self.summary:
                    self.sums.add(rows, batch_id, stream)
            if not self.ring.applied(batch_id, stream):
                old = self.ring.read().select("ts", "id", "input", "output")
                # the ring follows every response with tokens, recorded or not
                new = recorded(batch).select("ts", "id", "input", "output")
                self.ring.write(history_last(old.unionByName(new), HISTORY_KEEP), batch_id, stream)
        finally:
            batch.unpersist()


def start_live_ingest(source: DataFrame, sink: LiveSink, checkpoint: str,
                      available_now: bool = True) -> StreamingQuery:
    """Run the ingest; ``available_now`` drains what is there and stops."""
    def apply(batch: DataFrame, batch_id: int) -> None:
        sink.apply(batch, batch_id, stream_id(sink.spark, checkpoint))

    w = source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 second")
    return w.start()


def start_session_rings(source: DataFrame, root: str, checkpoint: str, session: str | None = None,
                        available_now: bool = True) -> StreamingQuery:
    """The last 50 responses of each session (S13 per key) as a stream without state: a batch adds its own rings
    as a run, and rings of one session merge in any order.  ``query.table.rings()`` reads them."""
    schema = T.StructType([T.StructField("session", T.StringType())] + [f for f in RING.fields if f.name != "pos"])
    table = RingRuns(source.sparkSession, f"{root}/session_rings", schema)

    def apply(batch: DataFrame, batch_id: int) -> None:
        rows = recorded(batch).withColumn("session", rows_session(session))
        table.add(table.merge(rows), batch_id, stream_id(source.sparkSession, checkpoint))

    w = source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 second")
    q = w.start()
    q.table = table  # type: ignore[attr-defined]
    return q


def start_session_totals(source: DataFrame, root: str, checkpoint: str, session: str | None = None,
                         available_now: bool = True) -> StreamingQuery:
    """Stateful running totals per session (state store, update mode); each
    batch's changed sessions replace their rows in a versioned snapshot."""
    from tokentally.plans.live import live_rows as rows_of
    totals_schema = T.StructType([T.StructField("session", T.StringType())] + [
        T.StructField(c, T.LongType()) for c in ("msgs", "input", "output", "cache_read", "cache_write")])
    table = SnapshotTable(source.sparkSession, f"{root}/session_totals", totals_schema)
    agg = rows_of(source, session).groupBy("session").agg(
        F.count("*").alias("msgs"),
        *[F.sum(c).cast("long").alias(c) for c in ("input", "output", "cache_read", "cache_write")])

    def upsert(changed: DataFrame, batch_id: int) -> None:
        stream = stream_id(source.sparkSession, checkpoint)
        if table.applied(batch_id, stream):
            return
        kept = anti_join(table.read(), changed, "session")
        table.write(kept.unionByName(changed.select(*[f.name for f in totals_schema.fields])), batch_id, stream)

    w = (agg.writeStream.outputMode("update").foreachBatch(upsert)
            .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 second")
    q = w.start()
    q.table = table  # type: ignore[attr-defined]
    return q
