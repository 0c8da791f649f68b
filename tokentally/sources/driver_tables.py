"""Adapters from the driver's parquet tables to the usage domain.

``events`` becomes the usage fact table and ``conversations`` becomes the
lines of JSONL transcripts.  Both are plain projections (no shuffle), so they
scale with the tables and keep parquet column pruning and filter pushdown.
"""

from __future__ import annotations

import os
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentally.functions.gauges import context_pct
from tokentally.functions.timeparse import epoch_of_ntz, epoch_to_iso

# --- fixed values: fixture mapping of event types to model names ----------
EVENT_MODEL = (
    ("purchase", "m-opus-1"),
    ("click", "m-haiku-1"),
    ("view", "m-sonnet-1"),
    ("signup", "m-other-1"),
    ("error", ""),
)
# transcript fixture: conversations start at 2024-01-01T00:00:00Z, one hour
# apart, one minute per turn; assistant models cycle through three names and
# every tenth conversation reports a blank model
TRANSCRIPT_BASE = 1704067200
TRANSCRIPT_MODELS = ("m-opus-4", "m-sonnet-4", "m-haiku-3")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def event_model(event_type: Column) -> Column:
    expr = None
    for et, m in EVENT_MODEL:
        expr = F.when(event_type == et, F.lit(m)) if expr is None else expr.when(event_type == et, F.lit(m))
    return expr.otherwise(F.lit(""))


def usage_from_events(events: DataFrame) -> DataFrame:
    """events -> usage facts (tokens schema), one row per event."""
    inp = F.round(F.col("value") * 100).cast("long")
    out = F.get_json_object("props", "$.k").cast("long") * 37
    cr = (F.col("event_id") % 7) * 1000
    cw = (F.col("event_id") % 5) * 300
    return events.select(
        F.col("event_id").alias("id"),
        epoch_of_ntz("ts").alias("ts"),
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session"),
        inp.alias("input"),
        out.alias("output"),
        cr.cast("long").alias("cache_read"),
        cw.cast("long").alias("cache_write"),
        context_pct(inp, cw, cr, F.lit(200000)).alias("ctx_pct"),
        event_model(F.col("event_type")).alias("model"),
    )


def load_usage(spark: SparkSession, sf_dir: str, since: int | None = None) -> DataFrame:
    """The usage facts; ``since`` (epoch s) bounds the raw stamp column, so row groups before it are skipped."""
    events = table(spark, sf_dir, "events")
    if since is not None:
        stamp = datetime.fromtimestamp(since, timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
        events = events.where(F.col("ts") >= F.lit(stamp).cast("timestamp_ntz"))
    return usage_from_events(events)


def transcript_lines_from_conversations(conv: DataFrame) -> DataFrame:
    """conversations -> transcript lines (session, pos, value, line_ts).

    Each (conv_id, turn) is one JSON line of session ``c<conv_id>`` at file
    position ``turn``.  Assistant lines carry a model and four usage counts
    derived from the text length; user lines on even turns carry a summary;
    system lines carry a second-precision timestamp with a zone marker.
    ``to_json`` writes no spaces, as the key scan expects, and omits NULLs.
    ``line_ts`` (epoch seconds) says when the line was written.
    """
    L = F.length("text").cast("long")
    turn = F.col("turn").cast("long")
    is_asst = F.col("role") == "assistant"
    line_ts = F.lit(TRANSCRIPT_BASE) + F.col("conv_id") * 3600 + turn * 60
    pick = (F.col("conv_id") + turn) % 3
    model = (F.when(F.col("conv_id") % 10 == 9, F.lit(""))
              .when(pick == 0, F.lit(TRANSCRIPT_MODELS[0]))
              .when(pick == 1, F.lit(TRANSCRIPT_MODELS[1]))
              .otherwise(F.lit(TRANSCRIPT_MODELS[2])))
    usage = F.struct(
        (L * 3 + turn).alias("input_tokens"),
        L.alias("output_tokens"),
        F.when(turn >= 3, L * 40).alias("cache_read_input_tokens"),
        F.when(turn < 3, L * 5).otherwise(F.lit(0).cast("long")).alias("cache_creation_input_tokens"),
    )
    message = F.struct(
        F.col("role").alias("role"),
        F.when(is_asst, model).alias("model"),
        F.col("text").alias("content"),
        F.when(is_asst, usage).alias("usage"),
    )
    stamp = (F.when(F.col("role") == "system", epoch_to_iso(line_ts, millis=False))
              .otherwise(epoch_to_iso(line_ts, millis=True)))
    summary = F.when((F.col("role") == "user") & (turn % 2 == 0), F.col("text"))
    doc = F.struct(
        F.col("role").alias("type"),
        summary.alias("summary"),
        stamp.alias("timestamp"),
        message.alias("message"),
    )
    return conv.select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("session"),
        F.struct(F.lit(0).cast("long").alias("blk"), turn.alias("seq")).alias("pos"),
        F.to_json(doc).alias("value"),
        line_ts.cast("long").alias("line_ts"),
    )


def load_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript_lines_from_conversations(table(spark, sf_dir, "conversations"))
