"""Bounded arrival history (last 50 usage pairs) and its bar levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokentally.constants import BAR_LEVELS, HISTORY_KEEP, SPARK_WIDTH_MAX, SPARK_WIDTH_MIN
from tokentally.functions.gauges import bar_level


def recorded(usage: DataFrame) -> DataFrame:
    """Only responses with input or output tokens enter the history."""
    return usage.filter((F.col("input") > 0) | (F.col("output") > 0))


def history_last(usage: DataFrame, keep: int = HISTORY_KEEP, key: str | None = None) -> DataFrame:
    """Last ``keep`` (input, output) pairs by arrival (ts, id), numbered
    ``pos`` 0 = oldest.  Unkeyed: a top-k (each task keeps ``keep`` rows)
    followed by a window over those rows only.  Keyed: ``row_number <= keep``
    per key, which Spark plans with a partial window group limit before the
    shuffle, so a hot key ships at most ``keep`` rows per task."""
    src = recorded(usage).select(*(([key] if key else []) + ["ts", "id", "input", "output"]))
    if key is None:
        top = src.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(keep)
        w = Window.orderBy("ts", "id")
        return top.select((F.row_number().over(w) - 1).cast("long").alias("pos"), "ts", "id", "input", "output")
    rk = Window.partitionBy(key).orderBy(F.col("ts").desc(), F.col("id").desc())
    ranked = src.withColumn("rk", F.row_number().over(rk)).filter(F.col("rk") <= keep)
    n = F.count("*").over(Window.partitionBy(key))
    return ranked.select(key, (n - F.col("rk")).cast("long").alias("pos"), "ts", "id", "input", "output")


def sparkline_levels(history: DataFrame, width: int = 30, levels: int = BAR_LEVELS,
                     key: str | None = None) -> DataFrame:
    """Bar levels of the last ``width`` history entries, right-aligned: slot
    ``width-1`` is the newest, slots before the oldest entry are level 0.
    Input and output are scaled separately by the max over the whole retained
    history (at least 1).  ``width`` is clamped to 16..40.  With ``key`` (a
    keyed history) each key gets its own bars; every window partition holds
    at most ``keep`` rows of one key."""
    w = max(SPARK_WIDTH_MIN, min(SPARK_WIDTH_MAX, width))
    spark = history.sparkSession
    keys = [key] if key else []
    part = Window.partitionBy(*keys)
    n = F.count("*").over(part)
    max_in = F.greatest(F.lit(1).cast("long"), F.max("input").over(part))
    max_out = F.greatest(F.lit(1).cast("long"), F.max("output").over(part))
    placed = history.select(*keys, (F.col("pos") - n + F.lit(w)).alias("slot"),
                            bar_level("input", max_in, levels).alias("in_level"),
                            bar_level("output", max_out, levels).alias("out_level")).filter(F.col("slot") >= 0)
    zero = F.lit(0).cast("long")
    if not key:
        spine = spark.range(w).select(F.col("id").alias("slot"))
        joined = spine.join(F.broadcast(placed), "slot", "left")
    else:
        # one spine row per (key, slot): explode a w-slot sequence per key
        spine = (history.select(key).distinct()
                 .select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(w - 1).cast("long"))).alias("slot")))
        joined = spine.join(placed, [key, "slot"], "left")
    return joined.select(*keys, "slot", F.coalesce("in_level", zero).alias("in_level"),
                         F.coalesce("out_level", zero).alias("out_level"))
