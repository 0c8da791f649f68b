"""Zero-filled time-bucket series for the four dashboard charts.

bucket = (as_of - ts) div width (truncation toward zero), slot = 29 - bucket,
kept when 0 <= slot <= 29.  A row exactly at the chart's cutoff lands in
bucket 30 and is dropped; rows less than one width in the future fall in
bucket 0.  Since every chart spans exactly 30 widths, the chart's own
``ts >= as_of - 30*width`` bound is implied by the slot range.

Plan: one scan, pre-aggregated on the finest bucket (``(as_of-ts) div g``,
g = gcd of the widths); every other width is a multiple of g and nested
truncating division composes, so each chart is re-bucketed from that small
table.  The scan's partial aggregate holds at most ~22k rows whatever the
data size; the 4-way fan-out touches only those rows, never the facts.
"""

from __future__ import annotations

from functools import reduce
from math import gcd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokentally.constants import CHART_SLOTS, CHARTS, DOT_LEVELS
from tokentally.functions.gauges import dot_height
from tokentally.functions.pricing import idiv, z
from tokentally.operators.pruning import since


def usage_series(usage: DataFrame, as_of: int, charts=CHARTS, n: int = CHART_SLOTS) -> DataFrame:
    """(chart_ord, range, slot, input, output) with every slot present."""
    spark = usage.sparkSession
    g = reduce(gcd, [w for _, w in charts])
    widest = max(w for _, w in charts)
    d = F.lit(as_of).cast("long") - F.col("ts")
    # rows that can reach slot 0..n-1 of some chart: -widest < d < n*widest
    fine = (since(usage, as_of - n * widest + 1).select("ts", "input", "output")
                 .filter(F.col("ts") < F.lit(as_of + widest))
                 .groupBy(idiv(d, g).alias("fb"))
                 .agg(F.sum(z("input")).alias("input"), F.sum(z("output")).alias("output")))
    # one row per (fine bucket, chart): the fan-out runs on the small table
    per_chart = F.explode(F.array(*[
        F.struct(F.lit(i).alias("chart_ord"), (F.lit(n - 1) - idiv(F.col("fb"), w // g)).alias("slot"))
        for i, (_, w) in enumerate(charts)]))
    grouped = (fine.select(per_chart.alias("c"), "input", "output")
                   .select("c.chart_ord", "c.slot", "input", "output")
                   .filter(F.col("slot").between(0, n - 1))
                   .groupBy("chart_ord", "slot")
                   .agg(F.sum("input").cast("long").alias("input"), F.sum("output").cast("long").alias("output")))
    # spine of len(charts) x n slots built from one range, no cross join
    labels = F.element_at(F.array(*[F.lit(lbl) for lbl, _ in charts]), (idiv("id", n) + 1).cast("int"))
    spine = spark.range(len(charts) * n).select(
        idiv("id", n).cast("int").alias("chart_ord"),
        labels.alias("range"),
        (F.col("id") % n).cast("long").alias("slot"))
    zero = F.lit(0).cast("long")
    return (spine.join(F.broadcast(grouped), ["chart_ord", "slot"], "left")
                 .select("chart_ord", "range", "slot",
                         F.coalesce("input", zero).alias("input"),
                         F.coalesce("output", zero).alias("output")))


def series_scaled(series: DataFrame, levels: int = DOT_LEVELS) -> DataFrame:
    """Adds the chart scale (max of input+output per chart, at least 1) and
    dot heights of input and output (ceil(v*16/max), clamp 16)."""
    w = Window.partitionBy("chart_ord")
    mx = F.greatest(F.lit(1).cast("long"), F.max(F.col("input") + F.col("output")).over(w))
    return (series.withColumn("max", mx)
                  .withColumn("dots_in", dot_height("input", "max", levels))
                  .withColumn("dots_out", dot_height("output", "max", levels)))
