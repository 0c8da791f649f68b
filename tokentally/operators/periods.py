"""Rolling-period totals and costs (one scan, no fan-out).

The metered tool runs twelve scans for six periods (counts and costs).  Here
one pass groups rows by (model, band), where the band is the narrowest period
holding the row; the partial aggregate on each task is at most
periods x models rows whatever the data size, and periods are cumulated from
those few rows before pricing and truncation per (period, model).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokentally.constants import PERIODS
from tokentally.functions.pricing import blank, cost_cents, z
from tokentally.operators.pruning import since
from tokentally.sources.literal import literal_table


def _in_period(secs: int | None, as_of: int) -> Column:
    # lower bound only, inclusive; rows in the future count in every period
    return F.lit(True) if secs is None else F.col("ts") >= F.lit(as_of - secs)


def _band(as_of: int, periods) -> Column:
    """Index of the narrowest period that contains the row.  Periods are
    nested (each lower bound is older than the previous), so a row belongs
    to period k exactly when its band is <= k.  The unbounded period prices
    only rows with ts >= 0 (its cost query is 'since epoch 0') but counts
    every row; other rows get the extra band len(periods)."""
    order = sorted(range(len(periods)), key=lambda i: (periods[i][1] is None, periods[i][1] or 0))
    if order != list(range(len(periods))):
        raise ValueError("periods must be listed from the shortest to the unbounded one")
    expr = None
    for i, (_, secs) in enumerate(periods):
        cond = (F.col("ts") >= F.lit(0)) if secs is None else (F.col("ts") >= F.lit(as_of - secs))
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr.otherwise(F.lit(len(periods))).cast("int")


SUMS = ("input", "output", "cache_read", "cache_write")


def period_model_totals(usage: DataFrame, as_of: int, periods=PERIODS) -> DataFrame:
    """(period_ord, period, model, msgs, input, output, cache_read,
    cache_write, and c_<class>: the sums of the rows that are priced).

    One pass over ``usage`` grouped by (model, band): five running sums per
    row, and at most (len(periods)+1) x models groups whatever the data size.
    Period k is then the sum of bands <= k, computed on those few rows.
    A column ``msgs`` says how many facts a row stands for (else one each).
    """
    unbounded = periods[-1][1] is None
    if not unbounded:
        usage = since(usage, as_of - max(s for _, s in periods))
    weighed = ["msgs"] if "msgs" in usage.columns else []
    src = usage.select("ts", F.coalesce(F.col("model"), F.lit("")).alias("model"), *weighed, *SUMS)
    banded = src.groupBy("model", _band(as_of, periods).alias("band")).agg(
        (F.sum("msgs") if weighed else F.count("*")).alias("msgs"), *[F.sum(z(c)).alias(c) for c in SUMS])
    last = len(periods) - 1
    labels = F.array(*[F.lit(lbl) for lbl, _ in periods])
    # the extra band (not priced) belongs to the unbounded period only
    first = F.least(F.col("band"), F.lit(last))
    spread = banded.select("model", F.explode(F.sequence(first, F.lit(last))).alias("period_ord"),
                           (F.col("band") <= last).alias("priced"), "msgs", *SUMS)
    return (spread.groupBy("period_ord", "model")
                  .agg(F.sum("msgs").cast("long").alias("msgs"),
                       *[F.sum(c).cast("long").alias(c) for c in SUMS],
                       *[F.sum(F.when(F.col("priced"), F.col(c))).cast("long").alias(f"c_{c}") for c in SUMS])
                  .withColumn("period", F.element_at(labels, F.col("period_ord") + 1)))


def period_summary(usage: DataFrame, as_of: int, periods=PERIODS) -> DataFrame:
    """(period, msgs, input, output, cost_cents) for each rolling period.

    msgs and tokens count every row; cost is priced and truncated to cents
    per (period, model string) and then summed; blank models cost nothing.
    """
    pm = period_model_totals(usage, as_of, periods)
    priced = pm.withColumn(
        "cents", F.when(blank("model"), F.lit(0).cast("long"))
                  .otherwise(cost_cents("model", "c_input", "c_output", "c_cache_read", "c_cache_write")))
    per = priced.groupBy("period_ord", "period").agg(
        F.sum("msgs").cast("long").alias("msgs"),
        F.sum("input").cast("long").alias("input"),
        F.sum("output").cast("long").alias("output"),
        F.sum("cents").cast("long").alias("cost_cents"),
    )
    # every period is reported, also when empty
    spine = literal_table(usage.sparkSession, [(i, label) for i, (label, _) in enumerate(periods)],
                          T.StructType([T.StructField("period_ord", T.IntegerType()),
                                        T.StructField("period", T.StringType())]))
    out = spine.join(F.broadcast(per), ["period_ord", "period"], "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "period_ord", "period",
        F.coalesce("msgs", zero).alias("msgs"),
        F.coalesce("input", zero).alias("input"),
        F.coalesce("output", zero).alias("output"),
        F.coalesce("cost_cents", zero).alias("cost_cents"),
    )


def period_cost(usage: DataFrame, as_of: int, periods=PERIODS) -> DataFrame:
    """(period, cost_cents) only."""
    return period_summary(usage, as_of, periods).select("period_ord", "period", "cost_cents")


def period_summary_per_period_scans(usage: DataFrame, as_of: int, periods=PERIODS) -> DataFrame:
    """The unfused form (one filtered scan per period), kept for measuring
    the fused plan against; same result as ``period_summary``."""
    out = None
    for i, (label, secs) in enumerate(periods):
        sub = usage.filter(_in_period(secs, as_of))
        priced_row = F.col("ts") >= F.lit(0) if secs is None else F.lit(True)
        by_model = sub.groupBy(F.coalesce(F.col("model"), F.lit("")).alias("model")).agg(
            F.count("*").alias("msgs"), F.sum(z("input")).alias("input"), F.sum(z("output")).alias("output"),
            *[F.sum(F.when(priced_row, z(c))).alias(f"c_{c}") for c in SUMS])
        cents = F.when(blank("model"), F.lit(0).cast("long")).otherwise(
            cost_cents("model", "c_input", "c_output", "c_cache_read", "c_cache_write"))
        one = by_model.agg(
            F.coalesce(F.sum("msgs"), F.lit(0)).cast("long").alias("msgs"),
            F.coalesce(F.sum("input"), F.lit(0)).cast("long").alias("input"),
            F.coalesce(F.sum("output"), F.lit(0)).cast("long").alias("output"),
            F.coalesce(F.sum(cents), F.lit(0)).cast("long").alias("cost_cents"),
        ).select(F.lit(i).alias("period_ord"), F.lit(label).alias("period"), "*")
        out = one if out is None else out.unionByName(one)
    return out
