"""A mergeable summary of the facts, for period reports that read no old facts.

Sums by (day, model, 120-second bucket) and by (day, model) add up in any
order, so each batch of facts adds its own.  A report's time bounds fall into a
few days, and in these into a few buckets: whole days are taken from the day
sums, the other buckets of a bound's day from the bucket sums, and only the
bounds' own buckets from the facts.  What is read of buckets and facts does not
grow with the age of the store, and of the days it is one row a day and model.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokentally.constants import PERIODS
from tokentally.functions.pricing import z
from tokentally.operators.periods import period_summary
from tokentally.operators.pruning import dt_of

BUCKET_S, DAY_S = 120, 86400
SUMS = ("input", "output", "cache_read", "cache_write")
_TOTALS = [T.StructField(c, T.LongType()) for c in ("msgs", *SUMS)]
#: ``ts`` is the start of the bucket, of the day.
BUCKETS = T.StructType([T.StructField("ts", T.LongType()), T.StructField("model", T.StringType()), *_TOTALS,
                        T.StructField("dt", T.StringType())])
DAYS = BUCKETS
_KEYS = ("dt", "model", "ts")


def _start(width: int) -> Column:
    return F.col("ts") - F.pmod(F.col("ts"), F.lit(width))


def bucket_sums(facts: DataFrame) -> DataFrame:
    """Sums of facts by model and bucket; rows without a stamp have a bucket without one."""
    rows = facts.select(dt_of("ts").alias("dt"), F.coalesce("model", F.lit("")).alias("model"), _start(BUCKET_S).alias("ts"), *SUMS)
    return rows.groupBy(*_KEYS).agg(F.count("*").alias("msgs"), *[F.sum(z(c)).cast("long").alias(c) for c in SUMS])


def merge_sums(rows: DataFrame) -> DataFrame:
    """Any number of summary rows a key -> one."""
    return rows.groupBy(*_KEYS).agg(*[F.sum(c).cast("long").alias(c) for c in ("msgs", *SUMS)])


def day_sums(buckets: DataFrame) -> DataFrame:
    """Bucket sums -> day sums."""
    return merge_sums(buckets.withColumn("ts", _start(DAY_S)))


def report_rows(days: DataFrame, buckets: DataFrame, facts: DataFrame, bounds: list[int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a report with the given lower bounds reads: (whole days, buckets of the bounds' days, facts of the
    bounds' buckets).  Together they stand for every fact once; all rows of one lie on one side of each bound.

    ``facts`` and ``buckets`` are pruned by ``dt``."""
    split = sorted({datetime.datetime.fromtimestamp(b, datetime.timezone.utc).strftime("%Y-%m-%d") for b in bounds if b % DAY_S})
    edges = sorted({b - b % BUCKET_S for b in bounds if b % BUCKET_S})
    in_split = F.col("dt").isin(split) if split else F.lit(False)
    whole = days.where(F.col("dt").isNull() | ~in_split)
    inner = buckets.where(in_split & ~(F.col("ts").isin(edges) if edges else F.lit(False)))
    near = F.lit(False)
    for e in edges:
        near = near | F.col("ts").between(e, e + BUCKET_S - 1)
    columns = ["ts", "model", "msgs", *SUMS]
    rows = facts.where(in_split & near).select(
        "ts", F.coalesce("model", F.lit("")).alias("model"), F.lit(1).cast("long").alias("msgs"), *[z(c).alias(c) for c in SUMS])
    return whole.select(*columns), inner.select(*columns), rows


def period_summary_from(days: DataFrame, buckets: DataFrame, facts: DataFrame, as_of: int, periods=PERIODS) -> DataFrame:
    """``period_summary`` from the summary, with the facts of at most one bucket a period."""
    bounds = [as_of - secs for _, secs in periods if secs is not None]
    whole, inner, rows = report_rows(days, buckets, facts, bounds)
    return period_summary(whole.unionByName(inner).unionByName(rows), as_of, periods)
