"""Running totals per key, including the current row, for keys of any size.

A window partitioned by the key would sort a hot key (say a third of all rows)
in one task, however its rows are spread over time.  Here the rows are split by
range on (key, order): a hot key, even one whose rows share a second or have no
stamp, takes as many parts as its rows fill.  Each part's totals by key are
few rows (keys plus parts); their running sums give what comes before a part.
They join their part as its first row, so the running sum inside the part
carries them along and no join of whole rows is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokentally.functions.pricing import cost_cents
from tokentally.sources.store import materialized

SUMS = ("input", "output", "cache_read", "cache_write")


def range_split(df: DataFrame, by: list[str]) -> DataFrame:
    """``df`` split by range of ``by`` (missing values first) and written once, with the number ``_part`` of a
    row's part: the same for everything that reads it, and after a lost executor."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialized(df.repartitionByRange(n, *by).withColumn("_part", F.spark_partition_id()), "range-split")


def sums_in_parts(rows: DataFrame, key: str, order: list[str], sums: tuple[str, ...], totals: bool = False,
                  split: DataFrame | None = None) -> DataFrame:
    """Running sums of rows of a split (with ``_part``), whose parts follow each other in the order of ``order``
    for every key; ``_part`` stays.  ``split``: the same rows as they were written, if ``rows`` has been
    worked on since.  See ``range_sums``."""
    columns, kind = rows.columns, dict(rows.dtypes)

    def z(c: str) -> Column:                # in the column's own type: a decimal stays one
        return F.coalesce(F.col(c), F.lit(0).cast(kind[c]))

    part_sums = (rows if split is None else split).groupBy("_part", key).agg(*[F.sum(z(c)).alias(f"_s_{c}") for c in sums])
    parts = Window.partitionBy(key).orderBy("_part")        # at most one row a part
    before = parts.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(key)
    heads = part_sums.select(
        "_part", key, F.lit(0).alias("_row"), *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_v_{c}") for c in sums],
        *([F.sum(f"_s_{c}").over(whole).alias(f"_t_{c}") for c in sums] if totals else []))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (rows.select("*", F.lit(1).alias("_row"), *[z(c).alias(f"_v_{c}") for c in sums])
             .unionByName(heads, allowMissingColumns=True).repartitionById(n, F.col("_part")))
    upto = (Window.partitionBy("_part", key).orderBy("_row", *order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    run = dealt.select(
        *columns, "_row", *[F.sum(f"_v_{c}").over(upto).alias(f"run_{c}") for c in sums],
        *([F.first(f"_t_{c}").over(upto).alias(f"all_{c}") for c in sums] if totals else []))
    return run.where("_row = 1").drop("_row")


def range_sums(df: DataFrame, key: str, order: list[str], sums: tuple[str, ...], totals: bool = False) -> DataFrame:
    """Adds ``run_<c>`` = sum of ``c`` over the key's rows up to and including this row in the given
    order (missing values first), and with ``totals`` also ``all_<c>``, the key's whole sum.

    A missing key is a key like any other.  Rows equal in key and order come in any order among
    themselves; only such rows cannot be split.  A task handles one part of the split.
    """
    return sums_in_parts(range_split(df, [key, *order]), key, order, sums, totals).drop("_part")


def running_totals(usage: DataFrame, key: str = "session", sums: tuple[str, ...] = SUMS) -> DataFrame:
    """Adds ``run_<c>`` = sum of ``c`` over the key's rows up to and including
    this row in (ts, id) order; rows without a stamp come first in their group."""
    out = range_sums(usage, key, ["ts", "id"], sums)
    return out.select(*usage.columns, *[F.col(f"run_{c}").cast("long").alias(f"run_{c}") for c in sums])


def session_running_cost(usage: DataFrame) -> DataFrame:
    """Per row: the session's running totals including the row, priced as a
    whole at the row's own model (blank -> default family)."""
    r = running_totals(usage.select("id", "ts", "session", "model", *SUMS))
    return r.select("id", "session", "ts", "model",
                    *[f"run_{c}" for c in SUMS],
                    cost_cents("model", "run_input", "run_output", "run_cache_read", "run_cache_write")
                    .alias("cost_cents"))
