"""Running totals by range split: exact for every order and key, and no task holds a hot key."""

from statistics import median

from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tokentally.operators.running import range_sums, running_totals
from core_helpers import usage_df

cfg = settings(max_examples=6, deadline=None, phases=[Phase.generate], suppress_health_check=[HealthCheck.function_scoped_fixture])
row = st.tuples(st.sampled_from([None, "", "a", "hot"]), st.one_of(st.none(), st.integers(0, 3)), st.integers(-5, 50))


@cfg
@given(st.lists(row, max_size=60))
def test_equal_to_a_plain_loop(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, k string, t long, v long")
    got = {r["id"]: (r["run_v"], r["all_v"]) for r in range_sums(df, "k", ["t", "id"], ("v",), totals=True).collect()}
    want, running, total = {}, {}, {}
    for _, k, _, v in [(0, *r) for r in rows]:
        total[k] = total.get(k, 0) + v
    for i, (k, t, v) in sorted(enumerate(rows), key=lambda r: (r[1][1] is not None, r[1][1] or 0, r[0])):
        running[k] = running.get(k, 0) + v
        want[i] = (running[k], total[k])
    assert got == want


def _tasks(spark, ts):
    """Rows a task of the last stage handles when two thirds of the rows are one session's, at the given stamps."""
    n = 60_000
    u = spark.range(n).select(
        "id", ts.cast("long").alias("ts"), F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("s"), F.col("id"))).alias("session"),
        *[F.lit(1).cast("long").alias(c) for c in ("input", "output", "cache_read", "cache_write")])
    out = running_totals(u).withColumn("task", F.spark_partition_id())
    hot = out.where("session = 'hot'").agg(F.max("run_input")).first()[0]
    assert hot == n * 2 // 3
    return [r["count"] for r in out.groupBy("task").count().collect()]


def test_one_hot_second_is_dealt_evenly(spark):
    rows = _tasks(spark, F.lit(7))
    assert len(rows) == 8 and max(rows) <= 2 * median(rows)


def test_rows_without_stamp_are_dealt_evenly(spark):
    rows = _tasks(spark, F.when(F.col("id") % 2 == 0, F.col("id")))
    assert len(rows) == 8 and max(rows) <= 2 * median(rows)


def test_no_row_shuffle_beyond_the_split(spark):
    u = usage_df(spark, [(1, 1, "a", 1, 1, 0, 0, "m")])
    plan = running_totals(u)._jdf.queryExecution().executedPlan().toString()
    # totals of the parts: by (part, key) and by key; the rows: dealt by part once, and no join at all
    assert plan.count("Exchange") == 3 and "shufflepartitionidpassthrough" in plan and "Join" not in plan
