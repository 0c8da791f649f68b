"""Property checks on random facts: fused forms equal their plain forms."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from core_helpers import AS_OF, usage_df
from tokentally.operators.periods import period_summary, period_summary_per_period_scans
from tokentally.operators.running import running_totals

MODELS = ["m-opus-1", "m-haiku-1", "m-sonnet-1", "", "x-haiku-opus", "OPUS"]

row = st.tuples(
    st.integers(min_value=-40 * 86400, max_value=2 * 86400),   # offset from as_of (future allowed)
    st.sampled_from(["a", "b", "hot"]),
    st.integers(min_value=0, max_value=3_000_000),
    st.integers(min_value=0, max_value=200_000),
    st.one_of(st.none(), st.integers(min_value=0, max_value=900_000)),
    st.sampled_from(MODELS),
)
cfg = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def build(spark, rows):
    return usage_df(spark, [(i, AS_OF - d, s, inp, out, cr, cr, m) for i, (d, s, inp, out, cr, m) in enumerate(rows)])


@cfg
@given(st.lists(row, min_size=1, max_size=60))
def test_fused_periods_equal_plain_scans(spark, rows):
    u = build(spark, rows)
    cols = ["period", "msgs", "input", "output", "cost_cents"]
    a = sorted(map(tuple, period_summary(u, AS_OF).select(*cols).collect()))
    b = sorted(map(tuple, period_summary_per_period_scans(u, AS_OF).select(*cols).collect()))
    assert a == b


@cfg
@given(st.lists(row, min_size=1, max_size=60))
def test_running_totals_equal_plain_window(spark, rows):
    # few distinct seconds so that ties within a second are common
    u = build(spark, [(d // 4000 * 4000, *rest) for d, *rest in rows])
    got = {r["id"]: (r["run_input"], r["run_cache_read"]) for r in running_totals(u).collect()}
    w = Window.partitionBy("session").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = {r["id"]: (r["a"], r["b"]) for r in u.select(
        "id", F.sum("input").over(w).alias("a"),
        F.sum(F.coalesce("cache_read", F.lit(0))).over(w).alias("b")).collect()}
    assert got == want
