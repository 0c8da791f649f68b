from pyspark.sql import functions as F

from core_helpers import AS_OF, usage_df
from tokentally.operators.periods import period_summary, period_summary_per_period_scans
from tokentally.operators.series import series_scaled, usage_series
from tokentally.operators.sessions import cost_by_family, session_rollup, top_sessions


def edge_usage(spark):
    return usage_df(spark, [
        (1, AS_OF - 3600, "a", 100, 10, None, None, "m-opus-1"),        # exactly on the 1h cutoff
        (2, AS_OF + 119, "a", 200, 20, 0, 0, "m-sonnet-1"),             # just in the future
        (3, AS_OF - 100, "b", 5000, 0, 0, 0, ""),                       # blank model
        (4, AS_OF - 200, "c", 3000, 0, 0, 0, "x-sonnet-a"),             # 0.9 cent
        (5, AS_OF - 300, "c", 3000, 0, 0, 0, "x-sonnet-b"),             # 0.9 cent, other string
        (6, AS_OF - 40 * 86400, "d", 10**6, 0, 0, 0, "m-haiku-1"),      # only in 'all'
    ])


def periods_of(df):
    return {r["period"]: r for r in df.collect()}


def test_period_edges(spark):
    p = periods_of(period_summary(edge_usage(spark), AS_OF))
    assert p["1h"]["msgs"] == 5          # cutoff row and future row both in
    assert p["1h"]["input"] == 100 + 200 + 5000 + 3000 + 3000
    assert p["all"]["msgs"] == 6
    # opus 100*1500 + 10*7500 = 225000 -> 0 cents; sonnet 200*300+20*1500 -> 0;
    # blank costs nothing; each sonnet string is truncated on its own -> 0
    assert p["1h"]["cost_cents"] == 0
    assert p["all"]["cost_cents"] == 80   # 1M haiku input
    assert p["30d"]["cost_cents"] == 0


def test_fused_equals_per_period(spark):
    u = edge_usage(spark)
    a = sorted(tuple(r) for r in period_summary(u, AS_OF).select("period", "msgs", "input", "output", "cost_cents").collect())
    b = sorted(tuple(r) for r in period_summary_per_period_scans(u, AS_OF).select("period", "msgs", "input", "output", "cost_cents").collect())
    assert a == b


def test_series_edges(spark):
    s = usage_series(edge_usage(spark), AS_OF)
    rows = {(r["range"], r["slot"]): r for r in s.collect()}
    assert len(rows) == 120
    # the future row is in the newest 1h slot; the cutoff row is in no 1h slot
    assert rows[("1h", 29)]["input"] == 200 + 5000  # future (bucket 0) and -100 s (bucket 0)
    total_1h = sum(r["input"] for (rg, _), r in rows.items() if rg == "1h")
    assert total_1h == 200 + 5000 + 3000 + 3000
    scaled = {(r["range"], r["slot"]): r for r in series_scaled(s).collect()}
    assert scaled[("1h", 29)]["max"] == 5220
    assert scaled[("1h", 29)]["dots_in"] == 16


def test_family_and_sessions(spark):
    u = edge_usage(spark)
    fam = {r["family"]: r for r in cost_by_family(u).collect()}
    assert fam["sonnet"]["cost_cents"] == 0      # truncated per model string
    assert fam["sonnet"]["input"] == 200 + 3000 + 3000   # blank model not in a family
    assert fam["haiku"]["cost_cents"] == 80
    assert fam["total"]["input"] == 100 + 200 + 5000 + 3000 + 3000 + 10**6   # blank model counted
    assert fam["total"]["cost_cents"] == 80
    top = top_sessions(u, 3).collect()
    assert [r["session"] for r in top] == ["a", "b", "c"]
    b = [r for r in top if r["session"] == "b"][0]
    assert b["cost_cents"] == 1                 # blank model priced as sonnet: 5000*300/1e6 = 1.5
    r = {x["session"]: x for x in session_rollup(u).collect()}
    assert r["a"]["model"] == "m-sonnet-1" and r["a"]["cache_read"] == 0


def test_all_time_cost_is_since_epoch(spark):
    u = usage_df(spark, [
        (1, AS_OF - 10, "a", 10**6, 0, 0, 0, "m-haiku-1"),
        (2, None, "a", 10**6, 0, 0, 0, "m-haiku-1"),    # no time: counted, not priced
    ])
    p = periods_of(period_summary(u, AS_OF))
    assert (p["all"]["msgs"], p["all"]["input"], p["all"]["cost_cents"]) == (2, 2 * 10**6, 80)
    assert (p["1h"]["msgs"], p["1h"]["cost_cents"]) == (1, 80)
    b = periods_of(period_summary_per_period_scans(u, AS_OF))
    assert (b["all"]["msgs"], b["all"]["cost_cents"]) == (2, 80)
    fam = {r["family"]: r for r in cost_by_family(u).collect()}
    assert fam["haiku"]["cost_cents"] == 160 and fam["total"]["cost_cents"] == 80


def test_series_composition_dense(spark):
    """Fine-bucket rollup == direct per-chart bucketing, over every edge."""
    from pyspark.sql import functions as F
    from tokentally.constants import CHARTS
    ds = set(range(-86400 - 5, 30 * 86400 + 6, 97))
    for _, w in CHARTS:
        for k in (-1, 0, 1, 29, 30, 31):
            for e in (-1, 0, 1):
                ds.add(k * w + e)
    rows = [(i, AS_OF - d, "s", 1 + (i % 5), i % 3, 0, 0, "m") for i, d in enumerate(sorted(ds))]
    u = usage_df(spark, rows)
    got = {(r["range"], r["slot"]): (r["input"], r["output"]) for r in usage_series(u, AS_OF).collect()}
    want = {}
    for label, w in CHARTS:
        b = (u.filter(F.col("ts") >= AS_OF - 30 * w)
              .select(((F.lit(AS_OF) - F.col("ts")).cast("long")).alias("d"), "input", "output")
              .select(F.expr(f"29 - (d div {w})").alias("slot"), "input", "output")
              .groupBy("slot").agg(F.sum("input").alias("i"), F.sum("output").alias("o")))
        for r in b.collect():
            if 0 <= r["slot"] <= 29:
                want[(label, r["slot"])] = (r["i"], r["o"])
    for key, val in got.items():
        assert val == want.get(key, (0, 0)), key


def test_chat_list_blank_model_priced_as_default(spark):
    from tokentally.operators.sessions import chat_list
    from tokentally.sources.schemas import CHATS
    c = spark.createDataFrame([("abcdefghij", "", "", 200000, 1, 5, 10**6, 0, 0, 0),
                               ("k", "t" * 31, "m-opus", 200000, 1, 9, 10**6, 0, 10, 20)], CHATS)
    rows = {r["session"]: r for r in chat_list(c, 100).collect()}
    assert rows["abcdefghij"]["cost_cents"] == 300 and rows["abcdefghij"]["family"] == "sonnet"
    assert rows["abcdefghij"]["title"] == "(untitled)"
    assert rows["k"]["title"] == "t" * 27 + "..." and rows["k"]["cache_total"] == 30
    assert [r["session"] for r in chat_list(c, 1).collect()] == ["k"]
