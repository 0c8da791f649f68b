from pyspark.sql import functions as F
from pyspark.sql.window import Window

from core_helpers import AS_OF, usage_df
from tokentally.operators.history import history_last, sparkline_levels
from tokentally.operators.running import running_totals
from tokentally.plans.live import live_rows
from tokentally.sources.live import decode_events


def test_decode_defaults(spark):
    raw = spark.createDataFrame([
        (1, AS_OF, '{"model":{"display_name":"Opus","id":"m-opus"},"context_window":{"context_window_size":1000,'
                   '"current_usage":{"input_tokens":100,"output_tokens":5,"cache_read_input_tokens":300,'
                   '"cache_creation_input_tokens":150}}}'),
        (2, AS_OF, '{"context_window":{"current_usage":null}}'),
        (3, AS_OF, '{"context_window":{"current_usage":{"cache_read_input_tokens":9}}}'),
        (4, AS_OF, 'not json'),
    ], "id long, ts long, value string")
    d = {r["id"]: r for r in decode_events(raw).collect()}
    assert d[1]["ctx_pct"] == 55 and d[1]["model"] == "m-opus" and d[1]["display_name"] == "Opus"
    assert (d[2]["display_name"], d[2]["model"], d[2]["ctx_size"], d[2]["input"]) == ("?", "", 200000, 0)
    assert d[3]["cache_read"] == 9 and d[3]["input"] == 0
    assert d[4]["ctx_size"] == 200000 and d[4]["output"] == 0
    rows = {r["id"]: r for r in live_rows(decode_events(raw)).collect()}
    assert set(rows) == {1}                          # cache-only and empty events are not recorded
    assert rows[1]["session"] == "20240131"
    assert live_rows(decode_events(raw), record=False).count() == 0


def test_history_ring(spark):
    u = usage_df(spark, [(i, 1000 + i, "s", i, 2 * i, 0, 0, "m") for i in range(1, 61)]
                 + [(100, 5000, "s", 0, 0, 9, 9, "m")])                 # cache-only: not in history
    h = history_last(u, 50)
    rows = sorted(h.collect(), key=lambda r: r["pos"])
    assert len(rows) == 50 and rows[0]["input"] == 11 and rows[-1]["input"] == 60
    lv = {r["slot"]: r for r in sparkline_levels(h, 30).collect()}
    assert lv[29]["in_level"] == 7 and lv[0]["in_level"] == 31 * 7 // 60
    short = sparkline_levels(history_last(u.filter(F.col("id") <= 10), 50), 30)
    lv2 = {r["slot"]: r for r in short.collect()}
    assert all(lv2[i]["in_level"] == 0 for i in range(20))              # left padding
    assert lv2[29]["in_level"] == 7


def test_history_keyed(spark):
    u = usage_df(spark, [(i, i, "hot" if i % 3 else "cold", 1, 1, 0, 0, "m") for i in range(1, 400)])
    h = history_last(u, 50, key="session")
    counts = {r["session"]: r["c"] for r in h.groupBy("session").agg(F.count("*").alias("c")).collect()}
    assert counts == {"hot": 50, "cold": 50}
    newest = h.filter((F.col("session") == "hot") & (F.col("pos") == 49)).first()
    assert newest["id"] == 398
    lv = sparkline_levels(h, 30, key="session")
    assert lv.count() == 60 and lv.filter(F.col("in_level") != 7).count() == 0


def test_running_totals_match_plain_window(spark):
    rows = []
    i = 0
    for t in range(0, 3 * 3600, 7):          # hot session over three hours, ties at the same second
        for k in range(2):
            i += 1
            rows.append((i, 1706000000 + t, "hot", k + 1, 1, 0, i % 3, "m"))
    for t in range(0, 5000, 500):
        i += 1
        rows.append((i, 1706000000 + t, "cold", 5, 5, 5, 5, "m"))
    u = usage_df(spark, rows)
    got = {r["id"]: (r["run_input"], r["run_cache_write"]) for r in running_totals(u).collect()}
    w = Window.partitionBy("session").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = {r["id"]: (r["a"], r["b"]) for r in
            u.select("id", F.sum("input").over(w).alias("a"), F.sum("cache_write").over(w).alias("b")).collect()}
    assert got == want


def test_status_counts_earlier_events_of_the_batch(spark):
    from tokentally.plans.live import live_status
    stored = usage_df(spark, [(1, 10, "a", 100, 10, 0, 0, "m-opus-1")])
    events = usage_df(spark, [(2, 20, "a", 5, 1, 0, 0, "m-opus-1"), (3, 21, "a", 0, 0, 9, 9, "m-opus-1"),
                              (4, 22, "a", 7, 2, 0, 0, "m-opus-1"), (5, 22, "b", 1, 1, 0, 0, "")])
    r = {x["id"]: x for x in live_status(stored, events, 30).collect()}
    assert [r[i]["session_input"] for i in (2, 3, 4, 5)] == [105, 105, 112, 1]
    assert [r[i]["session_cache_read"] for i in (2, 3, 4)] == [0, 9, 0]      # cache-only events are not stored
    assert r[2]["in_bar"] == "0" * 28 + "70" and r[3]["in_bar"] == r[2]["in_bar"]
    assert r[5]["in_bar"] == "0" * 26 + "7000" and r[5]["out_bar"] == "0" * 26 + "7010"


def test_running_totals_keep_rows_without_key_or_stamp(spark):
    u = usage_df(spark, [(1, 10, "a", 1, 0, 0, 0, "m"), (2, None, "a", 2, 0, 0, 0, "m"), (3, 10, None, 4, 0, 0, 0, "m"),
                         (4, 11, None, 8, 0, 0, 0, "m")])
    assert {r["id"]: r["run_input"] for r in running_totals(u).collect()} == {1: 3, 2: 2, 3: 4, 4: 12}


def test_costs_and_counts_beyond_long(spark):
    from tokentally.functions.pricing import cost_cents
    from tokentally.operators.extract import rejected_counts, transcript_sessions
    big = spark.createDataFrame([(10 ** 16,)], "n long").select(cost_cents(F.lit("m-opus-1"), "n", "n", "n", "n").alias("c"))
    assert big.first()["c"] == 10 ** 16 * (1500 + 7500 + 150 + 1875) // 10 ** 6
    lines = spark.createDataFrame([("s", (0, 0), '{"input_tokens":12345678901234567890,"output_tokens":5}'),
                                   ("s", (0, 1), '{"input_tokens":3}')],
                                  "session string, pos struct<blk:bigint,seq:bigint>, value string")
    row = transcript_sessions(lines, AS_OF).first()
    assert (row["input"], row["output"]) == (3, 5)
    assert [tuple(r) for r in rejected_counts(lines).collect()] == [("s", 1)]
