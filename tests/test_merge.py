from pyspark.sql import functions as F

from core_helpers import AS_OF, usage_df
from tokentally.operators.merge import (evolve_schema, replace_sessions, rollup_for_chats, upsert_additive,
                                        upsert_import, upsert_monotone)
from tokentally.plans.sync import UsageStore
from tokentally.session import scratch_dir
from tokentally.sources.literal import empty_table
from tokentally.sources.schemas import CHATS, TOKENS


def chats(spark, rows):
    return spark.createDataFrame(rows, CHATS)


def by_session(df):
    return {r["session"]: r.asDict() for r in df.collect()}


def test_upsert_import_policy(spark):
    old = chats(spark, [("s", "t", "m-opus", 1000, 10, 20, 10, 10, 10, 10), ("k", "keep", "m", 5, 1, 2, 3, 4, 5, 6)])
    new = chats(spark, [("s", "", "", 200000, 5, 15, 7, 7, 7, 7), ("n", "fresh", "m2", 200000, 1, 1, 1, 1, 1, 1)])
    r = by_session(upsert_import(old, new))
    assert r["s"]["title"] == "t" and r["s"]["model"] == "m-opus"      # blank keeps old
    assert (r["s"]["first_ts"], r["s"]["last_ts"]) == (5, 20)
    assert r["s"]["total_input"] == 7 and r["s"]["ctx_size"] == 1000    # totals overwritten, ctx kept
    assert r["k"]["title"] == "keep" and r["n"]["title"] == "fresh"
    again = by_session(upsert_import(upsert_import(old, new), new))
    assert again == r                                                    # importing twice = once


def test_upsert_monotone_policy(spark):
    old = chats(spark, [("s", "t", "", 1000, 10, 20, 10, 10, 10, 10)])
    new = chats(spark, [("s", "", "m-new", 200000, 5, 15, 7, 70, 7, 7)])
    r = by_session(upsert_monotone(old, new))["s"]
    assert r["model"] == "m-new" and r["title"] == "t"
    assert (r["first_ts"], r["last_ts"], r["total_input"], r["total_output"]) == (5, 20, 10, 70)
    assert by_session(upsert_monotone(upsert_monotone(old, new), new))["s"] == r


def test_upsert_additive_policy_and_batches(spark):
    old = chats(spark, [("s", "t", "m-old", 1000, 1, 2, 10, 10, 10, 10)])
    ev = usage_df(spark, [(1, 50, "s", 7, 1, 0, 0, ""), (2, 60, "s", 0, 1, 0, 0, "m-x"), (3, 70, "n", 1, 1, 0, 0, "")])
    r = by_session(upsert_additive(old, ev))
    assert r["s"]["total_input"] == 17 and r["s"]["last_ts"] == 60
    assert r["s"]["model"] == "m-x" and r["s"]["first_ts"] == 1 and r["s"]["title"] == "t"
    assert r["n"]["model"] == "" and r["n"]["first_ts"] == 70 and r["n"]["ctx_size"] == 200000
    # additive over two batches = additive over their union
    b1, b2 = ev.filter(F.col("id") == 1), ev.filter(F.col("id") != 1)
    assert by_session(upsert_additive(upsert_additive(old, b1), b2)) == r


def test_replace_sessions(spark):
    t = usage_df(spark, [(1, 1, "a", 1, 1, 0, 0, "m"), (2, 2, "a", 1, 1, 0, 0, "m"), (3, 3, "b", 1, 1, 0, 0, "m")])
    new = usage_df(spark, [(None, 9, "a", 5, 5, 0, 0, "m")])
    out = replace_sessions(t, new)
    assert sorted((r["session"], r["ts"]) for r in out.collect()) == [("a", 9), ("b", 3)]
    assert sorted(map(tuple, replace_sessions(out, new).collect())) == sorted(map(tuple, out.collect()))


def test_schema_evolve(spark):
    old = chats(spark, [("a", "", "m", 1, 1, 1, 1, 1, 5, 5)]).drop("cache_read", "cache_write")
    new = chats(spark, [("b", "", "m", 1, 1, 1, 1, 1, 5, None)])
    r = by_session(evolve_schema(old, new))
    assert (r["a"]["cache_read"], r["a"]["cache_write"]) == (0, 0)
    assert (r["b"]["cache_read"], r["b"]["cache_write"]) == (5, 0)


def test_store_sync_ledger(spark):
    from tokentally.sources.driver_tables import load_lines
    lines = load_lines(spark, "/root/testdata/sf0.001").drop("line_ts")
    store = UsageStore.open(spark, scratch_dir(spark, "store"))
    store.sync(lines, AS_OF)
    n1 = store.chats.read().count()
    v1 = store.chats.current()["version"]
    assert n1 > 0 and store.ledger.read().count() == n1
    store.sync(lines, AS_OF)                         # second run: nothing new to import
    assert store.chats.read().count() == n1
    assert store.tokens.read().count() == n1         # one aggregate fact row per session
    assert store.chats.current()["version"] == v1    # and nothing to write


def test_store_sync_replayed_batch_is_skipped(spark):
    from tokentally.sources.driver_tables import load_lines
    lines = load_lines(spark, "/root/testdata/sf0.001").drop("line_ts")
    store = UsageStore.open(spark, scratch_dir(spark, "store-replay"))
    store.sync(lines, AS_OF, batch_id=0)
    v = store.chats.current()["version"]
    store.sync(lines, AS_OF, batch_id=0)              # replay of batch 0: no new versions
    assert store.chats.current()["version"] == v
    fresh = UsageStore.open(spark, store.tokens.root.rsplit("/", 1)[0])   # a restarted driver
    assert fresh.ledger.applied(0) and not fresh.ledger.applied(1)


def test_pending_sessions_leave_out_the_ledger(spark):
    import tokentally.plans.sync as S
    from tokentally.sources.driver_tables import load_lines
    lines = load_lines(spark, "/root/testdata/sf0.001").drop("line_ts")
    every = {r["session"] for r in S.import_sessions(lines, AS_OF).collect()}
    ledger = lines.select("session").distinct().orderBy("session").limit(5)
    known = {r["session"] for r in ledger.collect()}
    assert {r["session"] for r in S.pending_sessions(lines, ledger, AS_OF).collect()} == every - known
