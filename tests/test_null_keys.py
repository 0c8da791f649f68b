"""Sessions without a name in every merge: one row, whole sums, equal on a second run."""

import duckdb
import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from core_helpers import usage_df
from tokentally.operators.joins import anti_join, semi_join
from tokentally.operators.merge import (keyed_delta, merge_keyed, replace_sessions, rollup_for_chats,
                                        upsert_additive, upsert_import, upsert_monotone)
from tokentally.sources.literal import empty_table
from tokentally.sources.schemas import CHAT_COLUMNS, CHATS, TOKEN_COLUMNS
from tokentally.streaming.live import LIVE_CHATS

cfg = settings(max_examples=5, deadline=None, phases=[Phase.generate], suppress_health_check=[HealthCheck.function_scoped_fixture])
session = st.sampled_from([None, None, "", "a", "b", "c"])
event = st.tuples(st.one_of(st.none(), st.integers(0, 9)), session, st.integers(0, 50), st.integers(0, 50),
                  st.one_of(st.none(), st.integers(0, 9)), st.sampled_from(["", "m-opus-1", "m-x"]))
events = st.lists(event, min_size=1, max_size=25)


def facts(spark, rows, start=0):
    return usage_df(spark, [(start + i, ts, s, a, b, c, c, m) for i, (ts, s, a, b, c, m) in enumerate(rows)])


def snapshot(df):
    rows = [tuple(r[c] for c in CHAT_COLUMNS) for r in df.collect()]
    assert len({r[0] for r in rows}) == len(rows)           # one row a session, the missing one too
    return {r[0]: r for r in rows}


def sequential(batches):
    """The additive policy, one event at a time in arrival order."""
    chats = {}
    for rows in batches:
        ordered = sorted(enumerate(rows), key=lambda r: (r[1][0] is not None, r[1][0] or 0, r[0]))
        for _, (ts, s, a, b, c, m) in ordered:
            if s not in chats:
                chats[s] = [s, "", m, 200000, ts, ts, a, b, c or 0, c or 0]
                continue
            old = chats[s]
            old[2], old[5] = m or old[2], ts
            for i, v in enumerate((a, b, c or 0, c or 0)):
                old[6 + i] += v
    return {s: tuple(r) for s, r in chats.items()}


@cfg
@given(events, events)
def test_additive_equals_event_by_event(spark, first, second):
    chats = upsert_additive(empty_table(spark, CHATS), facts(spark, first))
    chats = upsert_additive(chats, facts(spark, second, 100))
    assert snapshot(chats) == sequential([first, second])


@cfg
@given(events, events)
def test_import_and_monotone_equal_sql_and_are_idempotent(spark, first, second):
    old, new = rollup_for_chats(facts(spark, first)), rollup_for_chats(facts(spark, first[:5] + second, 100))
    sides = {"o": old.toPandas(), "n": new.toPandas()}
    duck = duckdb.connect()
    for name, frame in sides.items():
        duck.register(name, frame)
    both, fresh = "o.ctx_size is not null and n.ctx_size is not null", "n.ctx_size is not null"
    totals = ("total_input", "total_output", "cache_read", "cache_write")
    shared = f"""case when {fresh} then n.session else o.session end as session,
        case when {both} then o.title when {fresh} then n.title else o.title end as title,
        case when {both} then MODEL when {fresh} then n.model else o.model end as model,
        coalesce(o.ctx_size, n.ctx_size) as ctx_size, least(o.first_ts, n.first_ts) as first_ts,
        greatest(o.last_ts, n.last_ts) as last_ts"""
    overwrite = ", ".join(f"case when {fresh} then n.{c} else o.{c} end as {c}" for c in totals)
    most = ", ".join(f"greatest(o.{c}, n.{c}) as {c}" for c in totals)
    for upsert, model, sums in ((upsert_import, "case when n.model <> '' then n.model else o.model end", overwrite),
                                (upsert_monotone, "case when o.model <> '' then o.model else n.model end", most)):
        sql = f"select {shared.replace('MODEL', model)}, {sums} from o full join n on o.session is not distinct from n.session"
        want = {r[0]: r for r in duck.sql(sql).fetchall()}
        got = upsert(old, new)
        assert snapshot(got) == want
        assert snapshot(upsert(got, new)) == want            # a rerun changes nothing


@cfg
@given(events, events)
def test_replace_and_keyed_merge(spark, first, second):
    t, new = facts(spark, first), facts(spark, second, 100)
    names = {r[1] for r in second}
    want = sorted((i for i, r in enumerate(first) if r[1] not in names), key=int) + list(range(100, 100 + len(second)))
    out = replace_sessions(t, new)
    assert sorted(r["id"] for r in out.collect()) == want
    assert sorted(r["id"] for r in replace_sessions(out, new).collect()) == want
    empty = empty_table(spark, LIVE_CHATS)
    one = merge_keyed(empty, keyed_delta(t.unionByName(new)))
    two = merge_keyed(merge_keyed(empty, keyed_delta(new)), keyed_delta(t))
    assert snapshot(one) == snapshot(two)
    total = sum(r[2] for r in first + second if r[1] is None)
    assert snapshot(two).get(None, (None,) * 6 + (0,))[6] == total


def test_key_joins_hold_the_missing_key(spark):
    big = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "session string, v int")
    keys = spark.createDataFrame([(None,), (None,), ("b",)], "session string")
    assert [r["v"] for r in anti_join(big, keys, "session").collect()] == [2]
    assert sorted(r["v"] for r in semi_join(big, keys, "session").collect()) == [1, 3]


def test_merges_stay_equi_joins(spark):
    a, b = (rollup_for_chats(facts(spark, [(i, s, 1, 1, 0, "m")])) for i, s in ((1, None), (2, "a")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = upsert_import(a, b)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_live_status_of_events_without_session(spark):
    from tokentally.plans.live import live_status
    stored = usage_df(spark, [(1, 10, None, 5, 6, 7, 8, "m"), (2, 11, "a", 1, 1, 1, 1, "m")])
    new = usage_df(spark, [(3, 20, None, 1, 2, 3, 4, "m"), (4, 20, None, 1, 0, 0, 0, "m")])
    got = {r["id"]: (r["session_input"], r["session_output"], r["session_cache_read"]) for r in live_status(stored, new).collect()}
    assert got == {3: (6, 8, 10), 4: (7, 8, 10)}
