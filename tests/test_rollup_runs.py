"""The live rollup as runs: writes follow the batch, reads equal one additive pass, replays add nothing."""

import random

from pyspark.sql import functions as F

from core_helpers import usage_df
from tokentally.operators.merge import fold_keyed, keyed_delta, merge_keyed, upsert_additive
from tokentally.session import scratch_dir
from tokentally.sources.literal import empty_table
from tokentally.sources.schemas import CHATS
from tokentally.streaming.live import LIVE_CHATS
from tokentally.streaming.rollup import RollupRuns


def events(spark, rows):
    return usage_df(spark, rows).withColumn("ctx_size", F.when(F.col("id") % 3 == 0, 1000).otherwise(0).cast("long"))


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def table(spark):
    return RollupRuns(spark, scratch_dir(spark, "t-runs"), LIVE_CHATS)


def test_a_small_batch_writes_its_own_rows_only(spark):
    t = table(spark)
    many = spark.range(10_000).select(
        "id", F.col("id").alias("ts"), F.concat(F.lit("s"), F.col("id")).alias("session"), F.lit(1).cast("long").alias("input"),
        F.lit(1).cast("long").alias("output"), F.lit(0).cast("long").alias("cache_read"), F.lit(0).cast("long").alias("cache_write"),
        F.lit("m").alias("model"), F.lit(200000).cast("long").alias("ctx_size"))
    t.add(keyed_delta(many), 0)
    for batch in range(1, 4):
        few = many.where(f"id % 1000 = {batch}").withColumn("id", F.col("id") + 10_000 * batch)
        t.add(keyed_delta(few), batch)
        written = spark.read.parquet(t.current()["paths"][-1]).count()
        assert written == 10
    assert t.rollup().count() == 10_000
    assert t.rollup().agg(F.sum("total_input")).first()[0] == 10_030


def test_runs_equal_one_pass_in_any_order(spark):
    rng = random.Random(5)
    rows = [(i, rng.randint(0, 20), rng.choice([None, "", "a", "b", "c"]), rng.randint(0, 9), rng.randint(0, 9),
             rng.choice([None, 3]), 1, rng.choice(["", "m-x", "m-opus"])) for i in range(60)]
    want = rows_of(upsert_additive(empty_table(spark, CHATS), events(spark, rows)))
    dealt = rows[:]
    rng.shuffle(dealt)
    t = table(spark)
    t.fan = 3                                            # ten batches make runs of three sizes
    for n in range(10):
        t.add(keyed_delta(events(spark, dealt[n::10])), n, "x")
        t.add(keyed_delta(events(spark, dealt[n::10])), n, "x")          # a replay
    assert len(t.current()["paths"]) == 2                # 9 + 1
    assert rows_of(t.rollup()) == want
    fresh = RollupRuns(spark, t.root, LIVE_CHATS)        # a restarted driver
    assert fresh.applied(9, "x") and rows_of(fresh.rollup()) == want


def test_fold_equals_pairwise_merge(spark):
    rows = [(1, 5, "a", 1, 1, 0, 0, ""), (2, 4, "a", 1, 1, 0, 0, ""), (4, None, "a", 2, 0, 0, 0, "m"), (6, 4, None, 1, 0, 0, 0, "")]
    parts = [keyed_delta(events(spark, [r])) for r in rows]
    pairwise = parts[0]
    for p in parts[1:]:
        pairwise = merge_keyed(pairwise, p)
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    assert rows_of(fold_keyed(union)) == rows_of(pairwise)


def test_session_rings_equal_the_batch_form_in_any_order(spark):
    from tokentally.operators.history import history_last
    from tokentally.streaming.live import live_source, start_session_rings
    from tokentally.sources.live import decode_events, encode_enveloped, encode_events
    rows = [(i, 1706659200 - 40 * ((i * 37) % 900), "x", i % 5, i % 3, 0, 0, "m") for i in range(1, 900)]
    u = usage_df(spark, rows)
    src, ckpt = scratch_dir(spark, "t-rings-src"), scratch_dir(spark, "t-rings-ckpt")
    root = scratch_dir(spark, "t-rings")
    for n in (2, 0, 1):                                    # files out of time order, in two runs of the stream
        encode_enveloped(u.where(F.col("id") % 3 == n)).coalesce(1).write.mode("append").text(src)
        if n != 2:
            q = start_session_rings(live_source(spark, src, max_files=1), root, ckpt)
            q.awaitTermination()
    from tokentally.plans.live import live_rows
    want = history_last(live_rows(decode_events(encode_events(u))), 50, key="session")
    names = ["session", "pos", "ts", "id", "input", "output"]
    assert rows_of(q.table.rings().select(*names)) == rows_of(want.select(*names))
    assert q.table.rings().groupBy("session").count().agg(F.max("count")).first()[0] == 50
    one = q.table.read().where("session is not null").limit(40)
    q.table.add(one, 0, q.table.current()["stream"])      # a replay
    assert rows_of(q.table.rings().select(*names)) == rows_of(want.select(*names))
