import json
import os

from pyspark.sql import functions as F

from core_helpers import AS_OF, usage_df
from tokentally.operators.merge import upsert_additive
from tokentally.plans.live import live_rows
from tokentally.plans.sync import UsageStore
from tokentally.session import scratch_dir
from tokentally.sources.live import decode_events, encode_enveloped, encode_events
from tokentally.sources.literal import empty_table
from tokentally.sources.schemas import CHATS
from tokentally.streaming.live import LiveSink, live_source, start_live_ingest
from tokentally.streaming.sync import start_sync, transcript_stream


def sample(spark):
    rows = [(i, AS_OF - 5000 + 37 * i, "x", i * 10 % 700, (i * 7) % 300, (i % 4) * 100, (i % 3) * 50,
             ["m-opus-1", "m-haiku-1", "", "m-sonnet-1"][i % 4]) for i in range(1, 120)]
    rows.append((500, AS_OF, "x", 0, 0, 9, 0, "m-opus-1"))     # cache-only: not recorded
    return usage_df(spark, rows)


def test_live_stream_equals_batch_and_replay_is_noop(spark, capsys):
    u = sample(spark)
    src = scratch_dir(spark, "t-live-src")
    for cond in (F.col("id") < 40, (F.col("id") >= 40) & (F.col("id") < 80), F.col("id") >= 80):
        encode_enveloped(u.filter(cond)).write.mode("append").text(src)
    sink = LiveSink(spark, scratch_dir(spark, "t-live-sink"))
    q = start_live_ingest(live_source(spark, src, max_files=1), sink, scratch_dir(spark, "t-live-ckpt"))
    q.awaitTermination()
    batch = live_rows(decode_events(encode_events(u)))
    assert sorted(map(tuple, sink.facts().drop("dt").collect())) == sorted(map(tuple, batch.collect()))
    # the facts are date-partitioned: a time-bounded report prunes folders
    from tokentally.operators.periods import period_summary
    capsys.readouterr()
    period_summary(sink.facts(), AS_OF, (("1h", 3600), ("6h", 21600))).explain()
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(dt" in plan and "dt#" in plan
    want = upsert_additive(empty_table(spark, CHATS), batch.withColumn("ctx_size", F.lit(200000).cast("long")))
    got_chats = sorted(map(tuple, sink.rollup().collect()))
    assert got_chats == sorted(map(tuple, want.collect()))
    # any batch order gives the same rollup
    from tokentally.operators.merge import keyed_delta, merge_keyed
    ev = batch.withColumn("ctx_size", F.lit(200000).cast("long"))
    parts = [keyed_delta(ev.filter(F.col("id") % 3 == k)) for k in range(3)]
    a = merge_keyed(merge_keyed(parts[2], parts[0]), parts[1]).select(*want.columns)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, want.collect()))
    ring = sink.ring.read().orderBy("pos").collect()
    assert len(ring) == 50 and ring[-1]["id"] == 119
    # replaying the last batch changes nothing
    last, stream = sink.chats.current()["batch_id"], sink.chats.current()["stream"]
    ids = spark.read.parquet(sink.facts_path).filter(F.col("batch_id") == last).select("id")
    replay = decode_events(encode_events(u)).join(ids, "id", "left_semi")
    sink.apply(replay, last, stream)
    assert sorted(map(tuple, sink.rollup().collect())) == got_chats
    assert sink.facts().count() == batch.count()


def _write(path, docs, mode="w"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode) as fh:
        for d in docs:
            fh.write(json.dumps(d, separators=(",", ":")) + "\n")


def test_transcript_stream_reads_only_new_files(spark, tmp_dir):
    root = os.path.join(tmp_dir, "projects")
    u = lambda i, o: {"message": {"model": "m-haiku-3", "usage": {"input_tokens": i, "output_tokens": o}},
                      "timestamp": "2024-01-30T10:00:00.000Z"}
    _write(os.path.join(root, "a", "s1.jsonl"), [u(10, 1), u(5, 1)])
    _write(os.path.join(root, "a", "agent-9.jsonl"), [u(99, 99)])
    store = UsageStore.open(spark, scratch_dir(spark, "t-sync-store"))
    ckpt = scratch_dir(spark, "t-sync-ckpt")
    start_sync(transcript_stream(spark, root), store, AS_OF, ckpt, root).awaitTermination()
    first = {r["session"]: r["total_input"] for r in store.chats.read().collect()}
    assert first == {"s1": 15}
    _write(os.path.join(root, "a", "s1.jsonl"), [u(1000, 1)], mode="a")   # grows: ignored
    _write(os.path.join(root, "b", "s2.jsonl"), [u(7, 7)])
    start_sync(transcript_stream(spark, root), store, AS_OF, ckpt, root).awaitTermination()
    second = {r["session"]: r["total_input"] for r in store.chats.read().collect()}
    assert second == {"s1": 15, "s2": 7}
    assert store.ledger.read().count() == 2


def test_combined_views(spark):
    from tokentally.plans.views import all_chats, all_usage
    from tokentally.sources.driver_tables import load_lines
    store = UsageStore.open(spark, scratch_dir(spark, "t-views-store"))
    store.sync(load_lines(spark, "/root/testdata/sf0.001").drop("line_ts"), AS_OF)
    sink = LiveSink(spark, scratch_dir(spark, "t-views-sink"))
    u = sample(spark)
    sink.apply(decode_events(encode_events(u)), 0)
    n_live = sink.facts().count()
    assert all_usage(store, sink).count() == store.tokens.read().count() + n_live
    assert all_usage(store, sink).filter(F.col("source") == "live").count() == n_live
    chats = all_chats(store, sink)
    assert chats.count() == store.chats.read().count() + sink.rollup().count()
    assert chats.filter(F.col("session") == "20240130").first()["total_input"] == \
        sink.rollup().filter(F.col("session") == "20240130").first()["total_input"]


def test_ring_follows_responses_when_not_recording(spark):
    u = sample(spark)
    sink = LiveSink(spark, scratch_dir(spark, "t-norec"), record=False)
    sink.apply(decode_events(encode_events(u)), 0)
    assert sink.facts().count() == 0 and sink.rollup().count() == 0
    assert sink.ring.read().count() == 50


def test_second_checkpoint_adds_to_the_sink(spark):
    u = sample(spark)
    sink = LiveSink(spark, scratch_dir(spark, "t-two-sink"))
    for part in (F.col("id") < 60, F.col("id") >= 60):
        src = scratch_dir(spark, "t-two-src")
        encode_enveloped(u.filter(part)).write.text(src)
        start_live_ingest(live_source(spark, src), sink, scratch_dir(spark, "t-two-ckpt")).awaitTermination()
    batch = live_rows(decode_events(encode_events(u)))
    assert sorted(map(tuple, sink.facts().drop("dt").collect())) == sorted(map(tuple, batch.collect()))
    assert sink.rollup().agg(F.sum("total_input")).first()[0] == batch.agg(F.sum("input")).first()[0]
    assert max(r["id"] for r in sink.ring.read().collect()) == 119


def test_only_a_missing_table_reads_as_empty(spark):
    import pytest
    assert LiveSink(spark, scratch_dir(spark, "t-none")).facts().count() == 0
    with pytest.raises(Exception, match="nosuchscheme"):
        LiveSink(spark, "nosuchscheme://x/y").facts()
    with pytest.raises(Exception, match="nosuchscheme"):
        LiveSink(spark, "nosuchscheme://x/y").rollup()


def test_session_without_tokens_is_read_again(spark, tmp_dir):
    u = {"message": {"model": "m-haiku-3", "usage": {"input_tokens": 4, "output_tokens": 1}}}
    for how in ("batch", "stream"):
        root = os.path.join(tmp_dir, how)
        _write(os.path.join(root, "s1.jsonl"), [{"summary": "none yet"}])
        _write(os.path.join(root, "s2.jsonl"), [u])
        store, ckpt = UsageStore.open(spark, scratch_dir(spark, "t-again")), scratch_dir(spark, "t-again-ckpt")

        def run():
            if how == "batch":
                store.sync_folder(root, AS_OF)
            else:
                start_sync(transcript_stream(spark, root), store, AS_OF, ckpt, root).awaitTermination()
        run()
        assert {r["session"] for r in store.chats.read().collect()} == {"s2"}
        _write(os.path.join(root, "s1.jsonl"), [u, u], mode="a")
        _write(os.path.join(root, "s3.jsonl"), [u])
        run()
        assert {r["session"]: r["total_input"] for r in store.chats.read().collect()} == {"s1": 8, "s2": 4, "s3": 4}


def test_equal_names_last_path_and_synced_files_unread(spark, tmp_dir):
    from tokentally.sources.transcripts import read_transcripts
    u = lambda i: {"message": {"usage": {"input_tokens": i, "output_tokens": 1}}}
    _write(os.path.join(tmp_dir, "a", "s.jsonl"), [u(10)])
    _write(os.path.join(tmp_dir, "b", "s.jsonl"), [u(100)])
    _write(os.path.join(tmp_dir, "b", "t.jsonl"), [u(1)])
    lines = read_transcripts(spark, tmp_dir)
    assert sorted(r["value"].count("100") for r in lines.collect()) == [0, 1]
    left = read_transcripts(spark, tmp_dir, spark.createDataFrame([("s",)], "session string"))
    assert {f.rsplit("/", 1)[1] for f in left.inputFiles()} == {"t.jsonl"}
