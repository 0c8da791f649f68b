"""Registered queries over the driver tables: name -> (spark, sf_dir) -> DataFrame.

``events`` is read as the usage fact table and ``conversations`` as JSONL
transcript lines (see ``sources.driver_tables``).  Every query reads the
whole tables; splits into "earlier" and "later" parts for the merge queries
are by time, and together cover every row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentally.constants import CHART_SLOTS, CHARTS
from tokentally.constants import FIXTURE_AS_OF as AS_OF
from tokentally.functions import (bar_filled, bar_zones, cost_cents, cost_cents_ex_cache, humanize,
                                  idiv, model_family)
from tokentally.functions.pricing import join_prices
from tokentally.operators.extract import transcript_sessions, with_tokens
from tokentally.operators.history import history_last, sparkline_levels
from tokentally.operators.merge import (evolve_schema, replace_sessions, rollup_for_chats,
                                        upsert_additive, upsert_import, upsert_monotone)
from tokentally.operators.periods import period_cost, period_summary
from tokentally.operators.running import session_running_cost
from tokentally.operators.series import series_scaled, usage_series
from tokentally.operators.sessions import (chat_count, chat_list, cost_by_family, import_cost_by_family,
                                           import_summary, session_rollup, top_sessions, top_sessions_by_day)
from tokentally.plans.live import live_rows
from tokentally.plans.sync import backfill_chats, backfill_import, incremental_sync
from tokentally.sources.driver_tables import TRANSCRIPT_BASE, load_lines, load_usage
from tokentally.session import scratch_dir
from tokentally.sources.days import DayTable
from tokentally.sources.literal import empty_table
from tokentally.sources.live import decode_events, encode_events
from tokentally.sources.schemas import CHATS, LEDGER, TOKENS
from tokentally.sources.store import materialized
from tokentally.sources.transcripts import list_transcripts, read_transcripts, write_transcripts
from tokentally.streaming.rollup import UsageSummary

DAY, WEEK = 86400, 604800
# transcript fixture: the first sync runs 50 h 2.5 min after the first
# conversation starts; lines written later are not yet on disk then
SYNC_T1 = TRANSCRIPT_BASE + 50 * 3600 + 150
CONTEXT_BAR_WIDTH = 30
SPARK_WIDTH = 30
# files of one range of names of the import
IMPORT_RANGE = 500


def _empty(spark: SparkSession, schema) -> DataFrame:
    return empty_table(spark, schema)


def fixture_chats(usage: DataFrame) -> DataFrame:
    """A chats snapshot derived from fact rows in one aggregation, with a
    title: 'last <model>' of the latest row, '' when that row's model is blank."""
    order = F.struct("ts", "id")
    title = F.when(F.col("model") != "", F.concat(F.lit("last "), F.col("model"))).otherwise(F.lit(""))
    return usage.groupBy("session").agg(
        F.max_by(title, order).alias("title"),
        F.max_by("model", order).alias("model"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        *[F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long").alias(a) for c, a in
          (("input", "total_input"), ("output", "total_output"), ("cache_read", "cache_read"),
           ("cache_write", "cache_write"))],
    ).select("session", "title", "model", F.lit(200000).cast("long").alias("ctx_size"), "first_ts", "last_ts",
             "total_input", "total_output", "cache_read", "cache_write")


# ---------------------------------------------------------------- scalars
def q_model_family(spark, d):
    u = load_usage(spark, d)
    return u.select("id", "model", model_family("model").alias("family"))


def q_usage_priced(spark, d):
    u = join_prices(load_usage(spark, d))
    return u.select(
        "id", "session", "model", "family", "p_input", "p_cache_write", "p_cache_read", "p_output",
        cost_cents("model", "input", "output", "cache_read", "cache_write").alias("cost_cents"),
        cost_cents_ex_cache("model", "input", "output").alias("cost_cents_ex_cache"))


def q_humanize(spark, d):
    u = load_usage(spark, d)
    daily = u.groupBy(idiv("ts", DAY).alias("day")).agg(
        F.sum("input").cast("long").alias("input"), F.sum("output").cast("long").alias("output"),
        F.sum(F.col("input") + F.col("output") + F.col("cache_read") + F.col("cache_write")).cast("long").alias("total"))
    return daily.select("day", "input", "output", "total",
                        humanize("input").alias("input_h"), humanize("output").alias("output_h"),
                        humanize("total").alias("total_h"), humanize("total", 0).alias("total_short"),
                        humanize("input", 0).alias("input_short"))


def q_context_usage(spark, d):
    u = load_usage(spark, d)
    filled = bar_filled("ctx_pct", CONTEXT_BAR_WIDTH)
    g, y, r = bar_zones(filled, CONTEXT_BAR_WIDTH)
    return u.select("id", "ctx_pct", filled.alias("filled"), g.alias("green"), y.alias("yellow"), r.alias("red"))


# ---------------------------------------------------------------- dashboard
def q_period_summary(spark, d):
    return period_summary(load_usage(spark, d), AS_OF).select("period", "msgs", "input", "output", "cost_cents")


def q_period_cost(spark, d):
    return period_cost(load_usage(spark, d), AS_OF).select("period", "cost_cents")


def q_cost_by_family(spark, d):
    return cost_by_family(load_usage(spark, d))


def q_top_sessions(spark, d):
    return top_sessions(load_usage(spark, d), 3)


def q_session_rollup(spark, d):
    return session_rollup(load_usage(spark, d))


# the widest chart shows nothing before this
_CHARTS_SINCE = AS_OF - CHART_SLOTS * max(w for _, w in CHARTS) + 1


def q_usage_series(spark, d):
    return usage_series(load_usage(spark, d, _CHARTS_SINCE), AS_OF).select("range", "slot", "input", "output")


def q_series_scaled(spark, d):
    return series_scaled(usage_series(load_usage(spark, d, _CHARTS_SINCE), AS_OF)).select(
        "range", "slot", "input", "output", "max", "dots_in", "dots_out")


# ---------------------------------------------------------------- live
def q_session_running_cost(spark, d):
    return session_running_cost(load_usage(spark, d))


def q_history_last50(spark, d):
    return history_last(load_usage(spark, d), 50)


def q_sparkline_levels(spark, d):
    return sparkline_levels(history_last(load_usage(spark, d), 50), SPARK_WIDTH)


def _decoded(spark, d):
    return decode_events(encode_events(load_usage(spark, d)))


def q_live_event_decode(spark, d):
    return _decoded(spark, d).select("id", "ts", "display_name", "model", "ctx_size", "input", "output",
                                     "cache_read", "cache_write", "ctx_pct")


def q_live_append(spark, d):
    return live_rows(_decoded(spark, d))


def q_live_status(spark, d):
    from tokentally.plans.live import live_status
    u = load_usage(spark, d)
    cut = AS_OF - DAY
    return live_status(u.filter(F.col("ts") < cut), u.filter(F.col("ts") >= cut), CONTEXT_BAR_WIDTH)


def q_upsert_additive(spark, d):
    u = load_usage(spark, d)
    cut = AS_OF - WEEK
    before = upsert_additive(_empty(spark, CHATS), u.filter(F.col("ts") < cut))
    return upsert_additive(before, u.filter(F.col("ts") >= cut))


# ---------------------------------------------------------------- merges
def _recent_rows(u: DataFrame) -> DataFrame:
    """One fact row a session of the last day."""
    recent = rollup_for_chats(u.filter(F.col("ts") >= AS_OF - DAY))
    return recent.select(F.lit(None).cast("long").alias("id"), F.col("last_ts").alias("ts"), "session",
                         F.col("total_input").alias("input"), F.col("total_output").alias("output"),
                         "cache_read", "cache_write", F.lit(0).cast("long").alias("ctx_pct"), "model")


def q_replace_by_session(spark, d):
    u = load_usage(spark, d)
    return replace_sessions(u, _recent_rows(u))


def q_upsert_import(spark, d):
    u = load_usage(spark, d)
    old = fixture_chats(u.filter(F.col("ts") < AS_OF - WEEK))
    new = fixture_chats(u.filter(F.col("ts") >= AS_OF - 2 * WEEK))
    return upsert_import(old, new)


def q_upsert_monotone(spark, d):
    u = load_usage(spark, d)
    old = fixture_chats(u.filter(F.col("ts") < AS_OF - WEEK))
    return upsert_monotone(old, rollup_for_chats(u))


def q_schema_evolve(spark, d):
    u = load_usage(spark, d)
    old = fixture_chats(u.filter(F.col("ts") < AS_OF - WEEK)).drop("cache_read", "cache_write")
    new = fixture_chats(u.filter(F.col("ts") >= AS_OF - WEEK))
    return evolve_schema(old, new)


def _without_some_names(spark, d):
    """The facts with the sessions of every fourth user nameless."""
    u = load_usage(spark, d)
    return u.withColumn("session", F.when(F.substring("session", 2, 20).cast("long") % 4 != 0, F.col("session")))


def q_upsert_nameless(spark, d):
    """The three upserts over facts of which a part has no session: it keeps its sums, in one row."""
    u = _without_some_names(spark, d)
    old, late = u.filter(F.col("ts") < AS_OF - WEEK), u.filter(F.col("ts") >= AS_OF - WEEK)
    overlap = fixture_chats(u.filter(F.col("ts") >= AS_OF - 2 * WEEK))
    done = {"import": upsert_import(fixture_chats(old), overlap),
            "monotone": upsert_monotone(fixture_chats(old), rollup_for_chats(u)),
            "additive": upsert_additive(upsert_additive(_empty(spark, CHATS), old), late)}
    rows = [df.withColumn("policy", F.lit(policy)) for policy, df in done.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def _by_day(spark, d, name: str, usage=None) -> DayTable:
    t = DayTable(spark, scratch_dir(spark, name), TOKENS)
    t.append((load_usage(spark, d) if usage is None else usage).select(*TOKENS.names))
    return t


def q_replace_by_day(spark, d):
    """The replacement of ``replace_by_session``, in a table laid out by day."""
    t = _by_day(spark, d, "replace-days")
    t.replace(materialized(_recent_rows(load_usage(spark, d)), "recent"))
    return t.read().drop("dt")


def q_top_sessions_by_day(spark, d):
    """The latest sessions, found in the newest days of a table laid out by day."""
    t = _by_day(spark, d, "top-days")
    return top_sessions_by_day(t.read(), 3, t.days())


def q_period_from_summary(spark, d):
    """The period table from the mergeable summary, added to by four batches, and the facts of the bounds' buckets."""
    u = load_usage(spark, d)
    t, sums = _by_day(spark, d, "summary-days", u), UsageSummary(spark, scratch_dir(spark, "summary"))
    for batch in range(4):
        sums.add(u.filter(F.col("id") % 4 == batch), batch)
    return sums.period_summary(t.read(), AS_OF).select("period", "msgs", "input", "output", "cost_cents")


# ---------------------------------------------------------------- transcripts
def _sessions(spark, d):
    return transcript_sessions(load_lines(spark, d).drop("line_ts"), AS_OF)


def q_transcript_tokens(spark, d):
    return with_tokens(_sessions(spark, d)).select("session", "input", "output", "cache_read", "cache_write")


def q_transcript_model_title(spark, d):
    return _sessions(spark, d).select("session", "model", "title")


def q_transcript_span(spark, d):
    return _sessions(spark, d).select("session", "first_ts", "last_ts")


def _land_transcripts(spark, d) -> str:
    """The transcript lines as ``<session>.jsonl`` files on the shared folder."""
    root = scratch_dir(spark, "transcripts")
    write_transcripts(load_lines(spark, d).drop("line_ts"), root)
    return root


def q_transcript_files(spark, d):
    """File scan: sessions and line order come from the files."""
    return transcript_sessions(read_transcripts(spark, _land_transcripts(spark, d)), AS_OF)


def q_session_key(spark, d):
    """Session names from file names; no content is read."""
    return list_transcripts(spark, _land_transcripts(spark, d)).select("session")


def q_import_by_ranges(spark, d):
    """An import of the files by ranges of names, each a whole incremental run."""
    from tokentally.plans.sync import UsageStore
    store = UsageStore.open(spark, scratch_dir(spark, "range-store"))
    store.sync_folder(_land_transcripts(spark, d), AS_OF, files=IMPORT_RANGE)
    return store.chats.read()


def q_create_if_missing(spark, d):
    """A first sync into a store that isn't there."""
    from tokentally.plans.sync import UsageStore
    store = UsageStore.open(spark, scratch_dir(spark, "new-store"))
    store.sync(load_lines(spark, d).drop("line_ts"), AS_OF)
    return store.chats.read()


def _backfilled_chats(spark, d):
    lines = load_lines(spark, d).drop("line_ts")
    return backfill_chats(lines, _empty(spark, CHATS), AS_OF)


def q_backfill_import(spark, d):
    lines = load_lines(spark, d).drop("line_ts")
    _, chats = backfill_import(lines, _empty(spark, TOKENS), _empty(spark, CHATS), AS_OF)
    return chats


def q_import_per_line(spark, d):
    lines = load_lines(spark, d).drop("line_ts")
    tokens, _ = backfill_import(lines, _empty(spark, TOKENS), _empty(spark, CHATS), AS_OF, per_line=True)
    return tokens.drop("id")


def q_incremental_sync(spark, d):
    lines = load_lines(spark, d)
    early = lines.filter(F.col("line_ts") <= SYNC_T1).drop("line_ts")
    t1, c1, l1 = incremental_sync(early, _empty(spark, TOKENS), _empty(spark, CHATS), _empty(spark, LEDGER), AS_OF)
    _, c2, _ = incremental_sync(lines.drop("line_ts"), t1, c1, l1, AS_OF)
    return c2


def q_chat_list(spark, d):
    return chat_list(_backfilled_chats(spark, d), 100)


def q_chat_count(spark, d):
    return chat_count(_backfilled_chats(spark, d))


def q_import_summary(spark, d):
    return import_summary(_backfilled_chats(spark, d))


def q_import_cost_by_family(spark, d):
    return import_cost_by_family(_backfilled_chats(spark, d))


# ---------------------------------------------------------------- streams
STREAM_SLICES = 4


def _land_live_files(spark, d) -> str:
    """Write the usage rows as enveloped live JSON files, one append per week
    in time order, so the stream sees them arrive in order."""
    from tokentally.sources.live import encode_enveloped
    src = scratch_dir(spark, "live-src")
    u = load_usage(spark, d)
    start = AS_OF - STREAM_SLICES * WEEK
    for i in range(STREAM_SLICES):
        lo, hi = start + i * WEEK, start + (i + 1) * WEEK
        cond = F.col("ts") < hi if i == 0 else (F.col("ts") >= lo) & (F.col("ts") < hi)
        if i == STREAM_SLICES - 1:
            cond = F.col("ts") >= lo
        encode_enveloped(u.filter(cond)).write.mode("append").text(src)
    return src


def _run_live(spark, d):
    from tokentally.streaming.live import LiveSink, live_source, start_live_ingest
    src = _land_live_files(spark, d)
    sink = LiveSink(spark, scratch_dir(spark, "live-sink"))
    q = start_live_ingest(live_source(spark, src, max_files=1), sink, scratch_dir(spark, "live-ckpt"))
    q.awaitTermination()
    return sink


def q_stream_ingest(spark, d):
    return _run_live(spark, d).facts().drop("dt")


def q_stream_history(spark, d):
    return _run_live(spark, d).ring.read()


def q_stream_rollup(spark, d):
    """The live rollup of the streamed events, merged from its runs."""
    return _run_live(spark, d).rollup()


def q_stream_session_rings(spark, d):
    """The last 50 responses of each session, as a stream."""
    from tokentally.streaming.live import live_source, start_session_rings
    q = start_session_rings(live_source(spark, _land_live_files(spark, d), max_files=1), scratch_dir(spark, "rings"),
                            scratch_dir(spark, "rings-ckpt"))
    q.awaitTermination()
    return q.table.rings().select("session", "pos", "ts", "id", "input", "output")


def q_stream_session_totals(spark, d):
    from tokentally.streaming.live import live_source, start_session_totals
    src = _land_live_files(spark, d)
    q = start_session_totals(live_source(spark, src, max_files=1), scratch_dir(spark, "totals"),
                             scratch_dir(spark, "totals-ckpt"))
    q.awaitTermination()
    return q.table.read()


def q_stream_sync(spark, d):
    from tokentally.plans.sync import UsageStore
    from tokentally.streaming.sync import line_table_stream, start_sync
    lines = load_lines(spark, d)
    src, ckpt = scratch_dir(spark, "lines-src"), scratch_dir(spark, "lines-ckpt")
    store = UsageStore.open(spark, scratch_dir(spark, "sync-store"))
    # two arrivals; a session's lines of one arrival share a file
    for cond in (F.col("line_ts") <= SYNC_T1, F.col("line_ts") > SYNC_T1):
        lines.filter(cond).drop("line_ts").repartition("session").write.mode("append").parquet(src)
        start_sync(line_table_stream(spark, src), store, AS_OF, ckpt).awaitTermination()
    return store.chats.read()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "model_family": q_model_family,
    "usage_priced": q_usage_priced,
    "humanize": q_humanize,
    "context_usage": q_context_usage,
    "period_summary": q_period_summary,
    "period_cost": q_period_cost,
    "cost_by_family": q_cost_by_family,
    "top_sessions": q_top_sessions,
    "session_rollup": q_session_rollup,
    "usage_series": q_usage_series,
    "series_scaled": q_series_scaled,
    "session_running_cost": q_session_running_cost,
    "history_last50": q_history_last50,
    "sparkline_levels": q_sparkline_levels,
    "live_event_decode": q_live_event_decode,
    "live_append": q_live_append,
    "live_status": q_live_status,
    "upsert_additive": q_upsert_additive,
    "replace_by_session": q_replace_by_session,
    "upsert_nameless": q_upsert_nameless,
    "replace_by_day": q_replace_by_day,
    "top_sessions_by_day": q_top_sessions_by_day,
    "period_from_summary": q_period_from_summary,
    "upsert_import": q_upsert_import,
    "upsert_monotone": q_upsert_monotone,
    "schema_evolve": q_schema_evolve,
    "transcript_tokens": q_transcript_tokens,
    "transcript_model_title": q_transcript_model_title,
    "transcript_span": q_transcript_span,
    "transcript_files": q_transcript_files,
    "session_key": q_session_key,
    "import_by_ranges": q_import_by_ranges,
    "create_if_missing": q_create_if_missing,
    "backfill_import": q_backfill_import,
    "import_per_line": q_import_per_line,
    "incremental_sync": q_incremental_sync,
    "chat_list": q_chat_list,
    "chat_count": q_chat_count,
    "import_summary": q_import_summary,
    "import_cost_by_family": q_import_cost_by_family,
    "stream_ingest": q_stream_ingest,
    "stream_rollup": q_stream_rollup,
    "stream_session_rings": q_stream_session_rings,
    "stream_session_totals": q_stream_session_totals,
    "stream_history": q_stream_history,
    "stream_sync": q_stream_sync,
}
