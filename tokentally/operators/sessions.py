"""Per-session aggregation, family costs, top sessions and chat lists."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokentally.constants import CHAT_LIST_LIMIT, TOP_SESSIONS
from tokentally.functions.formatting import duration_text, session_prefix, title_display
from tokentally.functions.pricing import blank, cost_cents, model_family, z
from tokentally.operators.joins import semi_join
from tokentally.sources.literal import literal_table


def arrival_key():
    """(ts, id) as one decimal that sorts alike (missing values first).  Unlike a
    struct or text it fits the buffers of hash aggregation."""
    def whole(c, least):
        return F.coalesce(F.col(c).cast("decimal(20,0)"), F.lit(str(least)).cast("decimal(20,0)"))
    return (whole("ts", -(10 ** 14)) * F.lit(10 ** 17).cast("decimal(18,0)")).cast("decimal(38,0)") * F.lit(100).cast(
        "decimal(3,0)") + whole("id", -(10 ** 19))


def session_rollup(usage: DataFrame) -> DataFrame:
    """One row per session: count, first/last ts, four sums and the model of
    the latest row by (ts, id).

    Two levels: facts are hash-aggregated by (session, model), the latest row
    of each kept as a decimal key; the few models of a session then meet.  A
    hot session costs one buffer per task and model, and no task sorts facts."""
    by_model = usage.groupBy("session", "model").agg(
        F.count("*").alias("msgs"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        *[F.sum(z(c)).cast("long").alias(c) for c in ("input", "output", "cache_read", "cache_write")],
        F.max(arrival_key()).alias("latest"))
    return by_model.groupBy("session").agg(
        F.sum("msgs").alias("msgs"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.sum("input").alias("total_input"),
        F.sum("output").alias("total_output"),
        F.sum("cache_read").alias("cache_read"),
        F.sum("cache_write").alias("cache_write"),
        F.max_by("model", "latest").alias("model"),
    )


def top_sessions(usage: DataFrame, k: int = TOP_SESSIONS) -> DataFrame:
    """Latest ``k`` sessions by last ts (session name breaks ties): count,
    tokens, cost at the session's latest model (blank priced as the default
    family), duration.  Blank session names are dropped after the limit."""
    return _session_block(session_rollup(usage), k)


def latest_sessions(usage: DataFrame, k: int, days: Iterable[str | None]) -> tuple[DataFrame, list[str | None]]:
    """(session) of the latest ``k`` sessions of facts laid out by day, and the days that were read.

    ``days``: the days of ``usage`` (its partition column ``dt``), newest first, those without stamp (None)
    last.  A session without a row in the newest days ended before all that has one there, so the folders are
    read from the newest on, twice as many each time, until they hold ``k`` sessions."""
    days, n = list(days), 1
    while True:
        read = days[:n]
        named = [d for d in read if d is not None]
        inside = F.col("dt").isin(named) | (F.col("dt").isNull() if None in read else F.lit(False))
        last = usage.where(inside).groupBy("session").agg(F.max("ts").alias("last_ts"))
        top = last.orderBy(F.col("last_ts").desc(), F.col("session")).limit(k).collect()     # k rows
        if len(top) == k or n >= len(days):
            break
        n *= 2
    names = literal_table(usage.sparkSession, [(r["session"],) for r in top],
                          T.StructType([T.StructField("session", T.StringType())]))
    return names, read


def top_sessions_by_day(usage: DataFrame, k: int, days: Iterable[str | None]) -> DataFrame:
    """``top_sessions`` of facts laid out by day: the totals are of the latest ``k`` sessions alone."""
    names, _ = latest_sessions(usage, k, days)
    return _session_block(session_rollup(semi_join(usage, F.broadcast(names), "session")), k)


def _session_block(rollup: DataFrame, k: int) -> DataFrame:
    top = rollup.orderBy(F.col("last_ts").desc(), F.col("session")).limit(k)
    dur = (F.col("last_ts") - F.col("first_ts")).cast("long")
    return (top.filter(~blank("session"))
               .select("session", session_prefix("session", 6).alias("session_short"), "msgs",
                       F.col("total_input").alias("input"), F.col("total_output").alias("output"),
                       cost_cents("model", "total_input", "total_output", "cache_read", "cache_write").alias("cost_cents"),
                       dur.alias("duration_s"), duration_text(dur).alias("duration"),
                       "last_ts"))


def _model_group_costs(df: DataFrame, inp: str, out: str, cr: str, cw: str) -> DataFrame:
    """Per model string: four sums and their truncated cost (blank model
    strings are dropped, as the report skips them)."""
    by_model = df.groupBy(F.coalesce(F.col("model"), F.lit("")).alias("model")).agg(
        F.sum(z(inp)).cast("long").alias("input"), F.sum(z(out)).cast("long").alias("output"),
        F.sum(z(cr)).cast("long").alias("cache_read"), F.sum(z(cw)).cast("long").alias("cache_write"))
    return (by_model.filter(~blank("model"))
                    .withColumn("family", model_family("model"))
                    .withColumn("cents", cost_cents("model", "input", "output", "cache_read", "cache_write")))


def cost_by_family(usage: DataFrame) -> DataFrame:
    """Dashboard block: (family, input, output, cost_cents) for families with
    input or output tokens (each model string truncated on its own; blank
    model strings belong to no family), plus a 'total' row whose tokens count
    every row and whose cost is the all-time period cost (rows since epoch 0,
    per non-blank model string)."""
    since_epoch = F.col("ts") >= F.lit(0)
    by_model = usage.groupBy(F.coalesce(F.col("model"), F.lit("")).alias("model")).agg(
        F.sum(z("input")).cast("long").alias("input"), F.sum(z("output")).cast("long").alias("output"),
        F.sum(z("cache_read")).cast("long").alias("cache_read"), F.sum(z("cache_write")).cast("long").alias("cache_write"),
        *[F.sum(F.when(since_epoch, z(c))).cast("long").alias(f"t_{c}")
          for c in ("input", "output", "cache_read", "cache_write")])
    nonblank = lambda c: F.when(blank("model"), F.lit(0).cast("long")).otherwise(c)
    priced = (by_model.withColumn("family", F.when(blank("model"), F.lit(None)).otherwise(model_family("model")))
                      .withColumn("cents", nonblank(cost_cents("model", "input", "output", "cache_read", "cache_write")))
                      .withColumn("t_cents", nonblank(cost_cents("model", "t_input", "t_output", "t_cache_read",
                                                                 "t_cache_write"))))
    # family rows and the total row in one aggregation (grouping sets)
    both = priced.rollup("family").agg(
        F.grouping_id().alias("g"),
        F.sum(F.when(F.col("family").isNotNull(), F.col("input"))).cast("long").alias("f_input"),
        F.sum(F.when(F.col("family").isNotNull(), F.col("output"))).cast("long").alias("f_output"),
        F.sum("input").cast("long").alias("a_input"), F.sum("output").cast("long").alias("a_output"),
        F.sum("cents").cast("long").alias("cents"), F.sum("t_cents").cast("long").alias("t_cents"))
    zero = F.lit(0).cast("long")
    is_total = F.col("g") == 1
    out = both.select(
        F.when(is_total, F.lit("total")).otherwise(F.col("family")).alias("family"),
        F.coalesce(F.when(is_total, F.col("a_input")).otherwise(F.col("f_input")), zero).alias("input"),
        F.coalesce(F.when(is_total, F.col("a_output")).otherwise(F.col("f_output")), zero).alias("output"),
        F.coalesce(F.when(is_total, F.col("t_cents")).otherwise(F.col("cents")), zero).alias("cost_cents"))
    return out.filter((F.col("family") == "total")
                      | (F.col("family").isNotNull() & ((F.col("input") > 0) | (F.col("output") > 0))))


def import_cost_by_family(chats: DataFrame) -> DataFrame:
    """Import report: (family, cost_cents) for families with a positive cost,
    and a 'total' row (always present) over non-blank model strings; both
    from one aggregation (grouping sets)."""
    g = _model_group_costs(chats, "total_input", "total_output", "cache_read", "cache_write")
    both = g.rollup("family").agg(F.grouping_id().alias("g"), F.sum("cents").cast("long").alias("cost_cents"))
    is_total = F.col("g") == 1
    out = both.select(F.when(is_total, F.lit("total")).otherwise(F.col("family")).alias("family"),
                      F.coalesce("cost_cents", F.lit(0).cast("long")).alias("cost_cents"), "g")
    return out.filter(is_total | (F.col("cost_cents") > 0)).drop("g")


def import_summary(chats: DataFrame) -> DataFrame:
    """Chat count, four class totals and their sum in one job."""
    zero = F.lit(0).cast("long")
    s = lambda c: F.coalesce(F.sum(z(c)), zero).cast("long")
    return chats.agg(
        F.count("*").alias("chats"),
        s("total_input").alias("input"), s("cache_write").alias("cache_write"),
        s("cache_read").alias("cache_read"), s("total_output").alias("output"),
    ).withColumn("total", F.col("input") + F.col("output") + F.col("cache_read") + F.col("cache_write"))


def chat_count(chats: DataFrame) -> DataFrame:
    return chats.agg(F.count("*").alias("chats"))


def chat_list(chats: DataFrame, n: int = CHAT_LIST_LIMIT) -> DataFrame:
    """Latest ``n`` chats by last_ts (session breaks ties), each priced at its
    own model (blank model = default family): family, display title, tokens,
    cache total and cost.  Blank sessions are dropped after the limit."""
    top = chats.orderBy(F.col("last_ts").desc(), F.col("session")).limit(n)
    return (top.filter(~blank("session"))
               .select("session", session_prefix("session", 8).alias("session_short"),
                       model_family("model").alias("family"),
                       title_display("title").alias("title"),
                       z("total_input").alias("input"), z("total_output").alias("output"),
                       (z("cache_read") + z("cache_write")).alias("cache_total"),
                       cost_cents("model", "total_input", "total_output", "cache_read", "cache_write").alias("cost_cents"),
                       "last_ts"))
