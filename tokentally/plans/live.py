"""Live recording: decoded usage events -> fact rows and rollup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokentally.constants import BAR_LEVELS, HISTORY_KEEP, SPARK_WIDTH_MAX, SPARK_WIDTH_MIN
from tokentally.functions.gauges import bar_level
from tokentally.operators.history import history_last, recorded
from tokentally.sources.schemas import TOKEN_COLUMNS


def live_session_key(ts_col: str = "ts"):
    """The live session of an event: its UTC date as yyyyMMdd."""
    from tokentally.functions.timeparse import epoch_date
    return F.date_format(epoch_date(F.col(ts_col)), "yyyyMMdd")


def live_rows(decoded: DataFrame, session: str | None = None, record: bool = True) -> DataFrame:
    """Fact rows to append for decoded events that carry ``ts`` and ``id``:
    only when recording is on and the event has input or output tokens."""
    if not record:
        decoded = decoded.filter(F.lit(False))
    sess = F.lit(session) if session else live_session_key()
    return recorded(decoded).select(
        "id", "ts", sess.alias("session"), "input", "output", "cache_read", "cache_write",
        F.col("ctx_pct").cast("long").alias("ctx_pct"), "model")


SUMS = ("input", "output", "cache_read", "cache_write")


def live_status(tokens: DataFrame, events: DataFrame, width: int = 30) -> DataFrame:
    """The status line of incoming events (one row per event, in (ts, id) order).

    An event's line shows its session's stored totals (``tokens``), plus the
    recorded events of the batch before it, plus itself, priced as a whole at
    the event's model; its context use and bar; and the bars of the last
    recorded responses up to it.  ``events`` carries id, ts, session, model,
    ctx_pct and the four counts (as ``live_rows`` gives).
    """
    from tokentally.functions.gauges import bar_filled, bar_zones
    from tokentally.functions.pricing import cost_cents, z
    from tokentally.operators.joins import semi_join
    from tokentally.operators.running import range_split, sums_in_parts

    stored = (semi_join(tokens, events.select("session"), "session")
              .groupBy("session")
              .agg(*[F.sum(z(c)).cast("long").alias(f"s_{c}") for c in SUMS]))
    is_recorded = (z("input") > 0) | (z("output") > 0)
    ev = events.select(
        "id", "ts", "session", "model", "ctx_pct", *SUMS, F.lit("all").alias("one"),
        F.when(is_recorded, 1).otherwise(0).cast("long").alias("n"),
        *[F.when(is_recorded, z(c)).otherwise(0).cast("long").alias(f"m_{c}") for c in SUMS])
    # one split by arrival serves the sums of each session and the numbers of all events
    split = range_split(ev, ["ts", "id"])
    ev = sums_in_parts(split, "session", ["ts", "id"], tuple(f"m_{c}" for c in SUMS))
    ev = sums_in_parts(ev, "one", ["ts", "id"], ("n",), split=split).withColumnRenamed("run_n", "p")
    stored = stored.withColumnRenamed("session", "s_session")
    j = ev.join(stored, ev["session"].eqNullSafe(stored["s_session"]), "left").join(history_bars(tokens, ev, width), "p", "left")
    tot = {c: z(f"s_{c}") + F.col(f"run_m_{c}") - F.col(f"m_{c}") + z(c) for c in SUMS}
    filled = bar_filled("ctx_pct", width)
    g, y, r = bar_zones(filled, width)
    empty = F.lit("0" * _bar_width(width))
    return j.select(
        "id", "session", "model",
        *[tot[c].alias(f"session_{c}") for c in SUMS],
        cost_cents("model", tot["input"], tot["output"], tot["cache_read"], tot["cache_write"]).alias("cost_cents"),
        F.col("ctx_pct").cast("long").alias("ctx_pct"), filled.alias("filled"),
        g.alias("green"), y.alias("yellow"), r.alias("red"),
        F.coalesce("in_bar", empty).alias("in_bar"), F.coalesce("out_bar", empty).alias("out_bar"))


def _bar_width(width: int) -> int:
    return max(SPARK_WIDTH_MIN, min(SPARK_WIDTH_MAX, width))


def history_bars(tokens: DataFrame, ev: DataFrame, width: int = 30) -> DataFrame:
    """(p, in_bar, out_bar): bar levels, one digit a slot, of the history after the batch's p-th recorded event.

    Recorded responses are numbered: stored ones up to 0, those of the batch
    from 1.  A history is at most ``HISTORY_KEEP`` consecutive numbers, so it
    lies in two chunks of that length; histories meet responses by chunk, and
    no task sees more than two chunks for one history.
    """
    w = _bar_width(width)
    old = history_last(tokens, HISTORY_KEEP)
    n = F.count("*").over(Window.partitionBy())            # at most HISTORY_KEEP rows
    items = (old.select((F.col("pos") - n + 1).alias("idx"), "input", "output")
             .unionByName(ev.where("n = 1").select(F.col("p").alias("idx"), "input", "output"))
             .withColumn("chunk", F.floor(F.col("idx") / HISTORY_KEEP)))
    first = F.col("p") - (HISTORY_KEEP - 1)
    places = ev.select("p").distinct().withColumn("chunk", F.explode(F.array_distinct(F.array(
        F.floor(first / HISTORY_KEEP), F.floor(F.col("p") / HISTORY_KEEP)))))
    h = (places.join(items, "chunk").where((F.col("idx") >= first) & (F.col("idx") <= F.col("p")))
         .groupBy("p").agg(F.sort_array(F.collect_list(F.struct("idx", "input", "output"))).alias("h")))

    def bar(c: str):
        top = F.greatest(F.lit(1).cast("long"), F.array_max(F.col(f"h.{c}")))
        last = F.slice("h", F.greatest(F.lit(1), F.size("h") - w + 1), F.lit(w))
        digits = F.concat_ws("", F.transform(last, lambda x: bar_level(x[c], top, BAR_LEVELS).cast("string")))
        return F.lpad(digits, w, "0")
    return h.select("p", bar("input").alias("in_bar"), bar("output").alias("out_bar"))
