"""Keyed merge policies for the fact table and the per-session rollup.

Parquet tables have no MERGE, so every upsert is a full outer join of the
existing snapshot with the incoming rows on ``session`` (both sides hold one
row per session, so the join cannot skew), written as a new version.  The
missing session is a session like any other: keys meet null-safely, and which
side a row comes from is told by a flag of its own, never by a null key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokentally.functions.gauges import context_size
from tokentally.functions.pricing import blank, z
from tokentally.operators.joins import anti_join
from tokentally.sources.schemas import CHAT_COLUMNS, TOKEN_COLUMNS

CACHE_COLUMNS = ("cache_read", "cache_write")


def replace_sessions(tokens: DataFrame, new: DataFrame) -> DataFrame:
    """Delete every fact row of the incoming sessions, insert the new rows."""
    kept = anti_join(tokens.select(*TOKEN_COLUMNS), new.select("session"), "session")
    return kept.unionByName(new.select(*TOKEN_COLUMNS))


def _outer(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both sides by session (``<=>`` stays an equi-join), with ``o_here`` and ``n_here``."""
    o = old.select([F.col(c).alias(f"o_{c}") for c in old.columns] + [F.lit(True).alias("o_here")])
    n = new.select([F.col(c).alias(f"n_{c}") for c in new.columns] + [F.lit(True).alias("n_here")])
    return o.join(n, o["o_session"].eqNullSafe(n["n_session"]), "full_outer")


def _sides() -> tuple[Column, Column]:
    """Whether the new and the old side hold the row."""
    return F.col("n_here").isNotNull(), F.col("o_here").isNotNull()


def _pick(has_new: Column, has_old: Column, on_conflict: Column, new: Column, old: Column) -> Column:
    return F.when(has_new & has_old, on_conflict).when(has_new, new).otherwise(old)


def upsert_import(chats: DataFrame, new: DataFrame) -> DataFrame:
    """Import policy: title/model take the new value if non-blank, else keep
    the old; first_ts = min; last_ts = max; four totals overwritten; ctx_size
    kept on conflict."""
    j = _outer(chats.select(*CHAT_COLUMNS), new)
    hn, ho = _sides()
    nb = lambda c: F.when(~blank(f"n_{c}"), F.col(f"n_{c}")).otherwise(F.col(f"o_{c}"))
    cols = {
        "session": F.coalesce("n_session", "o_session"),
        "title": _pick(hn, ho, nb("title"), F.col("n_title"), F.col("o_title")),
        "model": _pick(hn, ho, nb("model"), F.col("n_model"), F.col("o_model")),
        "ctx_size": _pick(hn, ho, F.col("o_ctx_size"), F.col("n_ctx_size"), F.col("o_ctx_size")),
        "first_ts": F.least("o_first_ts", "n_first_ts"),
        "last_ts": F.greatest("o_last_ts", "n_last_ts"),
    }
    for c in ("total_input", "total_output", "cache_read", "cache_write"):
        cols[c] = _pick(hn, ho, F.col(f"n_{c}"), F.col(f"n_{c}"), F.col(f"o_{c}"))
    return j.select([cols[c].alias(c) for c in CHAT_COLUMNS])


def rollup_for_chats(usage: DataFrame) -> DataFrame:
    """Fact rows -> chats-shaped rows (title '', constant context size, the
    model of the latest row by (ts, id))."""
    from tokentally.operators.sessions import session_rollup
    return session_rollup(usage).select("session", F.lit("").alias("title"), "model", context_size().alias("ctx_size"),
             "first_ts", "last_ts", "total_input", "total_output", "cache_read", "cache_write")


def upsert_monotone(chats: DataFrame, rollup: DataFrame) -> DataFrame:
    """Rollup-from-facts policy: model keeps the old one unless blank; first_ts
    = min; last_ts and four totals = max(old, new); title and ctx_size kept."""
    j = _outer(chats.select(*CHAT_COLUMNS), rollup)
    hn, ho = _sides()
    old_model = F.when(~blank("o_model"), F.col("o_model")).otherwise(F.col("n_model"))
    cols = {
        "session": F.coalesce("n_session", "o_session"),
        "title": _pick(hn, ho, F.col("o_title"), F.col("n_title"), F.col("o_title")),
        "model": _pick(hn, ho, old_model, F.col("n_model"), F.col("o_model")),
        "ctx_size": _pick(hn, ho, F.col("o_ctx_size"), F.col("n_ctx_size"), F.col("o_ctx_size")),
        "first_ts": F.least("o_first_ts", "n_first_ts"),
    }
    for c in ("last_ts", "total_input", "total_output", "cache_read", "cache_write"):
        cols[c] = F.greatest(f"o_{c}", f"n_{c}")
    return j.select([cols[c].alias(c) for c in CHAT_COLUMNS])


def live_delta(events: DataFrame) -> DataFrame:
    """Events of one batch -> per-session delta, in (ts, id) arrival order:
    sums, first and last ts, last non-blank model, last positive context size
    (else the first event's)."""
    order = F.struct("ts", "id")
    return events.groupBy("session").agg(
        F.sum(z("input")).cast("long").alias("total_input"),
        F.sum(z("output")).cast("long").alias("total_output"),
        F.sum(z("cache_read")).cast("long").alias("cache_read"),
        F.sum(z("cache_write")).cast("long").alias("cache_write"),
        F.min_by("ts", order).alias("first_ts"),
        F.max_by("ts", order).alias("last_ts"),
        F.max_by("model", F.when(~blank("model"), order)).alias("last_model"),
        F.min_by("model", order).alias("first_model"),
        F.max_by("ctx_size", F.when(F.col("ctx_size") > 0, order)).alias("last_ctx"),
        F.min_by("ctx_size", order).alias("first_ctx"),
    )


def upsert_additive(chats: DataFrame, events: DataFrame) -> DataFrame:
    """Live policy, one event at a time in (ts, id) order: totals += event;
    last_ts = event ts; model replaced when the event's is non-blank;
    ctx_size replaced when the event's is positive; first_ts and title kept.
    ``events`` needs session, ts, id, model, ctx_size and the four counts."""
    if "ctx_size" not in events.columns:
        events = events.withColumn("ctx_size", context_size())
    d = live_delta(events)
    j = _outer(chats.select(*CHAT_COLUMNS), d)
    hn, ho = _sides()
    new_model = F.coalesce("n_last_model", "n_first_model")
    new_ctx = F.coalesce("n_last_ctx", "n_first_ctx")
    cols = {
        "session": F.coalesce("n_session", "o_session"),
        "title": _pick(hn, ho, F.col("o_title"), F.lit(""), F.col("o_title")),
        "model": _pick(hn, ho, F.coalesce("n_last_model", "o_model"), new_model, F.col("o_model")),
        "ctx_size": _pick(hn, ho, F.coalesce("n_last_ctx", "o_ctx_size"), new_ctx, F.col("o_ctx_size")),
        "first_ts": _pick(hn, ho, F.col("o_first_ts"), F.col("n_first_ts"), F.col("o_first_ts")),
        "last_ts": _pick(hn, ho, F.col("n_last_ts"), F.col("n_last_ts"), F.col("o_last_ts")),
    }
    for c in ("total_input", "total_output", "cache_read", "cache_write"):
        cols[c] = _pick(hn, ho, z(f"o_{c}") + z(f"n_{c}"), F.col(f"n_{c}"), F.col(f"o_{c}"))
    return j.select([cols[c].alias(c) for c in CHAT_COLUMNS])


def evolve_schema(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union of a table written before the cache columns existed with one
    written after; missing cache values read as 0."""
    u = old.unionByName(new, allowMissingColumns=True)
    for c in CACHE_COLUMNS:
        if c not in u.columns:
            u = u.withColumn(c, F.lit(0).cast("long"))
    return u.fillna(0, subset=list(CACHE_COLUMNS))


# ---- order-independent form of the live policy, for streams -----------------
# Keys (ts, id) of the events that set last_ts, model and ctx_size are kept with
# the rollup, so batches may be merged in any order: the result equals applying
# the events one by one in (ts, id) order, which is the arrival order of live
# events (each is stamped when it arrives).
KEY = "struct<ts:bigint,id:bigint>"
LIVE_KEYS = ("k_first", "k_last", "k_model", "k_ctx")


def keyed_delta(events: DataFrame) -> DataFrame:
    """Per-session delta of a batch with the keys of the deciding events."""
    if "ctx_size" not in events.columns:
        events = events.withColumn("ctx_size", context_size())
    k = F.struct(F.col("ts").cast("long").alias("ts"), F.col("id").cast("long").alias("id"))
    nb, pos = ~blank("model"), F.col("ctx_size") > 0
    return events.groupBy("session").agg(
        F.sum(z("input")).cast("long").alias("total_input"),
        F.sum(z("output")).cast("long").alias("total_output"),
        F.sum(z("cache_read")).cast("long").alias("cache_read"),
        F.sum(z("cache_write")).cast("long").alias("cache_write"),
        F.min(k).alias("k_first"), F.max(k).alias("k_last"),
        F.max(F.when(nb, k)).alias("k_model"), F.max(F.when(pos, k)).alias("k_ctx"),
        F.min_by("model", k).alias("first_model"), F.max_by("model", F.when(nb, k)).alias("last_model"),
        F.min_by("ctx_size", k).alias("first_ctx"), F.max_by("ctx_size", F.when(pos, k)).alias("last_ctx"),
    ).select(
        "session", F.lit("").alias("title"),
        F.coalesce("last_model", "first_model").alias("model"),
        F.coalesce("last_ctx", "first_ctx").alias("ctx_size"),
        F.col("k_first.ts").alias("first_ts"), F.col("k_last.ts").alias("last_ts"),
        "total_input", "total_output", "cache_read", "cache_write", *LIVE_KEYS)


def merge_keyed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Merge two keyed rollups (commutative, associative)."""
    j = _outer(old, new)
    hn, ho = _sides()

    def later(key: str) -> Column:      # new side decides `key`
        return F.col(f"n_{key}").isNotNull() & (F.col(f"o_{key}").isNull() | (F.col(f"n_{key}") > F.col(f"o_{key}")))

    def by(key: str, c: str) -> Column:
        return F.when(later(key), F.col(f"n_{c}")).otherwise(F.col(f"o_{c}"))

    first_new = F.col("n_k_first") < F.col("o_k_first")
    model = F.when(F.col("n_k_model").isNull() & F.col("o_k_model").isNull(),
                   F.when(first_new, F.col("n_model")).otherwise(F.col("o_model"))).otherwise(by("k_model", "model"))
    ctx = F.when(F.col("n_k_ctx").isNull() & F.col("o_k_ctx").isNull(),
                 F.when(first_new, F.col("n_ctx_size")).otherwise(F.col("o_ctx_size"))).otherwise(by("k_ctx", "ctx_size"))
    cols = {
        "session": F.coalesce("n_session", "o_session"),
        "title": F.coalesce("o_title", "n_title"),
        "model": _pick(hn, ho, model, F.col("n_model"), F.col("o_model")),
        "ctx_size": _pick(hn, ho, ctx, F.col("n_ctx_size"), F.col("o_ctx_size")),
        "first_ts": _pick(hn, ho, F.when(first_new, F.col("n_first_ts")).otherwise(F.col("o_first_ts")),
                          F.col("n_first_ts"), F.col("o_first_ts")),
        "last_ts": _pick(hn, ho, by("k_last", "last_ts"), F.col("n_last_ts"), F.col("o_last_ts")),
        "k_first": F.least("o_k_first", "n_k_first"),
        "k_last": F.greatest("o_k_last", "n_k_last"),
        "k_model": F.greatest("o_k_model", "n_k_model"),
        "k_ctx": F.greatest("o_k_ctx", "n_k_ctx"),
    }
    for c in ("total_input", "total_output", "cache_read", "cache_write"):
        cols[c] = z(f"o_{c}") + z(f"n_{c}")
    order = CHAT_COLUMNS + list(LIVE_KEYS)
    return j.select([cols[c].alias(c) for c in order])


def fold_keyed(rows: DataFrame) -> DataFrame:
    """Any number of keyed rows a session -> one, as merging them pair by pair
    with ``merge_keyed``; partial sums in every task, so a hot session is as
    cheap as any."""
    g = rows.groupBy("session").agg(
        F.first("title", ignorenulls=True).alias("title"),
        F.max_by("model", "k_model").alias("m_last"), F.min_by("model", "k_first").alias("m_first"),
        F.max_by("ctx_size", "k_ctx").alias("c_last"), F.min_by("ctx_size", "k_first").alias("c_first"),
        F.min_by("first_ts", "k_first").alias("first_ts"), F.max_by("last_ts", "k_last").alias("last_ts"),
        *[F.sum(z(c)).cast("long").alias(c) for c in ("total_input", "total_output", "cache_read", "cache_write")],
        F.min("k_first").alias("k_first"), F.max("k_last").alias("k_last"),
        F.max("k_model").alias("k_model"), F.max("k_ctx").alias("k_ctx"))
    # rows without a deciding event hold their first event's value
    g = (g.withColumn("model", F.when(F.col("k_model").isNotNull(), F.col("m_last")).otherwise(F.col("m_first")))
          .withColumn("ctx_size", F.when(F.col("k_ctx").isNotNull(), F.col("c_last")).otherwise(F.col("c_first"))))
    return g.select(*CHAT_COLUMNS, *LIVE_KEYS)
