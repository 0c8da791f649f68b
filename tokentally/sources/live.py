"""Decode live usage events (one JSON object per model response)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokentally.constants import DEFAULT_CONTEXT_SIZE, LIVE_DISPLAY_DEFAULT
from tokentally.functions.gauges import context_pct
from tokentally.sources.schemas import LIVE_EVENT


def decode_events(raw: DataFrame, value_col: str = "value") -> DataFrame:
    """Parse the JSON text and apply the defaults of the live recorder.

    display name '?' and id '' when missing; context size 200000 when
    missing; token counts 0 when missing, and all four 0 when the whole
    ``current_usage`` object is null.  ``ctx_pct`` = (in+cw+cr)*100 div size.
    Other input columns are kept.
    """
    keep = [c for c in raw.columns if c != value_col]
    # parse each document exactly once: ``inline`` of a one-element array is
    # a Generate, which neither the per-field JSON schema pruning nor the
    # filters of later steps are pushed through (either would re-parse)
    parsed = raw.select(*keep, F.inline(F.array(F.from_json(F.col(value_col), LIVE_EVENT))))
    return decode_records(parsed, keep)


def decode_records(parsed: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Defaults of the live recorder applied to parsed events (columns
    ``model`` and ``context_window`` as in ``LIVE_EVENT``), e.g. from
    ``spark.read.schema(LIVE_EVENT).json(path)`` or a JSON file stream."""
    keep = [c for c in parsed.columns if c not in ("model", "context_window")] if keep is None else keep
    u = F.col("context_window.current_usage")
    zero = F.lit(0).cast("long")

    def tok(name: str) -> Column:
        return F.when(u.isNull(), zero).otherwise(F.coalesce(u[name], zero))

    size = F.coalesce(F.col("context_window.context_window_size"), F.lit(DEFAULT_CONTEXT_SIZE).cast("long"))
    out = parsed.select(
        *keep,
        F.coalesce(F.col("model.display_name"), F.lit(LIVE_DISPLAY_DEFAULT)).alias("display_name"),
        F.coalesce(F.col("model.id"), F.lit("")).alias("model"),
        size.alias("ctx_size"),
        tok("input_tokens").alias("input"),
        tok("output_tokens").alias("output"),
        tok("cache_read_input_tokens").alias("cache_read"),
        tok("cache_creation_input_tokens").alias("cache_write"),
    )
    return out.withColumn("ctx_pct", F.coalesce(
        context_pct("input", "cache_write", "cache_read", "ctx_size"), zero))


def _event_doc(usage: DataFrame, envelope: bool):
    fam_name = F.initcap(F.regexp_extract("model", r"(opus|sonnet|haiku|other)", 1))
    model = F.when(F.col("model") != "", F.struct(fam_name.alias("display_name"), F.col("model").alias("id")))
    usage_obj = F.struct(
        F.col("input").alias("input_tokens"),
        F.col("output").alias("output_tokens"),
        F.when(F.col("cache_read") != 0, F.col("cache_read")).alias("cache_read_input_tokens"),
        F.when(F.col("cache_write") != 0, F.col("cache_write")).alias("cache_creation_input_tokens"),
    )
    allzero = (F.col("input") == 0) & (F.col("output") == 0) & (F.col("cache_read") == 0) & (F.col("cache_write") == 0)
    cw = F.struct(F.lit(DEFAULT_CONTEXT_SIZE).cast("long").alias("context_window_size"),
                  F.when(~allzero, usage_obj).alias("current_usage"))
    head = [F.col("id").alias("id"), F.col("ts").alias("ts")] if envelope else []
    return F.to_json(F.struct(*head, model.alias("model"), cw.alias("context_window")))


def encode_events(usage: DataFrame) -> DataFrame:
    """Usage rows -> live JSON text (the inverse used by tests and streams).

    Rows of blank model omit the ``model`` object; zero cache counts are
    omitted; rows whose four counts are all zero send ``current_usage`` null.
    """
    return usage.select("id", "ts", _event_doc(usage, False).alias("value"))


def encode_enveloped(usage: DataFrame) -> DataFrame:
    """Usage rows -> JSON lines with the collector's ``id`` and ``ts``."""
    return usage.select(_event_doc(usage, True).alias("value"))
