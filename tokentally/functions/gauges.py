"""Context use, context bar, chart dot heights and bar levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokentally.constants import BAR_LEVELS, DEFAULT_CONTEXT_SIZE, DOT_LEVELS
from tokentally.functions.pricing import col_, idiv, z


def context_size(model=None) -> Column:
    """Context window by model: the same constant for every family."""
    return F.lit(DEFAULT_CONTEXT_SIZE).cast("long")


def context_pct(inp, cache_write, cache_read, ctx_size) -> Column:
    """(input + cache_write + cache_read) * 100 div size; output excluded."""
    size = F.nullif(col_(ctx_size).cast("long"), F.lit(0).cast("long"))
    return idiv((z(inp) + z(cache_write) + z(cache_read)) * 100, size)


def bar_filled(pct, width) -> Column:
    """Cells filled of a ``width``-cell bar: (pct*W+50) div 100, at most W."""
    w = col_(width).cast("long") if isinstance(width, Column) else F.lit(width).cast("long")
    return F.least(idiv(col_(pct).cast("long") * w + 50, 100), w)


def bar_zones(filled, width: int) -> tuple[Column, Column, Column]:
    """Green/yellow/red cell counts: cell i is green if i < W/2, yellow if
    i < 3W/4, else red; only filled cells count."""
    f = col_(filled).cast("long")
    g_end, y_end = width // 2, width * 3 // 4
    green = F.least(f, F.lit(g_end))
    yellow = F.greatest(F.least(f, F.lit(y_end)) - F.lit(g_end), F.lit(0))
    red = F.greatest(f - F.lit(y_end), F.lit(0))
    return green.cast("long"), yellow.cast("long"), red.cast("long")


def dot_height(v, vmax, levels: int = DOT_LEVELS) -> Column:
    """ceil(v*levels/max) clamped to ``levels``; zero stays zero."""
    val = col_(v).cast("long")
    mx = col_(vmax).cast("long")
    h = F.least(idiv(val * levels + mx - 1, mx), F.lit(levels).cast("long"))
    return F.when(val > 0, h).otherwise(F.lit(0).cast("long"))


def bar_level(v, vmax, levels: int = BAR_LEVELS) -> Column:
    """v*7 div max clamped to 7 (eight block glyphs)."""
    return F.least(idiv(col_(v).cast("long") * levels, col_(vmax)), F.lit(levels).cast("long"))
