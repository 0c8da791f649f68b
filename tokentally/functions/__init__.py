"""Scalar functions: every one is a native Column expression."""

from tokentally.functions.formatting import duration_text, humanize, session_prefix, title_display
from tokentally.functions.gauges import (bar_filled, bar_level, bar_zones, context_pct,
                                         context_size, dot_height)
from tokentally.functions.pricing import (blank, cost_cents, cost_cents_ex_cache,
                                          idiv, model_family, price_of, price_table)
from tokentally.functions.timeparse import epoch_of_ntz, iso_to_epoch

__all__ = [
    "bar_filled", "bar_level", "bar_zones", "blank", "context_pct",
    "context_size", "cost_cents", "cost_cents_ex_cache", "dot_height", "duration_text",
    "epoch_of_ntz", "humanize", "idiv", "iso_to_epoch", "model_family", "price_of",
    "price_table", "session_prefix", "title_display",
]
