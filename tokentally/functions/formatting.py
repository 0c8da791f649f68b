"""Text forms of numbers, durations and titles (native Columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokentally.constants import TITLE_KEEP, TITLE_MAX, UNTITLED
from tokentally.functions.pricing import col_, idiv


def humanize(n, decimals: int = 1) -> Column:
    """<1000 as is; <1e6 whole thousands + 'k'; else millions + 'M'.

    ``decimals=1`` keeps one truncated decimal for millions (``1.2M``);
    ``decimals=0`` gives whole millions (``1M``).
    """
    v = col_(n).cast("long")
    s = lambda c: c.cast("string")
    if decimals:
        millions = F.concat(s(idiv(v, 1000000)), F.lit("."), s(idiv(v, 100000) % 10), F.lit("M"))
    else:
        millions = F.concat(s(idiv(v, 1000000)), F.lit("M"))
    return (F.when(v < 1000, s(v))
             .when(v < 1000000, F.concat(s(idiv(v, 1000)), F.lit("k")))
             .otherwise(millions))


def duration_text(seconds) -> Column:
    """<60 -> 'Ns'; <3600 -> 'Nm'; else 'HhMm' (no padding, no days)."""
    d = col_(seconds).cast("long")
    s = lambda c: c.cast("string")
    return (F.when(d < 60, F.concat(s(d), F.lit("s")))
             .when(d < 3600, F.concat(s(idiv(d, 60)), F.lit("m")))
             .otherwise(F.concat(s(idiv(d, 3600)), F.lit("h"), s(idiv(d % 3600, 60)), F.lit("m"))))


def title_display(title) -> Column:
    """Longer than 30 characters -> first 27 + '...'; empty -> '(untitled)'."""
    t = F.coalesce(col_(title), F.lit(""))
    return (F.when(F.length(t) > TITLE_MAX, F.concat(F.substring(t, 1, TITLE_KEEP), F.lit("...")))
             .when(t == "", F.lit(UNTITLED))
             .otherwise(t))


def session_prefix(session, k: int) -> Column:
    return F.substring(col_(session), 1, k)
