"""Epoch seconds <-> text and dates, independent of the session time zone.

Every conversion here is UTC by construction (field arithmetic on
TIMESTAMP_NTZ / DATE values, or text carrying an explicit offset), so results
do not depend on ``spark.sql.session.timeZone``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokentally.functions.pricing import col_, idiv

def _epoch_date() -> Column:
    return F.lit("1970-01-01").cast("date")


def iso_to_epoch(text, as_of: int) -> Column:
    """Drop everything from the first '.', read 'yyyy-MM-ddTHH:mm:ss' as UTC;
    missing or unparsable text gives ``as_of`` (the fallback is 'now')."""
    t = F.substring_index(F.coalesce(col_(text), F.lit("")), ".", 1)
    # keep at most the 19 characters of the pattern; a trailing zone marker
    # without a fraction would otherwise fail the parse
    t = F.substring(t, 1, 19)
    ts = F.try_to_timestamp(F.concat(t, F.lit("+00:00")), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))
    return F.coalesce(F.unix_seconds(ts), F.lit(as_of).cast("long"))


def epoch_of_ntz(ts) -> Column:
    """Whole epoch seconds of a TIMESTAMP_NTZ column, read as UTC."""
    c = col_(ts)
    days = F.datediff(F.to_date(c), _epoch_date()).cast("long")
    return days * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def epoch_date(epoch) -> Column:
    """UTC calendar date of epoch seconds."""
    days = F.floor(col_(epoch).cast("long") / F.lit(86400)).cast("int")
    return F.date_add(_epoch_date(), days)


def epoch_to_iso(epoch, millis: bool = True) -> Column:
    """'yyyy-MM-ddTHH:mm:ss[.000]Z' (UTC) of epoch seconds."""
    e = col_(epoch).cast("long")
    sod = e - F.floor(e / F.lit(86400)).cast("long") * 86400
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(F.date_format(epoch_date(e), "yyyy-MM-dd"), F.lit("T"),
                    two(idiv(sod, 3600)), F.lit(":"), two(idiv(sod % 3600, 60)), F.lit(":"), two(sod % 60),
                    F.lit(".000Z" if millis else "Z"))
