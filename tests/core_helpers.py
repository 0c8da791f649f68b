"""Shared by the core tests (a name of its own: other test folders have a conftest too)."""

AS_OF = 1706659200


def usage_df(spark, rows):
    """rows: (id, ts, session, input, output, cache_read, cache_write, model)."""
    from tokentally.sources.schemas import TOKENS
    full = [(i, ts, s, inp, out, cr, cw, 0, m) for (i, ts, s, inp, out, cr, cw, m) in rows]
    return spark.createDataFrame(full, TOKENS)
