"""Model family, price dimension and exact cent costs (native Columns)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentally.constants import DEFAULT_FAMILY, FAMILY_ORDER, PRICE_CENTS_PER_MTOK

TOKEN_CLASSES = ("input", "cache_write", "cache_read", "output")


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def idiv(c, n) -> Column:
    """Integer division truncating toward zero (SQL ``div``), as LONG."""
    other = n if isinstance(n, Column) else F.lit(n)
    return F.call_function("div", col_(c).cast("long"), other.cast("long"))


def blank(c) -> Column:
    """True when a string column is NULL or ''."""
    return F.coalesce(col_(c), F.lit("")) == F.lit("")


def z(c) -> Column:
    """NULL -> 0 as LONG."""
    return F.coalesce(col_(c).cast("long"), F.lit(0).cast("long"))


def model_family(model) -> Column:
    """opus if the name contains 'opus', else haiku if it contains 'haiku',
    else sonnet; case-sensitive; blank and NULL fall to the default."""
    m = F.coalesce(col_(model), F.lit(""))
    expr = None
    for fam in FAMILY_ORDER:
        cond = m.contains(fam)
        expr = F.when(cond, F.lit(fam)) if expr is None else expr.when(cond, F.lit(fam))
    return expr.otherwise(F.lit(DEFAULT_FAMILY))


def price_of(family, kind: str) -> Column:
    """Price (cents per million tokens) of one token class for a family.

    A CASE over three literals stays inside whole-stage codegen and needs no
    join; ``price_table`` offers the same numbers as a dimension table.
    """
    idx = TOKEN_CLASSES.index(kind)
    fam = col_(family)
    expr = None
    for name, prices in PRICE_CENTS_PER_MTOK.items():
        v = F.lit(prices[idx]).cast("long")
        expr = F.when(fam == name, v) if expr is None else expr.when(fam == name, v)
    return expr.otherwise(F.lit(PRICE_CENTS_PER_MTOK[DEFAULT_FAMILY][idx]).cast("long"))


def price_table(spark: SparkSession) -> DataFrame:
    """The price dimension: family and four prices in cents per MTok."""
    from pyspark.sql import types as T

    from tokentally.sources.literal import literal_table
    rows = [(fam, *p) for fam, p in PRICE_CENTS_PER_MTOK.items()]
    schema = T.StructType([T.StructField("family", T.StringType())] +
                          [T.StructField(f"p_{k}", T.LongType()) for k in TOKEN_CLASSES])
    return literal_table(spark, rows, schema)


def cost_cents(model, inp, out, cache_read, cache_write) -> Column:
    """Exact cost in cents of four token counts at ``model``'s prices.

    The metered tool divides with two decimals and truncates; every price is
    a whole number of cents per MTok, so cents = sum(tokens*price) div 1e6.
    Tokens are non-negative, so truncation is the floor.  NULL counts are 0.
    Products are decimals, so no LONG of tokens overflows; cents fit LONG.
    """
    fam = model_family(model)
    return _cents(_priced(inp, fam, "input") + _priced(out, fam, "output")
                  + _priced(cache_read, fam, "cache_read") + _priced(cache_write, fam, "cache_write"))


def _priced(tokens, family: Column, kind: str) -> Column:
    return z(tokens).cast("decimal(19,0)") * price_of(family, kind).cast("decimal(5,0)")


def _cents(total: Column) -> Column:
    return F.call_function("div", total, F.lit(1000000).cast("decimal(8,0)")).cast("long")


def cost_cents_ex_cache(model, inp, out) -> Column:
    """Cost of input and output tokens only (the no-cache variant)."""
    fam = model_family(model)
    return _cents(_priced(inp, fam, "input") + _priced(out, fam, "output"))


def join_prices(df: DataFrame, model_col: str = "model") -> DataFrame:
    """Adds ``family`` and p_input, p_cache_write, p_cache_read, p_output by
    joining the price dimension.  The dimension has one row per family (three
    rows, fixed), so broadcasting it is bounded by construction."""
    prices = price_table(df.sparkSession)
    return df.withColumn("family", model_family(F.col(model_col))).join(F.broadcast(prices), "family", "left")
