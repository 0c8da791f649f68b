from pyspark.sql import functions as F

from tokentally.functions import (bar_filled, bar_level, bar_zones, cost_cents, dot_height,
                                  duration_text, humanize, iso_to_epoch, model_family, title_display)

AS_OF = 1706659200


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_family_rules(spark):
    cases = {"x-haiku-opus": "opus", "OPUS-1": "sonnet", "": "sonnet", "m-haiku-3": "haiku",
             "sonnet-4": "sonnet", "whatever": "sonnet"}
    for name, fam in cases.items():
        assert one(spark, model_family(F.lit(name))) == fam
    assert one(spark, model_family(F.lit(None).cast("string"))) == "sonnet"


def test_cost_truncation(spark):
    # 3333 * 300 / 1e6 = 0.9999 cents -> 0
    assert one(spark, cost_cents(F.lit("m-sonnet"), F.lit(3333), F.lit(0), F.lit(0), F.lit(0))) == 0
    # opus: 1M input = 1500 cents, 1M output = 7500, 1M cache read = 150, 1M cache write = 1875
    assert one(spark, cost_cents(F.lit("opus"), F.lit(10**6), F.lit(10**6), F.lit(10**6), F.lit(10**6))) == 11025
    # NULL cache counts are 0
    assert one(spark, cost_cents(F.lit("haiku"), F.lit(10**6), F.lit(0), F.lit(None), F.lit(None))) == 80


def test_humanize(spark):
    for n, long_, short in [(999, "999", "999"), (1000, "1k", "1k"), (999999, "999k", "999k"),
                            (1290000, "1.2M", "1M"), (0, "0", "0")]:
        assert one(spark, humanize(F.lit(n))) == long_
        assert one(spark, humanize(F.lit(n), 0)) == short


def test_duration(spark):
    for d, txt in [(59, "59s"), (60, "1m"), (3599, "59m"), (3600, "1h0m"), (90061, "25h1m")]:
        assert one(spark, duration_text(F.lit(d))) == txt


def test_title(spark):
    assert one(spark, title_display(F.lit("a" * 30))) == "a" * 30
    assert one(spark, title_display(F.lit("b" * 31))) == "b" * 27 + "..."
    assert one(spark, title_display(F.lit(""))) == "(untitled)"


def test_context_bar(spark):
    f = one(spark, bar_filled(F.lit(55), 30))
    assert f == 17
    g, y, r = bar_zones(F.lit(f), 30)
    assert (one(spark, g), one(spark, y), one(spark, r)) == (15, 2, 0)
    assert one(spark, bar_filled(F.lit(250), 30)) == 30
    g, y, r = bar_zones(F.lit(30), 30)
    assert (one(spark, g), one(spark, y), one(spark, r)) == (15, 7, 8)


def test_dots_and_levels(spark):
    assert one(spark, dot_height(F.lit(1), F.lit(1000))) == 1
    assert one(spark, dot_height(F.lit(0), F.lit(1000))) == 0
    assert one(spark, dot_height(F.lit(1000), F.lit(1000))) == 16
    assert one(spark, bar_level(F.lit(999), F.lit(1000))) == 6
    assert one(spark, bar_level(F.lit(1000), F.lit(1000))) == 7


def test_iso_parse(spark):
    assert one(spark, iso_to_epoch(F.lit("2024-01-31T00:00:00.123Z"), 5)) == AS_OF
    assert one(spark, iso_to_epoch(F.lit("2024-01-31T00:00:00Z"), 5)) == AS_OF
    assert one(spark, iso_to_epoch(F.lit("not a time"), 5)) == 5
    assert one(spark, iso_to_epoch(F.lit(None).cast("string"), 5)) == 5


def test_scale_conf_sizes_partitions():
    from tokentally.session import scale_conf
    c = scale_conf(100 * 2**40, 8000)
    assert int(c["spark.sql.shuffle.partitions"]) == 131072     # 25 TB / 200 MB
    assert scale_conf(10**6, 8)["spark.sql.shuffle.partitions"] == "24"
