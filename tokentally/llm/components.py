"""Connected components of a link table in Spark.

Alternating large-star and small-star steps on (u, v) edges with v the smaller
node; the number of rounds grows with the logarithm of the largest component.
Every round is a written table, so nothing is kept on one executor, and no
neighbour list is gathered: minima are aggregates joined back to the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokentally.llm.sources import materialize


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("c"), F.least("u", "low").alias("m"))
    return (both.join(least, F.col("u") == F.col("c")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct())


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c")
    j = e.join(least, F.col("u") == F.col("c"))
    return (j.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            .unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct())


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links(a, b)``; root is the least node of the component."""
    e = (links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    e = materialize(e, "links")
    seen = None
    while True:
        e = materialize(_small_star(_large_star(e)), "links")
        # order-free fingerprint of the edge set: two numbers
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
