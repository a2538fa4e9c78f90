"""Connected components of a graph held as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import _shared


def components(spark: SparkSession, links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component: the smallest node reachable, for every node of ``links`` (columns a, b, both long).

    Alternating stars: each round hangs every node's larger neighbours, then its smaller ones, on the smallest it knows. The rows
    never outnumber the links, sums and minima combine before the shuffle, and each round is written, so nothing recomputes far
    back. Links to oneself only name a node.
    """
    named = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    edges = _shared.table(spark, links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = None
    for _ in range(most_rounds):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = _shared.table(spark, small.where("u <> v").distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    found = edges.groupBy("u").agg(F.min("v").alias("component"))
    return named.join(found, named["node"] == found["u"], "left").select("node", F.coalesce("component", "node").alias("component"))
