"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, store


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges: a, b (no nulls). Returns node, root: every node of an edge with the smallest node it reaches.

    Each round links every node to the smallest of its neighbours, first its larger neighbours, then itself and the
    smaller ones; the rounds end when all edges lead to roots, after about log(nodes) of them. Rounds are stored, so lost executors cost
    one round. An empty table gives no rows."""
    both = lambda e: e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = store(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(most_rounds):
        near = both(now)
        low = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = near.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x")).select(F.col("x.b").alias("a"), F.col("x.m").alias("b")).where("a <> b").distinct()
        after = store(small, "edges")
        discard(now)
        now = after
        ends = now.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.lit(1).alias("up")), F.struct(F.col("b").alias("v"), F.lit(0).alias("up")))).alias("e")).groupBy("e.v").agg(F.sum("e.up").alias("ups"), F.count("*").alias("n"))
        # done when every node has one edge up or only edges from below
        if ends.where("ups > 1 or (ups = 1 and n > 1)").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return store(now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots), "components")
