"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is one partially aggregated minimum and one join, so that neither a hub nor a large component meets in
one task; each round's edges are written, which ends the lineage. Edges shrink to stars in a logarithmic number
of rounds; the driver sees only counts and checksums.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import materialize, release, written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")


def _large_star(edges: DataFrame) -> DataFrame:
    pairs = _both_ways(edges)
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return pairs.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("w"), "m")
    moved = edges.join(least, F.col("a") == F.col("w")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").unionByName(least.select(F.col("w").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, root): root is the least node that edges reach; nodes without an edge are absent."""
    now = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    now, mark = materialize(now, "edges"), None
    for _ in range(rounds):
        since = written()
        now = materialize(_small_star(_large_star(now).distinct()), "edges")
        release(since - 1, now)  # the round before
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = seen
    raise RuntimeError(f"components did not settle in {rounds} rounds")
