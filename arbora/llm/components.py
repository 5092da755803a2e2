"""Connected components by alternating large-star and small-star contraction.

Every round is two joins on a node's smallest neighbour and is written to the
shared folder, so lineage stays short and a lost executor costs one round.
Minima are pre-aggregated before the shuffle and the joins are left to adaptive
skew splitting, so a node with very many neighbours is no hot spot.  Rounds
grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from arbora.llm import storage


def _least(pairs: DataFrame) -> DataFrame:
    # The arithmetic makes the join exchange both sides anew, without which a hot node's rows could not be split.
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.expr("u ^ 0L").alias("w"), "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("w", F.least("w", "m").alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("w")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = down.join(_least(down), F.col("u") == F.col("w"))
    moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(joined.where("v = m").select("u", F.col("m").alias("v"))).distinct()


def _rooted(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, settle: bool = True) -> DataFrame:
    """node, root: the smallest id reachable from every node that has an edge to another one.

    Without ``settle`` it stops after ``rounds``: a node's roots are then in its component, but it may have several.
    """
    spark = edges.sparkSession
    now, path, before = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v"), None, None
    for _ in range(rounds):
        seen = Observation()
        sums = F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0)).alias("h")
        following, new = storage.materialize(_small_star(_large_star(now)).observe(seen, *sums), "stars")
        if path:
            storage.drop(spark, path)
        now, path = following, new
        state = seen.get
        if state == before:
            break
        before = state
    else:
        if not settle:
            return _rooted(now)
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return _rooted(now)
