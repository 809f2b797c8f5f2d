"""Connected components of an undirected graph of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize, release


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): every node that occurs in `edges` with the smallest node of its component.

    Alternating star contraction: each round hangs every node and its larger neighbours on the smallest one, which halves
    long paths, so the rounds grow with the logarithm of the longest path. Loops, repeated edges and both directions are
    allowed; edges with a NULL end are left out; an empty table gives no rows. Rounds are written to the shared folder, so
    the lineage stays short and lost executors are recovered from there; a round that is superseded is removed. Stars are combined on the map side.
    """
    clean = materialize(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL"), "edges")
    nodes = clean.select(F.col("u").alias("node")).union(clean.select("v")).distinct()
    star = materialize(clean.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    size = None
    for _ in range(rounds):
        # large star: larger neighbours of each node move to its smallest neighbour
        both = star.union(star.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: each node and its smaller neighbours move to the smallest of them
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        before, star = star, materialize(small, "edges")
        release(before)
        now = tuple(star.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == size:
            break
        size = now
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return nodes.join(star.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
