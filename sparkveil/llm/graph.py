"""Connected components by alternating large-star and small-star rounds, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, hot_keys, new_path, remove, saved_at, split_join


def _to_least(edges: DataFrame, least: DataFrame, split: int | None) -> DataFrame:
    """edges(u, v) with m, the least neighbour of u. With split, nodes of over `split` edges are cut into parts."""
    hot = hot_keys(least, "u", "n", split) if split else None
    return split_join(edges, least.drop("n"), "u", ["v"], hot)


def _large(edges: DataFrame, split: int | None) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return _to_least(both.where("v > u"), least, split).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame, split: int | None) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    linked = _to_least(down, least, split)
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, split: int = HOT_ROWS) -> tuple[DataFrame, str]:
    """edges(u, v) of any orderable type -> (node, root) and the folder that holds it: root is the least node of the component.

    Nodes without an edge do not appear. Each round is written to the shared folder and the
    one before it deleted; links never reach the driver, only their count and a checksum do. Rounds go on until
    nothing changes, which takes a number of them that grows with the square of the logarithm of the nodes at most. A node
    can have over `split` edges only where there are that many, so smaller rounds do not look for such nodes.
    Repeated edges and loops (u = v) change nothing; an empty input gives an empty result.
    """
    spark = edges.sparkSession
    path = new_path(spark, "components")
    now = saved_at(edges.where("u <> v").select("u", "v").distinct(), path)
    state = None
    while True:
        n = state[0] if state else now.count()
        large = split if 2 * n > split else None
        after = new_path(spark, "components")
        nxt = saved_at(_small(_large(now, large), large), after)
        found = tuple(nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        remove(spark, path)
        now, path = nxt, after
        if found == state or not found[0]:
            break
        state = found
    star = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return star.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), path
