"""Shared helpers: cut lineage in the shared folder, rank rows without one big task."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import shared_dir

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Rows of one key that one task may take in a join.
HOT_ROWS = 1_000_000
WHITE = "[\\x20\\x09-\\x0D]+"


def on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package even if the driver was started elsewhere."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (env.get("PYTHONPATH", ""), ROOT) if x)


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def saved(df: DataFrame, tag: str) -> DataFrame:
    """Write df once as a table in the shared folder and read it back: lineage ends here and lost executors cost nothing."""
    return saved_at(df, new_path(df.sparkSession, tag))


def saved_at(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def hot_keys(counts: DataFrame, key: str, n: str, split: int) -> DataFrame | None:
    """_key and _parts of the keys with over `split` rows, given a table of counts; None if there are none.

    There are at most rows / split such keys, so their table is what may be broadcast.
    """
    hot = counts.where(F.col(n) > split).select(F.col(key).alias("_key"), F.ceil(F.col(n) / split).cast("int").alias("_parts"))
    return F.broadcast(hot) if hot.limit(1).count() else None


def split_join(many: DataFrame, one: DataFrame, key: str, spread: list[str], hot: DataFrame | None) -> DataFrame:
    """Inner join by `key` (null keys meet, too) of many rows to the one row that `one` has for their key, without one task for a hot key.

    The rows of a hot key are cut into parts by a hash of the columns `spread`, and its row in `one` is repeated for each part.
    """
    rest = [c for c in one.columns if c != key]
    one = one.select(F.col(key).alias("_to"), *rest)
    same = F.col(key).eqNullSafe(F.col("_to"))
    if hot is None:
        return many.join(one, same).drop("_to")
    parts = many.join(hot, F.col(key).eqNullSafe(F.col("_key")), "left")
    parts = parts.withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_parts")).cast("int"), F.lit(0))).drop("_key", "_parts")
    copies = one.join(hot, F.col("_to").eqNullSafe(F.col("_key")), "left").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))).drop("_key", "_parts")
    return parts.join(copies, same & (F.col("_part") == F.col("_copy"))).drop("_to", "_part", "_copy")


def gapless_rank(df: DataFrame, group: str, order: list[Column], chunk: Column, out: str, chunks: int) -> DataFrame:
    """Number the rows of each group 0, 1, 2, ... without one task per group.

    chunk (0 .. chunks-1) cuts each group into parts; rows are numbered inside a part and
    shifted by the sizes of the parts before it. The table of part sizes has at most
    groups x chunks rows, so it is what the last join may broadcast.
    """
    df = df.withColumn("_chunk", chunk)
    sizes = df.groupBy(group, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(group, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(group, "_chunk").orderBy(*order)))
    joined = ranked.join(sizes, [group, "_chunk"])
    return joined.withColumn(out, (F.col("_before") + F.col("_rank") - 1).cast("long")).drop("_chunk", "_before", "_rank")
