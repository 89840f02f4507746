"""Sharding by jump consistent hashing (Lamping and Veach), in Spark expressions only.

A key jumps through bucket numbers: from bucket b the next jump goes to floor((b + 1) / u), with
u uniform in (0, 1] drawn from the key and b. Its shard is the last jump below the shard count,
so shard n + 1 takes 1 / (n + 1) of the keys and no key moves between older shards. Draws come
from xxhash64(key, b), which Spark has as a native expression.

An empty table gives an empty result, and columns beside key and text are not read. A null key is a key like any other. Null text has size 16 and CRC 0. Rows repeated with the same
id and text share a shard and get different slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gapless_rank

SHARDS = 40
CHUNKS = 64


def jump(key: Column, shards: int) -> Column:
    """The shard of key among `shards`, as int. At most `shards` jumps; about ln(shards) do something."""
    draw = lambda at: (F.shiftrightunsigned(F.xxhash64(key, at), 33) + 1).cast("double") / F.lit(float(1 << 31))
    start = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))
    step = lambda s, _: F.when(s["j"] >= shards, s).otherwise(F.struct(s["j"].alias("b"), F.floor((s["j"] + 1) / draw(s["j"])).alias("j")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["b"].cast("int"))


def sharded(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text", chunks: int = CHUNKS) -> DataFrame:
    """key, size, text_crc32, law, shard, slot (0, 1, ... in each shard), grown_shard (the shard among shards + 1)."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("_key"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("shard", jump(F.col("_key"), shards)).withColumn("grown_shard", jump(F.col("_key"), shards + 1))
    ranked = gapless_rank(rows, "shard", [F.col("_key"), F.col("text_crc32"), F.col("size")], F.pmod(F.xxhash64("_key", "text_crc32"), F.lit(chunks)), "slot", chunks)
    return ranked.select(F.col("_key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, key: str = "doc_id") -> None:
    """Write the rows with all their columns as Parquet folders shard=0 .. shard=n-1; a column of that name is written beside, the folder has as many underscores more as it takes."""
    folder = "shard"
    while folder in docs.columns:
        folder = f"_{folder}"
    docs.withColumn(folder, jump(F.col(key), shards)).write.partitionBy(folder).parquet(path)
