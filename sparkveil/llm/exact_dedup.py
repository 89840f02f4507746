"""Exact de-duplication by skew-safe combining.

1. Local: each map task combines its own equal texts (partial aggregation on digest and full text).
2. Salted: what is left meets by (digest, text, salt); a group that holds a third of all rows
   arrives as at most one row per map task, spread over SALTS reducers.
3. Global: the winners of the salts meet by (digest, text).
Every stage has the whole normalised text in its grouping key, so a digest never stands in for
content. Members then find their group by digest if no digest turned out to have two contents
(checked, not assumed); otherwise by digest and text. Groups of more than HOT_ROWS rows are cut into parts for that join.

Null text counts as empty. Null doc_ids sort last: they stay only in groups without another id.
Rows repeated with the same id and text count in group_size, and one of them stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_ROWS, hot_keys, saved, split_join

SALTS = 8


def normalised(text: Column) -> Column:
    """Each run of space, tab, LF, VT, FF, CR becomes one space; lone spaces are left as they are."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x09-\\x0D][\\x20\\x09-\\x0D]*|\\x20[\\x20\\x09-\\x0D]+", " ")


def sha256(norm: Column) -> Column:
    return F.sha2(norm, 256)


def _keyed(docs: DataFrame, text: str, digest) -> DataFrame:
    return docs.withColumn("_norm", normalised(F.col(text))).withColumn("_sha", digest(F.col("_norm")))


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = SALTS, digest=sha256) -> tuple[DataFrame, list[str]]:
    """One row per different text, and the columns by which a row finds its group.

    The rows have _sha, _keep (least id) and _size, are written to the shared folder once, and
    are found by digest. If two contents share a digest the rows also keep _norm and are found by both.
    """
    keyed = _keyed(docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")), "_text", digest).withColumn("_salt", F.spark_partition_id() % salts)
    salted = keyed.groupBy("_sha", "_norm", "_salt").agg(F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
    merged = salted.groupBy("_sha", "_norm").agg(F.min("_keep").alias("_keep"), F.sum("_size").alias("_size"))
    found = saved(merged.select("_sha", "_keep", "_size"), "dedup-groups")
    clash = found.groupBy("_sha").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").limit(1).count()
    return (merged, ["_sha", "_norm"]) if clash else (found, ["_sha"])


def decisions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest=sha256, split: int = HOT_ROWS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    found, on = groups(docs, doc_id, text, digest=digest)
    light = _keyed(docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")), "_text", digest).groupBy(*on, "_id").agg(F.count(F.lit(1)).alias("_copies"))
    met = split_join(light, found, "_sha", ["_id"], hot_keys(found, "_sha", "_size", split)) if on == ["_sha"] else light.join(found, on)
    rows = met.withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return rows.select(F.col("_id").alias("doc_id"), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), (F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_nth") == 1)).alias("kept"), F.col("_sha").alias("text_sha256"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest=sha256) -> DataFrame:
    """The rows that stay, with all their columns."""
    found, on = groups(docs, doc_id, text, digest=digest)
    names = docs.columns
    packed = _keyed(docs.select(F.struct(*docs.columns).alias("_row"), F.col(doc_id).alias("_id"), F.col(text).alias("_text")), "_text", digest)
    same = [packed[c] == found[c] for c in on]
    first = Window.partitionBy(*(packed[c] for c in on), packed["_id"]).orderBy(F.lit(1))
    kept = packed.join(found, [*same, packed["_id"].eqNullSafe(found["_keep"])]).withColumn("_nth", F.row_number().over(first)).where("_nth = 1")
    return kept.select(*(F.col("_row").getField(c).alias(c) for c in names))
