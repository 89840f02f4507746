"""What was in force at a time: each row with the last setting of its key before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of one stretch of a key's time that one task sees together.
STRETCH = 86_400


def in_force(rows: DataFrame, settings: DataFrame, by: str, ts: str, value: Column, out: str, tie: Column | None = None, valid: Column | float | None = None, stretch: int = STRETCH) -> DataFrame:
    """rows with `out`: `value` of the last row of settings with the same `by` and a `ts` that is not later; null if there is none, or if it is older than `valid` seconds.

    Rows and settings are put together and ordered within stretches of each key's time, so no row meets more than it needs, and a key with a third of all rows is
    as many pieces of work as it has stretches. The last setting of each stretch is carried to the next ones in a window over
    stretches, a table of one row for each key and stretch. Of settings at one time the one with the greatest `tie` counts. Rows with a null
    key or time have a null result; settings with one count for nothing. All columns of rows are kept; one named `out` is replaced.
    """
    names = [c for c in rows.columns if c != out]
    packed = F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row")
    left = rows.select(packed, F.col(by).alias("_by"), F.col(ts).alias("_ts"), F.lit(1).alias("_side"))
    known = F.col(by).isNotNull() & F.col(ts).isNotNull()
    right = settings.where(known).select(F.col(by).alias("_by"), F.col(ts).alias("_ts"), F.lit(0).alias("_side"), (F.lit(0) if tie is None else tie).alias("_tie"), F.struct(F.col(ts).alias("since"), value.alias("value")).alias("_set"))
    both = left.where(F.col("_by").isNotNull() & F.col("_ts").isNotNull()).unionByName(right, allowMissingColumns=True)
    both = both.withColumn("_stretch", F.floor(F.unix_seconds(F.col("_ts").cast("timestamp")) / stretch))
    # the setting with which each stretch ends, and so the one with which the next begin
    ends = both.groupBy("_by", "_stretch").agg(F.max_by("_set", F.when(F.col("_side") == 0, F.struct("_ts", "_tie"))).alias("_end"))
    before = Window.partitionBy("_by").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    begins = ends.select(F.col("_by").alias("_of"), F.col("_stretch").alias("_in"), F.last("_end", ignorenulls=True).over(before).alias("_begin"))
    so_far = Window.partitionBy("_by", "_stretch").orderBy("_ts", "_side", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = both.withColumn("_here", F.last("_set", ignorenulls=True).over(so_far)).where("_side = 1")
    met = placed.join(begins, (F.col("_by") == F.col("_of")) & (F.col("_stretch") == F.col("_in"))).withColumn("_now", F.coalesce("_here", "_begin"))
    fresh = F.lit(True) if valid is None else F.unix_micros(F.col("_ts").cast("timestamp")) - F.unix_micros(F.col("_now.since").cast("timestamp")) <= ((valid if isinstance(valid, Column) else F.lit(valid)).cast("double") * 1_000_000.0)
    found = met.select("_row", F.when(fresh, F.col("_now.value")).alias("_out"))
    rest = left.where(F.col("_by").isNull() | F.col("_ts").isNull()).select("_row", F.lit(None).cast(found.schema["_out"].dataType).alias("_out"))
    return found.unionByName(rest).select(*(F.col("_row").getField(c).alias(c) for c in names), F.col("_out").alias(out))
