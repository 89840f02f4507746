"""Sinks: atomic configuration saves with a bounded history, JSON lines, idempotent streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEPT = 40


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def save_text(spark: SparkSession, path: str, text: str, history: str | None = None, stamp: str | None = None, kept: int = KEPT) -> None:
    """Write beside `path`, copy what is there to history under its stamp, rename over it, and drop all but the newest `kept` of the history.

    There is a whole file at `path` at any time, the old one or the new one, where the file system can rename over a file.
    """
    at, fs = _fs(spark, path)
    fresh, _ = _fs(spark, path + ".tmp")
    hadoop = spark._jvm.org.apache.hadoop
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = fs.create(fresh, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if history and stamp and fs.exists(at):
        old, _ = _fs(spark, f"{history}/{stamp}.json")
        fs.mkdirs(old.getParent())
        hadoop.fs.FileUtil.copy(fs, at, fs, old, False, True, conf)
    replace = spark.sparkContext._gateway.new_array(hadoop.fs.Options.Rename, 1)
    replace[0] = hadoop.fs.Options.Rename.OVERWRITE
    hadoop.fs.FileContext.getFileContext(at.toUri() if at.toUri().getScheme() else fs.getUri(), conf).rename(fresh, at, replace)
    if history:
        folder, _ = _fs(spark, history)
        if fs.exists(folder):
            for name in sorted((f.getPath().getName() for f in fs.listStatus(folder)), reverse=True)[kept:]:
                fs.delete(_fs(spark, f"{history}/{name}")[0], False)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def as_json(df: DataFrame, out: str = "json") -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias(out))


def upsert_batches(path: str, keys: list[str], at: str):
    """For foreachBatch: each batch is its own folder, so a batch that comes again replaces itself; readers take the latest row of each key."""
    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates([*keys, at]).write.mode("overwrite").parquet(f"{path}/batch={number}")
    return write
