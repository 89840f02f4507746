"""Configuration, vault, pin and presence files as DataFrames. All readers go through Spark, so any store it reads will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOM = "﻿"
TARGET = "struct<base:string,presence:string,model:string,key_env:string,skip_busy:boolean,timeout:double,max_input_chars:bigint>"
CONFIG = f"struct<chains:map<string,array<string>>,policies:map<string,map<string,string>>,settings:map<string,double>,targets:map<string,{TARGET}>>"
VAULT = "struct<entries:array<struct<name:string,kind:string,value:string,ignore_case:boolean,tool:boolean>>,secrets:map<string,string>>"
PINS = "struct<pins:array<struct<`group`:string,session:string,model:string,scope:string,source:string,sig:string,set_at:bigint,last_used:bigint,ttl_minutes:bigint>>,events:array<struct<time:bigint,`group`:string,session:string,`from`:string,`to`:string,reason:string>>>"


def json_texts(spark: SparkSession, path: str) -> DataFrame:
    """path and text of whole files, without a byte order mark."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return raw.withColumn("text", F.when(F.col("text").startswith(BOM), F.substr("text", F.lit(2))).otherwise(F.col("text")))


def parsed(texts: DataFrame, schema: str) -> DataFrame:
    """text as `schema` in _value; text that is no JSON object raises, so a broken file never passes for an empty one."""
    value = F.from_json("text", schema)
    checked = F.when(F.try_parse_json("text").isNull() | ~F.col("text").rlike(r"^\s*\{"), F.raise_error(F.concat(F.lit("no JSON object: "), F.coalesce("path", F.lit("?"))))).otherwise(value)
    return texts.withColumn("_value", checked)


def chains(config: DataFrame) -> DataFrame:
    """group, pos, entry of parsed CONFIG rows."""
    groups = config.select(F.explode("_value.chains").alias("name", "_entries"))
    return groups.select("name", F.posexplode("_entries").alias("pos", "entry"))


def targets(config: DataFrame) -> DataFrame:
    """Named targets with a base or a presence source and no | in their name; a timeout counts only above 0."""
    rows = config.select(F.explode("_value.targets").alias("name", "t")).select("name", "t.*")
    fine = rows.where((F.col("base").isNotNull() | F.col("presence").isNotNull()) & ~F.col("name").contains("|"))
    return fine.withColumn("timeout", F.when(F.col("timeout") > 0, F.col("timeout")))


def vault(texts: DataFrame, least: int = 4) -> DataFrame:
    """Entries and named secrets of VAULT files; shorter values are left out. A missing file raises in Spark's reader."""
    rows = parsed(texts, VAULT)
    entries = rows.select(F.explode("_value.entries").alias("e")).select("e.*")
    secrets = rows.select(F.explode("_value.secrets").alias("name", "value")).select("name", F.lit(None).cast("string").alias("kind"), "value", F.lit(False).alias("ignore_case"), F.lit(True).alias("tool"))
    return entries.unionByName(secrets).where(F.char_length("value") >= least)


def pins(texts: DataFrame, now: int) -> DataFrame:
    """Pins that have what a pin needs and are not over."""
    from ..functions.scalars import expires_at

    rows = parsed(texts, PINS).select(F.explode("_value.pins").alias("p")).select("p.*")
    whole = rows.dropna(subset=["group", "session", "model", "scope", "set_at", "last_used"]).fillna({"source": "", "sig": "", "ttl_minutes": 720})
    ends = expires_at(F.col("scope"), F.col("set_at"), F.col("last_used"), F.col("ttl_minutes"))
    return whole.withColumn("expires_at", ends).where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def history(spark: SparkSession, path: str) -> DataFrame:
    """Saved configurations by the stamp in their names, newest first, with their number of groups."""
    rows = parsed(json_texts(spark, path), CONFIG)
    stamp = F.regexp_extract("path", r"(\d{8}T\d{6}Z)", 1)
    return rows.select(stamp.alias("stamp"), F.size(F.map_keys("_value.chains")).alias("groups")).where("stamp <> ''").orderBy(F.desc("stamp"))


def leaves(df: DataFrame, key: str, body: str, depth: int = 8) -> DataFrame:
    """key, path and value of every string in JSON text, arguments that are JSON text themselves included."""
    now = df.select(key, F.lit("$").alias("path"), F.try_parse_json(body).alias("v"))
    out = None
    for _ in range(depth):
        kind = F.schema_of_variant("v")
        own = now.where(kind == "STRING").select(key, "path", F.try_variant_get("v", "$", "string").alias("value"))
        nested = own.where(F.col("path").endswith(".arguments") & F.try_parse_json("value").isNotNull())
        plain = own.join(nested.select(key, "path"), [key, "path"], "left_anti")
        out = plain if out is None else out.unionByName(plain)
        deeper = now.where(kind.startswith("OBJECT") | kind.startswith("ARRAY")).unionByName(nested.select(key, "path", F.try_parse_json("value").alias("v")))
        now = deeper.lateralJoin(deeper.sparkSession.tvf.variant_explode(F.col("v").outer())).select(key, F.concat("path", F.coalesce(F.concat(F.lit("."), "key"), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))).alias("path"), F.col("value").alias("v"))
    return out


# Keys whose strings are structure, not text.
STRUCTURAL = ("model", "role", "type", "id", "tool_call_id", "call_id", "item_id", "name", "object", "finish_reason", "stop_reason", "tool_choice", "status", "encrypted_content", "signature", "media_type", "detail", "format", "service_tier", "reasoning_effort", "previous_response_id", "user", "voice")


def skipped(path, value):
    """Leaves that are not scanned: structural keys, under three bytes, data: urls, and long base64 without white space."""
    last = F.regexp_extract(path, r"\.([^.\[\]]+)(?:\[\d+\])*$", 1)
    blob = (F.octet_length(value) > 512) & value.rlike(r"^[A-Za-z0-9+/=_-]+$")
    return last.isin(*STRUCTURAL) | (F.octet_length(value) < 3) | value.startswith("data:") | blob
