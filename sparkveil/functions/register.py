"""SQL names for what the package does: functions over a text, and one table function."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .workers import on_workers

#: SQL functions whose bodies are expressions; they stay in the JVM wherever they are called.
SQL_FUNCTIONS = {
    "sv_digits": ("s STRING", "STRING", "regexp_replace(s, '[^0-9]', '')"),
    "sv_luhn": ("s STRING", "BOOLEAN", "luhn_check(regexp_replace(s, '[^0-9]', ''))"),
    "sv_name_like": ("kind STRING", "BOOLEAN", "kind IN ('PERSON', 'ADDRESS', 'ORG', 'LOCATION')"),
    "sv_bare": ("model STRING, prefix STRING", "STRING", "CASE WHEN startswith(model, prefix) THEN substr(model, length(prefix) + 1) ELSE model END"),
    "sv_mask_header": ("tier STRING, masked BIGINT", "STRING", "concat('tier=', coalesce(tier, '-'), '; masked=', coalesce(masked, 0))"),
}


def _restore(texts: pd.Series, maps: pd.Series) -> pd.Series:
    from ..operators.names import Names

    return pd.Series([None if t is None else Names(json.loads(m or "{}")).restore(t) for t, m in zip(texts, maps, strict=True)], dtype=object)


class AddressSpans:
    """address_spans(text): start, stop and value of each postal address in a text."""

    def eval(self, text: str):
        from ..operators.address import find

        for start, stop in find(text or ""):
            yield start, stop, text[start:stop]


def register(spark: SparkSession) -> list[str]:
    """Register everything for spark.sql; returns the names."""
    on_workers()
    for name, (arguments, returns, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}")
    spark.udf.register("sv_restore", F.pandas_udf(_restore, "string"))
    spark.udtf.register("sv_address_spans", F.udtf(AddressSpans, returnType="start int, stop int, value string"))
    return [*SQL_FUNCTIONS, "sv_restore", "sv_address_spans"]
