"""Conversations with very many values: what a row carries, and that nothing is lost at any size."""

import time

import pytest
from pyspark.sql import functions as F

from sparkveil import queries, queries_more  # noqa: F401
from sparkveil.operators import mask, surrogate


def _mails(spark, n):
    """n turns of one conversation; each tells its own address and asks for that of the next, which no span marks there."""
    mail = lambda c: F.concat(F.lit("u"), c.cast("string"), F.lit("@x.org"))
    rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), mail(F.col("id")).alias("own"), mail((F.col("id") + 1) % n).alias("next"))
    span = F.struct(F.lit(0).alias("start"), F.length("own").alias("end"), F.lit("EMAIL").alias("kind"), F.col("own").alias("value"))
    rows = rows.select("conv_id", "turn", F.concat("own", F.lit(" asks "), "next", F.lit(", not x"), "next").alias("text"), F.array(span).alias("spans"))
    return rows, mask.assign_tags(rows.select("conv_id", "turn", F.explode("spans").alias("s")).select("conv_id", "turn", "s.*"))


def test_rows_of_a_large_conversation_carry_only_their_own_values(spark, monkeypatch):
    n = 2_000
    rows, tags = _mails(spark, n)
    assert {r["n"] for r in mask._with_entries(rows, tags, "conv_id", "text", "spans").select(F.size("_hits").alias("n")).collect()} <= {2, 3, 4, 5}
    for part in (mask.PART, 100 * mask.ROW_BYTES):  # in one piece and in many
        monkeypatch.setattr(mask, "PART", part)
        began = time.time()
        got = {r["turn"]: (r["masked"], r["blocked_reason"]) for r in mask.mask_rows(rows, tags).collect()}
        assert time.time() - began < 30
        of = {r["raw"]: r["tag"] for r in tags.collect()}
        mails = [f"u{k}@x.org" for k in range(n)]
        assert got == {k: (f"{of[mails[k]]} asks {of[mails[(k + 1) % n]]}, not x{mails[(k + 1) % n]}", None) for k in range(n)}


def test_rows_without_a_conversation_or_without_values(spark):
    schema = "conv_id int, turn int, text string, spans array<struct<start:int,end:int,kind:string,value:string>>"
    span = [(0, 3, "PIN", "123")]
    rows = spark.createDataFrame([(1, 0, "123 \x01", span), (1, 1, "is 123 here \x01", []), (1, 2, None, []), (2, 0, "123 \x01", []), (None, 0, "123", span), (None, 1, "123", [])], schema)
    tags = mask.assign_tags(rows.select("conv_id", "turn", F.explode("spans").alias("s")).select("conv_id", "turn", "s.*"))
    got = {(r["conv_id"], r["turn"]): (r["masked"], r["blocked_reason"]) for r in mask.mask_rows(rows, tags).collect()}
    assert got == {(1, 0): ("<PIN_A> \x02", None), (1, 1): ("is <PIN_A> here \x02", None), (1, 2): (None, None), (2, 0): ("123 \x01", None), (None, 0): (None, "no placeholder"), (None, 1): ("123", None)}


@pytest.mark.parametrize(("kind", "raw"), [("PERSON", "n{}"), ("PERSON", "n n{}"), ("ORG", "n{}"), ("LOCATION", "n{}"), ("ADDRESS", "n{}")])
def test_names_are_made_up_where_a_pool_is_empty(kind, raw):
    conv = surrogate.Conversation(3, ["bado"], coins=True)
    got = [conv.of(kind, raw.format(n)) for n in range(6_000)]
    assert None not in got and len({x.lower() for x in got}) == 6_000
    assert [conv.of(kind, raw.format(n)) for n in (0, 5_999)] == [got[0], got[-1]]
    plain = surrogate.Conversation(3, ["bado"])
    assert [plain.of(kind, raw.format(n)) for n in range(700)] == got[:700]


def test_made_up_names_differ_and_have_no_end():
    block = len(surrogate.SYLLABLE) ** 4
    names = [surrogate.coined(9, n) for n in (*range(20_000), *range(block - 500, block + 500))]
    assert len(set(names)) == len(names) and {len(x) for x in names} == {8, 10}


def test_a_nation_of_any_size_is_masked_and_restored(spark, tmp_path):
    n = mask.MAX_ENTRIES + 100
    spark.range(n).selectExpr("id AS c_custkey", "format_string('Customer#%09d', id) AS c_name", "7 AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    got = queries.QUERIES["mask_surrogates"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [(k, True, True) for k in range(n)]
