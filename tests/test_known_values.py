"""Known values are masked wherever they occur, and in one scan."""

import random
import time

import pytest
from pyspark.sql import functions as F

from sparkveil.operators import detect, mask, occurrences


def plain(text, entries):
    """Try every place and every entry, those that ignore case first."""
    taken = []
    for loose in (True, False):
        at = 0
        while at < len(text):
            best = 0
            for value, by, ignore in entries:
                size = len(value)
                same = text[at : at + size].lower() == value.lower() if loose else text[at : at + size] == value
                if value and ignore == loose and same and size > best and occurrences.bounded(text, at, at + size) and not any(at < b and a < at + size for a, b, _ in taken):
                    best, found = size, by
            if best:
                taken.append((at, at + best, found))
            at += best or 1
    return sorted(taken)


def test_scanner_equals_plain_search():
    rng = random.Random(1)
    for _ in range(1500):
        entries = [("".join(rng.choice("aAb +_") for _ in range(rng.randint(1, 4))), f"<{k}>", rng.random() < 0.4) for k in range(5)]
        seen = set()
        entries = [e for e in entries if ((e[0].lower(), True) if e[2] else (e[0], False)) not in seen and not seen.add((e[0].lower(), True) if e[2] else (e[0], False))]
        text = "".join(rng.choice("aAb +_é") for _ in range(20))
        got = occurrences.Scanner(entries).find(text)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in plain(text, entries)], (text, entries)


def test_vault_of_a_thousand_entries(spark):
    """One scan: placeholders are never scanned, letters go past Z, and size costs little."""
    entries = [("alpha", "SECRET", "SECRET"), ("maps", "K", "alpha", True, True), (None, "K", "CODE_A")] + [(None, "K", f"value{k:04d}") for k in range(1000)]
    tags = {v: t for v, t, _ in mask.vault_tags(entries)}
    assert tags["value0000"] == "<K_A>" and tags["value0026"] == "<K_AA>" and tags["value0999"] == "<K_ALL>"
    assert mask.vault_tools(entries) == {"<SECRET:maps>": "alpha"}
    df = spark.createDataFrame([("SECRET ALPHA value0026 value00261 CODE_A",), (None,), ("",)], "text string")
    began = time.time()
    got = [r["m"] for r in df.select(mask.vault_masked(F.col("text"), entries).alias("m")).collect()]
    assert got == [f"<SECRET:alpha> <SECRET:maps> <K_AA> value00261 {tags['CODE_A']}", None, ""] and time.time() - began < 30
    with pytest.raises(ValueError):
        mask.vault_tags([(None, "K", str(k)) for k in range(mask.MAX_ENTRIES + 1)])


def test_values_no_rule_finds_again_are_masked(spark):
    """A value found in one turn is masked in others, whatever stands around it there; names in any case, but not in links."""
    rows = spark.createDataFrame([(1, 0, "password: tulips9 ok"), (1, 1, "is it tulips9? or tulips99"), (1, 2, "ANN LEE and ann lee, see http://x.org/ann and annlee"), (2, 0, "tulips9"), (1, 3, None)], "conv_id int, turn int, text string")
    found = detect.with_spans(rows).withColumns({"_tags": F.lit("mine"), "_known": F.lit(1)})
    flat = found.select("conv_id", "turn", F.explode("spans").alias("s")).select("conv_id", "turn", "s.*")
    named = spark.createDataFrame([(1, 9, 0, 7, "PERSON", "Ann Lee")], "conv_id int, turn int, start int, end int, kind string, value string")
    out = mask.mask_rows(found, mask.assign_tags(flat.unionByName(named)))
    got = {(r["conv_id"], r["turn"]): r["masked"] for r in out.collect()}
    assert got == {(1, 0): "password: <PASSWORD_A> ok", (1, 1): "is it <PASSWORD_A>? or tulips99", (1, 2): "<PERSON_A> and <PERSON_A>, see http://x.org/ann and annlee", (2, 0): "tulips9", (1, 3): None}
    assert {(r["_tags"], r["_known"]) for r in out.collect()} == {("mine", 1)}
