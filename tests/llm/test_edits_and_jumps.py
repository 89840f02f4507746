"""Decontamination against plain edit distances on edited items, in one block and in many; jump hashing against the plain loop."""

import random

import pytest

pytest.importorskip("sparkveil.llm")
import xxhash  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from sparkveil.llm import decontaminate, sharding  # noqa: E402


def least_edits(item, found):
    """The least number of word edits between item and any stretch of found."""
    row = [0] * (len(found) + 1)
    for k, word in enumerate(item, 1):
        last, row[0] = row[0], k
        for j, other in enumerate(found, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (word != other))
    return min(row)


def brute(docs, items, min_words=1):
    out = []
    for i, text in docs:
        best = {}
        for item, body in items:
            w = decontaminate.words(body)
            if len(w) >= min_words and (d := least_edits(w, decontaminate.words(text))) <= len(w) // 5:
                key = (item,) if item is not None else (None, *w)
                best[key] = (item, min(d, best[key][1] if key in best else d))
        found = sorted(best.values(), key=lambda x: (x[0] is not None, x[0] or "", x[1]))
        out.append((i, len(found), [x[0] for x in found], min((x[1] for x in found), default=None)))
    return sorted(out, key=repr)


def cases(rng):
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 6))) for _ in range(60)]
    items = [(f"i{n}", " ".join(rng.choice(words) for _ in range(rng.choice((1, 3, 5, 6, 7, 8, 12, 20, 30))))) for n in range(40)]
    items += [("i0", "an other text of the first item"), (None, items[5][1]), (None, items[5][1].upper()), (None, "words of nobody in particular here"), ("e", ""), ("n", None)]
    docs = []
    for n in range(120):
        text = [rng.choice(words) for _ in range(rng.randrange(0, 30))]
        item = (rng.choice(items)[1] or "").split()
        for _ in range(rng.randrange(0, len(item) // 5 + 2)):
            at, how = rng.randrange(len(item) + 1), rng.randrange(3)
            item[at : at + (how != 0)] = [] if how == 1 else ["new"]
        docs.append((n, ", ".join([*text[: len(text) // 2], *item, *text[len(text) // 2 :]])))
    return [*docs, (500, None), (501, ""), (3, docs[3][1]), (None, docs[4][1])], items


@pytest.mark.parametrize(("block", "least"), [(8_000_000, 1), (400, 1), (400, 5)])
def test_edited_items_of_any_length_and_text_ids(spark, block, least):
    docs, items = cases(random.Random(2))
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"_n": F.lit("n"), "_row": F.lit(1)}).repartition(3)
    got = decontaminate.flagged(table, spark.createDataFrame(items, "item_id string, text string"), block_bytes=block, min_words=least)
    rows = sorted(((r["doc_id"], r["n_items"], list(r["items"]), r["least_distance"]) for r in got.collect()), key=repr)
    assert rows == brute(docs, items, least) and 20 < sum(r[1] > 0 for r in rows) and any(r[3] for r in rows)
    clean = decontaminate.clean(table, spark.createDataFrame(items, "item_id string, text string"), block_bytes=block, min_words=least)
    assert clean.columns == table.columns and clean.count() == sum(r[1] == 0 for r in rows)


def test_a_text_that_all_items_share_is_several_blocks(spark):
    items = spark.createDataFrame([(n, "one text that every item of this benchmark has") for n in range(300)], "item_id long, text string")
    n, blocks = decontaminate._blocks(items, "item_id", "text", 2000)
    sizes = [len(b) for b in blocks]
    assert n > 10 and sum(sizes) == 300 and max(sizes) < 60
    docs = spark.createDataFrame([(1, "x One text, that every item of this benchmark has."), (2, "x")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_items"], r["items"]) for r in decontaminate.flagged(docs, items, block_bytes=2000).collect()}
    assert got == {1: (300, list(range(300))), 2: (0, [])}
    assert decontaminate.flagged(docs, items.limit(0)).where("contaminated").count() == 0


def plain_jump(key, shards):
    """The loop as published, with the operator's draws."""
    b, j = -1, 0
    while j < shards:
        b = j
        draw = xxhash.xxh64_intdigest((j).to_bytes(8, "little"), seed=xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), seed=42))
        j = int((b + 1) / (((draw >> 33) + 1) / 2**31))
    return b


def test_shards_are_those_of_the_plain_loop(spark):
    ids = [*range(-50, 1500), 2**62, -(2**63)]
    rows = spark.createDataFrame([(i, "x") for i in ids], "doc_id long, text string")
    got = {r["doc_id"]: (r["shard"], r["grown_shard"]) for r in sharding.sharded(rows).collect()}
    assert got == {i: (plain_jump(i, 40), plain_jump(i, 41)) for i in ids}
    assert sharding.sharded(rows.limit(0)).collect() == []


def test_written_shards_keep_a_column_of_the_folders_name(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i}", "own", 7) for i in range(50)], "doc_id long, text string, shard string, _body int")
    sharding.write_shards(rows, str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert {r["doc_id"]: (r["shard"], r["_body"], r["_shard"]) for r in back.collect()} == {i: ("own", 7, plain_jump(i, 4)) for i in range(50)}
