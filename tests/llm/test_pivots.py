"""The pivot tables: what they discard, that they lose nothing, and hot keys cut into parts."""

import itertools
import random

import pytest

pytest.importorskip("sparkveil.llm")

from pyspark.sql import functions as F  # noqa: E402

from sparkveil.llm import simhash  # noqa: E402
from sparkveil.llm.graph import connected_components  # noqa: E402

signed = lambda x: x - 2**64 if x >> 63 else x


def clusters(seed):
    """Fingerprints that share bands: copies of some centres with a few to many bits changed in one half."""
    rng = random.Random(seed)
    out = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        out |= {centre ^ sum(1 << b for b in rng.sample(range(38), rng.randint(0, 24))) for _ in range(60)}
        out |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(40)}
    return sorted(out)


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_pivots_discard_pairs_and_lose_no_link(spark, distance):
    prints = clusters(distance)
    vertices = spark.createDataFrame([(signed(p),) for p in prints], "fp long").cache()
    want = {tuple(sorted((signed(a), signed(b)))) for a, b in itertools.combinations(prints, 2) if (a ^ b).bit_count() <= distance}
    tested = {tuple(r) for r in simhash.candidates(vertices, distance).collect()}
    plain = {tuple(r) for r in simhash.candidates(vertices, distance, references=[]).collect()}
    assert want <= tested < plain and len(tested) < len(plain) / 2
    assert {tuple(r) for r in simhash.links(vertices, distance).collect()} == want


def test_pivot_table_holds_the_distances(spark):
    rng = random.Random(4)
    prints = [0, 2**64 - 1] + [rng.getrandbits(64) for _ in range(20)]
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    rows = df.select("fp", F.array(*simhash.pivot_table(F.col("fp"), simhash.pivots())).alias("t")).collect()
    for r in rows:
        got = [r["t"][k // 7] >> 8 * (k % 7) & 255 for k in range(simhash.PIVOTS)]
        assert got == [((r["fp"] ^ p) & (2**64 - 1)).bit_count() for p in simhash.pivots()]
    far = df.alias("a").crossJoin(df.alias("b")).select(F.col("a.fp").alias("x"), F.col("b.fp").alias("y"))
    table = lambda c: simhash.pivot_table(F.col(c), simhash.pivots(7))[0]
    for r in far.select("x", "y", simhash._apart(table("x"), table("y"), 3).alias("apart")).collect():
        most = max(abs(((r["x"] ^ p) & (2**64 - 1)).bit_count() - ((r["y"] ^ p) & (2**64 - 1)).bit_count()) for p in simhash.pivots(7))
        assert r["apart"] == (most > 3)


@pytest.mark.parametrize("split", [1_000_000, 3])
def test_hubs_and_chains(spark, split):
    rng = random.Random(2)
    edges = [(0, k) for k in range(1, 60)] + [(k, k + 1) for k in range(100, 150)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    root = {n: n for e in edges for n in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    found, _ = connected_components(spark.createDataFrame(edges, "u long, v long"), split)
    loose = {n for n in root if not any(a != b and n in (a, b) for a, b in edges)}
    assert {r["node"]: r["root"] for r in found.collect()} == {n: r for n, r in root.items() if n not in loose}


def test_one_fingerprint_of_most_rows(spark):
    rows = [(k, "the same text for all") for k in range(60)] + [(100, "something else entirely here now"), (None, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain, cut = ({(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.components(docs, split=s).collect()} for s in (1_000_000, 4))
    assert plain == cut and len(plain) == 62
    assert simhash.components(docs.limit(0)).collect() == [] and simhash.deduplicated(docs.limit(0)).collect() == []
    assert simhash.deduplicated(docs).count() == 4
