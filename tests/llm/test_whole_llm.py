"""Cases in which an operator of the llm subpackage did less than the whole job."""

import random
from collections import Counter

import pytest

pytest.importorskip("sparkveil.llm")

from sparkveil.llm import decontaminate, packing, url_filter  # noqa: E402


@pytest.mark.parametrize("size", [2, 3, 20, 2000])
def test_link_farms_of_any_size_are_blocked(spark, size):
    """Hosts that link only to a blocked one; one with a link in a hundred to it, and one that a trusted host knows, stay."""
    link = lambda *hosts: "".join(f'<a href="https://{h}/p">x</a>' for h in hosts)
    rows = [(-1, "http://bad.net/es/1", None), (-2, "http://portal.org/", link("bad.net", *(f"site{k}.org" for k in range(99)))), (-3, "http://good.com/", link("known.org")), (-4, "http://known.org/", link("bad.net")), (-5, "http://alone.org/", None)]
    rows += [(k, f"http://farm{k}.org/", link("bad.net")) for k in range(size)] + [(10_000, "http://behind.org/", link("farm0.org"))]
    rows.append((-6, "http://wide.com/", link("farm0.org", *(f"other{k}.org" for k in range(99)))))  # a little trust must not save a farm
    got = {r["page_id"]: r["verdict"] for r in url_filter.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {k: got.pop(k) for k in (-1, -2, -3, -4, -5, -6)} == {-1: "block", -2: "allow", -3: "allow", -4: "allow", -5: "allow", -6: "allow"}
    assert len(got) == size + 1 and set(got.values()) == {"block"}


def least_padding(lengths, buckets):
    """By the plain recurrence, every cut tried."""
    counts = sorted(Counter(lengths).items())
    cost = [0] + [float("inf")] * len(counts)
    for _ in range(buckets):
        new = cost[:]
        for i in range(1, len(counts) + 1):
            padding = 0
            for j in range(i, 0, -1):
                padding += counts[j - 1][1] * (counts[i - 1][0] - counts[j - 1][0])
                new[i] = min(new[i], cost[j - 1] + padding)
        cost = new
    return cost[-1]


def test_padding_is_least_for_long_lengths(spark):
    """Lengths far beyond 64, and a third of all rows of one length."""
    rng = random.Random(8)
    cases = [[int(rng.lognormvariate(7, 1)) + 1 for _ in range(120)] for _ in range(20)] + [[rng.randint(3000, 9000) for _ in range(80)] + [5003] * 40, [700] * 5, [1, 100_000]]
    for lengths in cases:
        counts = sorted(Counter(lengths).items())
        for buckets in (1, 2, 7, 16, 200):
            bounds = packing.boundaries([c for _, c in counts], [n for n, _ in counts], buckets)
            assert len(bounds) <= buckets and bounds == sorted(set(bounds)) and bounds[-1] == max(lengths)
            assert sum(next(b for b in bounds if b >= n) - n for n in lengths) == least_padding(lengths, min(buckets, len(counts)))
    for lengths in cases[:1] + cases[20:21]:
        rows = packing.packed(spark.createDataFrame([(k, "x" * (n - 1)) for k, n in enumerate(lengths)], "doc_id long, text string"), buckets=6).collect()
        assert sum(r["padding"] for r in rows) == least_padding(lengths, 6) and len(rows) == len(lengths)


@pytest.mark.parametrize("size", [8_000_000, 40])
def test_items_without_an_id_are_matched(spark, size):
    bench = spark.createDataFrame([(None, "red green blue"), (None, "one two three"), (None, "one two three"), (-4, "white black grey"), (5, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a Red green blue b"), (2, "one two three red green blue white black grey"), (3, "nothing"), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["contaminated"], r["n_items"], r["items"], r["least_distance"]) for r in decontaminate.flagged(docs, bench, block_bytes=size).collect()}
    assert got == {1: (True, 1, [None], 0), 2: (True, 3, [None, None, -4], 0), 3: (False, 0, [], None), 4: (False, 0, [], None)}
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, bench, block_bytes=size).collect()) == [3, 4]
