"""Packing into optimal length buckets.

1. The exact global histogram of lengths is built in Spark. n different lengths need n * n / 2 bytes of
   text, so it has fewer than 250,000 rows for 30 GB and grows with the square root of the input.
2. A dynamic program over all lengths chooses the bucket boundaries that make padding least.
3. Inside each bucket, batches are filled to a token budget: rows are numbered without gaps and
   every budget // padded_length of them make a batch. A row longer than the budget is a batch alone.

Length is that of a byte-level tokenisation with an end token: UTF-8 bytes + 1 (null text: 1).
Every row is packed exactly once; none is dropped, split or cut. Equal lengths share a bucket.
An empty table gives an empty result.
"""

from __future__ import annotations

from array import array
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gapless_rank

BUCKETS = 16
BUDGET = 65_536
CHUNKS = 64


def length_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def histogram(lengths: DataFrame, n: str = "n_tokens") -> DataFrame:
    """count of each length."""
    return lengths.groupBy(F.col(n).alias("most")).agg(F.count(F.lit(1)).alias("count"))


def boundaries(count: list[int], most: list[int], buckets: int) -> list[int]:
    """The upper lengths of at most `buckets` buckets over ascending lengths with least sum of count x upper.

    Padding is that sum less the sum of lengths, which no choice changes. cost[i] is the least cost of
    the first i lengths in k buckets; a last bucket from j on makes it cost[j] + (before[i] - before[j]) x most[i - 1].
    As lines in most, those have falling slopes -before[j], so the lower hull of lines gives all minima in one pass, in
    whole numbers. Fewer buckets are used if more do not help.
    """
    n = len(count)
    if not n:
        return []
    before = [0, *accumulate(count)]
    cost: list[int | None] = [0] + [None] * n
    back: list[array] = []
    best = (None, 0)
    for k in range(1, min(buckets, n) + 1):
        new: list[int | None] = [None] * (n + 1)
        at, hull, first = array("l", [0]) * (n + 1), [], 0  # hull: (before, cost, j) of each line
        for i in range(1, n + 1):
            if (c := cost[i - 1]) is not None:
                b = before[i - 1]
                # the last line is nowhere the least once the new one meets the line before it no later
                while len(hull) - first >= 2 and (c - hull[-2][1]) * (hull[-1][0] - hull[-2][0]) <= (hull[-1][1] - hull[-2][1]) * (b - hull[-2][0]):
                    hull.pop()
                hull.append((b, c, i - 1))
            if first == len(hull):
                continue
            x = most[i - 1]
            while first + 1 < len(hull) and hull[first + 1][1] - hull[first + 1][0] * x < hull[first][1] - hull[first][0] * x:
                first += 1
            new[i], at[i] = hull[first][1] + (before[i] - hull[first][0]) * x, hull[first][2]
        back.append(at)
        cost = new
        if best[0] is None or new[n] < best[0]:
            best = (new[n], k)
    out, i = [], n
    for k in range(best[1], 0, -1):
        out.append(most[i - 1])
        i = back[k - 1][i]
    return out[::-1]


def packed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS, budget: int = BUDGET, chunks: int = CHUNKS) -> DataFrame:
    """doc_id, n_tokens, bucket, padded_length, batch (in its bucket), place (in its batch), padding."""
    rows = docs.select(F.col(doc_id).alias("_id"), length_of(F.col(text)).alias("n_tokens"))
    found = sorted(histogram(rows).collect(), key=lambda r: r["most"])
    bounds = boundaries([r["count"] for r in found], [r["most"] for r in found], buckets)
    edges = F.array(*(F.lit(x).cast("long") for x in bounds)) if bounds else F.array().cast("array<bigint>")
    rows = rows.withColumn("bucket", F.size(F.filter(edges, lambda e: e < F.col("n_tokens"))))
    rows = rows.withColumn("padded_length", F.try_element_at(edges, F.col("bucket") + 1))
    ranked = gapless_rank(rows, "bucket", [F.col("_id"), F.col("n_tokens")], F.pmod(F.xxhash64("_id", "n_tokens"), F.lit(chunks)), "_place", chunks)
    each = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.col("padded_length")))
    return ranked.select(F.col("_id").alias(doc_id), "n_tokens", "bucket", "padded_length", F.floor(F.col("_place") / each).alias("batch"), (F.col("_place") % each).cast("int").alias("place"), (F.col("padded_length") - F.col("n_tokens")).alias("padding"))
