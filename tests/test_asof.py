"""Settings in force at a time against a plain search; near words against plain edit distances."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkveil.operators import rehydrate
from sparkveil.operators.names import edits
from sparkveil.plans import asof


@pytest.mark.parametrize(("stretch", "valid"), [(60, None), (3600, 900), (10**9, 0)])
def test_in_force_equals_a_plain_search(spark, stretch, valid):
    rng, start = random.Random(4), datetime(2024, 1, 1)
    moment = lambda: start + timedelta(seconds=rng.randrange(0, 7200))
    rows = [(n, rng.choice((1, 1, 1, 2, 3, None)), moment() if rng.random() < 0.95 else None) for n in range(400)]
    pins = [(rng.choice((1, 1, 2, 9, None)), moment() if rng.random() < 0.9 else None, n) for n in range(60)]
    pins += [(1, start + timedelta(seconds=500), 900), (1, start + timedelta(seconds=500), 950)]  # at one time
    df = spark.createDataFrame(rows, "id int, user int, ts timestamp").withColumns({"_row": F.lit(1), "_side": F.lit(2), "pin": F.lit("old")})
    got = asof.in_force(df, spark.createDataFrame(pins, "user int, ts timestamp, pin int"), "user", "ts", F.col("pin"), "pin", tie=F.col("pin"), valid=valid, stretch=stretch)
    assert set(got.columns) == set(df.columns)

    def plain(user, ts):
        held = [(t, p) for u, t, p in pins if u is not None and t is not None and ts is not None and u == user and t <= ts]
        if not held or valid is not None and (ts - max(held)[0]).total_seconds() > valid:
            return None
        return max(held)[1]

    assert {r["id"]: r["pin"] for r in got.collect()} == {n: plain(u, t) for n, u, t in rows}
    assert asof.in_force(df, spark.createDataFrame([], "user int, ts timestamp, pin int"), "user", "ts", F.col("pin"), "pin").where("pin IS NOT NULL").count() == 0


def test_near_words_equal_all_pairs(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcé") for _ in range(n))
    names = [(word(rng.randrange(4, 11)).title(), f"Raw {n}") for n in range(60)]
    words = []
    for _ in range(300):
        w = list(rng.choice(names)[0])
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randrange(2)] = rng.choice(("", "a", "z"))
        words.append("".join(w))
    words += ["", "x" * 3000, "abcde"]
    known = {p for s, r in names for p in f"{s} {r}".lower().split()}
    want = {}
    for w in set(words):
        low = w.lower()
        if len(low) < 5 or low in known:
            continue
        near = [(d, r) for s, r in names if len(s) >= 5 and s[0].lower() == low[0] and (d := edits(low, s.lower(), 2 if len(s) >= 8 else 1))]
        best = {r for d, r in near if d == min(near)[0]}
        if len(best) == 1:
            want[w] = (best.pop(), min(near)[0])
    got = rehydrate.fuzzy_matches(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame(names, "surrogate string, raw string"))
    assert {r["word"]: (r["raw"], r["distance"]) for r in got.collect()} == want and len(want) > 40
