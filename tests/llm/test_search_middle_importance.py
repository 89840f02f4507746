"""Top-k search, fill-in-the-middle and importance resampling against brute force, on small tables with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

pytest.importorskip("sparkveil.llm")
from pyspark.sql import functions as F  # noqa: E402

from sparkveil.llm import fill_middle, importance, top_search  # noqa: E402

DOCS = "doc_id long, text string"
VECTORS = "vec_id long, embedding array<float>"


# ---- top-k search ------------------------------------------------------------


def brute_top(rows, k=10, every=100):
    kept = [(i, [math.floor(1024 * x) for x in e]) for i, e in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for n, (i, q) in enumerate(kept):
        if i is None or i % every:
            continue
        scored = [(-sum(x * y for x, y in zip(q, e)), j is None, j) for m, (j, e) in enumerate(kept) if m != n]
        scored.sort(key=lambda r: (r[0], r[1], r[2] or 0))
        out += [(i, rank, j, -s) for rank, (s, _, j) in enumerate(scored[:k], 1)]
    return sorted(out, key=repr)


def found_top(spark, rows, **options):
    vectors = spark.createDataFrame(rows, VECTORS).withColumns({"_id": F.lit(1), "_body": F.lit(2), "score": F.lit(3)})
    return sorted((tuple(r) for r in top_search.top(vectors, **options).select("query_id", "rank", "vec_id", "score").collect()), key=repr)


def odd_vectors(dims=6, n=700, seed=3):
    rng = random.Random(seed)
    vector = lambda: [rng.choice((-1, 1)) * rng.randrange(0, 64) / 64 for _ in range(dims)]  # noqa: E731  exact as floats, many ties
    rows = [(i, vector()) for i in range(n)]
    copy, near = vector(), vector()
    rows += [(1000 + i, copy) for i in range(300)]  # a third is one vector, and its rows are queries, too
    rows += [(2000 + i, [near[0] + i / 1024, *near[1:]]) for i in range(150)]
    rows += [(3000, None), (3100, []), (3200, [1.0, None]), (3300, [float("nan")] * dims), (3400, [float("inf")] + [0.0] * (dims - 1)), (3500, [0.5]), (3600, [0.0] * dims)]
    rows += [(None, vector()), (None, copy), (-100, vector()), (4000, vector()), (4000, vector()), (4100, copy), (4100, copy)]
    return rows


@pytest.mark.parametrize("lists", [1, 2, 4])
def test_search_equals_brute_force(spark, lists):
    rows = odd_vectors()
    assert found_top(spark, rows, lists=lists, depth=12) == brute_top(rows)


def test_search_with_a_shallow_first_phase_and_split_copies(spark):
    rows = odd_vectors(seed=9)
    assert found_top(spark, rows, depth=1, split=50) == brute_top(rows)


def test_search_of_few_none_and_very_large(spark):
    assert found_top(spark, []) == []
    assert found_top(spark, [(100, None)]) == []
    few = [(0, [1.0, 2.0]), (1, [0.5, -1.0]), (200, [0.0, 1.0])]
    assert found_top(spark, few) == brute_top(few)
    empties = [(0, []), (1, []), (100, [])]
    assert found_top(spark, empties) == [(0, 1, 1, 0), (0, 2, 100, 0), (100, 1, 0, 0), (100, 2, 1, 0)]
    large = [(i, [float(2**18 + i), -(2.0**17), 3.0]) for i in range(0, 1500, 50)]  # beyond doubles, within longs
    assert found_top(spark, large) == brute_top(large)
    beyond = found_top(spark, [(0, [1e30, 0.0]), (1, [1e30, 0.0]), (2, [-1e30, 1.0])])
    assert [r[2] for r in beyond] == [1, 2] and beyond[0][3] > 2**60 > -(2**60) > beyond[1][3]


def test_the_second_phase_hands_in_a_fraction(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(32)]) for i in range(4000)]
    whole, dims, longest = top_search.whole_numbers(spark.createDataFrame(rows, VECTORS), "vec_id", "embedding")
    of = top_search.saved_at(top_search.classes(whole, 10, 100).select(F.monotonically_increasing_id().alias("_class"), "*"), top_search.new_path(spark, "test"))
    best, used = top_search.best_classes(of, dims, longest, 11, 2, 48)
    entries = spark.read.parquet(used[-1])
    assert best.count() <= entries.count() < 0.08 * 40 * 4000


# ---- fill in the middle ------------------------------------------------------


def brute_middle(doc_id, text, unit="line", seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    n = len(units)
    h = [int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_texts():
    rng = random.Random(4)
    texts = [None, "", "\n", "\n\n\n", "one line", "a\nb", "a\nb\n", "<", "<P", "a <P> b", "<M>", "x<S\n>", "<<P\n<S", "é\n𝄞\nü", "\r\n\x0b\x0c\x85 \n", "tab\t\n"]
    texts += ["".join(rng.choice("ab\n<>PSM é") for _ in range(rng.randrange(1, 60))) for _ in range(200)]
    texts.append("".join(rng.choice("abc \n") for _ in range(300_000)))
    return [(k, t) for k, t in enumerate(texts)] + [(None, "null id\nof two lines"), (7, "again"), (7, "again")]


@pytest.mark.parametrize("options", [{}, {"unit": "char"}, {"rate": 40, "spm_rate": 10, "seed": 11}])
def test_middle_equals_brute_force(spark, options):
    rows = odd_texts()
    docs = spark.createDataFrame(rows, DOCS).withColumns({"_row": F.lit("r"), "_text": F.lit("t"), "fim": F.lit(0), "n": F.lit(5)})
    made = fill_middle.transformed(docs, **options)
    assert set(made.columns) == {"doc_id", "_row", "_text", "n", "fim"}
    back = made.select("doc_id", "fim.*", fill_middle.restored(F.col("fim.output"), F.col("fim.form")).alias("back"), "_row")
    got = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in back.collect()), key=repr)
    args = {"unit": options.get("unit", "line"), "seed": options.get("seed", 7), "rate": options.get("rate", 100), "spm": options.get("spm_rate", 50)}
    assert got == sorted(((i, *brute_middle(i, t, **args), t or "") for i, t in rows), key=repr)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}


def test_places_are_those_of_the_units():
    for unit, sentinel in (("line", "<P>"), ("char", "<P>")):
        scanner = fill_middle.Scanner(unit)
        for _, text in odd_texts()[:150]:
            text = text or ""
            places = scanner.places(text)
            if places is None:
                assert any(s in text for s in ("<P>", "<S>", "<M>"))
                continue
            units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
            assert places.n == len(units)
            assert [places.after(r) for r in range(places.n + 1)] == [len("".join(units[:r])) for r in range(places.n + 1)]


def test_middle_of_an_empty_table_and_sentinels_that_overlap(spark):
    assert fill_middle.digests(spark.createDataFrame([], DOCS)).collect() == []
    for bad in (("<P>", "", "<M>"), ("ab", "bc", "x"), ("<P>", "<P>", "<M>"), ("abc", "b", "x")):
        if len(set(bad)) == 3:
            with pytest.raises(ValueError):
                fill_middle.checked(bad)
    assert fill_middle.checked(("[p]", "[s]", "[m]")) == ("[p]", "[s]", "[m]")


# ---- importance resampling ---------------------------------------------------


def brute_resampled(docs, target, buckets=10_000, ngrams=1, percent=10, least=20, seed=2024):
    def words(text):
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)

    def hits(text):
        w = words(text)
        return Counter(zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in range(1, ngrams + 1) for k in range(len(w) - n + 1))

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(hits(text))
    for text in target:
        t.update(hits(text))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    rows = []
    for i, text in docs:
        h = hits(text)
        n = sum(h.values())
        weight = sum(gain(b) * c for b, c in h.items()) // n if n else 0
        u = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, weight, weight + math.floor(-1000 * math.log(-math.log((u + 0.5) / 4294967296))), len(words(text)) >= least])
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    ranked = [(*r[:4], rank if rank <= percent * len(able) // 100 else None) for rank, r in enumerate(able, 1)]
    return sorted(ranked + [(*r[:4], None) for r in rows if not r[4]], key=repr)


def corpora(n=260):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefgé7") for _ in range(rng.randrange(1, 6))) for _ in range(400)]
    prose = lambda k: rng.choice((" ", ", ", "-\n")).join(rng.choice(vocabulary).title() if rng.random() < 0.2 else rng.choice(vocabulary[:40]) for _ in range(k))
    docs = [(i, prose(rng.randrange(1, 70))) for i in range(n)]
    docs += [(1000, None), (1001, ""), (1002, "... \x00 !?"), (None, prose(40)), (None, prose(40)), (2000, prose(30)), (2000, docs[3][1])]
    docs += [(3000, "the same words over and over again " * 5)] * 90  # a third is one row
    docs.append((4000, prose(60_000)))
    return docs, [prose(30) for _ in range(20)] + [None, ""]


@pytest.mark.parametrize("options", [{}, {"buckets": 50, "percent": 60}, {"ngrams": 3, "buckets": 997, "percent": 35, "least": 5, "seed": 1}])
def test_resampling_equals_brute_force(spark, options, monkeypatch):
    monkeypatch.setattr(importance, "PART_ROWS", 60)
    docs, target = corpora()
    table = spark.createDataFrame(docs, DOCS).withColumns({"_row": F.lit(1), "_id": F.lit("x"), "score": F.lit(9), "_part": F.lit(0)}).repartition(5)
    wanted = spark.createDataFrame([(t, "none") for t in target], "text string, _none string")
    got = sorted((tuple(r) for r in importance.resampled(table, wanted, **options).select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)
    assert got == brute_resampled(docs, target, **options)
    ranks = sorted(r[4] for r in got if r[4] is not None)
    assert ranks == list(range(1, len(ranks) + 1)) and ranks


def test_resampling_of_empty_tables(spark):
    none, docs = spark.createDataFrame([], DOCS), corpora(30)[0][:34]
    assert importance.resampled(none, spark.createDataFrame([("a b",)], "text string")).collect() == []
    got = importance.resampled(spark.createDataFrame(docs, DOCS), none)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_resampled(docs, [])
