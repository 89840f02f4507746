"""The spans that the trees add: against a twin in plain Python, and on the secrets of the documents table."""

import random
import re

import pytest

pytest.importorskip("sparkveil.llm")

from pyspark.sql import functions as F  # noqa: E402

from sparkveil.llm import pii_boost  # noqa: E402

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
PATTERNS = [(kind, pattern, [g for g in (shared, own) if g]) for shared, several in pii_boost.MORE.items() for kind, pattern, own in several]


def base_of(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 14 <= len(digits) <= 19 and pii_boost.luhn(digits) or kind == "phone" and 10 <= len(digits) <= 15:
                out.append((m.start(), m.end(), kind))
    return out


def assigned(text):
    """The generator with a look-behind of varying width, which Python has not."""
    name = r"(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|key|auth|credential|bearer)"
    before = re.compile(rf"(?i:{name})[\"']?\x20{{0,3}}(?:=|:|=>|:=|\x20is)\x20{{0,3}}[\"']?$")
    at = 0
    while m := re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-][A-Za-z0-9_+/.=-]{7,}").search(text, at):
        if before.search(text[max(0, m.start() - 40) : m.start()]):
            yield m.start(), m.end()
            at = m.end()
        else:
            at = m.start() + 1


def twin(text):
    """Spans that are added: score every proposal in Python and take the most probable first."""
    cuts, found = pii_boost.model()[3], []
    for kind, pattern, _ in PATTERNS:
        places = assigned(text) if "(?<=(?i:" in pattern else ((m.start(), m.end()) for m in re.finditer(pattern, text))
        for a, b in places:
            p = pii_boost.probability(pii_boost.features(kind, text[a:b], text[max(0, a - pii_boost.WIDTH) : a]))
            if p >= cuts[kind]:
                found.append((-round(p, 12), a, pii_boost.ALL_KINDS.index(kind), b, kind))
    base = [(a, b) for a, b, _ in base_of(text)]
    return sorted(f"{kind}:{a}:{b}" for a, b, kind in best_first(base, [(p, a, b, kind) for p, a, _, b, kind in sorted(found)]))


def best_first(base, ranked):
    """Of (-p, start, end, kind) in order, what overlaps neither base nor anything taken before."""
    taken = []
    for _, a, b, kind in ranked:
        if not any(a < y and x < b for x, y in base + [t[:2] for t in taken]):
            taken.append((a, b, kind))
    return taken


def selected_of(spark, base, proposed, monkeypatch):
    """selected() with the probabilities given: of each proposal (start, end, p) its only feature is p."""
    monkeypatch.setattr(pii_boost, "score", lambda f: f[0])
    span = lambda a, b, kind, rank: f"named_struct('start', {a}, 'rank', {rank}, 'end', {b}, 'kind', '{kind}', 'value', 'x')"
    columns = [f"array({', '.join(span(a, b, 'email', 0) for a, b in base)})", f"array({', '.join(f'named_struct({chr(39)}span{chr(39)}, {span(a, b, chr(115) + chr(101) + chr(99) + chr(114) + chr(101) + chr(116), 4)}, {chr(39)}f{chr(39)}, array(cast({p} as double)))' for a, b, p in proposed)})"]
    kinds = [f"array<{pii_boost._SPAN}>", f"array<struct<span:{pii_boost._SPAN},f:array<double>>>"]
    row = spark.range(1).select(*(F.expr(c).cast(k).alias(n) for c, k, n in zip(columns, kinds, "bp", strict=True)))
    return [(s["start"], s["end"]) for s in row.select(pii_boost.selected(F.col("b"), F.col("p")).alias("s")).first()["s"]]


def test_chains_lose_nothing_that_only_a_dropped_span_overlaps(spark, monkeypatch):
    assert selected_of(spark, [], [(0, 10, 0.95), (8, 30, 0.97), (28, 40, 0.99)], monkeypatch) == [(0, 10), (28, 40)]
    assert selected_of(spark, [(28, 40)], [(0, 10, 0.95), (8, 30, 0.97)], monkeypatch) == [(0, 10)]
    assert selected_of(spark, [(5, 20), (15, 30)], [(0, 6, 0.99), (25, 40, 0.98), (38, 50, 0.97), (50, 60, 0.96)], monkeypatch) == [(38, 50), (50, 60)]
    assert selected_of(spark, [], [(0, 10, 0.99), (5, 15, 0.99), (14, 20, 0.99)], monkeypatch) == [(0, 10), (14, 20)]
    rng = random.Random(3)
    for _ in range(6):
        at = [rng.randrange(0, 120) for _ in range(25)]
        proposed = [(a, a + rng.randrange(1, 15), round(rng.uniform(0.9, 1), 3)) for a in at]
        base = [(a, a + rng.randrange(1, 8)) for a in (rng.randrange(0, 120) for _ in range(rng.randrange(0, 4)))]
        want = best_first(base, [(-p, a, b, "secret") for p, a, b in sorted(((p, a, b) for a, b, p in proposed), key=lambda x: (-x[0], x[1], x[2]))])
        assert selected_of(spark, base, proposed, monkeypatch) == sorted(t[:2] for t in want)


def test_long_values_and_very_many(spark):
    h = "0123456789abcdef"
    texts = [f'token = "{h * 40}" end', f"token = {'aB3' * 200}", "x " + "A1b2c3d4e5f6g7h8i9j0k " * 4000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii_boost.report(docs).collect()}
    assert got[0]["spans"] == f"secret:9:{9 + 640}" and got[1]["spans"] == f"secret:8:{8 + 600}" and got[2]["n_added"] == 4000
    red = {r["doc_id"]: r["text"] for r in pii_boost.redacted(docs).collect()}
    assert red[0] == 'token = "<SECRET>" end' and red[2] == "x " + "<SECRET> " * 4000


def made(rng):
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    h = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    w = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    piece = lambda: rng.choice([w(), w(), w() + ".", f'token = "{h(40)}"', f"api_key: {h(32).upper()}", f"commit {h(40)}", f"password is {w()}{d(3)}x", f"{w()} (at) {w()} dot org", f"{w()} at {w()}.com", f"{w()} [at] {w()} [dot] net", f"{h(4)}:{h(4)}::{h(3)}", ":".join(h(3) for _ in range(8)), f"call 0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"tel {d(3)}-{d(3)}-{d(4)}", f"order {d(4)} {d(4)} {d(4)}", f"visa 4111.1111.1111.{rng.choice(['1111', '1112'])}", f"{d(4)}-{d(6)}-{d(5)}", f"sk-{h(24)}", d(18), f"{w()}@{w()}.de", f"+1 ({d(3)}) {d(3)}-{d(4)}", f"1.2.3.{d(2)}", f"key={w()}-{d(4)}-{w()}{d(9)}é"])
    return " ".join(piece() for _ in range(rng.randint(1, 12)))


def test_added_spans_equal_the_twin(spark):
    rng = random.Random(6)
    texts = [made(rng) for _ in range(150)]
    got = {r["doc_id"]: r for r in pii_boost.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    some = 0
    for k, text in enumerate(texts):
        base = {f"{kind}:{a}:{b}" for a, b, kind in base_of(text)}
        added = sorted(s for s in got[k]["spans"].split(",") if s and s not in base)
        assert added == twin(text), text
        assert got[k]["n_added"] == len(added)
        some += len(added)
    assert some > 150


def test_tests_hold_for_every_match():
    rng = random.Random(7)
    for _ in range(3000):
        text = made(rng)
        for _, pattern, guards in PATTERNS:
            if "(?<=" not in pattern and re.search(pattern, text):
                assert all(re.search(g, text) for g in guards if "(?<=" not in g), (pattern, text)
    for text in ("ann at mail.org", "ann at mail [dot] org", "ann at mail(dot)org", "ann@ mail.org"):
        assert re.search(PATTERNS[0][1], text) and re.search(PATTERNS[0][2][0], text)


def test_secrets_of_documents(spark):
    """Every planted token is redacted, and nothing else is taken for one."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    want = {(k, m.start(1), m.end(1)) for k, t in texts.items() for m in re.finditer(r'(?i)token = "([0-9a-f]{16,})"', t)}
    got = {(r["doc_id"], *map(int, s.split(":")[1:])) for r in pii_boost.report(docs).collect() for s in r["spans"].split(",") if s.startswith("secret")}
    assert len(want) > 5 and len(want & got) >= 0.9 * len(want) and len(want & got) >= 0.9 * len(got)


def test_trees_agree_on_examples_they_have_not_seen():
    cuts = pii_boost.model()[3]
    for kind in pii_boost.ALL_KINDS:
        rows = [(pii_boost.probability(x) >= cuts[kind], y) for x, y in pii_boost.examples(3000, 77) if pii_boost.ALL_KINDS[int(x[0])] == kind]
        hits = sum(a and y for a, y in rows)
        assert hits >= 0.9 * sum(a for a, _ in rows) and hits >= 0.9 * sum(y for _, y in rows), kind


def test_edges(spark):
    schema = "doc_id long, text string, _body string, _base int, kind string"
    assert pii_boost.report(spark.createDataFrame([], schema)).collect() == []
    many = "a@b.co 1.2.3.4 token=0123456789abcdef0123 " * 400
    rows = [(1, many, "b", 1, "k"), (2, None, None, None, None), (2, None, None, None, None), (None, "", "x", 2, "y")]
    df = spark.createDataFrame(rows, schema)
    got = sorted(((r["doc_id"] or 0, r["n_email"], r["n_ip"], r["n_added"]) for r in pii_boost.report(df).collect()))
    assert got == [(0, 0, 0, 0), (1, 400, 400, 400), (2, 0, 0, 0), (2, 0, 0, 0)]
    red = pii_boost.redacted(df).where("doc_id = 1").first()
    assert red["text"] == "<EMAIL> <IP> token=<SECRET> " * 400 and (red["_body"], red["_base"], red["kind"]) == ("b", 1, "k")
    assert pii_boost.redacted(df.limit(0)).collect() == []
    assert pii_boost.report(df.select("doc_id", F.lit("x@y.zz").alias("text"))).count() == 4
