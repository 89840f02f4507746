"""Host edges: links of every form, parent domains, hot hosts, and what propagation changes on real pages."""

import random
from collections import defaultdict

import pytest

pytest.importorskip("sparkveil.llm")

from pyspark.sql import functions as F  # noqa: E402

from sparkveil.llm import url_filter  # noqa: E402

SF = "/root/testdata/sf0.01"
SCHEMA = "page_id long, url string, html string"


def twin(links, seeds, reverse):
    """The rounds in plain Python."""
    out = defaultdict(float)
    for s, _, w in links:
        out[s] += w
    base = {h: 0.15 * x for h, x in seeds.items() if x}
    now = dict(base)
    for _ in range(url_filter.ROUNDS):
        new = defaultdict(float, base)
        for s, d, w in links:
            a, b = (d, s) if reverse else (s, d)
            new[b] += 0.85 * now.get(a, 0) * w / out[s]
        now = new
    return now


def test_links(spark):
    rows = [
        (1, "http://a.org/x", "<a href='//B.org/y'>1</a><a class=k href=https://u:p@c.org:8080?q>2</a><img src='http://no.org/i'><link href='http://no.org/css'><AREA href=\"http://d.org\">"),
        (2, "http://a.org/y", "<base href='http://e.org/dir/'><a href='page.html'>r</a><a href='http://b.org'>again</a>"),
        (3, "http://f.org/", "<base href='http://g.org/'><a href='mailto:x@y.z'>m</a><a href='#top'>t</a>"),
        (4, None, "<a href='http://b.org'>x</a>"),
        (5, "http://a.org/z", None),
    ]
    got = {(r["src"], r["dst"], r["weight"]) for r in url_filter.host_links(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("a.org", "b.org", 2), ("a.org", "c.org:8080", 1), ("a.org", "d.org", 1), ("a.org", "e.org", 1)}


def test_domains(spark):
    hosts = spark.createDataFrame([("a.b.c.org",), ("x.b.c.org",), ("c.org",), ("1.2.3.4",), ("h.co.uk",), ("w.h.co.uk",), ("a.b.org:80",), ("",), ("localhost",)], "host string")
    got = {(r["src"], r["dst"]) for r in url_filter.domain_links(hosts).collect()}
    up = {("a.b.c.org", "b.c.org"), ("x.b.c.org", "b.c.org"), ("b.c.org", "c.org"), ("w.h.co.uk", "h.co.uk")}
    assert got == up | {(b, a) for a, b in up}


@pytest.mark.parametrize("split", [1_000_000, 2])
def test_scores_equal_the_twin(spark, split):
    """Random graphs, with hubs cut into parts and without."""
    rng = random.Random(3)
    rows = []
    for k in range(150):
        host = rng.choice(["a.com", "s.bad.net", "t.bad.net", "hub.org"] + [f"h{n}.org" for n in range(12)] + [f"w.h{n}.org" for n in range(4)])
        to = [rng.choice(["hub.org", "t.bad.net", "a.com"] + [f"h{n}.org" for n in range(12)]) for _ in range(rng.randint(0, 5))]
        rows.append((k, f"http://{host}/{rng.choice(['en', 'fr'])}/", "".join(f"<a href='http://{h}/'>x</a>" for h in to)))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["host"]: (r["trust"], r["distrust"]) for r in url_filter.judged(df, split=split).collect()}
    weight, ruled = defaultdict(int), defaultdict(list)
    for _, url, html in rows:
        host, path = url[7:].split("/", 1)
        for h in {x.split("/")[0] for x in html.split("http://")[1:]} - {host}:
            weight[host, h] += 1
        if host == "a.com" or host.endswith("net") and path == "fr/":
            ruled[host].append(host != "a.com")
    for host in {u[7:].split("/")[0] for _, u, _ in rows}:
        if host.count(".") == 2:
            weight[host, host.split(".", 1)[1]] += 1
            weight[host.split(".", 1)[1], host] += 1
    links = [(a, b, w) for (a, b), w in weight.items()]
    trust = twin(links, {h: 1 - sum(x) / len(x) for h, x in ruled.items()}, False)
    distrust = twin(links, {h: sum(x) / len(x) for h, x in ruled.items()}, True)
    for host, (t, d) in got.items():
        assert abs(t - trust.get(host, 0)) < 1e-9 and abs(d - distrust.get(host, 0)) < 1e-9


def test_propagation_changes_verdicts_of_real_pages(spark):
    """Pages whose host has no ruled page of its own, and so no seed, are judged through the graph."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    verdicts = lambda rounds: {r["page_id"]: r["verdict"] for r in url_filter.judged(pages, rounds=rounds).collect()}
    with_graph, without = verdicts(url_filter.ROUNDS), verdicts(0)
    assert sum(with_graph[k] != without[k] for k in with_graph) > 0


def test_edges(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert url_filter.judged(none).collect() == []
    row = (1, "http://x.net/es/", "<a href=//y.org>")
    odd = spark.createDataFrame([row, row, (None, None, None), (2, "", ""), (3, "http://y.org/" + "p" * 100_000, "z" * 500_000)], SCHEMA).withColumns({"host": F.lit(1), "rule": F.lit("r"), "score": F.lit(2.0), "_says": F.lit("allow")})
    got = sorted((r["page_id"] or 0, r["host"], r["rule"], r["verdict"]) for r in url_filter.judged(odd).collect())
    assert [g[:2] + g[3:] for g in got] == [(0, "", "allow"), (1, "x.net", "block"), (1, "x.net", "block"), (2, "", "allow"), (3, "y.org", "allow")]
