"""The two passes over blocks: what decides, against a plain twin, and markup that ends oddly."""

import random
import re

import pytest

pytest.importorskip("sparkveil.llm")

from pyspark.sql import functions as F  # noqa: E402

from sparkveil.llm import html_text  # noqa: E402

SF = "/root/testdata/sf0.01"
GOOD = "the cat and the dog are in the house of the man who is with them "


def twin(features):
    """Labels of (characters, linked share, stop-word density) by the rules as the docstring states them, without carrying anything along."""
    labels = []
    for n, link, density in features:
        if link > 0.33:
            labels.append("bad")
        elif n >= 70 and density >= 0.25 or n >= 200 and density >= 0.12:
            labels.append("good")
        elif n >= 70 and density < 0.12 and link > 0:
            labels.append("bad")
        else:
            labels.append(None)
    out = []
    for at, label in enumerate(labels):
        found = {abs(k - at): set() for k, x in enumerate(labels) if x}
        for k, x in enumerate(labels):
            if x:
                found[abs(k - at)].add(x)
        left = next((labels[k] for k in range(at - 1, -1, -1) if labels[k]), None)
        right = next((labels[k] for k in range(at + 1, len(labels)) if labels[k]), None)
        if label:
            out.append(label)
        elif not found:
            out.append("good")
        elif left and left == right:
            out.append(left)
        else:
            nearest = found[min(found)]
            out.append("good" if len(nearest) > 1 else nearest.pop())
    return [x == "good" for x in out], sum(x is not None for x in labels)


def density(text):
    found = re.findall(r"\w+", text.lower())
    return sum(w in html_text.STOP_WORDS for w in found) / max(1, len(found))


def test_passes_equal_the_twin():
    rng = random.Random(8)
    for _ in range(400):
        made = []
        for _ in range(rng.randint(0, 12)):
            words = [rng.choice(["the", "of", "and"]) if rng.random() < rng.choice([0, 0.15, 0.5]) else "zorb" for _ in range(rng.choice([1, 3, 12, 20, 60]))]
            cut = rng.choice([0, 0, 0, 1, len(words) // 3, len(words)])
            made.append((" ".join(words[:cut]), " ".join(words[cut:])))
        html = "".join(f"<div><a href=x>{a}</a> {b}</div>" for a, b in made)
        blocks = [(f"{a} {b}".strip(), len(a)) for a, b in made]
        labels, by_rule = twin([(len(t), n / len(t), density(t)) for t, n in blocks])
        assert html_text.judged(html) == ("\n".join(t for (t, _), ok in zip(blocks, labels, strict=True) if ok), by_rule, len(blocks) - by_rule)


def test_an_article_element_decides_nothing():
    links = "".join(f"<li><a href=/{k}>some page {k}</a></li>" for k in range(5))
    assert html_text.main_text(f"<article><ul>{links}</ul><p>{GOOD * 2}</p></article>") == (GOOD * 2).strip()
    assert html_text.main_text(f"<div><p>{GOOD * 2}</p><p>Short.</p></div><div>{links}</div>") == (GOOD * 2).strip() + "\nShort."


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<div><form><input></div><article><p>all of it</p></article>", "all of it"),
        ("<form>a<form>b</form>c<p>yes</p>", "c\nyes"),
        ("<div><button>go<svg><path></div><p>text</p>", "text"),
        ("<p>x <button>b</button> y</p>", "x y"),
        ("<ul><li class=ad>buy<li>kept</ul>", "kept"),
        ("<p class=ad>buy<div>kept</div>", "kept"),
        ("<div class=responsive><p>kept</p></div>", "kept"),
        ("<article><div class='article-header'><h1>Title</h1></div><p>text</p></article><div class='site-header'>S</div>", "Title\ntext"),
        ("<p>a &lt<b>;</b> b &amp<i></i>amp;</p>", "a <; b &amp;"),
        ("<p>1 < 2 &#x41;&nbsp;&nbsp;B</p>", "1 < 2 A B"),
        ("<div hidden>no</div><div class='x comments'>no</div><div id=sidebar>no</div><p>yes", "yes"),
        ("<nav><p>" + GOOD * 4 + "</p></nav><p>yes</p>", "yes"),
        ("<select><option>a</select><p>yes</p>", "yes"),
        ("</div></p></article>yes", "yes"),
    ],
)
def test_odd_markup(html, want):
    assert html_text.main_text(html) == want


def test_rules_and_neighbours_decide_real_pages(spark):
    """No page of the table is decided by its containers alone: both passes have work, and the article comes out whole."""
    got = html_text.extracted(spark.read.parquet(f"{SF}/pages.parquet")).agg(F.sum("n_by_rule").alias("rule"), F.sum("n_inherited").alias("inherited"), F.min("n_chars").alias("least")).first()
    assert got["rule"] > 1000 and got["inherited"] > 1000 and got["least"] > 0


def test_edges(spark):
    schema = "page_id long, url string, html string, text int, _id string, n_chars string, _html int"
    assert html_text.extracted(spark.createDataFrame([], schema)).collect() == []
    row = (1, None, "<p>a</p>", 5, "x", "y", 7)
    got = html_text.extracted(spark.createDataFrame([row, row, (None, "u", None, None, None, None, None), (2, "u", "<p>" + "a b " * 300_000, 1, "x", "y", 7)], schema)).collect()
    assert sorted((r["page_id"] or 0, r["url"], r["text"][:3], r["n_chars"]) for r in got) == [(0, "u", "", 0), (1, None, "a", 1), (1, None, "a", 1), (2, "u", "a b", 1_199_999)]
