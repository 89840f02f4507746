"""Language labels of whole texts against a plain network that goes byte by byte."""

import os
import random
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
from pyspark.sql import functions as F  # noqa: E402

from sparkveil.llm import language_id as lid  # noqa: E402


def plain_states(gru, data):
    """States after each byte, one at a time, in double precision."""
    n, h, out = len(gru.u), np.zeros(len(gru.u)), []
    w, u = gru.w.astype(float), gru.u.astype(float)
    for b in data:
        z, r = (1 / (1 + np.exp(-(w[b][k * n : k * n + n] + h @ u[:, k * n : k * n + n]))) for k in (0, 1))
        c = np.tanh(w[b][2 * n :] + (r * h) @ u[:, 2 * n :])
        h = (1 - z) * h + z * c
        out.append(h)
    return out


def plain(net, text):
    """Pooled probabilities of a text: each core with CONTEXT bytes before it (forward) and after it (backward)."""
    data, total = text.encode(), np.zeros(len(net.langs))
    for a in range(0, len(data), lid.INNER):
        b = min(a + lid.INNER, len(data))
        before, after = max(0, a - lid.CONTEXT), min(len(data), b + lid.CONTEXT)
        ahead = plain_states(net.ahead, data[before:b])[a - before :]
        behind = plain_states(net.behind, data[a:after][::-1])[::-1][: b - a]
        for f, g in zip(ahead, behind, strict=True):
            logit = np.concatenate([f, g, [1]]) @ net.out.astype(float)
            total += logit - logit.max() - np.log(np.exp(logit - logit.max()).sum())
    p = np.exp(total / len(data))
    return p / p.sum()


def test_whole_texts_against_plain_network():
    rng, net = random.Random(3), lid.Network(["a", "b", "c"], hidden=5)
    sizes = [1, 2, 40, 63, 64, 65, 255, 256, 257, 319, 320, 321, 700, 2000]
    texts = ["".join(rng.choice("abc déñ\n中!") for _ in range(n)) + "x" for n in sizes]
    rng.shuffle(texts)
    langs, scores = lid.predict(net, pa.array([None, *texts, "", "12 !"]))
    assert (langs[0], scores[0]) == (langs[-1], scores[-1]) == (langs[-2], scores[-2]) == ("und", 0.0)
    for text, lang, score in zip(texts, langs[1:], scores[1:], strict=False):
        p = plain(net, text)
        assert lang == net.langs[int(p.argmax())] and score == pytest.approx(p.max(), abs=1e-4)
    # neither the neighbours in a batch nor an offset into it change a label
    alone = [lid.predict(net, pa.array([t])) for t in texts]
    assert [a for (a,), _ in alone] == langs[1:-2]
    sliced = lid.predict(net, pa.array(["filler", *texts]).slice(3))
    assert sliced[0] == langs[3:-2] and np.allclose(sliced[1], scores[3:-2], atol=1e-4)


def test_scores_ignore_how_often_a_text_stands_in_itself():
    net = lid.Network(["a", "b"], hidden=4)
    (_,), (once,) = lid.predict(net, pa.array(["word " * 200]))
    (_,), (often,) = lid.predict(net, pa.array(["word " * 20_000]))
    assert abs(once - often) < 0.01


def test_rare_languages_are_learned(spark):
    """The sample has as many rows of each language as there are: one in a thousand is enough."""
    rng = random.Random(4)
    def words(letters, n=40):
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))
    rows = [(i, words("abcdefgh"), "common") for i in range(6000)] + [(10_000 + i, words("xyzuvw"), "rare") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r["lang_pred"] for r in lid.identified(docs).collect()}
    assert all(found[i] == lang for i, _, lang in rows)


def test_repeated_ids_and_texts_leave_no_language_out(spark):
    """One id for all rows, none at all, a few ids for most rows, one text for a language: each text gets the language it has."""
    rng = random.Random(5)
    def words(letters, n=30):
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))
    few = [i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1][:4]  # ids that are not held out
    tables = [
        [(few[0], words("xyzuvw"), "b") for _ in range(600)], [(None, words("xyzuvw"), "b") for _ in range(600)],
        [(few[i % 4], words("xyzuvw"), "b") for i in range(2400)], [(few[1], "xyz wuv zzy xuw vxy", "b") for _ in range(2400)] + [(few[1], "...", "c")] * 50,
    ]
    for k, table in enumerate(tables):
        rows = [(100 + i, words("abcdefgh"), "a") for i in range(600 if k else 0)] + table
        net = lid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
        assert net.langs == (["a", "b"] if k else ["b"])
        texts = [t for _, t, lang in rows if lang != "c"]
        right = [a == lang for a, (_, _, lang) in zip(lid.predict(net, pa.array(texts))[0], rows, strict=False)]
        assert sum(right) >= 0.99 * len(right) and all(right[-500:])


def test_edges(spark):
    schema = "doc_id long, text string, lang string, _row string, _text string, lang_pred string, score double, _order int"
    none = spark.createDataFrame([], schema)
    assert lid.identified(none).collect() == [] and lid.accepted(none).collect() == []
    rows = [(1, "the word", "en"), (1, "the word", "en"), (None, "le mot", "fr"), (2, None, None), (3, "中文", None), (4, "le mot " * 50_000, "fr"), (5, "", "fr")]
    docs = spark.createDataFrame([(*r, "row", "text", "pred", 0.5, 1) for r in rows], schema)
    got = lid.identified(docs).collect()
    assert len(got) == len(rows) and {r["lang_pred"] for r in got} <= {"en", "fr", "und"}
    assert [r["lang_pred"] for r in got if r["doc_id"] in (2, 5)] == ["und", "und"] and len({(r["lang_pred"], r["score"]) for r in got if r["doc_id"] == 1}) == 1
    kept = lid.accepted(docs)
    assert kept.columns == docs.columns and kept.count() == 5
    assert {r["lang_pred"] for r in lid.identified(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
