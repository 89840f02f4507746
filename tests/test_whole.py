"""Named queries that must take every row: whole results against brute force on small fixtures."""

import re
from collections import Counter

import pytest

from sparkveil import queries, queries_catalog, queries_more  # noqa: F401
from sparkveil.operators import ner, surrogate


def brute_chunks(text):
    """Paragraphs; one over the limit in pieces of whole lines."""
    out = []
    for para in (text or "").split("\n\n"):
        if len(para.encode()) <= ner.CHUNK:
            out.append(para)
            continue
        now = None
        for line in para.split("\n"):
            if now is not None and len(f"{now}\n{line}".encode()) > ner.CHUNK:
                out.append(now)
                now = None
            now = line if now is None else f"{now}\n{line}"
        out.append(now)
    return out


def test_chunks_of_every_document(spark, tmp_path):
    texts = [None, "", "a\n\nb", "x" * 4096, "é" * 2049, "\n".join(["line é " * 90] * 40) + "\n\nend", "\n".join(["w" * 4095, "", "y", "z" * 9000, "t"]), "\n" + "q" * 4096, "\n".join("k" * n for n in range(300))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {n: (len(c), max(len(x.encode()) for x in c)) for n, c in enumerate(map(brute_chunks, texts))}
    got = {r["doc_id"]: (r["chunks"], r["longest"]) for r in queries.QUERIES["ner_chunks_whole"](spark, str(tmp_path)).collect()}
    assert got == want and sum(n > 1 for n, _ in want.values()) >= 5
    short = {n for n, t in enumerate(texts) if all(len(p.encode()) <= ner.CHUNK for p in (t or "").split("\n\n"))}
    twin = {r["doc_id"]: (r["chunks"], r["longest"]) for r in queries.QUERIES["ner_chunks"](spark, str(tmp_path)).collect()}
    assert twin == {n: want[n] for n in short} and 0 in short


def test_pools_are_large_and_disjoint():
    sizes = {len(surrogate.GIVEN_FIRST): 82, len(surrogate.FAMILY_FIRST): 62, len(surrogate.ORG): 24 * 12, len(surrogate.CITY_FIRST): 39}
    assert all(ours >= theirs for ours, theirs in sizes.items())
    names = [x.lower() for x in [*surrogate.GIVEN, *surrogate.FAMILY, *surrogate.CITY, *surrogate.ORG]]
    assert len(set(names)) == len(names)


@pytest.mark.parametrize(("kind", "raw", "pool"), [("PERSON", "n{}", "GIVEN"), ("PERSON", "n n{}", "FAMILY"), ("ORG", "n{}", "ORG"), ("LOCATION", "n{}", "CITY")])
def test_a_conversation_is_blocked_only_when_its_pool_is_empty(kind, raw, pool):
    size = len(getattr(surrogate, pool))
    conv = surrogate.Conversation(3, [])
    got = [conv.of(kind, raw.format(n)) for n in range(size + 5)]
    assert len(set(got[:size])) == size and None not in got[:size] and got[size:] == [None] * 5


def test_customers_of_every_kind_get_surrogates(spark):
    got = queries.QUERIES["surrogate_person"](spark, "/root/testdata/sf0.01").collect()
    assert Counter(r["kind"] for r in got) == dict.fromkeys(("PERSON", "ORG", "LOCATION", "ADDRESS"), 1500)
    assert all(r["surrogate"] for r in got) and len({(r["conv_id"], r["surrogate"]) for r in got}) == len(got)


def brute_words(text):
    """Words of at most 64 bytes, and at most three symbols in a row."""
    run = words = 0
    for w in re.findall(r"\w+(?:[-_]\w+)*|\S", text or ""):
        run = 0 if re.search(r"[^\W_]", w) else run + 1
        words += len(w.encode()) <= 64 and run <= 3
    return words


def test_words_of_every_turn(spark, tmp_path):
    texts = [None, "", " ", "no", "wait ... what?", 'he said "really?!", then left', "a !!!!!! b", "?? ? ? ? x ?", "(a), (b)", "x" * 64 + " " + "y" * 65, "é-ü a_b __ ____ ," * 3]
    spark.createDataFrame([(1, n, "user", t) for n, t in enumerate(texts)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["turn"]: r["words"] for r in queries.QUERIES["tagger_words_whole"](spark, str(tmp_path)).collect()}
    assert got == {n: brute_words(t) for n, t in enumerate(texts)}
