"""Events of three dialects, cut anywhere and out of order, give what the whole text gives."""

import json
import random

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkveil.operators import names as names_
from sparkveil.operators.names import Names
from sparkveil.operators.occurrences import Scanner
from sparkveil.streaming import dialects, sse

MAPPING = {"<CARD_A>": "4111", "<PASSWORD_A>": 'p"w\\1', "Nora Vale": "Ann Lee", "Nora": "Ann"}


def event(body, name=None):
    return (f"event: {name}\n" if name else "") + f"data: {json.dumps(body)}\n\n"


def chat(content=None, tool=None, fin=None, index=0):
    delta = {} if content is None else {"content": content}
    if tool is not None:
        delta["tool_calls"] = [{"index": 0, "function": {"arguments": tool}}]
    return event({"id": "x", "choices": [{"index": index, "delta": delta, "finish_reason": fin}]})


def text_of(stream):
    """All text by field."""
    out = {}
    for part in stream.split("\n\n"):
        data = [x[6:] for x in part.split("\n") if x.startswith("data: {")]
        for body in map(json.loads, data):
            dialect = dialects.dialect_of(body)
            for spot in dialect.texts(body) if dialect else ():
                out[*spot.part, *spot.key] = out.get((*spot.part, *spot.key), "") + spot.holder[spot.name]
    return out


def run(stream, size, state=False):
    kernel, out = dialects.EventRehydrator(Names(MAPPING, {"<SECRET:m>": "K"})), ""
    for k in range(0, len(stream), size):
        out += kernel.feed(stream[k : k + size])
        if state:
            kernel = dialects.EventRehydrator(kernel.names, kernel.state())
    return out + kernel.finish()


@given(st.lists(st.sampled_from(["<CARD", "_A>", "<", "no", "ra va", "le", " ", "Nora", "<CARD_A>", "x", "\\u003c", "PASSWORD_A\\u003e", "<SECRET:m>", "é"]), max_size=8), st.integers(1, 40), st.booleans())
@settings(max_examples=150, deadline=None)
def test_any_cut_gives_the_whole(pieces, size, state):
    whole = Names(MAPPING, {"<SECRET:m>": "K"})
    streams = {
        ("choice", 0, "content", 0): "".join(map(chat, pieces)) + chat(fin="stop") + "data: [DONE]\n\n",
        ("block", "2", "text"): "".join(event({"type": "content_block_delta", "index": 2, "delta": {"type": "text_delta", "text": p}}, "content_block_delta") for p in pieces) + event({"type": "content_block_stop", "index": 2}),
        ("item", "response.output_text", '"i"', "0", "null", "delta"): "".join(event({"type": "response.output_text.delta", "item_id": "i", "output_index": 0, "delta": p}) for p in pieces) + event({"type": "response.output_text.done", "item_id": "i", "output_index": 0}),
    }
    for key, stream in streams.items():
        assert text_of(run(stream, size, state)).get(key, "") == whole.restore("".join(pieces))
    tool = "".join(chat(tool=p) for p in pieces) + chat(fin="tool_calls")
    plain = dialects._ANGLE.sub(lambda m: m[1] + ("<" if m[2] in "cC" else ">"), "".join(pieces))
    assert text_of(run(tool, size, state)).get(("choice", 0, "arguments", 0, 0), "") == whole.restore(plain, escape=True, names=False, tool=True)


def test_what_is_no_event_passes():
    odd = ": comment\n\ndata: {broken\n\nevent: ping\n\ndata: [1]\n\ndata: 5\n\n" + event({"choices": [None, {"delta": None}, {"delta": {"tool_calls": [None, {}]}}]}).replace(", ", ",").replace(": ", ":").replace("data:", "data: ")
    assert run(odd, 5) == odd
    assert run(chat("<CARD_A") , 3).count("<CARD_A") == 1  # flushed at the end
    blocks = list(sse.BlockConverter().feed('data: {bad\ndata: {"choices":[null]}\ndata: {"choices":[{"delta":{"tool_calls":[{"function":null}]}}]}\ndata: [DONE]'))
    assert [b["type"] for b in blocks] == ["content_block_start", "content_block_delta", "content_block_stop", "message_stop"]


def test_flushed_text_precedes_the_end():
    out = run(chat("a <CARD_A") + chat("", fin="stop") + chat("b <X", index=1) + "data: [DONE]\n\n", 1000)
    assert out.index("<X") < out.index("[DONE]") and text_of(out) == {("choice", 0, "content", 0): "a <CARD_A", ("choice", 1, "content", 1): "b <X"}


def test_order(spark):
    frames = [pd.DataFrame({"seq": [3, 1], "chunk": ["d", "b"]}), pd.DataFrame({"seq": [0, 1], "chunk": ["a", "B"]})]
    ready, due, waiting = sse.in_order(frames, 0, "{}")
    assert (ready, due, waiting) == ([(0, "a"), (1, "b")], 2, '{"3": "d"}')
    assert sse.in_order([pd.DataFrame({"seq": [2], "chunk": [None]})], due, waiting) == ([(2, None), (3, "d")], 4, "{}")
    assert sse.in_order((), 2, '{"5": "x", "4": "w"}', True) == ([(4, "w"), (5, "x")], 6, "{}")


def test_shuffled_chunks_over_two_batches(spark, tmp_path):
    """Chunks in any order, in one micro-batch or the next, and some brought again: nothing is lost or doubled."""
    text = "a <CARD_A> b Nora Vale c <CARD_A>."
    stream = chat(text) + chat(fin="stop") + "data: [DONE]\n\n"
    chunks = [("s", k, stream[3 * k : 3 * k + 3]) for k in range(-(-len(stream) // 3))]
    chunks.append(("s", len(chunks), None))
    random.Random(3).shuffle(chunks)
    (tmp_path / "in").mkdir()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        for n, rows in enumerate((chunks[:25], chunks[20:])):
            pd.DataFrame(rows, columns=["stream_id", "seq", "chunk"]).to_json(tmp_path / "in" / f"{n}.json", orient="records", lines=True)
            source = spark.readStream.schema("stream_id string, seq long, chunk string").json(str(tmp_path / "in"))
            out = dialects.rehydrating_stream(source, MAPPING).writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "check"))
            q = out.trigger(once=True).start(str(tmp_path / "out"))
            try:
                assert q.awaitTermination(90)
            finally:
                q.stop()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = "".join(r["text"] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect())
    assert text_of(got) == {("choice", 0, "content", 0): Names(MAPPING).restore(text)}


def test_masked_bodies(spark):
    scanner = Scanner([("ann lee", "Nora Vale", True), ("4111", "<CARD_A>", False)])
    body = {"model": "4111", "messages": [{"role": "user", "content": "ANN LEE 4111 41112"}], "arguments": '{"a":["4111"]}', "partial_json": "{broken 4111"}
    assert names_.mask_walk(scanner, body) == {"model": "4111", "messages": [{"role": "user", "content": "Nora Vale <CARD_A> 41112"}], "arguments": '{"a":["<CARD_A>"]}', "partial_json": "{broken <CARD_A>"}
    assert names_._masked_bodies(pd.Series(["[1]", "x", None]), pd.Series([None, None, None])).tolist() == [None, None, None]
