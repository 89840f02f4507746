"""Server-sent events over chunked streams, in batch and as Structured Streaming with the same kernel.

Input rows are (stream_id, seq, chunk). A stream's text is cut anywhere; events end at blank lines, and a
placeholder that a cut has split must still be restored. `Rehydrator` holds back what may be the start of one.
"""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BinaryType

from ..functions.workers import on_workers

#: Fixed value: the longest text that may be a placeholder.
HOLD = 100
_TAG = re.compile(r"<[A-Za-z0-9_:.-]{1,98}>")
_OPEN = re.compile(r"<[A-Za-z0-9_:.-]*\Z")


class Rehydrator:
    """Restores placeholders in text that comes in pieces; a tail that may yet become one waits for the next piece."""

    def __init__(self, mapping: dict[str, str], held: str = ""):
        self.mapping, self.held = mapping, held

    def feed(self, piece: str) -> str:
        text = self.held + piece
        tail = _OPEN.search(text)
        cut = tail.start() if tail and len(text) - tail.start() <= HOLD else len(text)
        self.held = text[cut:]
        return _TAG.sub(lambda m: self.mapping.get(m[0], m[0]), text[:cut])

    def finish(self) -> str:
        out, self.held = _TAG.sub(lambda m: self.mapping.get(m[0], m[0]), self.held), ""
        return out


class Framer:
    """Lines to events: a blank line ends one, CR at a line's end goes."""

    def __init__(self, buffer: str = ""):
        self.buffer = buffer

    def feed(self, chunk: str) -> list[str]:
        text = self.buffer + chunk
        waits = "\r" if text.endswith("\r") else ""  # its LF may be in the next chunk
        *events, rest = text[: len(text) - len(waits)].replace("\r\n", "\n").split("\n\n")
        self.buffer = rest + waits
        return [e for e in events if e]


class OfBytes:
    """A kernel of text that is fed with bytes, each as the Latin-1 character of its number: a character that a cut has split waits for its rest, bytes that are no UTF-8 become U+FFFD."""

    def __init__(self, kernel, held: str = ""):
        self.kernel, self.bytes = kernel, held

    def feed(self, piece: str) -> str:
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        text = decoder.decode((self.bytes + piece).encode("latin-1"))
        self.bytes = decoder.getstate()[0].decode("latin-1")
        return self.kernel.feed(text)

    def finish(self) -> str:
        rest, self.bytes = self.bytes.encode("latin-1").decode("utf-8", "replace"), ""
        return (self.kernel.feed(rest) if rest else "") + self.kernel.finish()


def in_pieces(chunks: DataFrame, chunk: str = "chunk") -> tuple[DataFrame, bool]:
    """chunks with text pieces, and whether these stand for bytes: binary chunks, which may be cut within a character, are for OfBytes."""
    binary = isinstance(chunks.schema[chunk].dataType, BinaryType)
    return (chunks.withColumn(chunk, F.decode(chunk, "ISO-8859-1")) if binary else chunks), binary


class BlockConverter:
    """Chat deltas to typed blocks: opens, fills and closes blocks as text and tool calls alternate."""

    def __init__(self):
        self.index, self.open, self.stop, self.done = -1, None, "end_turn", False

    def feed(self, event: str) -> Iterator[dict]:
        for line in event.split("\n"):
            if not line.startswith("data:") or self.done:
                continue
            data = line[5:].strip()
            if data == "[DONE]":
                yield from self.finish()
                return
            try:
                choice = (json.loads(data).get("choices") or [{}])[0] or {}
                delta = choice.get("delta") or {}
            except (ValueError, AttributeError, TypeError):  # no chat event
                continue
            if delta.get("content"):
                yield from self._to("text", None)
                yield {"type": "content_block_delta", "index": self.index, "text": delta["content"]}
            for call in filter(None, delta.get("tool_calls") or []):
                yield from self._to("tool_use", call.get("index", 0))
                yield {"type": "content_block_delta", "index": self.index, "partial_json": (call.get("function") or {}).get("arguments") or ""}
                self.stop = "tool_use"
            if choice.get("finish_reason") == "length":
                self.stop = "max_tokens"

    def _to(self, kind: str, which) -> Iterator[dict]:
        if self.open != (kind, which):
            if self.open:
                yield {"type": "content_block_stop", "index": self.index}
            self.index, self.open = self.index + 1, (kind, which)
            yield {"type": "content_block_start", "index": self.index, "block": kind}

    def finish(self) -> Iterator[dict]:
        if not self.done:
            if self.open:
                yield {"type": "content_block_stop", "index": self.index}
            self.done = True
            yield {"type": "message_stop", "stop_reason": self.stop}


def reassembled(chunks: DataFrame) -> DataFrame:
    """(stream_id, seq, chunk) -> stream_id, n, data: the data lines of whole events, in the JVM. One stream's chunks meet in one row, so streams, not chunks, are spread."""
    whole = chunks.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk"))), lambda x: x["chunk"]), "").alias("_all"))
    events = F.filter(F.split(F.regexp_replace("_all", "\r\n", "\n"), "\n\n"), lambda e: e.startswith("data:"))
    return whole.select("stream_id", F.posexplode(events).alias("n", "event")).select("stream_id", "n", F.trim(F.substr("event", F.lit(6))).alias("data"))


def restored_streams(chunks: DataFrame, mapping: dict[str, str], chunk: str = "chunk") -> DataFrame:
    """Batch: stream_id and text with placeholders restored across chunk borders; chunks are text or binary."""
    on_workers()
    chunks, binary = in_pieces(chunks, chunk)
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        kernel = OfBytes(Rehydrator(mapping)) if binary else Rehydrator(mapping)
        text = "".join(map(kernel.feed, pdf.sort_values("seq")[chunk])) + kernel.finish()
        return pd.DataFrame({"stream_id": [pdf["stream_id"].iloc[0]], "text": [text]})
    return chunks.groupBy("stream_id").applyInPandas(one, f"stream_id {chunks.schema['stream_id'].dataType.simpleString()}, text string")


def in_order(batches, due: int, waiting: str, all_of_them: bool = False) -> tuple[list[tuple[int, str | None]], int, str]:
    """The chunks (seq, chunk) that are due, the next seq and those that wait for a gap to close, as JSON.

    All batches of a key are gathered first, as rows of one micro-batch may come in any order. A seq that was seen before, as after
    a restart, is skipped; one beyond a gap waits. With all_of_them nothing waits any longer.
    """
    kept: dict[int, str | None] = {int(k): v for k, v in json.loads(waiting).items()}
    for pdf in batches:
        for seq, chunk in zip(pdf["seq"], pdf["chunk"], strict=True):
            if seq >= due:
                kept.setdefault(int(seq), chunk if isinstance(chunk, str) else None)
    ready = []
    while kept and (due in kept or all_of_them):
        due = due if due in kept else min(kept)
        ready.append((due, kept.pop(due)))
        due += 1
    return ready, due, json.dumps(kept)


def restoring_stream(chunks: DataFrame, mapping: dict[str, str], idle: str = "6 hours") -> DataFrame:
    """Streaming: the same kernel with its held text as state; a null chunk, or the timeout, ends a stream and flushes it. Chunks, of text or binary, are taken in the order of seq, which counts from 0, whatever order they come in."""
    on_workers()
    chunks, binary = in_pieces(chunks)
    milliseconds = int(pd.Timedelta(idle).total_seconds() * 1000)
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, due, waiting, cut = state.get if state.exists else ("", 0, "{}", "")
        text_kernel = Rehydrator(mapping, held)
        kernel, out, ended = OfBytes(text_kernel, cut) if binary else text_kernel, [], state.hasTimedOut
        ready, due, waiting = in_order(() if ended else batches, due, waiting, ended)
        for seq, chunk in ready:
            ended = ended or chunk is None
            out.append((seq, kernel.feed(chunk) if chunk is not None else ""))
        if ended:
            out.append((due, kernel.finish()))
            state.remove()
        else:
            state.update((text_kernel.held, due, waiting, kernel.bytes if binary else ""))
            state.setTimeoutDuration(milliseconds)
        yield pd.DataFrame({"stream_id": [key[0]] * len(out), "seq": [s for s, _ in out], "text": [t for _, t in out]})
    key = chunks.schema["stream_id"].dataType.simpleString()
    return chunks.groupBy("stream_id").applyInPandasWithState(step, f"stream_id {key}, seq long, text string", "held string, due long, waiting string, cut string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def _blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    converter = BlockConverter()
    rows = [e for data in pdf.sort_values("n")["data"] for e in converter.feed("data: " + data)] + list(converter.finish())
    return pd.DataFrame({"stream_id": pdf["stream_id"].iloc[0], "n": range(len(rows)), "type": [r["type"] for r in rows], "block": [r.get("index", -1) for r in rows], "body": [r.get("text", r.get("partial_json", r.get("block", r.get("stop_reason", "")))) for r in rows]})


def to_blocks(chunks: DataFrame) -> DataFrame:
    """(stream_id, seq, chunk) of chat deltas -> stream_id, n, type, block, body."""
    on_workers()
    key = chunks.schema["stream_id"].dataType.simpleString()
    return reassembled(chunks).groupBy("stream_id").applyInPandas(_blocks, f"stream_id {key}, n long, type string, block long, body string")


def gaps(rows: DataFrame, by: str, ts: str, seconds: Column | int, tie: str) -> DataFrame:
    """Where a stream was silent for longer than `seconds`: by, ts and the silence after it. Keep-alives and idle ends both follow from it."""
    from pyspark.sql import Window

    after = F.lead(ts).over(Window.partitionBy(by).orderBy(ts, tie))
    silence = F.unix_timestamp(after) - F.unix_timestamp(ts)
    return rows.select(by, ts, tie, silence.alias("silence")).where(F.col("silence") > seconds)


#: Fixed value: the comment that keeps a silent connection open.
KEEPALIVE = ": keepalive\n\n"


def comment(name: str, body: Column) -> Column:
    return F.concat(F.lit(f": {name} "), body, F.lit("\n\n"))


def error_event(anthropic: Column, body: Column) -> Column:
    """A gateway error (struct with message) as the last event of a stream of either dialect."""
    own = F.to_json(F.struct(F.lit("error").alias("type"), F.struct(F.lit("api_error").alias("type"), body["message"].alias("message"), body.alias("gateway")).alias("error")))
    return F.when(anthropic, F.concat(F.lit("event: error\ndata: "), own, F.lit("\n\n"))).otherwise(F.concat(F.lit("data: "), F.to_json(F.struct(body.alias("error"))), F.lit("\n\ndata: [DONE]\n\n")))


def decorated(chunks: DataFrame, keepalive: int = 10, total: int | None = None, served: Column | None = None, usage: Column | None = None, stream: str = "stream_id", seq: str = "seq", at: str = "at", chunk: str = "chunk") -> DataFrame:
    """chunks(stream, seq, at in seconds from the start, chunk) -> stream, seq, part, text: what a client sees.

    part 0 is the chunk itself; 1 holds the keep-alives of the silence after it, sent only between
    events; 2 the error that ends a stream beyond `total` seconds (later chunks are not sent). The
    JSON columns served and usage, if given, go out as comments: part -1 before a stream's first
    chunk, and part 3 after the last chunk of a stream that ends by itself.
    """
    from pyspark.sql import Window

    order = Window.partitionBy(stream).orderBy(seq)
    rows = chunks.withColumn("_next", F.lead(at).over(order)).withColumn("_first", F.row_number().over(order))
    late = F.lit(False) if total is None else F.col(at) >= total
    rows = rows.where(~late)
    upto = F.col("_next") if total is None else F.when(F.col("_next").isNotNull(), F.least("_next", F.lit(total)))
    boundary = F.col(chunk).endswith("\n\n") | F.col(chunk).endswith("\r\n\r\n")
    pings = F.greatest(F.coalesce(F.ceil((upto - F.col(at)) / keepalive) - 1, F.lit(0)), F.lit(0)).cast("int")
    kept = F.when(boundary, F.repeat(F.lit(KEEPALIVE), pings)).otherwise("")
    over = F.lit(False) if total is None else F.coalesce(F.col("_next") >= total, F.lit(False))
    body = F.struct(F.lit("stream exceeded its total time").alias("message"), F.lit("gateway_timeout").alias("type"), F.lit("total_timeout").alias("reason"))
    gap = F.when(boundary, "").otherwise("\n\n")
    end = F.concat(gap, error_event(F.lit(False), body))
    texts = {0: F.col(chunk), 1: kept, 2: F.when(over, end).otherwise("")}
    if served is not None:
        texts[-1] = F.when(F.col("_first") == 1, comment("gateway-served", served)).otherwise("")
    if usage is not None:
        texts[3] = F.when(F.col("_next").isNull(), F.concat(gap, comment("gateway-usage", usage))).otherwise("")
    parts = F.array(*(F.struct(F.lit(n).alias("part"), text.alias("text")) for n, text in sorted(texts.items())))
    return rows.select(stream, seq, F.explode(parts).alias("p")).select(stream, seq, "p.part", "p.text").where("text <> ''")


class LastGood:
    """A small table that is read again when its source changes; a source that does not parse leaves the last good one in place.

    For foreachBatch: `current()` is asked once a batch. read() must raise on a broken source, and version() tells changes apart.
    """

    def __init__(self, read, version):
        self.read, self.version, self.seen, self.rows, self.error = read, version, None, None, None

    def current(self):
        now = self.version()
        if now != self.seen:
            self.seen = now
            try:
                self.rows, self.error = self.read(), None
            except Exception as e:
                self.error = str(e)
                if self.rows is None:
                    raise
        return self.rows
