"""Placeholders that stay the same over calls: a conversation's numbering as keyed state of a stream.

Turns are numbered in the order of `turn`, which counts from 0; one that comes before its turn waits in the state until the gap closes, so
the same turns get the same tags however they are dealt to micro-batches, and over restarts from the checkpoint.

A call to the state costs far more than a turn's work. So the state's keys are BUCKETS of conversations, each with PAGES; a page
holds its conversations, and is read and written once for all of a micro-batch's turns of them (once for every UNIT rows of a bucket, if there are more). Only the first INLINE
entities (kind and normalised value) and waiting turns of a conversation lie in its page. Further ones have pages of their own, entities by hash
and turns by number, so a turn of a large conversation touches only the entries near its own values, however many there are.

A conversation that rests for `hours` starts anew with an empty map. That is decided by the times of its turns, so it does not
depend on when a batch runs; an event-time timer of its bucket frees the state once the watermark is past the rest, to the minute. If turns still wait then,
they are taken without those that are missing. All that stays is the number of the next turn, for `forget_hours`.

A turn that finds the map full (`most` entities) gets no tag for a new entity and is blocked; known ones keep theirs.
Null conversations, turns and times are dropped, as they have no place in any order; a turn that comes twice counts once, the first
time. Turns without spans count, but give no rows. Rows later than the watermark allows are dropped by Spark.
The stream needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from zlib import crc32

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import scalars
from ..functions.workers import on_workers
from ..operators.conversation import TTL_HOURS
from ..operators.mask import MAX_ENTRIES

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR, MINUTE = 3_600_000, 60_000
COLUMNS = ("conv", "turn", "start", "kind", "value", "tag", "blocked")
#: Keys of the state and pages of each; both are fixed by a checkpoint.
BUCKETS, PAGES = 1_024, 64
#: Entities and waiting turns of a conversation that lie in its page, pages for its further entities, and how many rows of a bucket are held at once.
INLINE, SPREAD, UNIT = 64, 128, 50_000


def letters(n: int) -> str:
    """0, 1, ... as A .. Z, AA, AB ..."""
    out, n = "", n + 1
    while n:
        n, at = divmod(n - 1, 26)
        out = chr(65 + at) + out
    return out


def _name(kind: str | None, norm: str | None) -> str:
    """An entity as one string."""
    return f"{-1 if kind is None else len(kind)}{',' if norm is None else ':'}{kind}{norm}"


class Numbering(StatefulProcessor):
    """The numbering of the conversations of each bucket. times: the page's timer, by page; pages: conversations by page; more: what does not fit there, by conversation and place.

    A conversation is a list: the next turn, the time of the last one (-1: none), the time its rest counts from, the number of entities, numbers by kind, entities and waiting turns
    (the first of each), and the places of further waiting turns.
    """

    def __init__(self, rest: int, forget: int, most: int):
        self.rest, self.forget, self.most = rest, forget, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getValueState("times", "pages string")
        self.pages = handle.getMapState("pages", "page int", "conversations string")
        self.more = handle.getMapState("more", "conv string, at long", "entries string")

    # ---- one conversation ----

    def _open(self, conv: str, kept: list | None) -> None:
        self.conv, self.read, self.changed = conv, {}, set()
        self.due, self.seen, self.since, self.size, self.counts, self.entries, self.waiting, far = kept or (0, -1, -1, 0, {}, {}, {}, [])
        self.far = set(far)

    def _close(self) -> list:
        for at in self.changed:
            if self.read[at]:
                self.more.updateValue((self.conv, at), (json.dumps(self.read[at], ensure_ascii=False),))
            else:
                self.more.removeKey((self.conv, at))
        return [self.due, self.seen, self.since, self.size, self.counts, self.entries, self.waiting, sorted(self.far)]

    def _more(self, at: int) -> dict:
        """Entities (at below 0) or turns that lie outside the page."""
        if at not in self.read:
            kept = self.more.getValue((self.conv, at))
            self.read[at] = json.loads(kept[0]) if kept else {}
        return self.read[at]

    def _place(self, name: str) -> int:
        return -1 - crc32(name.encode()) % SPREAD

    def _empty(self) -> None:
        if self.size > INLINE:
            for at in range(-SPREAD, 0):
                if self._more(at):
                    self.read[at] = {}
                    self.changed.add(at)
        self.counts, self.entries, self.size = {}, {}, 0

    def _tag(self, kind: str | None, norm: str | None) -> str | None:
        """The tag of an entity, a new one if there is room."""
        name = _name(kind, norm)
        n = self.entries.get(name)
        if n is None and self.size > INLINE:
            n = self._more(self._place(name)).get(name)
        if n is None:
            if self.size >= self.most:
                return None
            by = _name(kind, "")
            n = self.counts.get(by, 0)
            self.counts[by] = n + 1
            if self.size < INLINE:
                self.entries[name] = n
            else:
                at = self._place(name)
                self._more(at)[name] = n
                self.changed.add(at)
            self.size += 1
        return f"<{kind}_{letters(n)}>"

    def _number(self, turn: int, ms: int, spans: str) -> Iterator[tuple]:
        """The rows of one turn; all that state remembers of the conversation moves on."""
        if self.seen >= 0 and ms - self.seen >= self.rest:
            self._empty()
        self.seen = max(self.seen, ms)
        rows, full = [], False
        for start, kind, value, norm in sorted(json.loads(spans), key=lambda s: (s[0], s[1], s[3])):
            known = self._tag(kind, norm)
            full |= known is None
            rows.append((self.conv, turn, start, kind, value, known))
        return ((*row, full) for row in rows)

    def _waits(self, turn: int) -> bool:
        return str(turn) in self.waiting or turn // INLINE in self.far and str(turn) in self._more(turn // INLINE)

    def _wait(self, turn: int, ms: int, spans: str) -> None:
        if len(self.waiting) < INLINE:
            self.waiting[str(turn)] = (ms, spans)
        else:
            at = turn // INLINE
            self._more(at)[str(turn)] = (ms, spans)
            self.changed.add(at)
            self.far.add(at)

    def _taken(self, turn: int) -> tuple[int, str] | None:
        """A waiting turn, which then waits no more."""
        if (kept := self.waiting.pop(str(turn), None)) is not None or (at := turn // INLINE) not in self.far:
            return kept
        if (kept := self._more(at).pop(str(turn), None)) is not None:
            self.changed.add(at)
            if not self._more(at):
                self.far.discard(at)
        return kept

    def _arrive(self, rows: list[tuple[int, int, str]]) -> Iterator[tuple]:
        """Turns in their order as far as they go without a gap."""
        arrived: dict[int, tuple[int, str]] = {}
        for turn, ms, spans in rows:
            self.since = max(self.since, ms)
            if turn >= self.due and turn not in arrived and not self._waits(turn):
                arrived[turn] = (ms, spans)
        while (row := arrived.pop(self.due, None) or self._taken(self.due)) is not None:
            yield from self._number(self.due, *row)
            self.due += 1
        for turn, row in arrived.items():
            self._wait(turn, *row)

    def _expire(self) -> Iterator[tuple]:
        """The turns that still wait; then an empty map."""
        for turn in sorted({int(t) for at in self.far for t in self._more(at)} | {int(t) for t in self.waiting}):
            yield from self._number(turn, *self._taken(turn))
            self.due = turn + 1
        self._empty()
        self.seen, self.since = -1, self.since + self.forget

    # ---- one bucket ----

    def _keep(self, times: dict[str, int], page: int, held: dict[str, list]) -> None:
        """Keep the page, with a timer for its first conversation that ends."""
        if not held:
            self.pages.removeKey((page,))
            return
        self.pages.updateValue((page,), (json.dumps(held, ensure_ascii=False),))
        end = -((min(kept[2] for kept in held.values()) + self.rest) // -MINUTE) * MINUTE
        if end < times.get(str(page), end + 1):
            if end not in times.values():
                self.handle.registerTimer(end)
            times[str(page)] = end

    def _held(self, page: int) -> dict[str, list]:
        kept = self.pages.getValue((page,))
        return json.loads(kept[0]) if kept else {}

    def _unit(self, frames: list[pd.DataFrame]) -> pd.DataFrame:
        by_page: dict[int, dict[str, list]] = {}
        for pdf in frames:
            for page, conv, *row in zip(*(pdf[c].tolist() for c in ("page", "conv", "turn", "ms", "spans")), strict=True):
                by_page.setdefault(page, {}).setdefault(conv, []).append(row)
        kept = self.times.get()
        times, out = json.loads(kept[0]) if kept else {}, []
        before = dict(times)
        for page, convs in by_page.items():
            held = self._held(page)
            for conv, rows in convs.items():
                self._open(conv, held.get(conv))
                out += self._arrive(rows)
                held[conv] = self._close()
            self._keep(times, page, held)
        if times != before:
            self.times.update((json.dumps(times),))
        return pd.DataFrame(out, columns=COLUMNS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames, n = [], 0
        for pdf in rows:
            frames.append(pdf)
            n += len(pdf)
            if n >= UNIT:
                yield self._unit(frames)
                frames, n = [], 0
        if frames:
            yield self._unit(frames)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = expiredTimerInfo.getExpiryTimeInMs(), []
        kept = self.times.get()
        times = json.loads(kept[0]) if kept else {}
        for page in [int(page) for page, end in times.items() if end <= now]:
            del times[str(page)]
            held = self._held(page)
            for conv in [conv for conv, kept in held.items() if kept[2] + self.rest <= now]:
                asleep = held[conv][1] < 0 and not held[conv][6] and not held[conv][7]
                self._open(conv, held.pop(conv))
                if not asleep:
                    out += self._expire()
                    held[conv] = self._close()
            self._keep(times, page, held)
        if times:
            self.times.update((json.dumps(times),))
        else:
            self.times.clear()
        yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


def _as_text(value: Column, kind: str) -> Column:
    return F.hex(value) if kind == "binary" else F.unix_micros(value).cast("string") if kind == "timestamp" else value.cast("string")


def _from_text(text: Column, kind: str) -> Column:
    return F.unhex(text) if kind == "binary" else F.timestamp_micros(text.cast("long")) if kind == "timestamp" else text.cast(kind)


def numbered(found: DataFrame, conv: str = "conv_id", turn: str = "turn", ts: str = "ts", spans: str = "spans", hours: float = TTL_HOURS, forget_hours: float = 168, most: int = MAX_ENTRIES) -> DataFrame:
    """A stream of turns (conv, turn, ts with a watermark, spans: array<struct<start, kind, value, ...>>) -> conv, turn, start, kind, value, tag, blocked: a row for each span."""
    spark = on_workers()
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKS:
        raise ValueError(f"spark.sql.streaming.stateStore.providerClass must be {ROCKS}")
    as_list = F.transform(spans, lambda s: F.array(s["start"].cast("string"), s["kind"], s["value"], scalars.normalize(s["kind"], s["value"])))
    numbers = F.transform(as_list, lambda s: F.concat(F.lit("["), s[0], F.lit(","), F.substr(F.to_json(F.slice(s, 2, 3)), F.lit(2))))
    rows = found.where(F.col(conv).isNotNull() & F.col(turn).isNotNull() & F.col(ts).isNotNull())
    kind = rows.schema[conv].dataType.simpleString()
    rows = rows.select(_as_text(F.col(conv), kind).alias("conv"), F.col(turn).cast("long").alias("turn"), F.unix_millis(F.col(ts).cast("timestamp")).alias("ms"), F.concat(F.lit("["), F.coalesce(F.array_join(numbers, ","), F.lit("")), F.lit("]")).alias("spans"), F.col(ts).alias("at"))
    page = F.pmod(F.xxhash64("conv"), F.lit(BUCKETS * PAGES))
    rows = rows.select((page / PAGES).cast("int").alias("bucket"), (page % PAGES).cast("int").alias("page"), "*")
    step = Numbering(int(hours * HOUR), int(forget_hours * HOUR), most)
    out = rows.groupBy("bucket").transformWithStateInPandas(step, "conv string, turn long, start int, kind string, value string, tag string, blocked boolean", "append", "eventTime")
    return out.select(_from_text(F.col("conv"), kind).alias(conv), F.col("turn").alias(turn), "start", "kind", "value", "tag", "blocked")
