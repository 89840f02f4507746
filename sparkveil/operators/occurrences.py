"""Known values in texts: many values at once, by an automaton, for lists that are the same for all rows and for those of each conversation."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column

from ..functions.workers import series_udf

_LOWER = {c: c + 32 for c in range(65, 91)}


def is_word(c: str) -> bool:
    return c.isalnum() or c == "_" or unicodedata.category(c)[0] == "M"


def bounded(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] is no part of a longer word; edges that are no word characters bound themselves."""
    return not (start and is_word(text[start]) and is_word(text[start - 1]) or end < len(text) and is_word(text[end - 1]) and is_word(text[end]))


class Scanner:
    """entries: (value, replacement, ignore_case). Of equal values the first one counts; empty ones match nothing.

    Only bounded occurrences count. Of those that overlap, the leftmost and then the longest is taken. Values that ignore
    (ASCII) case go first and win where they overlap others. Each scan costs the text's length and its matches.
    """

    def __init__(self, entries: list[tuple[str, str, bool]]):
        self.automata = []
        for loose in (True, False):
            found = ahocorasick.Automaton()
            for value, by, ignore_case in entries:
                key = value.translate(_LOWER) if loose else value
                if ignore_case == loose and value and key not in found:
                    found.add_word(key, (len(value), by))
            if len(found):
                found.make_automaton()
                self.automata.append((loose, found))

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, replacement), disjoint and in order."""
        taken: list[tuple[int, int, str]] = []
        for loose, automaton in self.automata:
            hits = ((end + 1 - size, end + 1, by) for end, (size, by) in automaton.iter(text.translate(_LOWER) if loose else text))
            before, new, k, at = taken, [], 0, 0
            for start, end, by in sorted((h for h in hits if bounded(text, h[0], h[1])), key=lambda h: (h[0], -h[1])):
                while k < len(before) and before[k][1] <= start:
                    k += 1
                if start >= at and not (k < len(before) and before[k][0] < end):
                    new.append((start, end, by))
                    at = end
            taken = sorted(before + new)
        return taken

    def replace(self, text: str) -> str:
        out, at = [], 0
        for start, end, by in self.find(text):
            out += [text[at:start], by]
            at = end
        return "".join([*out, text[at:]]) if out else text


def replaced(text: Column, entries: list[tuple[str, str, bool]]) -> Column:
    """text with every occurrence replaced in one scan; null stays null. The entries go to the workers with the function."""
    scanner: list[Scanner] = []

    def scan(texts: pd.Series) -> pd.Series:
        if not scanner:
            scanner.append(Scanner(entries))
        return texts.map(lambda t: scanner[0].replace(t) if isinstance(t, str) else None)

    return series_udf(scan, "string")(text)


def found(text: Column, entries: list[tuple[str, str, bool]]) -> Column:
    """Every occurrence in one scan, as array<struct<start, end, by, value>>; null for a null text."""
    scanner: list[Scanner] = []

    def scan(texts: pd.Series) -> pd.Series:
        if not scanner:
            scanner.append(Scanner(entries))
        return pd.Series([[{"start": a, "end": b, "by": by, "value": t[a:b]} for a, b, by in scanner[0].find(t)] if isinstance(t, str) else None for t in texts], dtype=object)

    return series_udf(scan, "array<struct<start:int,end:int,by:string,value:string>>")(text)


def folded(text: str) -> str:
    """text so that two texts that differ only in the case of ASCII letters become one."""
    return text.lower().replace("ς", "σ")


class Entries:
    """What is known in one conversation: tags by key, and values (loose: in any ASCII case) that may occur in its texts."""

    def __init__(self):
        self.tags: dict[str, str] = {}
        self.values: list[tuple[bool, str, str]] = []
        self.automata: list[tuple[bool, ahocorasick.Automaton]] | None = None

    def add(self, sort: str, value: str, tag: str) -> None:
        if sort == "key":
            self.tags[value] = tag
        else:
            self.values.append((sort == "loose", value, tag))

    def within(self, text: str) -> list[tuple[bool, str, str]]:
        """The values that text holds anywhere, also inside longer words."""
        if self.automata is None:
            self.automata = []
            for wanted in (True, False):
                found = ahocorasick.Automaton()
                for loose, value, tag in self.values:
                    if loose == wanted:
                        key = folded(value) if loose else value
                        found.add_word(key, [*found.get(key, ()), (loose, value, tag)])
                if len(found):
                    found.make_automaton()
                    self.automata.append((wanted, found))
        return list(dict.fromkeys(hit for loose, automaton in self.automata for _, hits in automaton.iter(folded(text) if loose else text) for hit in hits))


#: What `entries_of_rows` reads (but for _key and _row, of any type) and adds to the rows.
HITS = pa.list_(pa.struct([("loose", pa.bool_()), ("value", pa.string()), ("tag", pa.string())]))


def between(text: str, spans: Iterable[tuple[int, int]], mark: str) -> str:
    """text with a mark in the place of each span."""
    out, end = [], 0
    for start, after in spans:
        out.append(text[end:start])
        end = after
    return mark.join([*out, text[end:]])


def entries_of_rows(at: int, spans: int, mark: str, other: str):
    """For mapInArrow: a stream of _key, _part, _keys, _sort, _value, _tag and _row, in which the entries (_row null) of each key and part come
    before its rows, becomes its rows with _tags, those of _keys, and _hits, the values that field number `at` of the row holds outside the spans in field number `spans` (null if
    nothing is known to the conversation). One conversation's entries are held at a time. mark is read as other.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, known = None, Entries()
        for batch in batches:
            is_row = batch.column("_row").is_valid()
            texts, places = batch.column("_row").field(at), batch.column("_row").field(spans)
            starts, ends, offsets = places.values.field("start").to_pylist(), places.values.field("end").to_pylist(), places.offsets.to_pylist()
            tags, hits = [], []
            columns = (batch.column(c).to_pylist() for c in ("_key", "_part", "_keys", "_sort", "_value", "_tag"))
            for i, (key, part, keys, sort, value, tag) in enumerate(zip(*columns, strict=True)):
                if here != (key, part):
                    here, known = (key, part), Entries()
                if sort is not None:
                    known.add(sort, value, tag)
                    continue
                tags.append([known.tags.get(k) for k in keys or ()])
                text = texts[i].as_py() if known.values else None
                found = known.within(between(text.replace(mark, other), zip(starts[offsets[i] : offsets[i + 1]], ends[offsets[i] : offsets[i + 1]], strict=True), mark)) if text is not None else []
                hits.append([dict(zip(("loose", "value", "tag"), h, strict=True)) for h in found] if known.values else None)
            if tags:
                rows = batch.filter(is_row).column("_row")
                yield pa.RecordBatch.from_arrays([rows, pa.array(tags, pa.list_(pa.string())), pa.array(hits, HITS)], ["_row", "_tags", "_hits"])
    return run
