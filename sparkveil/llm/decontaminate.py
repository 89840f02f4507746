"""Benchmark decontamination by pigeonhole edit matching, on words.

Texts and items are lower-cased and cut into runs of letters and digits. An item of n words may
match a stretch of a document with up to k = floor((1 - similarity) * n) word edits. Cut into k + 1
pieces of nearly equal length, at least one piece of it is in any such stretch unchanged, so an
Aho-Corasick automaton over all pieces finds every place worth a look; Myers' bit-parallel
distance over the words around it then decides. Documents are scanned whole, and every hit is verified.

Items go to the executors in blocks of about block_bytes (larger benchmark tables are dealt into more blocks by a hash of id and
text), so what is sent is bounded at any benchmark size, also if one text is all of it. With several blocks, rows are written once to the
shared folder with a number, each block scans their texts alone, and the hits are joined back by that number.

Items without a word match nothing; a null or empty document is clean. Ids may have any type that sorts. Items repeated in the table
are all reported, the same id and text once. An item with a null id counts as any other and is reported as null; such items are
told apart by their words, so a document that holds two different ones has n_items 2. Items of fewer than five words have no room for an edit and match as a
whole only; min_words leaves out shorter items (the default, 1, leaves out none, so an item of one word marks each document that has it).
Repeated documents are judged alike, each on its own; other columns, whatever their names, are kept by matches and clean.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator
from typing import Any

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import on_workers, saved

SIMILARITY, MIN_WORDS, BLOCK_BYTES = 0.8, 1, 8_000_000
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def myers(pattern: list[str], stretch: list[str], most: int) -> tuple[int, int] | None:
    """The least edit distance of pattern to any part of stretch and the last end that has it, if it is at most `most`."""
    m = len(pattern)
    seen: dict[str, int] = {}
    for at, word in enumerate(pattern):
        seen[word] = seen.get(word, 0) | 1 << at
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, None
    for end, word in enumerate(stretch):
        eq = seen.get(word, 0)
        x = eq | minus
        d0 = (((x & plus) + plus) ^ plus) | x
        horizontal_plus, horizontal_minus = minus | (~(d0 | plus) & full), plus & d0
        if horizontal_plus & top:
            score += 1
        elif horizontal_minus & top:
            score -= 1
        horizontal_plus <<= 1
        plus = ((horizontal_minus << 1) | (~(d0 | horizontal_plus) & full)) & full
        minus = horizontal_plus & d0 & full
        if score <= most and (best is None or score <= best[0]):
            best = (score, end + 1)
    return best


def _order(row: tuple) -> tuple:
    """A key that puts null ids first."""
    return (False, row[1]) if row[0] is None else (True, row[0], row[1])


class Matcher:
    """The pieces of some items, ready to scan documents."""

    def __init__(self, items: Iterable[tuple[Any, str]], similarity: float = SIMILARITY, min_words: int = MIN_WORDS):
        self.items = [(item, w, int((1 - similarity) * len(w) + 1e-9)) for item, text in items if (w := words(text)) and len(w) >= min_words]
        self.pieces = ahocorasick.Automaton()
        for n, (_, w, k) in enumerate(self.items):
            for p in range(k + 1):
                a, b = len(w) * p // (k + 1), len(w) * (p + 1) // (k + 1)
                piece = " " + " ".join(w[a:b]) + " "
                self.pieces.get(piece, None) or self.pieces.add_word(piece, (b - a, []))
                self.pieces.get(piece)[1].append((n, a))
        if self.items:
            self.pieces.make_automaton()

    def find(self, text: str | None) -> list[tuple[Any, int]]:
        """(item, distance) of each item that some stretch of text matches, by item, null ids first."""
        return sorted(self.found(text).values(), key=_order)

    def found(self, text: str | None) -> dict[tuple, tuple[Any, int]]:
        """The same by what makes an item one of its own: its id, or else its words."""
        found = words(text)
        if not found or not self.items:
            return {}
        joined, hits = " " + " ".join(found) + " ", {}
        at, last = 0, 0
        for end, (length, where) in self.pieces.iter(joined):
            at += joined.count(" ", last, end + 1)
            last = end + 1
            for n, offset in where:
                hits.setdefault(n, set()).add(at - 1 - length - offset)
        out: dict[tuple, tuple[Any, int]] = {}
        for n, places in hits.items():
            item, w, k = self.items[n]
            reach = -1
            for place in sorted(places):
                a, b = max(0, place - k), place + len(w) + k
                if b <= reach:
                    continue
                reach = b
                got = myers(w, found[a:b], k)
                key = (item,) if item is not None else (None, *w)
                if got and got[0] < out.get(key, (item, k + 1))[1]:
                    out[key] = (item, got[0])
        return out


_MATCHERS: dict[tuple, Matcher] = {}


def _matcher(items: list[tuple[Any, str]], similarity: float, min_words: int) -> Matcher:
    key = (hash(tuple(items)), similarity, min_words)
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(items, similarity, min_words)
    return _MATCHERS[key]


def _scan(items: list[tuple[Any, str]], similarity: float, min_words: int, kind: pa.DataType, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_row and _text -> _row and _hits, for all rows."""
    matcher, hit = _matcher(items, similarity, min_words), pa.struct([("item_id", kind), ("distance", pa.int32())])
    for batch in batches:
        found = [[{"item_id": i, "distance": d} for i, d in matcher.find(t.as_py())] for t in batch.column("_text")]
        yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(found, pa.list_(hit))], ["_row", "_hits"])


def _scan_block(items: list[tuple[Any, str]], similarity: float, min_words: int, kind: pa.DataType, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_n and _text -> _n, item_id, _words (of an item without an id), distance of the hits alone."""
    matcher = _matcher(items, similarity, min_words)
    for batch in batches:
        found = [(n.as_py(), i, " ".join(key[1:]) if i is None else None, d) for n, t in zip(batch.column("_n"), batch.column("_text"), strict=True) for key, (i, d) in matcher.found(t.as_py()).items()]
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), kind, pa.string(), pa.int32()))], ["_n", "item_id", "_words", "distance"])


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> tuple[int, Iterator[list[tuple[Any, str]]]]:
    """How many blocks there are, and the items of each."""
    rows = benchmark.select(F.col(item_id).alias("item"), F.col(text).alias("text")).where(F.col("text").isNotNull()).distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-2 * total // block_bytes))
    part = lambda k: rows if n == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
    return n, (sorted(((r["item"], r["text"]) for r in part(k).collect()), key=_order) for k in range(n))


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, min_words: int = MIN_WORDS, block_bytes: int = BLOCK_BYTES, out: str = "_hits") -> DataFrame:
    """docs with one more column, `out`: an array of (item_id, distance), empty where clean. All other columns are kept."""
    on_workers(docs.sparkSession)
    names = docs.columns
    of_id = benchmark.schema[item_id].dataType
    id_sql, kind, hits = of_id.simpleString(), to_arrow_type(of_id), f"array<struct<item_id:{of_id.simpleString()},distance:int>>"
    n, blocks = _blocks(benchmark, item_id, item_text, block_bytes)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_text"))
    row_sql = rows.schema["_row"].dataType.simpleString()
    if n == 1:
        items = next(blocks)
        found = rows.mapInArrow(lambda batches: _scan(items, similarity, min_words, kind, batches), f"_row {row_sql}, _hits {hits}")
    else:
        numbered = saved(rows.select("_row", F.monotonically_increasing_id().alias("_n")), "decontamination-rows")
        texts = numbered.select("_n", F.col(f"_row.`{text}`").alias("_text"))
        each = [texts.mapInArrow(lambda batches, items=items: _scan_block(items, similarity, min_words, kind, batches), f"_n long, item_id {id_sql}, _words string, distance int") for items in blocks]
        # an item with several texts may stand in several blocks: the nearest counts
        near = functools.reduce(DataFrame.union, each).groupBy("_n", "item_id", "_words").agg(F.min("distance").alias("distance"))
        best = near.groupBy("_n").agg(F.collect_list(F.struct("item_id", "distance")).alias("_some"))
        found = numbered.join(best, "_n", "left").select("_row", F.coalesce(F.col("_some").cast(hits), F.array().cast(hits)).alias("_hits"))
    return found.select(*(F.col("_row").getField(c).alias(c) for c in names), F.array_sort("_hits").alias(out))


def flagged(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, contaminated, n_items, items (sorted ids), least_distance (null if clean)."""
    found = matches(docs.select(doc_id, text), benchmark, doc_id, text, **options)
    return found.select(F.col(doc_id).alias("doc_id"), (F.size("_hits") > 0).alias("contaminated"), F.size("_hits").alias("n_items"), F.transform("_hits", lambda h: h["item_id"]).alias("items"), F.array_min(F.transform("_hits", lambda h: h["distance"])).alias("least_distance"))


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows without a match, with their own columns, whatever their names."""
    out = "_hits"
    while out in docs.columns:
        out = f"_{out}"
    return matches(docs, benchmark, doc_id, text, out=out, **options).where(F.size(out) == 0).drop(out)
