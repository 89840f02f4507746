"""Fill-in-the-middle by one Aho-Corasick scan for events.

Two cuts are drawn between the units of a text and its middle goes to the end, after sentinels, so that
a left-to-right model learns to fill gaps. One automaton per unit finds the events of a text in one pass: the
ASCII characters that close a unit, and the sentinels. Between two events nothing happens, so the units of
a gap are a number (its length for `char`, none for `line`, whose units end at events only), and the sparse
events with their ranks are all that is kept: the place of a rank is a binary search and an addition.

Draws come from sha256("<seed>:<id>"): h1 to h4 are its first four 8-digit groups. With n units the prefix ends
after the smaller of h1 % (n + 1) and h2 % (n + 1), the middle after the larger. A text stays plain if it is
empty, holds a sentinel already, or h3 % 100 >= rate; h4 % 100 < spm_rate chooses suffix-prefix-middle.

Null and empty texts are plain with 0 units. A null id is drawn as if it were empty text. Repeated ids share
their draws, repeated rows their whole result. Texts are scanned and kept whole, whatever their length. An
empty table gives no rows. All columns but the text are kept; one with the name of the result is replaced.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import on_workers

SEED, RATE, SPM_RATE = 7, 100, 50
SENTINELS = ("<P>", "<S>", "<M>")  # before the prefix, the suffix, the middle
#: Of each kind of unit: the characters that close one, and how many units a character of a gap is.
UNITS = {"line": ("\n", 0), "char": ("", 1)}
FIM = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
FIM_SQL = "struct<n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,output:string>"


def checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    """Sentinels that can be told from any text without one: none empty, none within another, none that ends as one begins."""
    for a in sentinels:
        for b in sentinels:
            overlap = any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b))))
            if not a or overlap or (a is not b and a in b):
                raise ValueError(f"sentinels must not overlap: {sentinels}")
    return sentinels


class Scanner:
    """The automaton of one kind of unit and three sentinels."""

    def __init__(self, unit: str = "line", sentinels: tuple[str, str, str] = SENTINELS):
        closing, self.per_char = UNITS[unit]
        self.events = ahocorasick.Automaton()
        for c in closing:
            self.events.add_word(c, True)
        for s in sentinels:
            self.events.add_word(s, False)
        self.events.make_automaton()

    def places(self, text: str) -> Places | None:
        """The units of text; None if it holds a sentinel."""
        ends = []
        for at, closes in self.events.iter(text):
            if not closes:
                return None
            ends.append(at + 1)
        return Places(len(text), ends, self.per_char)


class Places:
    """Ranks of the units of a text of `size` characters: ends[k] is where event k closes a unit."""

    def __init__(self, size: int, ends: list[int], per_char: int):
        self.size, self.ends, self.per_char = size, ends, per_char
        if per_char:  # every character is a unit, with or without an event
            self.ranks = [per_char * end for end in ends]
        else:
            self.ranks = range(1, len(ends) + 1)
        last = ends[-1] if ends else 0
        done = self.ranks[-1] if ends else 0
        self.n = done + (per_char * (size - last) if per_char else int(size > last))

    def after(self, rank: int) -> int:
        """Where the first `rank` units end."""
        k = bisect_left(self.ranks, rank)
        if k < len(self.ends) and self.ranks[k] == rank:
            return self.ends[k]
        if not self.per_char:
            return 0 if rank == 0 else self.size
        last, done = (self.ends[k - 1], self.ranks[k - 1]) if k else (0, 0)
        return last + (rank - done) // self.per_char


def draws(doc_id: str | None, seed: int) -> tuple[int, ...]:
    digest = hashlib.sha256(f"{seed}:{doc_id or ''}".encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in range(0, 32, 8))


def transform(scanner: Scanner, doc_id: str | None, text: str, seed: int, rate: int, spm_rate: int, sentinels: tuple[str, str, str], unit: str) -> tuple:
    """n, form, prefix_chars, middle_chars, output of one text."""
    places = scanner.places(text)
    if places is None:  # its units are counted for the report alone
        return _units(text, unit), "plain", None, None, text
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= rate:
        return places.n, "plain", None, None, text
    a, b = sorted((h1 % (places.n + 1), h2 % (places.n + 1)))
    p, m = places.after(a), places.after(b)
    before_p, before_s, before_m = sentinels
    prefix, middle, suffix = text[:p], text[p:m], text[m:]
    if h4 % 100 < spm_rate:
        return places.n, "spm", p, m - p, "".join((before_s, suffix, before_p, prefix, before_m, middle))
    return places.n, "psm", p, m - p, "".join((before_p, prefix, before_s, suffix, before_m, middle))


def _units(text: str, unit: str) -> int:
    closing, per_char = UNITS[unit]
    return per_char * len(text) if per_char else sum(text.count(c) for c in closing) + (text != "" and text[-1] not in closing)


def _batches(text: str, unit: str, seed: int, rate: int, spm_rate: int, sentinels: tuple[str, str, str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner(unit, sentinels)
    names = ("n", "form", "prefix_chars", "middle_chars", "output")
    for batch in batches:
        columns = zip(*(transform(scanner, i.as_py(), t.as_py() or "", seed, rate, spm_rate, sentinels, unit) for i, t in zip(batch.column("_id"), batch.column(text), strict=True)), strict=True)
        made = [pa.array(c, FIM.field(n).type) for n, c in zip(names, columns, strict=True)] if batch.num_rows else [pa.array([], f.type) for f in FIM]
        yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.StructArray.from_arrays(made, names)], ["_row", "_fim"])


def transformed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: str = "line", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, sentinels: tuple[str, str, str] = SENTINELS, out: str = "fim") -> DataFrame:
    """docs without its text, and with `out`: n, form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output."""
    on_workers(docs.sparkSession)
    sentinels = checked(tuple(sentinels))
    others = [c for c in docs.columns if c not in (text, out)]
    # a row without other columns still needs a struct with a field
    row = F.struct(*(F.col(f"`{c}`") for c in others)) if others else F.struct(F.lit(0).alias("_"))
    rows = docs.select(row.alias("_row"), F.col(doc_id).cast("string").alias("_id"), F.col(text).alias("_text"))
    made = rows.mapInArrow(lambda batches: _batches("_text", unit, seed, rate, spm_rate, sentinels, batches), f"_row {rows.schema['_row'].dataType.simpleString()}, _fim {FIM_SQL}")
    return made.select(*(F.col("_row").getField(c).alias(c) for c in others), F.col("_fim").alias(out))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made of. Between sentinels there is none, so each is the border of a part."""
    parts = F.split(output, "|".join(map(re.escape, sentinels)))
    first, second, middle = parts[1], parts[2], parts[3]
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and the SHA-256 of the output and of the text restored from it."""
    made = transformed(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_t")), "doc_id", "_t", **options)
    text_of = restored(F.col("fim.output"), F.col("fim.form"), options.get("sentinels", SENTINELS))
    return made.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", F.sha2("fim.output", 256).alias("output_sha256"), F.sha2(text_of, 256).alias("restored_sha256"))


def sql(table: str = "documents", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> str:
    """The same for lines and the usual sentinels: the lines' lengths are summed up to the cuts."""
    draw = ", ".join(f"('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), {8 * k + 1}, 8))::BIGINT AS h{k + 1}" for k in range(4))
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS body, string_split(coalesce(text, ''), chr(10)) AS lines, {draw} FROM {table}),
u AS (SELECT *, len(lines) - CASE WHEN lines[-1] = '' THEN 1 ELSE 0 END AS n FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 % 100 >= {rate} THEN 'plain' WHEN h4 % 100 < {spm_rate} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, least(length(body), a + coalesce(list_sum(list_transform(lines[1:a], lambda x: length(x))), 0))::BIGINT AS p,
  least(length(body), b + coalesce(list_sum(list_transform(lines[1:b], lambda x: length(x))), 0))::BIGINT AS m FROM c),
o AS (SELECT *, substr(body, 1, p) AS head, substr(body, p + 1, m - p) AS mid, substr(body, m + 1) AS tail FROM p)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN m - p END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || head || '<S>' || tail || '<M>' || mid ELSE '<S>' || tail || '<P>' || head || '<M>' || mid END) AS output_sha256, sha256(body) AS restored_sha256
FROM o"""
