"""Stand-ins that come back in Devanagari or Bengali letters, restored in the texts of their conversations.

1. Every different stand-in is written in both scripts by rule, with the spellings near it (translit); an organisation also by
   its head alone, with the tokens that its tail may be.
2. Of a conversation's forms those stay as they are that lead to several originals, and those that its request holds itself.
   Single words also have their consonant skeleton in the table, for spellings that no form has, under the same two conditions.
3. A conversation's names are sent once to each part of it and meet its rows in one sorted stream; they are written where they meet, each
   stand-in once a worker. A conversation with more than MOST_NAMES of them gets forms instead, from a table that is joined
   with the runs of words of its texts (without a Bengali case ending, too), so only what stands somewhere in them is kept.
4. In a text the leftmost, then the longest form wins; a tail behind it goes with it, a case ending stays.

Texts that are null, have no Indic letter, or belong to no conversation stay as they are and go around the join. Repeated
rows are restored alike. A name without an original is no name. All columns are kept, whatever their names; one that is
named as the result is replaced.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import content
from ..functions.workers import on_workers
from . import translit
from .conversation import head_length

#: Words of the longest phrase that is looked up; bytes of one conversation's texts in a part, and what a row counts besides.
MOST_WORDS, PART, ROW_BYTES = 4, 4 << 20, 256
#: Names of a conversation that are written where they meet its rows.
MOST_NAMES = 5_000
# Bengali case endings, longest first, and what ends a token.
ENDINGS = ("\u09af\u09bc\u09c7\u09b0", "\u09df\u09c7\u09b0", "\u09a6\u09c7\u09b0", "\u09c7\u09b0", "\u0995\u09c7", "\u09b0", "\u09c7", "\u0993", "\u0987")
_TOKEN = re.compile(r"( +)([^\s,;:!?()\[\]\"'।॥]*)")
_WORD = re.compile("[\\wऀ-ॣ०-৿‌‍]+")
_INDIC = re.compile("[ऀ-ॣ०-৿]")
_BENGALI = re.compile("[ঀ-৿]")
FORM, SKELETON = "form", "skeleton"
#: Names that are still to be written, and what stays as it is.
NAME, STAYS = "name", "stays:"


def _stems(phrase: str) -> Iterator[tuple[str, int]]:
    """phrase, then what is left of it without a case ending, each with the length of that ending."""
    yield phrase, 0
    if _BENGALI.search(phrase):
        for ending in ENDINGS:
            if phrase.endswith(ending):
                yield phrase[: -len(ending)], len(ending)


def keys_of(text: str) -> set[tuple[str, str]]:
    """(how, key) of all that a text could hold: runs of words with an Indic letter, and skeletons."""
    words, out = list(_WORD.finditer(text)), set()
    for k, first in enumerate(words):
        for last in words[k : k + MOST_WORDS]:
            phrase = text[first.start() : last.end()]
            if "  " in phrase or _INDIC.search(phrase) is None:
                continue
            out.update((FORM, stem) for stem, _ in _stems(phrase.lower()))
        if (found := translit.skeleton(first[0])) and first[0] not in translit.STOP:
            out.add((SKELETON, found))
    return out


class Forms:
    """What may stand in the texts of one conversation, ready to restore them."""

    def __init__(self, seeds: Mapping[str, tuple[str, ...]] | None = None):
        self.forms: dict[str, tuple[str | None, frozenset[str]]] = {}  # without an original: a word to leave alone
        self.skeletons: dict[str, str] = {}
        self.longest = 1
        self.seen: dict[str, tuple[str, int, frozenset[str]] | bool] = {}
        self.seeds, self.names, self.stay = seeds or {}, [], set()

    def add(self, how: str, key: str, raw: str | None, tails: list[str] | None, kind: str | None = None, head: int | None = None) -> None:
        if how == NAME:
            self.names.append((key, kind, head, raw))
        elif how.startswith(STAYS):
            self.stay.add((how[len(STAYS) :], key))
        elif how == FORM:
            self.forms[key] = (raw, frozenset(tails or ()))
            if " " in key or not key.isalnum():
                self.longest = max(self.longest, min(MOST_WORDS, len(_WORD.findall(key))))
        elif raw is not None:
            self.skeletons[key] = raw

    def write(self) -> None:
        """Write the names; what leads to several originals, or is to stay, has none."""
        table: dict[tuple[str, str], tuple[str | None, list[str] | None]] = {}
        for surrogate, kind, head, raw in self.names:
            for how, key, tails in _writings(surrogate, kind, head, tuple((w, self.seeds[w]) for w in dict.fromkeys(surrogate.lower().split()) if w in self.seeds)):
                if (known := table.get((how, key))) is not None:
                    raw_, tails = known[0] if known[0] == raw else None, max(filter(None, (known[1], tails)), default=None)
                else:
                    raw_ = raw
                table[how, key] = raw_, tails
        for (how, key), (raw, tails) in table.items():
            self.add(how, key, None if (how, key) in self.stay else raw, tails)
        self.names, self.stay = [], set()

    def _found(self, phrase: str) -> tuple[str, int, frozenset[str]] | bool:
        """The original of a form, the length of its case ending, its tails; else whether a form without an original is meant."""
        known = False
        for stem, ending in _stems(phrase.lower()):
            if (hit := self.forms.get(stem)) is not None:
                if hit[0] is not None:
                    return hit[0], ending, hit[1]
                known = True
        return known

    def _word(self, word: str) -> tuple[str, int, frozenset[str]] | bool:
        """As _found, for a single word, or by its skeleton."""
        found = self._found(word)
        if found is False and word not in translit.STOP and (raw := self.skeletons.get(translit.skeleton(word) or "")) is not None:
            return raw, 0, frozenset()
        return found

    def _at(self, text: str, words: list[re.Match], k: int) -> tuple[int, str] | None:
        """Where the longest form from word k on ends, and what it stands for."""
        start = words[k].start()
        for last in reversed(words[k + 1 : k + self.longest]):
            found = self._found(text[start : last.end()])
            if not isinstance(found, bool):
                break
        else:
            last, word = words[k], words[k][0]
            if (found := self.seen.get(word)) is None:
                found = self.seen[word] = self._word(word)
        if isinstance(found, bool):
            return None
        raw, ending, tails = found
        return (last.end() - ending if ending else _with_tail(text, last.end(), tails)), raw

    def restore(self, text: str) -> str:
        words, out, at = list(_WORD.finditer(text)), [], 0
        for k, word in enumerate(words):
            if word.start() >= at and (hit := self._at(text, words, k)):
                out += [text[at : word.start()], hit[1]]
                at = hit[0]
        return "".join([*out, text[at:]])


def _with_tail(text: str, end: int, tails: frozenset[str]) -> int:
    """Where a hit ends if the tail tokens behind it belong to it; a full stop at a line's end stays the sentence's."""
    while tails and (m := _TOKEN.match(text, end)) and m[2]:
        token = m[2].lower()
        bare = token.rstrip(".")
        closes = m.end() == len(text) or text[m.end()] == "\n"
        if token in tails and not (closes and bare != token and bare in tails):
            end = m.end()
            continue
        return m.start(2) + len(bare) if bare != token and bare in tails else end
    return end


@functools.lru_cache(maxsize=8192)
def _writings(surrogate: str, kind: str, head: int, seeds: tuple[tuple[str, tuple[str, ...]], ...]) -> tuple[tuple[str, str, list[str] | None], ...]:
    """how, key and tails of each form and skeleton of a stand-in."""
    words, known = surrogate.split(), dict(seeds)
    tails = translit.tail_tokens(words[head:], known) if kind == "ORG" and head < len(words) else None
    rows = [(FORM, form, tails) for form in translit.phrase_forms(words, head if kind == "ORG" else None, known)]
    if len(words) == 1 or kind == "ORG" and head == 1:
        found = dict.fromkeys(filter(None, (translit.skeleton(f) for script in translit.word_forms(words[0], known.get(words[0].lower(), ())) for f in script)))
        rows += [(SKELETON, key, None) for key in found]
    return tuple(rows)


def _written(seeds: Mapping[str, tuple[str, ...]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """surrogate, kind, head -> its forms and skeletons."""
    for batch in batches:
        rows = []
        for surrogate, kind, head in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            known = tuple((w, seeds[w]) for w in dict.fromkeys(surrogate.lower().split()) if w in seeds)
            rows += [(surrogate, kind, *row) for row in _writings(surrogate, kind, head, known)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.list_(pa.string()) if k == 4 else pa.string()) for k in range(5)], ["surrogate", "kind", "how", "key", "tails"])


def written(surrogates: DataFrame, heads: list[str] | None = None, seeds: Mapping[str, tuple[str, ...]] | None = None) -> DataFrame:
    """surrogates(surrogate, kind) -> surrogate, kind, how, key, tails of each form. heads: organisations' heads of several words; seeds: known Devanagari writings of words in lower case."""
    on_workers()
    known = dict(seeds or {})
    rows = surrogates.where(F.trim("surrogate") != "").select("surrogate", "kind", head_length(F.col("surrogate"), heads or []).alias("head")).distinct()
    return rows.mapInArrow(lambda batches: _written(known, batches), "surrogate string, kind string, how string, key string, tails array<string>")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        conv, rows = batch.column("_conv"), {}
        for k, text in enumerate(batch.column("_text")):
            of = conv[k].as_py()
            rows.update(dict.fromkeys((of, how, key) for how, key in keys_of(text.as_py() or "")))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], conv.type), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], ["_conv", "how", "key"])


def held_keys(texts: DataFrame, conv: str, text: str) -> DataFrame:
    """_conv, how, key: all different keys of a conversation's texts."""
    on_workers()
    rows = texts.where(F.col(conv).isNotNull() & content.has_indic(F.col(text))).select(F.col(conv).alias("_conv"), F.col(text).alias("_text"))
    return rows.mapInArrow(_keys, f"_conv {rows.schema['_conv'].dataType.simpleString()}, how string, key string").distinct()


def own_names(names: DataFrame, conv: str = "conv_id") -> DataFrame:
    """names(conv, surrogate, kind, raw) -> _conv, surrogate, kind, raw: those that are looked for."""
    own = names.where(F.col("raw").isNotNull() & F.col(conv).isNotNull()).select(F.col(conv).alias("_conv"), "surrogate", "kind", "raw").distinct()
    # a person whose words are all stand-ins of their own is found by those
    words = own.where(F.col("kind").isin("PERSON", "NAME") & F.col("surrogate").contains(" ")).select("_conv", "surrogate", F.explode(F.array_distinct(F.split(F.trim("surrogate"), r"\s+"))).alias("_word"))
    singles = own.select("_conv", F.col("surrogate").alias("_word")).distinct().withColumn("_own", F.lit(1))
    parted = words.join(singles, ["_conv", "_word"], "left").groupBy("_conv", "surrogate").agg(F.count(F.lit(1)).alias("_n"), F.count("_own").alias("_known")).where("_n = _known").select("_conv", "surrogate")
    return own.join(parted, ["_conv", "surrogate"], "left_anti")


def form_table(own: DataFrame, requests: DataFrame | None = None, conv: str = "conv_id", text: str = "text", heads: list[str] | None = None, seeds: Mapping[str, tuple[str, ...]] | None = None) -> DataFrame:
    """own_names -> _conv, how, key, raw, tails. What leads to several originals or is in the request has a null raw: it is known, and stays."""
    table = own.join(written(own, heads, seeds), ["surrogate", "kind"])
    one = table.groupBy("_conv", "how", "key").agg(F.when(F.min("raw") == F.max("raw"), F.min("raw")).alias("raw"), F.max("tails").alias("tails"))
    if requests is None:
        return one
    held = one.join(held_keys(requests, conv, text).withColumn("_held", F.lit(True)), ["_conv", "how", "key"], "left")
    return held.select("_conv", "how", "key", F.when(F.col("_held").isNull(), F.col("raw")).alias("raw"), "tails")


def _restored(at: int, seeds: Mapping[str, tuple[str, ...]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forms, of = Forms(seeds), None
    for batch in batches:
        keys, parts, hows = (batch.column(c).to_pylist() for c in ("_key", "_part", "how"))
        rows = []
        texts = batch.column("_row").field(at)
        out = []
        for k, key in enumerate(zip(keys, parts, strict=True)):
            if key != of:
                forms, of = Forms(seeds), key
            if hows[k] is not None:
                forms.add(hows[k], *(batch.column(c)[k].as_py() for c in ("key", "raw", "tails", "kind", "head")))
            else:
                if forms.names:
                    forms.write()
                rows.append(k)
                out.append(forms.restore(texts[k].as_py()))
        yield pa.RecordBatch.from_arrays([batch.column("_row").take(pa.array(rows, pa.int64())), pa.array(out, pa.string())], ["_row", "_out"])


def restored(texts: DataFrame, names: DataFrame, requests: DataFrame | None = None, conv: str = "conv_id", text: str = "text", out: str = "restored", heads: list[str] | None = None, seeds: Mapping[str, tuple[str, ...]] | None = None) -> DataFrame:
    """texts with one more column, `out`."""
    on_workers()
    kept = [c for c in texts.columns if c != out]
    row = F.struct(*(F.col(f"`{c}`") for c in kept))
    scanned = F.coalesce(F.col(conv).isNotNull() & content.has_indic(F.col(text)), F.lit(False))
    rows, others = texts.where(scanned), texts.where(~scanned)
    own = own_names(names, conv)
    many = own.groupBy("_conv").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > MOST_NAMES).select("_conv")
    of_many = rows.join(many.withColumnRenamed("_conv", "_many"), F.col(conv) == F.col("_many"), "left_semi")
    found = form_table(own.join(many, "_conv", "left_semi"), requests, conv, text, heads, seeds).join(held_keys(of_many, conv, text), ["_conv", "how", "key"], "left_semi")
    few = own.join(many, "_conv", "left_anti").where(F.trim("surrogate") != "")
    found = found.unionByName(few.select("_conv", F.lit(NAME).alias("how"), F.col("surrogate").alias("key"), "raw", "kind", head_length(F.col("surrogate"), heads or []).alias("head")), allowMissingColumns=True)
    if requests is not None:
        held = held_keys(requests, conv, text).join(many, "_conv", "left_anti")
        found = found.unionByName(held.select("_conv", F.concat(F.lit(STAYS), "how").alias("how"), "key"), allowMissingColumns=True)
    sizes = rows.groupBy(F.col(conv).alias("_of")).agg(F.sum(F.octet_length(text).cast("long") + ROW_BYTES).alias("_bytes")).where(F.col("_bytes") > PART)
    sizes = sizes.select("_of", F.ceil(F.col("_bytes") / PART).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    entries = found.join(sizes, F.col("_conv") == F.col("_of"), "left").select(F.col("_conv").alias("_key"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"), "how", "key", "raw", "tails", "kind", "head")
    spread = F.xxhash64(F.col(text), F.monotonically_increasing_id())
    packed = rows.select(row.alias("_row"), F.col(conv).alias("_key"), spread.alias("_spread")).join(sizes, F.col("_key") == F.col("_of"), "left").select("_key", F.pmod("_spread", parts).cast("int").alias("_part"), "_row")
    stream = entries.unionByName(packed, allowMissingColumns=True).repartition("_key", "_part").sortWithinPartitions("_key", "_part", F.col("how").isNull())
    at, known = kept.index(text), dict(seeds or {})
    schema = T.StructType([T.StructField("_row", packed.schema["_row"].dataType), T.StructField("_out", T.StringType())])
    done = stream.mapInArrow(lambda batches: _restored(at, known, batches), schema)
    rest = others.select(row.alias("_row"), F.col(text).alias("_out"))
    return done.unionByName(rest).select(*(F.col("_row").getField(c).alias(c) for c in kept), F.col("_out").alias(out))
