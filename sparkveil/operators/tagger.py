"""Running a name tagger over a column: settings, words, labels, batches, a cache, and failures.

The tagger is any function from a list of texts to one list of (start, end, kind, score) for each. It
runs inside Arrow batches on the executors; a text that breaks it is left out and marked, and a tagger
that breaks on everything raises, so that nothing passes as clean for want of an answer.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules, spans
from ..functions.workers import on_workers
from .ner import BATCH_BYTES, BATCH_TEXTS, MIN_SCORE, ORG_MIN, ORG_SINGLE_MIN, SYMBOL_RUN, TOTAL_BYTES, WORD_BYTES

Tagger = Callable[[list[str]], list[list[tuple[int, int, str, float]]]]
#: What counts as a word, room kept beside the prompt, least budget, most positions.
WORD = r"[\p{L}\p{M}\p{N}_]+(?:[-_][\p{L}\p{M}\p{N}_]+)*|[^\s]"
SPECIAL, RESERVE, LEAST_BUDGET, MOST_POSITIONS = 2, 8, 16, 8_192
OFFSET_MODELS = ("xlm-roberta", "roberta", "camembert")


@dataclasses.dataclass(frozen=True)
class Settings:
    """A tagger's settings within their bounds. Without a url, or with no kind left, it is off."""

    url: str | None = None
    kinds: tuple[str, ...] = ("PERSON", "ADDRESS")
    min_score: float = MIN_SCORE
    org_min_score: float = ORG_MIN
    org_single_min_score: float = ORG_SINGLE_MIN
    allow: frozenset[str] = frozenset()
    disable_groups: frozenset[str] = frozenset()
    timeout_ms: int = 10_000
    max_bytes: int = TOTAL_BYTES

    @property
    def enabled(self) -> bool:
        return bool(self.url and self.kinds)

    @classmethod
    def of(cls, given: dict | None) -> Settings:
        """Settings from decoded JSON; values of a wrong type count as absent, numbers are brought within bounds."""
        if not isinstance(given, dict) or given.get("enabled") is False:
            return cls()
        out: dict = {}
        if isinstance(given.get("url"), str) and given["url"].strip():
            out["url"] = given["url"]
        if isinstance(given.get("kinds"), list):
            out["kinds"] = tuple(k.upper() for k in given["kinds"] if isinstance(k, str) and k.upper() in rules.NER_KINDS)
        for name in ("min_score", "org_min_score", "org_single_min_score"):
            if isinstance(given.get(name), int | float) and not isinstance(given[name], bool):
                out[name] = min(1.0, max(0.0, float(given[name])))
        if isinstance(given.get("allow"), list):
            out["allow"] = frozenset(x.strip().lower() for x in given["allow"] if isinstance(x, str) and x.strip())
        if isinstance(given.get("disable_groups"), list):
            out["disable_groups"] = frozenset(x.strip() for x in given["disable_groups"] if isinstance(x, str) and x.strip())
        if isinstance(given.get("timeout_ms"), int) and given["timeout_ms"] >= 0:
            out["timeout_ms"] = min(600_000, max(100, given["timeout_ms"]))
        if isinstance(given.get("max_bytes"), int) and given["max_bytes"] >= 0:
            out["max_bytes"] = given["max_bytes"]
        return cls(**out)


def off_for(model: Column, groups: list[str]) -> Column:
    """Whether one of the | separated parts of model is a group without a tagger."""
    return F.arrays_overlap(F.transform(F.split(model, r"\|"), lambda p: F.trim(p)), F.array(*map(F.lit, groups)).cast("array<string>"))


def labels_of(spec: Column, default: float = MIN_SCORE) -> Column:
    """prompt:KIND[:threshold] between | or ; as array<struct<prompt, kind, threshold>>. Parts without both names go; a threshold that is no number is the default."""
    fields = lambda p: F.transform(F.split(p, ":"), lambda f: F.trim(f))
    made = F.transform(F.transform(F.split(spec, "[|;]"), fields), lambda f: F.struct(
        f[0].alias("prompt"), F.upper(F.try_element_at(f, F.lit(2))).alias("kind"), F.coalesce(F.try_element_at(f, F.lit(3)).try_cast("double"), F.lit(default)).alias("threshold"),
    ))
    return F.filter(made, lambda x: (x["prompt"] != "") & F.coalesce(x["kind"] != "", F.lit(False)))


def tags_of(id2label: Column, labels: Column) -> Column:
    """map<id, name> of a model and its labels -> array<struct<id, kind, begin>> by id: B- begins, other one-letter prefixes do not, unknown types have no kind."""
    def one(entry: Column) -> Column:
        marked = entry["value"].rlike("^.-")
        name = F.when(marked, F.substr(entry["value"], F.lit(3))).otherwise(entry["value"])
        hit = F.try_element_at(F.filter(labels, lambda x: F.lower(x["prompt"]) == F.lower(name)), F.lit(1))
        return F.struct(entry["key"].cast("int").alias("id"), hit["kind"].alias("kind"), (marked & F.upper(entry["value"]).startswith("B")).alias("begin"))

    return F.array_sort(F.transform(F.map_entries(id2label), one))


def words(text: Column) -> Column:
    """array<struct<start, end>> of the words a tagger sees: none over WORD_BYTES bytes, and at most SYMBOL_RUN symbols in a row."""
    found = spans.matches(spans.unmarked(text), "WORD", WORD)
    kind = "array<struct<start:int,end:int>>"

    def step(acc: Column, w: Column) -> Column:
        run = F.when(w["value"].rlike(r"[\p{L}\p{N}]"), 0).otherwise(acc["run"] + 1)
        fits = (F.octet_length(w["value"]) <= WORD_BYTES) & (run <= SYMBOL_RUN)
        return F.struct(run.cast("int").alias("run"), F.when(fits, F.array_append(acc["out"], F.struct(w["start"].alias("start"), w["end"].alias("end")))).otherwise(acc["out"]).cast(kind).alias("out"))

    return F.aggregate(found, F.struct(F.lit(0).alias("run"), F.array().cast(kind).alias("out")), step, lambda acc: acc["out"])


def position_limit(model_type: Column, positions: Column) -> Column:
    """How many positions a model has for text: two fewer in the families that count from two."""
    offset = F.when(model_type.isin(*OFFSET_MODELS), 2).otherwise(0)
    return F.least(F.greatest(F.coalesce(positions, F.lit(512)) - offset, F.lit(0)), F.lit(MOST_POSITIONS))


def budget(limit: Column, prompt_tokens: Column) -> Column:
    """Tokens that a window may hold beside the prompt."""
    return F.greatest(limit - prompt_tokens - (SPECIAL + RESERVE), F.lit(LEAST_BUDGET))


def calls(texts: list[str], most_bytes: int = BATCH_BYTES, most_texts: int = BATCH_TEXTS) -> Iterator[list[int]]:
    """Indexes of texts in calls of bounded size; a text over the bound is a call of its own."""
    now: list[int] = []
    size = 0
    for n, text in enumerate(texts):
        bytes_ = len(text.encode("utf-8", "surrogatepass"))
        if now and (size + bytes_ > most_bytes or len(now) >= most_texts):
            yield now
            now, size = [], 0
        now.append(n)
        size += bytes_
    if now:
        yield now


def answered(tagger: Tagger, texts: list[str], most_bytes: int = BATCH_BYTES, most_texts: int = BATCH_TEXTS) -> list[list | None]:
    """One answer for each text; a call that fails is asked again text by text, and a text that fails alone has None. ConnectionError always goes up."""
    out: list[list | None] = [None] * len(texts)
    for part in calls(texts, most_bytes, most_texts):
        for group in _ask(tagger, texts, part, out):
            for n in group:
                _ask_one(tagger, texts[n], n, out)
    return out


def _ask(tagger: Tagger, texts: list[str], part: list[int], out: list) -> Iterator[list[int]]:
    """Fill the answers of part; yield it back if the call failed."""
    try:
        got = tagger([texts[n] for n in part])
        if len(got) != len(part):
            raise ValueError("one answer for each text is due")
        for n, found in zip(part, got, strict=True):
            out[n] = _checked(found, texts[n])
    except ConnectionError:
        raise
    except Exception:
        yield part


def _ask_one(tagger: Tagger, text: str, n: int, out: list) -> None:
    try:
        out[n] = _checked(tagger([text])[0], text)
    except ConnectionError:
        raise
    except Exception:
        out[n] = None


def _checked(found: list, text: str) -> list[dict]:
    rows = [{"start": int(a), "end": int(b), "kind": str(k), "score": round(float(s), 3)} for a, b, k, s in found]
    if any(not 0 <= r["start"] < r["end"] <= len(text) for r in rows):
        raise ValueError("span outside its text")
    return rows


def halved(run: Callable[[list], list], items: list) -> tuple[list, int]:
    """Results of run over items, halving whatever fails: (results, number of single items that failed)."""
    if not items:
        return [], 0
    try:
        return list(run(items)), 0
    except Exception:
        if len(items) == 1:
            return [], 1
    half = len(items) // 2
    (left, a), (right, b) = halved(run, items[:half]), halved(run, items[half:])
    return left + right, a + b


def tagged(chunks: DataFrame, tagger: Tagger, text: str = "chunk") -> DataFrame:
    """chunks with found, array<struct<start, end, kind, score>>, null where the tagger failed on the text alone."""
    on_workers()
    kind = "array<struct<start:int,end:int,kind:string,score:double>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(found=answered(tagger, [t or "" for t in pdf[text]]))

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema)
    return chunks.mapInPandas(run, f"{columns}, found {kind}")


def through_cache(chunks: DataFrame, cache: DataFrame, tagger: Tagger, text: str = "chunk") -> tuple[DataFrame, DataFrame]:
    """(chunks with found, answers to add to the cache). cache(hash, found) is keyed by SHA-256 of the text; each different unknown text is tagged once."""
    keyed = chunks.withColumn("hash", F.sha2(F.col(text), 256))
    cold = keyed.select("hash", text).dropDuplicates(["hash"]).join(cache.select("hash"), "hash", "left_anti")
    fresh = tagged(cold, tagger, text).select("hash", "found").where("found IS NOT NULL")
    return keyed.join(cache.select("hash", "found").unionByName(fresh), "hash", "left").drop("hash"), fresh


def call_stats(log: DataFrame) -> DataFrame:
    """log(texts, bytes, ms, failed, hits) -> one row of totals with the median time of a call."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return log.agg(F.count(F.lit(1)).alias("calls"), total("texts"), total("bytes"), total("ms"), F.count_if("failed").alias("errors"), total("hits"), F.median("ms").alias("median_ms"))
