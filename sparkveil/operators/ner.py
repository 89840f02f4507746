"""Around a name tagger: chunks in, spans out, and which of them to believe.

The tagger itself is a table of spans (or any function that makes one); everything before and after
it is expressed here.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars

# Limits and thresholds.
CHUNK, TOTAL_BYTES, BATCH_BYTES, BATCH_TEXTS = 4_096, 256 << 10, 48 << 10, 64
MIN_SCORE, ORG_MIN, ORG_SINGLE_MIN = 0.5, 0.7, 0.85
WINDOW_WORDS, WINDOW_OVERLAP, SPAN_WORDS, WORD_BYTES, SYMBOL_RUN = 160, 24, 30, 64, 3

# Titles, words that start an order, and words that are no organisation.
HONORIFIC = tuple("mr mrs ms miss dr prof shri sri shrimati smt late sir madam ji da di didi dada bhaiya bhaiyya bhai anna akka amma appa aunty auntie uncle saab sahab babu bro chachu chacha mama mami".split())
IMPERATIVE = tuple("find show check send get make tell list open run draft reply ask add book pay call create update delete remove search fetch read write summarise summarize schedule reschedule cancel remind email text message share forward move copy save set fix start stop play pause close give take buy order note ping sync pull push merge review approve join invite post upload download print scan track look see try help keep go turn compare explain translate plan prepare confirm sign submit attach archive mute block report what where when who why how which hey".split())
NOT_ORG = tuple("emi emis kyc otp upi gst gstin tds pan atm pdf faq eta ceo cto cfo coo hr qa ui ux api url sms ott nri ifsc neft rtgs imps pr prs".split())
#: Defaults of our own, to be given as parameters for other languages: words that belong to no name, and names to leave alone.
STOP = ("the", "a", "an", "and", "or", "of", "to", "in", "is", "was", "hai", "ka", "ki", "ke", "ko", "se", "ne", "me")
ALLOW = ("python", "linux", "docker", "github", "json", "api", "http", "rust", "windows")


def chunks(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, n, chunk: paragraphs, and those over CHUNK bytes in pieces of whole lines (a longer line is a piece of its own).

    Lines are dealt to pieces by where they start, so pieces follow from the text alone.
    """
    paragraphs = df.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n\n")).alias("_p", "_para"))
    def step(acc: Column, line: Column) -> Column:
        size = F.octet_length(acc["now"]) + 1 + F.octet_length(line)
        full = F.struct(F.array_append(acc["done"], acc["now"]).alias("done"), line.alias("now"), F.lit(False).alias("new"))
        more = F.struct(acc["done"].alias("done"), F.when(acc["new"], line).otherwise(F.concat_ws("\n", acc["now"], line)).alias("now"), F.lit(False).alias("new"))
        return F.when(~acc["new"] & (size > CHUNK), full).otherwise(more)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(True).alias("new"))
    cut = F.aggregate(F.split("_para", "\n"), start, step, lambda acc: F.array_append(acc["done"], acc["now"]))
    pieces = F.when(F.octet_length("_para") > CHUNK, cut).otherwise(F.array("_para"))
    return paragraphs.select(key, "_p", F.posexplode(pieces).alias("_q", "chunk")).select(key, F.struct("_p", "_q").alias("n"), "chunk")


def to_tag(found: DataFrame, key: str) -> DataFrame:
    """The different chunks with a letter, each with how many rows hold it: what a tagger needs to see."""
    return found.where(F.col("chunk").rlike(r"\p{L}")).groupBy("chunk").agg(F.count(F.lit(1)).alias("uses"), F.min(key).alias("first"))


def over_budget(found: DataFrame, key: str, most: int = TOTAL_BYTES) -> DataFrame:
    """key, bytes and blocked for texts whose untagged chunks are more than a tagger may be asked for."""
    return found.groupBy(key).agg(F.sum(F.octet_length("chunk")).alias("bytes")).withColumn("blocked", F.col("bytes") > most)


def sentence_initial(text: Column, at: Column) -> Column:
    before = F.regexp_replace(F.left(text, at), r"[ \t\"'(\[{*_`“‘]+$", "")
    return (before == "") | before.rlike(r"[\n.!?:;\->#|•–—]$")


def cleaned(value: Column, kind: Column, stop: tuple[str, ...] = STOP, allow: tuple[str, ...] = ALLOW) -> Column:
    """The name inside a tagged span, null if none is left: stop words, titles and orders at the edges go, also possessives."""
    personish = kind.isin("PERSON", "LOCATION")
    bare = lambda w: F.lower(F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    words = F.filter(F.split(value, r"\s+"), lambda w: w != "")
    edge = lambda w: (bare(w) == "") | bare(w).isin(*stop) | (personish & bare(w).isin(*HONORIFIC))
    first = F.aggregate(words, F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda a, w: F.struct(F.when(a["go"] & (edge(w) | bare(w).isin(*IMPERATIVE)), a["n"] + 1).otherwise(a["n"]).alias("n"), (a["go"] & (edge(w) | bare(w).isin(*IMPERATIVE))).alias("go")), lambda a: a["n"])
    last = F.aggregate(F.reverse(words), F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda a, w: F.struct(F.when(a["go"] & edge(w), a["n"] + 1).otherwise(a["n"]).alias("n"), (a["go"] & edge(w)).alias("go")), lambda a: a["n"])
    kept = F.when(first + last < F.size(words), F.slice(words, first + 1, F.size(words) - first - last)).otherwise(F.array().cast("array<string>"))
    inner = F.exists(kept, lambda w: bare(w).isin(*stop) | (bare(w).isin(*HONORIFIC) & (F.size(kept) > 3)))
    trimmed = F.regexp_replace(F.array_join(kept, " "), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    raw = F.regexp_replace(F.regexp_replace(trimmed, "(?:['’][sS]?)$", ""), r"[^\p{L}\p{N}]+$", "")
    bad = (
        (F.size(kept) == 0) | ((kind == "PERSON") & inner) | F.exists(kept, lambda w: bare(w).isin(*allow)) | (F.length(F.regexp_replace(raw, r"[^\p{L}]", "")) < 3)
        | (personish & (raw.rlike("[0-9]") | ((F.size(kept) == 1) & (F.length(raw) <= 4) & ~raw.rlike(r"\p{Ll}"))))
    )
    return F.when(~bad, raw)


def accepted(found: DataFrame, common: DataFrame, stop: tuple[str, ...] = STOP, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """found(text, start, value, kind, score) -> the rows to believe, with raw. common(word, proper) holds ordinary words."""
    rows = found.withColumn("raw", cleaned(F.col("value"), F.col("kind"), stop, allow)).where("raw IS NOT NULL")
    rows = rows.withColumn("_single", ~F.col("raw").rlike(r"\s")).withColumn("_word", F.lower("raw"))
    least = F.when((F.col("kind") == "ORG") & F.col("_single"), ORG_SINGLE_MIN).when(F.col("kind") == "ORG", ORG_MIN).otherwise(MIN_SCORE)
    rows = rows.where(F.col("score") >= least).join(common.withColumnRenamed("word", "_common"), F.col("_word") == F.col("_common"), "left")
    checked = F.col("_single") & F.col("kind").isin("PERSON", "ORG", "LOCATION")
    usual = F.col("_common").isNotNull() & F.when(F.col("kind") == "ORG", True).when(F.col("kind") == "LOCATION", ~F.col("proper")).otherwise(F.col("raw").rlike(r"^\p{Ll}") | (~F.col("proper") & sentence_initial(F.col("text"), F.col("start"))))
    drop = checked & (F.col("_word").isin(*IMPERATIVE, *stop) | ((F.col("kind") == "ORG") & F.col("_word").isin(*NOT_ORG)) | usual)
    return rows.where(~drop).drop("_single", "_word", "_common", "proper")


def bio_decoded(tags: DataFrame, key: str = "text_id", threshold: float = MIN_SCORE) -> DataFrame:
    """tags(key, n, tag, score) -> spans key, first, last, kind, score: B- or a change of kind starts one, O ends it, the mean score decides."""
    by = Window.partitionBy(key).orderBy("n")
    kind = F.when(F.col("tag") != "O", F.substring("tag", 3, 100))
    rows = tags.withColumn("_kind", kind).withColumn("_before", F.lag(kind).over(by))
    fresh = F.col("_kind").isNotNull() & (F.col("tag").startswith("B-") | F.col("_before").isNull() | (F.col("_before") != F.col("_kind")))
    runs = rows.withColumn("_run", F.sum(fresh.cast("int")).over(by)).where(F.col("_kind").isNotNull())
    found = runs.groupBy(key, "_run").agg(F.min("n").alias("first"), F.max("n").alias("last"), F.first("_kind").alias("kind"), F.avg("score").alias("score"))
    return found.where(F.col("score") >= threshold).drop("_run")


def windows(sizes: list[int], budget: int, most_words: int = WINDOW_WORDS, overlap: int = WINDOW_OVERLAP) -> list[tuple[int, int]]:
    """(first, end) word windows of at most `budget` tokens and most_words words; each goes back by up to `overlap` words and a quarter of the budget. A word over the budget is in none."""
    until, out, start = [0, *accumulate(sizes)], [], 0
    while start < len(sizes):
        end = min(start + most_words, bisect_right(until, until[start] + budget) - 1)
        if end > start:
            out.append((start, end))
        if end >= len(sizes):
            break
        # the next window: behind a word that fits nowhere, else as far back as the overlap allows
        start = max(start + 1, end - overlap, bisect_left(until, until[end] - budget // 4)) if end > start else start + 1
    return out


def decode_logits(logits: np.ndarray, labels: list[str], threshold: float = MIN_SCORE, most: int = SPAN_WORDS) -> list[tuple[int, int, str, float]]:
    """logits (words, labels, 3: start, end, inside) -> (first, last, kind, score): the score of a span is the least of its sigmoids."""
    p = 1 / (1 + np.exp(-logits.astype(np.float64)))
    out = []
    for k, kind in enumerate(labels):
        for first in np.flatnonzero(p[:, k, 0] >= threshold):
            for last in np.flatnonzero(p[first : first + most, k, 1] >= threshold) + first:
                inside = p[first : last + 1, k, 2]
                if inside.min() >= threshold:
                    out.append((int(first), int(last), kind, float(min(p[first, k, 0], p[last, k, 1], inside.min()))))
    return out


def metrics(want: DataFrame, got: DataFrame, keys: list[str]) -> DataFrame:
    """Per kind: true and false positives and false negatives of exact spans."""
    both = want.select(*keys, "kind").distinct().withColumn("_w", F.lit(1)).join(got.select(*keys, "kind").distinct().withColumn("_g", F.lit(1)), [*keys, "kind"], "full")
    return both.groupBy("kind").agg(F.count_if(F.col("_w").isNotNull() & F.col("_g").isNotNull()).alias("tp"), F.count_if(F.col("_w").isNull()).alias("fp"), F.count_if(F.col("_g").isNull()).alias("fn"))


def same_entity(found: DataFrame) -> DataFrame:
    """One row for each (kind, normalised raw), the first spelling in order."""
    return found.groupBy("kind", scalars.normalize(F.col("kind"), F.col("raw")).alias("norm")).agg(F.min_by("raw", "start").alias("raw"))
