"""Pattern matches with positions, and operations on spans, without leaving the JVM.

A match is marked by a control character on both sides and the text is split there: every second
part is a match, and the lengths of the parts before it are its offset. Offsets are code points. Spans are
struct<start, end, kind, value>, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK, OTHER = "\x01", "\x02"
BLOCK = 256
TYPE = "array<struct<start:int,end:int,kind:string,value:string>>"
#: An ASCII word boundary; Java's own counts accented letters as word characters.
EDGE = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def unmarked(text: Column) -> Column:
    """text without the marking character; lengths stay."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit(MARK), F.lit(OTHER))


def none() -> Column:
    return F.array().cast(TYPE)


def computed_once(c: Column) -> Column:
    """c itself. The condition always holds, but as the optimizer cannot know, it pushes no filter on c below c, which would compute all patterns once for each mention."""
    return F.when(F.spark_partition_id() >= 0, c)


def parts(text: Column, value: str, before: str = "") -> Column:
    """text (unmarked) in parts; those at odd places match `value`, which `before` must precede."""
    return F.split(F.regexp_replace(text, f"({before})(?<val>{value})" if before else f"(?<val>{value})", f"{'$1' if before else ''}{MARK}${{val}}{MARK}"), MARK, -1)


def bind(value: Column, f) -> Column:
    """f(value), with value computed once however often f mentions it."""
    return F.transform(F.array(value), f)[0]


def odd_parts(found: Column, make, kind: str) -> Column:
    """make(start, end, part) of every second part of `found`, as an array of type `kind`.

    The parts are folded in blocks of an even size, so a text with n matches costs in proportion to n and not to its square.
    """
    none_of = F.array().cast(kind)

    def inside_block(at: Column, block: Column) -> Column:
        def step(acc: Column, part: Column) -> Column:
            end = acc["at"] + F.length(part)
            return F.struct(end.alias("at"), (~acc["hit"]).alias("hit"), F.when(acc["hit"], F.array_append(acc["out"], make(acc["at"], end, part))).otherwise(acc["out"]).alias("out"))
        return F.aggregate(block, F.struct(at.alias("at"), F.lit(False).alias("hit"), none_of.alias("out")), step)

    def over_blocks(p: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), ((F.size(p) - 1) / BLOCK).cast("int")), lambda b: F.slice(p, b * BLOCK + 1, BLOCK))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        step = lambda acc, block: bind(inside_block(acc["at"], block), lambda r: F.struct(r["at"].alias("at"), F.array_append(acc["out"], r["out"]).alias("out")))
        return F.flatten(F.aggregate(blocks, start, step, lambda acc: acc["out"]))

    short = lambda p: F.when(F.size(p) <= BLOCK, inside_block(F.lit(0), p)["out"]).otherwise(over_blocks(p))
    return bind(found, short)


def matches(text: Column, kind: str, value: str, before: str = "") -> Column:
    """All matches of `value` after `before`, from left to right."""
    span = lambda start, end, part: F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), part.alias("value"))
    return odd_parts(parts(text, value, before), span, TYPE)


def chains(found: Column, settle, kind: str, out: str) -> Column:
    """What settle(chain) makes of each chain of overlapping spans, joined: found is an array of `kind` (with start and end) by start, a chain the array of its spans, and settle gives an array of `out`.

    Spans are folded in blocks, as in odd_parts; the chain that is open at a block's end goes on in the next.
    """
    nothing, none_open = F.array().cast(f"array<{out}>"), F.array().cast(f"array<{kind}>")
    settled = lambda acc: F.when(F.size(acc["chain"]) > 0, F.concat(acc["out"], settle(acc["chain"]))).otherwise(acc["out"])

    def inside_block(end: Column, chain: Column, block: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            longer = F.struct(F.greatest(acc["end"], s["end"]).alias("end"), F.array_append(acc["chain"], s).alias("chain"), acc["out"].alias("out"))
            return F.when((F.size(acc["chain"]) > 0) & (s["start"] < acc["end"]), longer).otherwise(F.struct(s["end"].alias("end"), F.array(s).alias("chain"), settled(acc).alias("out")))
        return F.aggregate(block, F.struct(end.alias("end"), chain.alias("chain"), nothing.alias("out")), step)

    def over_blocks(p: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), ((F.size(p) - 1) / BLOCK).cast("int")), lambda b: F.slice(p, b * BLOCK + 1, BLOCK))
        start = F.struct(F.lit(0).alias("end"), none_open.alias("chain"), F.array().cast(f"array<array<{out}>>").alias("out"))
        step = lambda acc, block: bind(inside_block(acc["end"], acc["chain"], block), lambda r: F.struct(r["end"].alias("end"), r["chain"].alias("chain"), F.array_append(acc["out"], r["out"]).alias("out")))
        last = lambda acc: F.flatten(F.array_append(acc["out"], F.when(F.size(acc["chain"]) > 0, settle(acc["chain"])).otherwise(nothing)))
        return F.aggregate(blocks, start, step, last)

    short = lambda p: F.when(F.size(p) <= BLOCK, bind(inside_block(F.lit(0), none_open, p), settled)).otherwise(over_blocks(p))
    return bind(found, short)


#: Spans with the place of the rule that proposes them.
RANKED = "struct<start:int,rank:int,end:int,kind:string,value:string>"


def ranked(spans: Column, rank: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))


def by_rank(proposed: Column) -> Column:
    """Of an array of RANKED, by start: those that overlap none of a lower rank, or of the same rank and further left, that is kept. Only spans of one chain of overlaps are held against each other."""
    kind = f"array<{RANKED}>"

    def settle(chain: Column) -> Column:
        order = F.array_sort(F.transform(chain, lambda s: F.struct(s["rank"].alias("by"), s["start"].alias("start"), s["end"].alias("end"), s.alias("span"))))
        kept = F.aggregate(order, F.array().cast(kind), lambda acc, s: F.when(F.exists(acc, lambda k: overlap(k, s)), acc).otherwise(F.array_append(acc, s["span"])))
        return F.when(F.size(chain) == 1, chain).otherwise(F.array_sort(kept))

    return bind(proposed, lambda p: F.when(F.size(p) > 1, chains(F.array_sort(p), settle, RANKED, RANKED)).otherwise(p))


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def apart_from(new: Column, kept: Column) -> Column:
    """The spans of new that overlap none of kept."""
    return F.filter(new, lambda s: ~F.exists(kept, lambda k: overlap(k, s)))


def inside(spans: Column, outer: Column) -> Column:
    """The spans that lie within one of outer."""
    return F.filter(spans, lambda s: F.exists(outer, lambda o: (o["start"] <= s["start"]) & (s["end"] <= o["end"])))


def replaced(text: Column, spans: Column, by) -> Column:
    """text with each span (sorted, disjoint) replaced by by(span)."""
    def step(acc: Column, s: Column) -> Column:
        return F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), by(s)).alias("out"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))).otherwise(text)


def greedy(spans: Column, score: str = "score") -> Column:
    """Keep by score (highest first), then start, whatever overlaps nothing kept before; in order of start. spans: array<struct<start, end, kind, score>>."""
    ranked = F.array_sort(F.transform(spans, lambda s: F.struct((-s[score]).alias("by"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s[score].alias(score))))
    kind = f"array<struct<start:int,end:int,kind:string,{score}:double>>"
    def step(acc: Column, s: Column) -> Column:
        own = F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), s["kind"].alias("kind"), s[score].cast("double").alias(score))
        return F.when(F.exists(acc, lambda k: overlap(k, s)), acc).otherwise(F.array_append(acc, own))
    return F.array_sort(F.aggregate(ranked, F.array().cast(kind), step))
