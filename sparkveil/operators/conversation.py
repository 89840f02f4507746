"""Whole conversations: from turns to masked turns, how long a conversation's map lives, and stand-ins that must go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import content, scalars, spans
from ..sources.scratch import saved
from . import detect, mask, occurrences, surrogate

#: A map's life after its last use, and how many conversations have one.
TTL_HOURS, MOST_CONVERSATIONS = 6, 2_000
#: The rank of a tagger's finds, after rules and addresses; what the kind of a vault find begins with, so that each placeholder is a kind of its own.
TAGGED_RANK, VAULT = 2_000, "VAULT:"


def masked(
    turns: DataFrame, tiers: DataFrame, allowed: DataFrame, disabled: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text",
    vault: list[tuple] = (), tagged: DataFrame | None = None, styled: tuple[str, ...] = (), coins: bool = False,
) -> DataFrame:
    """turns with tier, masked, entities, occurrences and blocked_reason: one call for all that may not leave.

    tiers(conv, tier) says how each conversation is to be treated; allowed(tier, kind) and disabled(kind) are
    the policy. Tiers that do not mask pass their text on; a conversation without a tier is blocked.
    vault: entries as in mask.vault_tags, found in any masked text whatever the policy; tagged(conv, turn, start, end, kind, value) are a
    tagger's finds; entities of `styled` kinds get stand-ins. Where finds overlap, the vault goes before the rules, rules before addresses, and these
    before the tagger; what equals a vault value has the vault's placeholder only. Placeholders are numbered in the order of mask.assign_candidates, and every
    value found anywhere in a conversation is masked in all its turns in one scan.
    Nothing raw leaves a blocked row: its masked is null. Only texts that are to be masked are scanned, and
    once: the spans, which numbering and masking both need, are kept in the shared folder.
    """
    rows = turns.join(tiers.select(conv, "tier"), conv, "left")
    scanned = F.when(content.masks(F.col("tier")), F.col(text))
    found = detect.with_spans(rows.withColumn("_scan", scanned), "_scan", ranked=True)
    policy = allowed.groupBy("tier").agg(F.collect_set("kind").alias("_allowed"))
    off = disabled.agg(F.collect_set("kind").alias("_off")).withColumn("_one", F.lit(1))
    found = found.join(F.broadcast(policy), "tier", "left").withColumn("_one", F.lit(1)).join(F.broadcast(off), "_one").drop("_one")
    fits = lambda s: ~F.array_contains("_off", s["kind"]) & (F.col("_allowed").isNull() | F.array_contains("_allowed", s["kind"]))
    if tagged is not None:
        # a turn's finds are one short list
        each = tagged.groupBy(F.col(conv).alias("_conv"), F.col(turn).alias("_turn")).agg(F.collect_list(F.struct("start", F.lit(TAGGED_RANK).alias("rank"), "end", "kind", "value")).cast(f"array<{spans.RANKED}>").alias("_tagged"))
        found = found.join(each, (F.col(conv) == F.col("_conv")) & (F.col(turn) == F.col("_turn")), "left").drop("_conv", "_turn")
        more = F.when(F.col("_scan").isNotNull(), F.filter(F.coalesce("_tagged", F.array().cast(f"array<{spans.RANKED}>")), lambda s: (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.length("_scan"))))
        found = found.withColumn("spans", F.concat("spans", F.coalesce(more, F.array().cast(f"array<{spans.RANKED}>")))).drop("_tagged")
    found = found.withColumn("spans", F.filter("spans", fits)).drop("_allowed", "_off")
    if vault:
        held = occurrences.found(F.col("_scan"), mask.vault_tags(list(vault)))
        secret = F.transform(held, lambda h: F.struct(h["start"].alias("start"), F.lit(-1).alias("rank"), h["end"].alias("end"), F.concat(F.lit(VAULT), h["by"]).alias("kind"), h["value"].alias("value")))
        found = found.withColumn("spans", F.concat(F.coalesce(secret, F.array().cast(f"array<{spans.RANKED}>")), "spans"))
    if vault or tagged is not None:
        found = found.withColumn("spans", spans.by_rank(F.col("spans")))
    found = saved(found.drop("_scan"), "conversation-spans")
    every = found.select(conv, turn, text, F.explode("spans").alias("s")).select(conv, turn, text, "s.*")
    secrets = every.where("rank < 0").select(conv, "kind", F.col("value").alias("norm"), F.col("value").alias("raw"), F.substr("kind", F.lit(len(VAULT) + 1)).alias("tag"), F.lit(False).alias("blocked")).distinct()
    each = every.where("rank >= 0").withColumn("source", F.when(F.col("rank") == TAGGED_RANK, mask.TAGGED).otherwise(mask.DETECTED))
    tags = mask.assign_candidates(each.drop(text), conv, turn)
    if styled:
        place = F.struct(turn, "start")
        keyed = each.where(F.col("kind").isin(*styled)).withColumn("norm", scalars.normalize(F.col("kind"), F.col("value")))
        firsts = keyed.groupBy(conv, "kind", "norm").agg(F.min(place).alias("_at"), F.min_by(content.words_of(F.col(text)), place).alias("words"))
        known = tags.where(F.col("kind").isin(*styled)).join(firsts, [conv, "kind", "norm"])
        people = known.select(F.col(conv).alias("conv_id"), (F.col("_at")[turn].cast("long") * 2**24 + F.col("_at")["start"]).alias("at"), "kind", "raw", "words")
        tags = mask.with_surrogates(tags, surrogate.assign(people, coins=coins).withColumnRenamed("conv_id", conv), list(styled), conv)
    tags = saved(tags.unionByName(secrets), "conversation-tags")
    out = mask.mask_rows(found, tags, conv, text)
    reason = F.when(F.col("tier").isNull(), "no tier").otherwise(F.col("blocked_reason"))
    out = out.withColumn("blocked_reason", reason).withColumn("masked", F.when(F.col("blocked_reason").isNull(), F.col("masked")))
    values = F.transform("spans", lambda s: F.struct(s["kind"], s["value"]))
    return out.select(*turns.columns, "tier", "masked", F.size(F.array_distinct(values)).alias("entities"), F.size("spans").alias("occurrences"), "blocked_reason")


def lives(turns: DataFrame, conv: str = "conv_id", ts: str = "ts", hours: int = TTL_HOURS) -> DataFrame:
    """conv, life (1, 2, ...), first and last use, turns: a conversation that rests for `hours` starts anew with an empty map."""
    used = turns.groupBy(conv, F.session_window(ts, f"{hours} hours")).agg(F.min(ts).alias("first_used"), F.max(ts).alias("last_used"), F.count(F.lit(1)).alias("turns"))
    return used.select(conv, F.row_number().over(Window.partitionBy(conv).orderBy("first_used")).alias("life"), "first_used", "last_used", "turns")


def resident(lives_: DataFrame, now: Column, conv: str = "conv_id", hours: int = TTL_HOURS, most: int = MOST_CONVERSATIONS) -> DataFrame:
    """The lives that still have a map at `now`: not over, and among the `most` used last (a top-k, not a sort of all)."""
    fresh = lives_.where(F.unix_timestamp(now) - F.unix_timestamp("last_used") < hours * 3600)
    return fresh.orderBy(F.desc("last_used"), conv).limit(most)


def conversation_words(turns: DataFrame, conv: str = "conv_id", text: str = "text") -> DataFrame:
    """conv and each of its different words; two partial aggregations, so a long conversation is many small rows."""
    return turns.select(conv, F.explode(content.words_of(F.col(text))).alias("word")).distinct()


def retired(surrogates: DataFrame, words: DataFrame, conv: str = "conv_id", parts: Column | None = None) -> DataFrame:
    """surrogates(conv, surrogate, ...) of which no word has since appeared as a real word (conv, word) of the conversation.

    parts: the lower-case words of a surrogate, where its own case may have changed them (the upper case of ſ is S); else they are read from it.
    """
    listed = surrogates.withColumn("_parts", F.split(F.lower("surrogate"), r"\s+") if parts is None else parts)
    each = listed.select(conv, "surrogate", "_parts", F.explode("_parts").alias("word")).distinct()
    gone = each.join(words, [conv, "word"], "left_semi").select(conv, "surrogate", "_parts").distinct()
    return listed.join(gone, [conv, "surrogate", "_parts"], "left_anti").drop("_parts")


def head_length(name: Column, heads: list[str]) -> Column:
    """How many words of an organisation's stand-in are its head: those of the longest of heads that starts it, else one."""
    sizes = [F.when(name.startswith(h + " "), F.lit(len(h.split()))) for h in heads]
    return F.coalesce(F.greatest(*sizes, F.lit(None).cast("int")) if sizes else F.lit(None).cast("int"), F.lit(1))
