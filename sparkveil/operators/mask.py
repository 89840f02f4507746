"""Placeholders: assignment by conversation, masking, vaults, reports and the way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import content, scalars, spans
from ..functions.workers import on_workers
from . import detect, occurrences

MAX_ENTRIES = 5_000
#: How many bytes of one conversation are masked in one piece, what a row counts besides its text, and how many bytes go to Python at once.
PART, ROW_BYTES, BATCH = 4 << 20, 256, 4 << 20


def tag(kind: Column, n: Column) -> Column:
    return F.concat(F.lit("<"), kind, F.lit("_"), scalars.letters(n), F.lit(">"))


def conversation_key(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv and conv_key: b: and the hash of the system text and the first user text; anon if there is neither."""
    first = turns.groupBy(conv).agg(
        F.coalesce(F.min_by(F.when(F.col(role) == "system", F.col(text)), F.when(F.col(role) == "system", F.col(turn))), F.lit("")).alias("_system"),
        F.coalesce(F.min_by(F.when(F.col(role) == "user", F.col(text)), F.when(F.col(role) == "user", F.col(turn))), F.lit("")).alias("_user"),
    )
    key = F.concat(F.lit("b:"), scalars.fnv_parts(F.col("_system"), F.col("_user")))
    return first.select(conv, F.when((F.col("_system") == "") & (F.col("_user") == ""), "anon").otherwise(key).alias("conv_key"))


def assign_tags(found: DataFrame, conv: str = "conv_id", order: tuple[str, ...] = ("turn", "start"), most: int | None = MAX_ENTRIES) -> DataFrame:
    """found(conv, order..., kind, value) -> (conv, kind, norm, raw, tag, blocked).

    Values that normalise alike within a kind are one entity; it is numbered by its first occurrence and its
    first spelling is what the tag leads back to. Conversations with more than `most` entities are
    blocked: their rows have no tag, and only most + 1 of them are listed; None sets no limit. One partial aggregation brings
    found down to entities before any ordering, and the limit on a conversation's entities is applied
    before the shuffle (a window group limit), so a hot conversation sends at most that many rows from each task.
    """
    keyed = found.withColumn("norm", scalars.normalize(F.col("kind"), F.col("value")))
    at = F.struct(*order)
    entities = keyed.groupBy(conv, "kind", "norm").agg(F.min(at).alias("_at"), F.min_by("value", at).alias("raw"))
    if most is not None:
        _limit_windows_to(found.sparkSession, most + 1)
        place = F.row_number().over(Window.partitionBy(conv).orderBy("_at", "kind", "norm"))
        entities = entities.withColumn("_place", place).where(F.col("_place") <= most + 1)
    rank = F.row_number().over(Window.partitionBy(conv, "kind").orderBy("_at", "norm")) - 1
    over = F.lit(False) if most is None else F.count(F.lit(1)).over(Window.partitionBy(conv)) > most
    numbered = entities.withColumn("blocked", over).withColumn("_n", rank)
    return numbered.select(conv, "kind", "norm", "raw", F.when(~F.col("blocked"), tag(F.col("kind"), F.col("_n"))).alias("tag"), "blocked")


#: Where a find comes from, in the order in which they are taken: rules and addresses of a text, then a tagger's.
DETECTED, TAGGED = 0, 1


def assign_candidates(found: DataFrame, conv: str = "conv_id", call: str = "turn", visit: tuple[str, ...] = (), most: int | None = MAX_ENTRIES) -> DataFrame:
    """found(conv, call, visit..., source, rank, start, kind, value) -> as assign_tags.

    Within a call values of more words come first, so a full name is numbered before its parts; then a text's own finds before a tagger's, the
    texts in the order of `visit`, the rules by rank (addresses last), and places from left to right. A value that was found before keeps the placeholder it
    has, also if it is now found as another kind: such a kind is listed with the tag of the first, unless it has an entity of that norm itself.
    """
    words = F.size(F.filter(F.split("value", r"\s+"), lambda w: w != ""))
    order = (call, "_few", "source", *visit, "rank", "start")
    keyed = found.withColumn("_few", -words)
    first = keyed.groupBy(conv, "value").agg(F.min_by("kind", F.struct(*order, "kind")).alias("_first"), F.collect_set("kind").alias("_kinds"))
    several = first.where(F.size("_kinds") > 1)
    as_first = keyed.join(first.select(F.col(conv).alias("_conv"), F.col("value").alias("_value"), "_first"), F.col(conv).eqNullSafe(F.col("_conv")) & (F.col("value") == F.col("_value"))).drop("_conv", "_value")
    tags = assign_tags(as_first.withColumn("kind", F.col("_first")), conv, order, most)
    alias = several.select(F.col(conv).alias("_conv"), "value", "_first", F.explode(F.array_remove("_kinds", F.col("_first"))).alias("_kind"))
    named = alias.join(tags, F.col(conv).eqNullSafe(F.col("_conv")) & (F.col("kind") == F.col("_first")) & (F.col("norm") == scalars.normalize(F.col("_first"), F.col("value"))))
    extra = named.select(conv, F.col("_kind").alias("kind"), scalars.normalize(F.col("_kind"), F.col("value")).alias("norm"), F.col("value").alias("raw"), "tag", "blocked")
    extra = extra.groupBy(conv, "kind", "norm").agg(F.min_by("raw", "tag").alias("raw"), F.min("tag").alias("tag"), F.max("blocked").alias("blocked"))
    own = tags.select(F.col(conv).alias("_conv"), F.col("kind").alias("_kind"), F.col("norm").alias("_norm"))
    return tags.unionByName(extra.join(own, F.col(conv).eqNullSafe(F.col("_conv")) & (F.col("kind") == F.col("_kind")) & (F.col("norm") == F.col("_norm")), "left_anti"))


def _limit_windows_to(spark: SparkSession, rows: int) -> None:
    """Let the optimizer limit windows of up to `rows` rows a group before their shuffle; a higher setting stays."""
    name = "spark.sql.optimizer.windowGroupLimitThreshold"
    if int(spark.conf.get(name)) < rows:
        spark.conf.set(name, str(rows))


def _limit_batches_to(spark: SparkSession, size: int) -> None:
    """Let batches on their way to Python and back hold up to `size` bytes, so whole rows take little memory on either side; a lower setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < now <= size:
        spark.conf.set(name, str(size))


def spellings(rows: DataFrame, tags: DataFrame, conv: str = "conv_id", span_column: str = "spans") -> DataFrame:
    """conv, kind, value, tag: every spelling of a tagged value that was found in a row of the conversation, and the one its tag leads back to."""
    known = tags.where("tag IS NOT NULL").select(conv, "kind", "norm", "raw", "tag")
    each = rows.select(conv, F.explode(span_column).alias("s")).select(conv, F.col("s.kind").alias("kind"), F.col("s.value").alias("value")).distinct()
    found = each.withColumn("norm", scalars.normalize(F.col("kind"), F.col("value"))).join(known, [conv, "kind", "norm"]).select(conv, "kind", "value", "tag")
    return found.union(known.select(conv, "kind", F.col("raw").alias("value"), "tag")).distinct()


WORD = r"[\p{L}\p{M}\p{N}_]"


def _bounded(value: Column) -> Column:
    """A pattern of value that matches no part of a longer word."""
    quoted = F.regexp_replace(value, r"([^\p{L}\p{M}\p{N}_\s])", r"\\$1")
    edge = lambda where, mark: F.when(value.rlike(where), mark).otherwise("")
    return F.concat(edge("^" + WORD, f"(?<!{WORD})"), quoted, edge(WORD + "$", f"(?!{WORD})"))


def known_values(spelt: DataFrame, conv: str = "conv_id") -> DataFrame:
    """conv, loose, value, tag: each different value of a conversation. Those of name-like kinds are loose: found in any (ASCII) case."""
    loose = content.name_like(F.col("kind"))
    keyed = spelt.where("value <> ''").select(conv, loose.alias("loose"), F.when(loose, F.lower("value")).otherwise(F.col("value")).alias("value"), "tag")
    return keyed.groupBy(conv, "loose", "value").agg(F.min("tag").alias("tag"))


def _patterns(found: DataFrame) -> DataFrame:
    """found with _known, _exact, _any and _least in the place of _hits: the values (loose, value, tag) that a row's text holds, and the patterns that find them, longest value first, loose ones before the others, and the length of the shortest."""
    pattern = lambda wanted: F.nullif(F.array_join(F.transform(F.filter("_all", lambda x: x["loose"] == wanted), lambda x: _bounded(x["value"])), "|"), F.lit(""))
    entry = lambda x: F.struct(F.concat(F.when(x["loose"], "i:").otherwise("c:"), x["value"]).alias("key"), x["tag"].alias("value"))
    listed = F.array_sort(F.transform("_hits", lambda x: F.struct((-F.length(x["value"])).alias("by"), x["value"].alias("value"), x["loose"].alias("loose"), x["tag"].alias("tag"))))
    rows = found.withColumn("_all", listed).drop("_hits").withColumn("_exact", pattern(False)).withColumn("_loose", pattern(True)).withColumn("_known", F.map_from_entries(F.transform("_all", entry)))
    either = F.concat_ws("|", F.concat(F.lit("(?i:"), F.col("_loose"), F.lit(")")), F.col("_exact"))
    least = F.array_min(F.transform("_all", lambda x: F.length(x["value"])))
    return rows.withColumn("_any", F.when(F.col("_loose").isNotNull(), either)).withColumn("_least", least).drop("_all", "_loose")


def _known_masked(text: Column, known: Column, exact: Column, any_: Column) -> Column:
    """text (unmarked) with known values replaced; name-like ones only outside links. Stand-ins take the case of what they replace."""
    tag_of = lambda x: F.coalesce(F.try_element_at(known, F.concat(F.lit("i:"), F.lower(x))), F.try_element_at(known, F.concat(F.lit("c:"), x)))
    shown = lambda x: F.coalesce(F.when(tag_of(x).startswith("<"), tag_of(x)).otherwise(scalars.apply_case(tag_of(x), x)), x)

    def within(part: Column, pattern: Column) -> Column:
        cut = F.split(F.regexp_replace(part, F.concat(F.lit("("), pattern, F.lit(")")), F.lit(f"{spans.MARK}$1{spans.MARK}")), spans.MARK, -1)
        found = F.array_join(F.transform(cut, lambda x, i: F.when(i % 2 == 1, shown(x)).otherwise(x)), "")
        return F.when(F.coalesce(part.rlike(pattern) if isinstance(pattern, str) else F.regexp_like(part, pattern), F.lit(False)), found).otherwise(part)

    links = F.when(text.contains("."), spans.parts(text, detect.LINK.replace(r"\b", spans.EDGE))).otherwise(F.array(text))
    apart = F.array_join(F.transform(links, lambda part, i: F.when(i % 2 == 1, within(part, exact)).otherwise(within(part, any_))), "")
    return F.when(any_.isNotNull(), apart).otherwise(within(text, exact))


def _with_entries(rows: DataFrame, tags: DataFrame, conv: str, text: str, span_column: str) -> DataFrame:
    """_row (all columns of rows), _tags (the tag of each span, null without one) and _hits (the known values of the conversation that the text holds outside its spans; null if it has none).

    Each conversation's entries go once to every part of it, of PART bytes of text or so, and meet its rows in one sorted stream. So a
    row carries only what its own text holds, and a conversation of any size is as many pieces of work as it has parts. With very many
    entries the parts are larger, so that what is sent grows with the text and not with its product with the entries.
    """
    _limit_batches_to(on_workers(), BATCH)
    weight = F.sum(F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES)
    listed = tags.groupBy(F.col(conv).alias("_of")).agg((F.count(F.lit(1)) * ROW_BYTES).alias("_least"))
    sizes = rows.groupBy(F.col(conv).alias("_of")).agg(weight.alias("_weight")).where(F.col("_weight") > PART).join(listed, "_of", "left")
    sizes = F.broadcast(sizes.select("_of", F.ceil(F.col("_weight") / F.greatest(F.lit(PART), "_least")).cast("int").alias("_parts")))
    spread = F.xxhash64(*(F.col(c) for c, t in rows.dtypes if "map<" not in t and "variant" not in t))
    keys = F.transform(span_column, lambda s: F.concat_ws("\0", s["kind"], scalars.normalize(s["kind"], s["value"])))
    none = F.lit(None).cast("string")
    packed = rows.join(sizes, F.col(conv) == F.col("_of"), "left").select(
        F.col(conv).alias("_key"), F.coalesce(F.pmod(spread, F.col("_parts")).cast("int"), F.lit(0)).alias("_part"), keys.alias("_keys"),
        none.alias("_sort"), none.alias("_value"), none.alias("_tag"), F.struct(*(F.col(c) for c in rows.columns)).alias("_row"),
    )
    keyed = tags.where("tag IS NOT NULL").select(conv, F.lit("key").alias("_sort"), F.concat_ws("\0", "kind", "norm").alias("_value"), F.col("tag").alias("_tag"))
    known = known_values(spellings(rows, tags, conv, span_column), conv).select(conv, F.when(F.col("loose"), "loose").otherwise("exact").alias("_sort"), F.col("value").alias("_value"), F.col("tag").alias("_tag"))
    entries = keyed.union(known).where(F.col(conv).isNotNull()).join(sizes, F.col(conv) == F.col("_of"), "left")
    entries = entries.select(
        F.col(conv).alias("_key"), F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)).alias("_part"), F.lit(None).cast("array<string>").alias("_keys"),
        "_sort", "_value", "_tag", F.lit(None).cast(packed.schema["_row"].dataType).alias("_row"),
    )
    stream = entries.union(packed).repartition("_key", "_part").sortWithinPartitions("_key", "_part", F.col("_sort").isNull())
    schema = T.StructType([packed.schema["_row"], T.StructField("_tags", T.ArrayType(T.StringType())), T.StructField("_hits", T.ArrayType(T.StructType.fromDDL("loose boolean, value string, tag string")))])
    return stream.mapInArrow(occurrences.entries_of_rows(rows.columns.index(text), rows.columns.index(span_column), spans.MARK, spans.OTHER), schema)


def mask_rows(rows: DataFrame, tags: DataFrame, conv: str = "conv_id", text: str = "text", span_column: str = "spans") -> DataFrame:
    """rows(conv, text, spans) with masked, and blocked_reason instead where a tag is missing. Raw text is never passed on: a blocked row's masked is null.

    Detected spans are replaced by their tags, and in what is left every other occurrence of a value of the same
    conversation, also where no rule found it; see known_values. A row gets only those tags and patterns that its own text
    needs. All columns of rows are kept, whatever their names, but for masked and blocked_reason.
    """
    names = [c for c in rows.columns if c not in ("masked", "blocked_reason")]
    found = _patterns(_with_entries(rows.select(*names), tags, conv, text, span_column))
    tagged = lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.get("_tags", i).alias("tag"))
    joined = found.select("_row", "_known", "_exact", "_any", "_least", F.col("_row").getField(text).alias("_text"), F.transform(F.col("_row").getField(span_column), tagged).alias("_spans"))
    by = lambda s: F.when(s["tag"].startswith("<"), s["tag"]).otherwise(scalars.apply_case(s["tag"], s["value"]))
    missing = F.coalesce(F.exists("_spans", lambda s: s["tag"].isNull()), F.lit(False))
    marked = F.split(spans.replaced(spans.unmarked(F.col("_text")), F.col("_spans"), lambda s: F.concat(F.lit(spans.MARK), by(s), F.lit(spans.MARK))), spans.MARK, -1)
    # a pattern is compiled for each part, so only for parts that are long enough for a value
    rest = lambda part: F.when(F.length(part) >= F.col("_least"), _known_masked(part, F.col("_known"), F.col("_exact"), F.col("_any"))).otherwise(part)
    masked = F.array_join(F.transform(marked, lambda part, i: F.when(i % 2 == 1, part).otherwise(rest(part))), "")
    masked = F.when(F.col("_text").isNull() | F.col("_known").isNull(), F.col("_text")).otherwise(masked)
    done = joined.select("_row", F.when(missing, "no placeholder").alias("blocked_reason"), masked.alias("masked"))
    return done.select(*(F.col("_row").getField(c).alias(c) for c in names), "blocked_reason", F.when(F.col("blocked_reason").isNull(), F.col("masked")).alias("masked"))


def with_surrogates(tags: DataFrame, surrogates: DataFrame, kinds: list[str], conv: str = "conv_id") -> DataFrame:
    """tags where entities of `kinds` have their stand-in (conv, kind, raw, surrogate) in the place of a tag; without one they are blocked."""
    chosen = surrogates.select(F.col(conv).alias("_conv"), F.col("kind").alias("_kind"), F.col("raw").alias("_raw"), "surrogate").distinct()
    joined = tags.join(chosen, (tags[conv] == chosen["_conv"]) & (tags["kind"] == chosen["_kind"]) & (tags["raw"] == chosen["_raw"]), "left")
    styled = F.col("kind").isin(*kinds)
    return joined.select(conv, "kind", "norm", "raw", F.when(styled, F.col("surrogate")).otherwise(F.col("tag")).alias("tag"), (F.col("blocked") | (styled & F.col("surrogate").isNull())).alias("blocked"))


PLACEHOLDER = "<[A-Za-z0-9_:.-]{1,98}>"


def restored(text: Column, mapping: Column, escape: bool = False) -> Column:
    """text with each known placeholder replaced by its value; unknown ones stay. mapping: map<tag, value>. escape writes values as inside a JSON string."""
    pieces = spans.parts(spans.unmarked(text), PLACEHOLDER)
    value = lambda p: F.try_element_at(mapping, p)
    shown = lambda v: F.when(v.isNotNull(), F.regexp_replace(F.to_json(F.array(v)), r'^\["|"\]$', "")) if escape else v
    return F.when(text.contains("<"), F.array_join(F.transform(pieces, lambda p: F.coalesce(shown(value(p)), p)), "")).otherwise(text)


def unescape_angles(text: Column) -> Column:
    r"""< and > become < and > unless their backslash is itself escaped."""
    even = r"(?<!\\)((?:\\\\)*)"
    once = F.regexp_replace(F.regexp_replace(text, even + r"\\[uU]003[cC]", "$1<"), even + r"\\[uU]003[eE]", "$1>")
    return F.when(text.contains("\\u003"), once).otherwise(text)


def vault_patterns(vault: DataFrame, least: int = 4) -> DataFrame:
    """Clean vault entries (name, kind, value, ignore_case, tool); values under `least` characters are left out."""
    name = F.nullif(F.left(F.regexp_replace("name", "[^A-Za-z0-9_.-]", ""), F.lit(48)), F.lit(""))
    kind = F.upper(F.coalesce(F.nullif(F.left(F.regexp_replace("kind", "[^A-Za-z0-9_]", ""), F.lit(24)), F.lit("")), F.lit("SECRET")))
    return vault.where(F.char_length("value") >= least).select(name.alias("name"), kind.alias("kind"), "value", F.coalesce("ignore_case", F.lit(False)).alias("ignore_case"), F.coalesce("tool", F.lit(False)).alias("tool"))


def vault_tags(entries: list[tuple]) -> list[tuple[str, str, bool]]:
    """(value, placeholder, ignore_case) of vault entries (name, kind, value[, ignore_case[, tool]]): <SECRET:name> for named ones, <KIND_A>, <KIND_B>... for others, longest value first."""
    if len(entries) > MAX_ENTRIES:
        raise ValueError("vault too large")
    seen: dict[str, int] = {}
    out = []
    for name, kind, value, *more in sorted(entries, key=lambda e: (-len(e[2]), e[2])):
        if name:
            by = f"<SECRET:{name}>"
        else:
            n = seen[kind] = seen.get(kind, -1) + 1
            by, n = "", n + 1
            while n:
                by, n = chr(65 + (n - 1) % 26) + by, (n - 1) // 26
            by = f"<{kind}_{by}>"
        out.append((value, by, bool(more and more[0])))
    return out


def vault_tools(entries: list[tuple]) -> dict[str, str]:
    """Placeholder to value of the named entries that tools may use."""
    return {f"<SECRET:{name}>": value for name, _, value, *more in entries if name and len(more) > 1 and more[1]}


def vault_masked(text: Column, entries: list[tuple]) -> Column:
    """text with each bounded occurrence of a vault value replaced, in one scan for all entries, so no placeholder is ever scanned. Entries as in vault_tags."""
    return occurrences.replaced(text, vault_tags(entries))


def report(found: DataFrame, by: list[str]) -> DataFrame:
    """occurrences and entities (different normalised values) of found(by..., kind, value), by `by`."""
    keyed = found.withColumn("_norm", F.struct("kind", scalars.normalize(F.col("kind"), F.col("value"))))
    return keyed.groupBy(*by).agg(F.count(F.lit(1)).alias("occurrences"), F.countDistinct("_norm").alias("entities"))
