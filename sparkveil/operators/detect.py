"""Detection of personal data and secrets in a text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules, spans
from .address import address_spans

# The endings by which a bare host name is known.
TLDS = "com|net|org|dev|io|ai|app|in|co|uk|us|me|xyz|info|biz|edu|gov|tech|cloud|site|online|sh|gg|tv|so|to|ly|page|blog|email|live|store|shop|pro|one|run|host|space|website|club|design|studio|systems|internal|local|lan|localhost"
LINK = (
    r"(?i:\b[a-z][a-z0-9+.-]{1,15}://[^\s<>\"'`]+"
    r"|\b[a-z0-9._%+-]{1,64}@[a-z0-9-]{1,63}(?:\.[a-z0-9-]{1,63})*\.[a-z]{2,24}\b"
    rf"|(?:\*\.)?\b(?:[a-z0-9](?:[a-z0-9-]{{0,61}}[a-z0-9])?\.)+(?:{TLDS})\b(?::[0-9]{{1,5}})?(?:/[^\s<>\"'`]*)?)"
)


def of_rule(text: Column, rule: rules.Rule, has_digit: Column | None = None) -> Column:
    """Valid spans of one rule in text (unmarked); its guards keep the pattern off texts that cannot match."""
    hits = spans.matches(text, rule.kind, rule.java(rule.value), rule.java(rule.before))
    if rule.check == "phone":  # the separator before a bare number is not part of it
        lead = lambda s: F.length(s["value"]) - F.length(F.regexp_replace(s["value"], r"^\s+", ""))
        hits = F.transform(hits, lambda s: F.struct((s["start"] + lead(s)).cast("int").alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.regexp_replace(s["value"], r"^\s+", "").alias("value")))
    kept = F.filter(hits, lambda s: rules.valid(rule.check, s["value"]))
    guard = rules.may_match(rule, text, text.rlike("[0-9]") if has_digit is None else has_digit)
    return F.when(guard, kept).otherwise(spans.none())


#: The rank of addresses, which come after all rules.
ADDRESS_RANK = 1_000


def with_spans(df: DataFrame, text: str = "text", out: str = "spans", kinds: list[str] | None = None, addresses: bool = True, ranked: bool = False) -> DataFrame:
    """df with `out`, the spans of all rules by start; with `ranked` each has the rank of its rule. Rules go by priority: a span that overlaps one of an earlier rule is dropped.

    Rules whose kind is not wanted are not in the plan at all. All rules propose their spans, and only those of one chain of
    overlaps are held against each other. Only addresses need Python, and only texts with a postal code reach it. All columns
    of df are kept, whatever their names; one that is named `out` is replaced.
    """
    body, names = F.col("_body"), [c for c in df.columns if c != out]
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row") if names else F.struct(F.lit(0)).alias("_row"), spans.unmarked(F.col(text)).alias("_body"))
    rows = rows.withColumn("_digit", body.rlike("[0-9]"))
    wanted = [(n, r) for n, r in enumerate(rules.RULES) if kinds is None or r.kind in kinds]
    found = [spans.ranked(of_rule(body, r, F.col("_digit")), n) for n, r in wanted]
    if addresses and (kinds is None or "ADDRESS" in kinds):
        rows = rows.withColumn("_addresses", address_spans(body))
        found.append(spans.ranked(F.col("_addresses"), ADDRESS_RANK))
    rows = rows.withColumn("_all", F.concat(*found) if found else F.array().cast(f"array<{spans.RANKED}>"))
    kept = spans.by_rank(F.col("_all"))
    shown = kept if ranked else F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))
    return rows.select(*(F.col("_row").getField(c).alias(c) for c in names), spans.computed_once(shown).alias(out))


def link_spans(text: Column) -> Column:
    """Urls, email addresses and host names; none in a text without a full stop."""
    body = spans.unmarked(text)
    return F.when(body.contains("."), spans.matches(body, "LINK", LINK.replace(r"\b", spans.EDGE))).otherwise(spans.none())


def kind_allowed(df: DataFrame, allowed: DataFrame, disabled: DataFrame) -> DataFrame:
    """Rows (tier, kind) that are not disabled and whose tier lists the kind or has no list: allowed(tier, kind), disabled(kind)."""
    listed = F.broadcast(allowed.select("tier").distinct().withColumn("_listed", F.lit(True)))
    named = F.broadcast(allowed.select("tier", "kind").distinct().withColumn("_named", F.lit(True)))
    return df.join(F.broadcast(disabled.select("kind")), "kind", "left_anti").join(listed, "tier", "left").join(named, ["tier", "kind"], "left").where("_listed IS NULL OR _named").drop("_listed", "_named")
