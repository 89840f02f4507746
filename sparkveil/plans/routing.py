"""Routing analytics: tiers, chains, health, pins, failover walks, presence and configuration checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars

# Tiers from open to strict; ties between rules go to the stricter.
TIERS = ("local", "trusted_raw", "trusted_masked", "public")
DEPTH, MOST_TARGETS, MOST_EVENTS, MOST_PINS = 4, 40, 200, 5_000


def tier_of(specs: DataFrame, rules: DataFrame, default: str = "public", spec: str = "spec") -> DataFrame:
    """specs with tier: that of the most specific matching rule(pattern, tier), the stricter on a tie, else the default.

    The rules are a policy kept by hand; joining by pattern compares each different spec with each of them once.
    """
    rank = F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier"))
    different = specs.select(spec).distinct()
    hits = different.join(F.broadcast(rules.select("pattern", "tier")), scalars.glob_match(F.col("pattern"), F.col(spec)))
    best = hits.groupBy(spec).agg(F.max_by("tier", F.struct(scalars.specificity(F.col("pattern")), rank)).alias("tier"))
    return specs.join(best, spec, "left").withColumn("tier", F.coalesce("tier", F.lit(default)))


def expand(parts: DataFrame, chains: DataFrame, models: DataFrame, depth: int = DEPTH) -> DataFrame:
    """parts(id, pos, part) -> (id, path, target): groups unfold to `depth` levels, provider/* to the provider's models, the rest stays.

    chains(name, pos, entry) and models(pos, provider, id). Depth bounds the unfolding, so cycles end.
    """
    place = lambda c: F.lpad(c.cast("string"), 6, "0")
    now = parts.select("id", place(F.col("pos")).alias("path"), F.col("part").alias("target"))
    groups = chains.select("name", place(F.col("pos")).alias("_at"), "entry")
    for _ in range(depth):
        now = now.join(groups, now["target"] == groups["name"], "left").select("id", F.concat_ws("/", "path", "_at").alias("path"), F.coalesce("entry", "target").alias("target"))
    served = models.select(F.concat("provider", F.lit("/*")).alias("_star"), place(F.col("pos")).alias("_at"), F.concat_ws("/", "provider", F.col("id")).alias("_model"))
    star = now.join(served, now["target"] == served["_star"], "left")
    return star.where(~F.col("target").endswith("/*") | F.col("_model").isNotNull()).select("id", F.concat_ws("/", "path", "_at").alias("path"), F.coalesce("_model", "target").alias("target"))


def resolve(requests: DataFrame, chains: DataFrame, models: DataFrame, prefix: str = "", most: int = MOST_TARGETS) -> DataFrame:
    """requests(id, model) -> (id, n, target): the ordered targets without repetition; a plain model has none."""
    name = scalars.bare(F.col("model"), prefix)
    parts = F.filter(F.transform(F.split(name, r"\|"), lambda p: F.trim(p)), lambda p: p != "")
    rows = requests.select("id", parts.alias("parts"))
    known = chains.select(F.col("name").alias("_name")).distinct()
    rows = rows.join(known, (F.size("parts") == 1) & (F.try_element_at("parts", F.lit(1)) == F.col("_name")), "left")
    rows = rows.where((F.size("parts") != 1) | F.col("_name").isNotNull() | F.try_element_at("parts", F.lit(1)).endswith("/*"))
    exploded = rows.select("id", F.posexplode("parts").alias("pos", "part")).withColumn("part", scalars.bare(F.col("part"), prefix))
    first = expand(exploded, chains, models).groupBy("id", "target").agg(F.min("path").alias("path"))
    n = F.row_number().over(Window.partitionBy("id").orderBy("path"))
    return first.select("id", n.alias("n"), "target").where(F.col("n") <= most)


def qualified(specs: DataFrame, models: DataFrame, spec: str = "spec") -> DataFrame:
    """A spec whose prefix is a known provider stays; otherwise the first model with that id lends its provider."""
    providers = models.select(F.col("provider").alias("_known")).distinct()
    first = models.groupBy(F.col("id").alias("_id")).agg(F.min_by("provider", "pos").alias("_provider"))
    out = specs.join(F.broadcast(providers), F.substring_index(spec, "/", 1) == F.col("_known"), "left").join(first, F.col(spec) == F.col("_id"), "left")
    full = F.when(F.col("_known").isNotNull() & F.col(spec).contains("/"), F.col(spec)).when(F.col("_provider").isNotNull(), F.concat_ws("/", "_provider", spec)).otherwise(F.col(spec))
    return out.withColumn("qualified", full).drop("_known", "_id", "_provider")


# Fixed value: the longest wait that an answer may ask for, in seconds.
RETRY_AFTER = 300


def failure_runs(attempts: DataFrame, target: str = "target", ts: str = "ts", failed: str = "failed", tie: str = "id", base: int = 30) -> DataFrame:
    """Each failed attempt with fails (its place in the unbroken run of failures) and seconds of cooldown: base, doubled up to five times, at most 600 or base; retry_after (a column, if any), at most RETRY_AFTER, takes its place."""
    by = Window.partitionBy(target).orderBy(ts, tie)
    runs = attempts.withColumn("_run", F.sum((~F.col(failed)).cast("int")).over(by))
    inside = Window.partitionBy(target, "_run").orderBy(ts, tie)
    rows = runs.where(failed).withColumn("fails", F.row_number().over(inside))
    grown = F.least(F.lit(base) * F.pow(F.lit(2.0), F.least(F.col("fails") - 1, F.lit(5))), F.lit(max(600, base))).cast("long")
    seconds = F.when(F.col("retry_after").isNotNull(), F.least(F.col("retry_after").cast("long"), F.lit(RETRY_AFTER))).otherwise(grown) if "retry_after" in attempts.columns else grown
    return rows.withColumn("seconds", seconds).drop("_run")


def cooling(attempts: DataFrame, now: Column, target: str = "target", ts: str = "ts", failed: str = "failed", tie: str = "id", base: int = 30) -> DataFrame:
    """Targets whose last attempt failed and whose cooldown is not over at `now`: target, fails, seconds_left."""
    last = attempts.groupBy(target).agg(F.max(F.struct(ts, tie)).alias("_last"))
    runs = failure_runs(attempts, target, ts, failed, tie, base).join(last, target).where(F.struct(ts, tie) == F.col("_last"))
    left = F.col("seconds") - (F.unix_timestamp(now) - F.unix_timestamp(ts))
    return runs.select(target, "fails", left.alias("seconds_left")).where("seconds_left > 0")


def sessions(events: DataFrame, by: str = "user_id", ts: str = "ts", minutes: int = 720) -> DataFrame:
    """Conversation pins: a pin lives while uses follow within `minutes`. by, set_at, last_used, uses, expires_at (epoch seconds)."""
    grouped = events.groupBy(by, F.session_window(ts, f"{minutes} minutes")).agg(F.min(ts).alias("set_at"), F.max(ts).alias("last_used"), F.count(F.lit(1)).alias("uses"))
    seconds = lambda c: F.unix_timestamp(c)
    return grouped.select(by, seconds("set_at").alias("set_at"), seconds("last_used").alias("last_used"), "uses", (seconds("last_used") + minutes * 60).alias("expires_at"))


def live_pins(pins: DataFrame, lists: DataFrame, now: Column) -> DataFrame:
    """pins(group, session, model, scope, sig, set_at, last_used, ttl_minutes) with state: live, expired, left, scope or changed.

    lists(group, scope, models): each group's present scope and ordered targets.
    """
    joined = pins.withColumnRenamed("scope", "_own").join(lists, "group", "left")
    ends = scalars.expires_at(F.col("_own"), F.col("set_at"), F.col("last_used"), F.col("ttl_minutes"))
    state = (
        F.when(F.coalesce(ends <= now, F.lit(False)), "expired").when(~F.coalesce(F.array_contains("models", F.col("model")), F.lit(False)), "left")
        .when(F.col("_own") != F.col("scope"), "scope").when((F.col("_own") == "until_changed") & (F.col("sig") != scalars.signature(F.col("models"))), "changed").otherwise("live")
    )
    return joined.withColumn("expires_at", ends).withColumn("state", state).withColumn("scope", F.col("_own")).drop("_own", "models")


def pin_outcome(mode: Column, pinned: Column, explicit: Column, served: Column, why: Column) -> Column:
    """What becomes of a pin after an answer: none, held, explicit, moved, kept or new."""
    hold = F.coalesce(why.isin("presence", "input-too-large"), F.lit(False)) & pinned.isNotNull()
    moved = explicit.isNotNull() | (pinned.isNotNull() & (pinned != served))
    return F.when(mode == "failover", "none").when(hold, "held").when(explicit == served, "explicit").when(F.coalesce(moved, F.lit(False)), "moved").when(pinned.isNotNull(), "kept").otherwise("new")


def keep_latest(rows: DataFrame, most: int, by: str, tie: str) -> DataFrame:
    """The `most` rows used last; a top-k, not a sort of everything."""
    return rows.orderBy(F.col(by).desc(), F.col(tie).desc()).limit(most)


def latest(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Of each key the row with the greatest `at`, by partial aggregation."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in rows.columns if c not in keys)), F.col(at)).alias("_row")).select(*keys, "_row.*")


def walk(attempts: DataFrame, request: str = "request") -> DataFrame:
    """attempts(request, pos, target, status, error, mode) -> request, served_by, attempts, skipped, first_reason.

    The first success in order serves; strict looks at the first target only. Everything is one partial aggregation.
    """
    rows = attempts.where((F.col("mode") != "strict") | (F.col("pos") == 0))
    ok = F.col("status").between(200, 299)
    first = rows.groupBy(request).agg(
        F.min(F.when(ok, F.struct("pos", "target"))).alias("_won"), F.count(F.lit(1)).alias("_n"),
        F.min(F.struct("pos", scalars.reason_of(F.col("status"), F.col("error")).alias("why"), ok.alias("ok"))).alias("_first"),
    )
    return first.select(request, F.col("_won.target").alias("served_by"), F.coalesce(F.col("_won.pos") + 1, "_n").alias("attempts"), F.coalesce(F.col("_won.pos"), "_n").alias("skipped"), F.when(~F.col("_first.ok"), F.col("_first.why")).alias("first_reason"))


def policy_walk(attempts: DataFrame, request: str = "request") -> DataFrame:
    """The walk of each request under its policy, as one partial aggregation over targets and one over requests.

    attempts(request, pos, target, nth, status, error) has what each target would answer when asked for the nth time (0, 1, ...), and on each
    row the request's policy (mode, retries, stop_on_timeout, size) and the target's state (max_input, presence, cooling).
    Strict takes the first target alone; else targets that cool down go last. A target whose max_input is below size, or that has a presence
    reason, is skipped. Only the first target is asked again, `retries` times at most, after a status that may pass or a failed connection.
    With stop_on_timeout a timeout ends the walk.

    -> request, served_by, attempts (answers and skips up to the end), failover (whether another than the first target served), reason (why the
    first target did not) and error (null, gateway_strict, gateway_timeout or gateway_exhausted).
    """
    again = F.col("status").isin(*scalars.RETRYABLE) | F.coalesce(F.col("error") == "connect", F.lit(False))
    allowed = F.when(F.col("pos") == 0, F.col("retries")).otherwise(0)
    rows = attempts.where(((F.col("mode") != "strict") | (F.col("pos") == 0)) & (F.col("nth") <= allowed))
    rows = rows.withColumn("_final", ~F.coalesce(again, F.lit(False)) | (F.col("nth") == allowed))
    answer = F.struct("nth", "status", "error")
    kept = ("mode", "stop_on_timeout", "size", "max_input", "presence", "cooling")
    each = rows.groupBy(request, "pos", "target", *kept).agg(F.coalesce(F.min(F.when(F.col("_final"), answer)), F.max(answer)).alias("_a"))
    skip = F.when(F.col("size") > F.col("max_input"), "input-too-large").when(F.col("presence").isNotNull(), "presence")
    each = each.withColumn("_skip", skip).withColumn("_order", F.struct(((F.col("mode") != "strict") & F.coalesce("cooling", F.lit(False))).alias("late"), F.col("pos").alias("pos")))
    served = F.col("_skip").isNull() & F.col("_a.status").between(200, 299)
    halted = F.col("_skip").isNull() & F.coalesce(F.col("_a.error") == "timeout", F.lit(False)) & F.col("stop_on_timeout")
    why = F.coalesce("_skip", scalars.reason_of(F.col("_a.status"), F.col("_a.error")))
    end = F.struct("_order", served.alias("served"), "target")
    tries = F.struct("_order", F.when(F.col("_skip").isNull(), F.col("_a.nth") + 1).otherwise(1).alias("n"))
    one = each.groupBy(request).agg(
        F.min(F.when(served | halted, end)).alias("_end"), F.collect_list(tries).alias("_tries"), F.min(F.when(F.col("pos") == 0, F.struct(served.alias("ok"), F.when(F.coalesce("cooling", F.lit(False)) & (F.col("mode") != "strict"), "cooldown").otherwise(why).alias("why"), "target"))).alias("_first"), F.first("mode").alias("_mode"),
    )
    until = F.aggregate(F.filter("_tries", lambda t: F.col("_end").isNull() | (t["_order"] <= F.col("_end._order"))), F.lit(0).cast("long"), lambda n, t: n + t["n"])
    by = F.when(F.col("_end.served"), F.col("_end.target"))
    error = F.when(F.col("_end.served"), None).when(F.col("_mode") == "strict", "gateway_strict").when(F.col("_end").isNotNull(), "gateway_timeout").otherwise("gateway_exhausted")
    other = F.coalesce(by != F.col("_first.target"), F.lit(False))
    return one.select(request, by.alias("served_by"), until.alias("attempts"), other.alias("failover"), F.when(other | by.isNull(), F.col("_first.why")).alias("reason"), error.alias("error"))


def eligibility(targets: DataFrame, nodes: DataFrame, now: Column, max_age_ms: int = 5_000, route: str = "direct") -> DataFrame:
    """targets(node, skip_busy) against the last feed row of each node (node, at, enabled, route, reason, busy) -> reason (null: eligible)."""
    seen = latest(nodes, ["node"], "at").withColumn("_seen", F.lit(True))
    newest = nodes.agg(F.max("at").alias("_newest"))
    joined = targets.join(seen, "node", "left").crossJoin(F.broadcast(newest))
    why = F.coalesce(F.nullif("reason", F.lit("")), "route")
    reason = (
        F.when(F.col("_newest").isNull(), "no presence source").when(now - F.col("_newest") > max_age_ms, "presence stale").when(F.col("_seen").isNull(), F.concat("node", F.lit(" unknown")))
        .when(~F.col("enabled") | (F.col("route") != route), F.concat_ws(" ", "node", why)).when(F.col("skip_busy") & F.col("busy"), F.concat("node", F.lit(" busy")))
    )
    return joined.select("node", "skip_busy", reason.alias("reason"))


def policies_of_groups(policies: DataFrame, chains: DataFrame, name: str = "name") -> DataFrame:
    """The policies (name, ...) whose group is saved."""
    return policies.join(chains.select(F.col("name").alias("_group")).distinct(), F.col(name) == F.col("_group"), "left_semi")


# Bounds of settings and policies.
SETTINGS = {"timeout": (5, 600), "ttfb": (3, 120), "idle": (10, 600), "max_tokens": (256, 200_000), "keepalive": (1, 60)}
ENUMS = {"mode": ("sticky", "strict", "failover"), "sticky_scope": ("conversation", "day", "until_changed"), "failover_on": ("errors", "errors_and_timeouts")}
WHOLE = {"sticky_ttl_minutes": (1, 10_080), "retry_same_model": (0, 5), "cooldown_seconds": (0, 3600)}
NUMBERS = {"ttfb_seconds": (3, 300), "total_timeout_seconds": (10, 1800)}


def setting_error(key: Column, value: Column) -> Column:
    out = F.concat(F.lit("unknown setting "), key)
    for name, (low, high) in SETTINGS.items():
        out = F.when(key == name, F.when(~F.coalesce(value.between(low, high), F.lit(False)), F.lit(f"{name} must be between {low} and {high}"))).otherwise(out)
    return out


def policy_error(key: Column, value: Column) -> Column:
    """The message about one policy field given as JSON text, null if it is in order."""
    out, text = F.concat(F.lit("unknown policy field "), key), F.regexp_replace(value, "^\"|\"$", "")
    number = value.try_cast("double")
    for name, allowed in ENUMS.items():
        out = F.when(key == name, F.when(~(value.startswith('"') & text.isin(*allowed)), f"{name} must be one of {', '.join(allowed)}")).otherwise(out)
    for name, (low, high) in WHOLE.items():
        fine = F.coalesce(number.between(low, high) & (number == F.floor(number)), F.lit(False))
        out = F.when(key == name, F.when(~fine, f"{name} must be a whole number between {low} and {high}")).otherwise(out)
    for name, (low, high) in NUMBERS.items():
        fine = (value == "null") | F.coalesce(number.between(low, high), F.lit(False))
        out = F.when(key == name, F.when(~fine, f"{name} must be a number between {low} and {high}, or null")).otherwise(out)
    return out


def group_error(name: Column, entries: Column) -> Column:
    """The message about a group: its name, then its entries."""
    bad = F.exists(entries, lambda e: (F.length(e) > 200) | (e == "") | e.rlike("[\\n|]"))
    return F.when(~name.rlike("^[A-Za-z0-9._-]{1,40}$"), "bad name").when(F.size(entries) == 0, "no entries").when(F.size(entries) > 40, "too many entries").when(bad, "bad entry")


def clean_entries(entries: Column) -> Column:
    return F.array_distinct(F.transform(entries, lambda e: F.trim(e)))


def rename_group(chains: DataFrame, old: str, new: str) -> DataFrame:
    """A new name for a group, also where other groups list it."""
    swap = lambda c: F.when(F.col(c) == old, F.lit(new)).otherwise(F.col(c)).alias(c)
    return chains.select(swap("name"), *(c for c in chains.columns if c not in ("name", "entry")), swap("entry"))


def rename_everywhere(chains: DataFrame, policies: DataFrame, pins: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A new name for a group in the groups' names and entries, in the policies' names and in the pins' groups. A group, policy or pin that has the new name already is replaced."""
    def renamed(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
        swapped = F.when(F.col(column) == old, F.lit(new)).otherwise(F.col(column)).alias(column)
        moved = df.where(F.col(column) == old).select(*(c for c in keys if c != column)).distinct() if len(keys) > 1 else df.where(F.col(column) == old).select(F.lit(new).alias(column)).distinct()
        own = [c for c in keys if c != column] or [column]
        gone = df.where(F.col(column) == new).join(moved, own, "left_semi").select(*df.columns)
        rest = df.join(gone.select(*keys).distinct(), keys, "left_anti").select(*df.columns)
        return rest.select(*(swapped if c == column else F.col(c) for c in df.columns))

    return rename_group(chains, old, new), renamed(policies, "name", ["name"]), renamed(pins, "group", ["group", "session"])
