"""What the routing tables look like from outside: models, groups, plans for requests, pins, events and status.

Chains, targets, policies and pins are configuration: chains(name, pos, entry), targets(name, base, model),
models(pos, provider, id, endpoints), policies(name, mode, sticky_scope, cooldown_seconds).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from . import routing

#: A policy's defaults, the endpoints of a group, and the session that stands for a whole group.
DEFAULTS = {"mode": "sticky", "sticky_scope": "conversation", "cooldown_seconds": 30}
ENDPOINTS = ("/v1/chat/completions", "/v1/messages")
EVERY = "*"


def ordered(rows: DataFrame, by: str, at: str, value: str, out: str) -> DataFrame:
    """by and its values as an array in order; for short lists that configuration bounds."""
    lists = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(at, value))).alias("_l"))
    return lists.select(by, F.transform("_l", lambda x: x[value]).alias(out))


def known(specs: DataFrame, models: DataFrame, targets: DataFrame, spec: str = "spec") -> DataFrame:
    """specs that name a target, a model, or a provider's model."""
    names = targets.select(F.col("name").alias("_k")).union(models.select("id")).union(models.select(F.concat_ws("/", "provider", "id"))).distinct()
    return specs.join(names, F.col(spec) == F.col("_k"), "left_semi")


def native(models: DataFrame, endpoint: str = "/v1/messages") -> DataFrame:
    """Ids of the models that have the endpoint themselves."""
    return models.where(F.array_contains("endpoints", endpoint)).select("id")


def models_list(chains: DataFrame, targets: DataFrame, models: DataFrame) -> DataFrame:
    """id, owner, endpoints, chain: groups, named targets and models; every model can be asked in either dialect."""
    both = F.array(*map(F.lit, ENDPOINTS))
    groups = ordered(chains, "name", "pos", "entry", "chain").select(F.col("name").alias("id"), F.lit("group").alias("owner"), both.alias("endpoints"), "chain")
    none = F.lit(None).cast("array<string>").alias("chain")
    own = targets.select(F.col("name").alias("id"), F.lit("target").alias("owner"), both.alias("endpoints"), none)
    served = models.select("id", F.col("provider").alias("owner"), F.when(F.col("endpoints").isNotNull(), F.array_union("endpoints", F.array(F.lit(ENDPOINTS[1])))).alias("endpoints"), none)
    return groups.unionByName(own).unionByName(served)


def with_defaults(policies: DataFrame) -> DataFrame:
    return policies.fillna(DEFAULTS)


def groups_list(chains: DataFrame, models: DataFrame, policies: DataFrame) -> DataFrame:
    """name, models, expanded, mode, sticky_scope, cooldown_seconds, policy_set of each group."""
    own = ordered(chains, "name", "pos", "entry", "models")
    full = ordered(routing.resolve(own.select(F.col("name").alias("id"), F.col("name").alias("model")), chains, models), "id", "n", "target", "expanded")
    joined = own.join(full, own["name"] == full["id"], "left").drop("id").join(policies.withColumn("policy_set", F.lit(True)), "name", "left")
    return with_defaults(joined).select("name", "models", F.coalesce("expanded", "models").alias("expanded"), *DEFAULTS, F.coalesce("policy_set", F.lit(False)).alias("policy_set"))


def pin_key(scope: Column, session: Column) -> Column:
    """Whose pin it is: the session's for conversations, the group's for the other scopes; a conversation without a session has none."""
    return F.when(scope == "conversation", session).otherwise(F.lit(EVERY))


def plan(requests: DataFrame, groups: DataFrame, pins: DataFrame, known_specs: DataFrame, now: Column) -> DataFrame:
    """requests(id, group, session, explicit) -> id, targets (in the order to try), pinned, error.

    groups is groups_list's result. An explicit target goes first, else that of a live pin; an explicit
    one that is neither in the list nor known (known_specs: spec) is an error. Failover ignores pins.
    """
    lists = groups.select(F.col("name").alias("group"), F.col("sticky_scope").alias("scope"), F.col("expanded").alias("models"))
    live = routing.live_pins(pins, lists, now).where("state = 'live'").select(F.col("group").alias("_g"), F.col("session").alias("_s"), F.col("model").alias("_pin"))
    rows = requests.join(groups.withColumnRenamed("name", "group"), "group")
    key = F.when(F.col("mode") != "failover", pin_key(F.col("sticky_scope"), F.col("session")))
    rows = rows.withColumn("_key", key).join(live, (F.col("group") == F.col("_g")) & (F.col("_key") == F.col("_s")), "left")
    rows = rows.join(known_specs.select(F.col("spec").alias("_spec"), F.lit(True).alias("_known")).distinct(), F.col("explicit") == F.col("_spec"), "left")
    bad = F.col("explicit").isNotNull() & ~F.array_contains("expanded", F.col("explicit")) & F.col("_known").isNull()
    first = F.coalesce("explicit", "_pin")
    tried = F.when(first.isNull(), F.col("expanded")).otherwise(F.concat(F.array(first), F.array_remove("expanded", first)))
    error = F.when(bad, F.concat(F.col("explicit"), F.lit(" is not a model of group "), F.col("group"), F.lit(" or a known model")))
    return rows.select("id", F.when(~bad, tried).alias("targets"), F.col("_pin").alias("pinned"), error.alias("error"))


def target_of(plans: DataFrame, targets: DataFrame, upstream: str) -> DataFrame:
    """plans(id, n, target) with base and model: those of a named target, else the upstream and the name itself."""
    named = F.broadcast(targets.select(F.col("name").alias("_name"), F.col("base").alias("_base"), F.col("model").alias("_model")))
    joined = plans.join(named, F.col("target") == F.col("_name"), "left")
    return joined.select("id", "n", "target", F.coalesce("_base", F.lit(upstream)).alias("base"), F.coalesce("_model", "target").alias("model"))


def healthy_first(plans: DataFrame, cooling: DataFrame) -> DataFrame:
    """plans(id, n, target) with n anew: targets that are not cooling down before those that are, each in their order."""
    from pyspark.sql import Window

    cold = cooling.select(F.col("target").alias("_t"), F.lit(True).alias("_cooling")).distinct()
    joined = plans.join(cold, F.col("target") == F.col("_t"), "left").withColumn("cooling", F.coalesce("_cooling", F.lit(False)))
    again = F.row_number().over(Window.partitionBy("id").orderBy("cooling", "n"))
    return joined.select("id", again.alias("n"), "target", "cooling")


def pins_shown(pins: DataFrame, now: Column, group: str | None = None, session: str | None = None) -> DataFrame:
    """Pins that are not over, used last first; a session also sees the pins of its whole group."""
    ends = scalars.expires_at(F.col("scope"), F.col("set_at"), F.col("last_used"), F.col("ttl_minutes"))
    rows = pins.withColumn("expires_at", ends).where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    rows = rows.where(F.col("group") == group) if group is not None else rows
    rows = rows.where(F.col("session").isin(session, EVERY)) if session is not None else rows
    return rows.orderBy(F.desc("last_used"), "group", "session")


def set_pins(pins: DataFrame, changes: DataFrame, most: int = routing.MOST_PINS) -> DataFrame:
    """pins after changes (same columns and `at`; model null clears): the last change of each (group, session) wins, and the `most` used last stay."""
    last = routing.latest(changes, ["group", "session"], "at").drop("at")
    rest = pins.join(last.select("group", "session"), ["group", "session"], "left_anti")
    return rest.unionByName(last.where("model IS NOT NULL").select(*pins.columns)).orderBy(F.desc("last_used"), "group", "session").limit(most)


def status(attempts: DataFrame, masked: DataFrame, cooling: DataFrame) -> DataFrame:
    """One row: requests, errors, served by label (map), entities and blocked of masking, and what is cooling down.

    attempts(target, failed) and masked(entities, blocked) are aggregated first; labels and targets are configuration.
    """
    by = attempts.groupBy("target").agg(F.count_if(~F.col("failed")).alias("served"), F.count_if("failed").alias("errors"))
    one = by.agg(F.coalesce(F.sum(F.col("served") + F.col("errors")), F.lit(0)).alias("requests"), F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("target", "served")))).alias("served"))
    two = masked.agg(F.coalesce(F.sum("entities"), F.lit(0)).alias("entities"), F.count_if("blocked").alias("blocked"))
    three = cooling.agg(F.array_sort(F.collect_set("target")).alias("cooling"))
    return one.withColumn("_k", F.lit(1)).join(two.withColumn("_k", F.lit(1)), "_k").join(three.withColumn("_k", F.lit(1)), "_k").drop("_k")


def vault_counts(vault: DataFrame) -> DataFrame:
    return vault.agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("name").isNotNull()).alias("named"), F.count_if(F.coalesce("tool", F.lit(False))).alias("tool"))


def parsed_events(lines: DataFrame, line: str = "line") -> DataFrame:
    """JSON lines of pin events; those without time, group and session go, the rest has defaults."""
    schema = "struct<time:bigint,`group`:string,session:string,`from`:string,`to`:string,reason:string>"
    return lines.select(F.from_json(line, schema).alias("e")).select("e.*").dropna(subset=["time", "group", "session"]).fillna("", ["reason"])
