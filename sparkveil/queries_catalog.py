"""Named queries, continued: the tagger's frame, content, whole conversations, and routing seen from outside."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import content, scalars
from .operators import conversation, names, tagger
from .plans import catalog, routing
from .queries import query, table, values
from .queries_more import CHAINS, _attempts, _models
from .streaming import sse

# ---- the tagger's frame --------------------------------------------------------

LABELS = [(1, "person:per;company:org:0.8", "person/PER/0.5 company/ORG/0.8"), (2, "city : LOCATION : x | : A | b", "city/LOCATION/0.5"), (3, "", ""), (4, "a:b:1|c:d:0.25", "a/B/1.0 c/D/0.25")]


@query(f"SELECT id, want AS labels FROM {values(LABELS, 'id, spec, want')}")
def tagger_labels(spark, sf_dir):
    rows = spark.createDataFrame(LABELS, "id int, spec string, want string")
    return rows.select("id", F.array_join(F.transform(tagger.labels_of(F.col("spec")), lambda x: F.concat_ws("/", x["prompt"], x["kind"], x["threshold"].cast("string"))), " ").alias("labels"))


@query(f"SELECT * FROM {values([(0, None, False), (1, 'PERSON', True), (2, 'PERSON', False), (3, 'ORG', True), (4, None, True), (5, 'PERSON', False)], 'tag, kind, begins')}")
def tagger_tags(spark, sf_dir):
    ids = {0: "O", 1: "B-PER", 2: "I-per", 3: "b-Org", 4: "B-MISC", 5: "PER"}
    rows = spark.createDataFrame([(ids, "PER:PERSON|ORG:ORG")], "ids map<int,string>, spec string")
    found = rows.select(F.explode(tagger.tags_of(F.col("ids"), tagger.labels_of(F.col("spec")))).alias("t"))
    return found.select(F.col("t.id").alias("tag"), F.col("t.kind").alias("kind"), F.col("t.begin").alias("begins"))


@query(r"""WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+(?:[-_][\p{L}\p{M}\p{N}_]+)*|[^\s]')) AS w FROM conversations WHERE NOT regexp_matches(text, '[^\p{L}\p{M}\p{N}\s][\s]*[^\p{L}\p{M}\p{N}\s]')),
c AS (SELECT conv_id, turn, count(*) AS words FROM w WHERE strlen(w) <= 64 GROUP BY 1, 2)
SELECT conv_id, turn, words FROM c""")
def tagger_words(spark, sf_dir):
    """Words that a tagger sees of each turn; the twin leaves runs of symbols out, so turns with them are left out here; tagger_words_whole has every turn."""
    rows = table(spark, sf_dir, "conversations").where(~F.col("text").rlike(r"[^\p{L}\p{M}\p{N}\s][\s]*[^\p{L}\p{M}\p{N}\s]"))
    return rows.select("conv_id", "turn", F.size(tagger.words(F.col("text"))).cast("long").alias("words")).where("words > 0")


@query()
def tagger_words_whole(spark, sf_dir):
    """Every turn, also those with runs of symbols or without a word; tests hold it against brute force."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(tagger.words(F.coalesce("text", F.lit("")))).cast("long").alias("words"))


LIMITS = [("roberta", 514, 12, 512, 490), ("bert", 512, 0, 512, 502), ("camembert", 514, 600, 512, 16), ("deberta", 20_000, 8, 8192, 8174), ("bert", None, 10, 512, 492)]


@query(f"SELECT family, prompt, want AS positions, budget FROM {values(LIMITS, 'family, positions, prompt, want, budget')}")
def tagger_budget(spark, sf_dir):
    rows = spark.createDataFrame(LIMITS, "family string, positions int, prompt int, want int, b int")
    limit = tagger.position_limit(F.col("family"), F.col("positions"))
    return rows.select("family", "prompt", limit.alias("positions"), tagger.budget(limit, F.col("prompt")).alias("budget"))


def _capitals(texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
    import re

    return [[(m.start(), m.end(), "PERSON", 0.9) for m in re.finditer(r"\b[A-Z][a-z]+\b", t, re.ASCII)] for t in texts]


@query(r"""SELECT conv_id, turn, len(regexp_extract_all(text, '\b[A-Z][a-z]+\b')) AS found FROM conversations""")
def tagger_cached(spark, sf_dir):
    """A stand-in tagger (capitalised words) behind a cache that knows every even conversation's texts."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("chunk"))
    known = tagger.tagged(rows.where("conv_id % 2 = 0").select("chunk").distinct(), _capitals).select(F.sha2("chunk", 256).alias("hash"), "found")
    out, _ = tagger.through_cache(rows, known, _capitals)
    return out.select("conv_id", "turn", F.size("found").cast("long").alias("found"))


@query("SELECT 4::BIGINT AS calls, 100::BIGINT AS texts, 5000::BIGINT AS bytes, 100::BIGINT AS ms, 1::BIGINT AS errors, 7::BIGINT AS hits, 20.0::DOUBLE AS median_ms")
def tagger_stats(spark, sf_dir):
    return tagger.call_stats(spark.createDataFrame([(64, 3000, 50, False, 3), (30, 1500, 30, False, 4), (6, 500, 10, False, 0), (0, 0, 10, True, 0)], "texts long, bytes long, ms long, failed boolean, hits long"))


@query("SELECT user_id, median(value)::DOUBLE AS median_value, count(*) AS events FROM events GROUP BY user_id")
def latency_medians(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.median("value").alias("median_value"), F.count(F.lit(1)).alias("events"))


# ---- content -------------------------------------------------------------------

CONTENTS = [(1, '"plain"', "plain"), (2, '[{"type":"text","text":"one"},{"type":"image"},"two",{"content":"three"}]', "one\ntwo\nthree"), (3, "null", ""), (4, None, ""), (5, '{"a":1}', '{"a":1}'), (6, '"a\\"b"', 'a"b'), (7, "[]", "")]


@query(f"SELECT id, want AS text FROM {values(CONTENTS, 'id, body, want')}")
def content_text(spark, sf_dir):
    return spark.createDataFrame(CONTENTS, "id int, body string, want string").select("id", content.text_of(F.col("body")).alias("text"))


HEADERS = ["host", "accept", "x-own-pin", "x-session-id", "authorization", "anthropic-version", "content-type", "te"]


@query("SELECT 'plain' AS mode, 'accept anthropic-version authorization content-type x-session-id' AS headers UNION ALL SELECT 'translating', 'accept x-session-id' UNION ALL SELECT 'masked', 'accept anthropic-version authorization content-type' UNION ALL SELECT 'bearer', 'accept anthropic-version content-type x-session-id'")
def headers_forwarded(spark, sf_dir):
    modes = {"plain": {}, "translating": {"translating": True}, "masked": {"masked": True, "conversation": ("x-session-id",)}, "bearer": {"bearer": True}}
    rows = spark.createDataFrame([({h: "v" for h in HEADERS},)], "h map<string,string>")
    each = [F.struct(F.lit(m).alias("mode"), F.array_join(F.array_sort(F.map_keys(content.forwarded(F.col("h"), "x-own-", **o))), " ").alias("headers")) for m, o in modes.items()]
    return rows.select(F.explode(F.array(*each)).alias("x")).select("x.*")


@query("SELECT word, count(*) AS conversations FROM (SELECT DISTINCT conv_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS word FROM conversations) WHERE word <> '' GROUP BY word")
def request_words(spark, sf_dir):
    return conversation.conversation_words(table(spark, sf_dir, "conversations")).groupBy("word").agg(F.count(F.lit(1)).alias("conversations"))


SCRIPTS = [(1, "Hello कमला शर्मा. ok", True, False, "कमला शर्मा."), (2, "no", False, False, ""), (3, "x কমলা y रवि", True, True, "কমলা\nरवि"), (4, " . ", False, False, "")]


@query(f"SELECT id, indic, bengali, runs FROM {values(SCRIPTS, 'id, text, indic, bengali, runs')}")
def script_runs(spark, sf_dir):
    rows = spark.createDataFrame(SCRIPTS, "id int, text string, a boolean, b boolean, c string")
    return rows.select("id", content.has_indic(F.col("text")).alias("indic"), content.is_bengali(F.col("text")).alias("bengali"), content.indic_runs(F.col("text")).alias("runs"))


# ---- conversations -------------------------------------------------------------


@query("""WITH u AS (SELECT user_id, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) < 21600 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
l AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)::INT AS life FROM u)
SELECT user_id, life, min(ts) AS first_used, max(ts) AS last_used, count(*) AS turns FROM l GROUP BY user_id, life""")
def conversation_lives(spark, sf_dir):
    return conversation.lives(table(spark, sf_dir, "events"), "user_id")


@query("""WITH s AS (SELECT DISTINCT conv_id, 'Anna ' || upper(left(w, 1)) || substr(w, 2) AS surrogate, w FROM (SELECT conv_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS w FROM conversations WHERE turn = 0) WHERE length(w) >= 8),
k AS (SELECT DISTINCT conv_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS w FROM conversations WHERE turn > 0)
SELECT conv_id, surrogate FROM s WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.conv_id = s.conv_id AND k.w IN (s.w, 'anna'))""")
def surrogates_retired(spark, sf_dir):
    """Long words of first turns stand for surrogates; those that a later turn really says are retired."""
    turns = table(spark, sf_dir, "conversations")
    words = conversation.conversation_words(turns.where("turn = 0")).where(F.length("word") >= 8)
    made = words.select("conv_id", F.concat(F.lit("Anna "), scalars.capitalized(F.col("word"))).alias("surrogate"), "word")
    kept = conversation.retired(made, conversation.conversation_words(turns.where("turn > 0")), parts=F.array(F.lit("anna"), F.col("word")))
    return kept.select("conv_id", "surrogate")


POLICY = [("trusted_masked", "EMAIL"), ("trusted_masked", "CARD")]


@query()
def conversations_masked(spark, sf_dir):
    """Documents as turns of the conversation of their source, under a policy: en is public, de trusted and masked, fr local, es without a tier."""
    docs = table(spark, sf_dir, "documents").select(F.concat_ws("-", F.coalesce("source", F.lit("?")), F.coalesce("lang", F.lit("?"))).alias("conv_id"), F.col("doc_id").alias("turn"), "text", "lang")
    tiers = docs.select("conv_id", F.when(F.col("lang") == "en", "public").when(F.col("lang") == "de", "trusted_masked").when(F.col("lang") == "fr", "local").alias("tier")).where("tier IS NOT NULL").distinct()
    out = conversation.masked(docs.drop("lang"), tiers, spark.createDataFrame(POLICY, "tier string, kind string"), spark.createDataFrame([("PHONE",)], "kind string"))
    return out.select("conv_id", "turn", "tier", "masked", "entities", "occurrences", "blocked_reason")


REPLIES = [(1, "Ask MIRA or mira, at <EMAIL_A>.", "Ask LENA or lena, at l@x.org."), (2, "Mirabela went", "Mirabela went"), (3, "Kestrelin wrote <X_A>", "Ohm wrote <X_A>"), (4, None, None), (5, "kestrel kestr", "ohm kestr")]
REPLY_MAP = {"Mira": "Lena", "Kestrelyn": "Ohm", "<EMAIL_A>": "l@x.org"}


@query(f"SELECT id, want AS restored FROM {values(REPLIES, 'id, text, want')}")
def names_restored(spark, sf_dir):
    rows = spark.createDataFrame([(n, t, REPLY_MAP) for n, t, _ in REPLIES], "id int, text string, m map<string,string>")
    return rows.select("id", names.restored_names(F.col("text"), F.col("m")).alias("restored"))


# ---- routing from outside ------------------------------------------------------

HOMES = [("home", "http://home", "local-one")]


def _chains(spark):
    return spark.createDataFrame(CHAINS, "name string, pos int, entry string")


def _homes(spark):
    return spark.createDataFrame(HOMES, "name string, base string, model string")


@query(f"""SELECT name AS id, 'group' AS owner, 2 AS endpoints, string_agg(entry, '|' ORDER BY pos) AS chain FROM {values(CHAINS, 'name, pos, entry')} GROUP BY name
UNION ALL SELECT 'home', 'target', 2, NULL UNION ALL SELECT n_name, r_name, CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 1 END, NULL FROM nation JOIN region ON n_regionkey = r_regionkey""")
def models_list(spark, sf_dir):
    models = _models(spark, sf_dir).withColumn("endpoints", F.when(F.col("pos") % 2 == 0, F.array(F.lit(catalog.ENDPOINTS[0]))).otherwise(F.array(F.lit(catalog.ENDPOINTS[1]))))
    return catalog.models_list(_chains(spark), _homes(spark), models).select("id", "owner", F.size("endpoints").alias("endpoints"), F.array_join("chain", "|").alias("chain"))


GROUPS = [("fast", "x/one|ASIA/*", "failover", "conversation", 30, True), ("loop", "loop|y/two", "sticky", "conversation", 30, False), ("smart", "EUROPE/*|fast|x/one", "sticky", "day", 60, True)]
SET = [("fast", "failover", None, None), ("smart", None, "day", 60)]


def _groups(spark, sf_dir):
    return catalog.groups_list(_chains(spark), _models(spark, sf_dir), spark.createDataFrame(SET, "name string, mode string, sticky_scope string, cooldown_seconds int"))


@query(f"SELECT * FROM {values(GROUPS, 'name, models, mode, sticky_scope, cooldown_seconds, policy_set')}")
def groups_list(spark, sf_dir):
    return _groups(spark, sf_dir).select("name", F.array_join("models", "|").alias("models"), "mode", "sticky_scope", "cooldown_seconds", "policy_set")


ASKED = [
    (1, "smart", "s1", None, "x/one", "x/one", None), (2, "fast", "s1", None, "x/one", None, None), (3, "smart", None, "home", "home", "x/one", None), (4, "smart", "s1", "nobody", None, "x/one", "nobody is not a model of group smart or a known model"),
    (5, "loop", "s9", None, "y/two", "y/two", None), (6, "loop", None, None, "loop", None, None),
]
PINNED = [("smart", "*", "x/one", "day", "", 1000, 1000, 60), ("fast", "s1", "ASIA/CHINA", "conversation", "", 1000, 1000, 60), ("loop", "s9", "y/two", "conversation", "", 1000, 1000, 60), ("loop", "s8", "y/two", "conversation", "", 1, 1, 1)]
PIN_COLUMNS = "`group` string, session string, model string, scope string, sig string, set_at long, last_used long, ttl_minutes long"


@query(f"SELECT id, first, pinned, error FROM {values(ASKED, 'id, name, session, explicit, first, pinned, error')}")
def request_plan(spark, sf_dir):
    requests = spark.createDataFrame([a[:4] for a in ASKED], "id int, `group` string, session string, explicit string")
    known = _homes(spark).select(F.col("name").alias("spec"))
    found = catalog.plan(requests, _groups(spark, sf_dir), spark.createDataFrame(PINNED, PIN_COLUMNS), known, F.lit(2000))
    return found.select("id", F.try_element_at("targets", F.lit(1)).alias("first"), "pinned", "error")


@query(f"SELECT * FROM {values([('fast', 's1', 'ASIA/CHINA'), ('loop', 's9', 'y/two'), ('smart', '*', 'x/one')], 'holder, session, model')}")
def pins_shown(spark, sf_dir):
    return catalog.pins_shown(spark.createDataFrame(PINNED, PIN_COLUMNS), F.lit(2000)).select(F.col("group").alias("holder"), "session", "model")


@query("""SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_type IN ('error', 'click'), event_type) AS n, event_type IN ('error', 'click') AS cooling FROM (SELECT DISTINCT user_id, event_type FROM events)""")
def healthy_first(spark, sf_dir):
    """Each user's kinds of event as the targets of a request, by name; two kinds are cooling down and go behind."""
    kinds = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("target")).distinct()
    plans = kinds.select("id", F.col("target").alias("n"), "target")
    found = catalog.healthy_first(plans, spark.createDataFrame([("error",), ("click",)], "target string"))
    return found.select(F.col("id").alias("user_id"), F.col("target").alias("event_type"), "n", "cooling")


@query("SELECT count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, count(DISTINCT user_id) FILTER (event_type <> 'error') AS served_by, 3::BIGINT AS entities, 1::BIGINT AS blocked FROM events")
def gateway_status(spark, sf_dir):
    attempts = _attempts(spark, sf_dir)
    masked = spark.createDataFrame([(2, False), (1, False), (0, True)], "entities long, blocked boolean")
    cooling = routing.cooling(attempts, F.lit("2030-01-01").cast("timestamp"))
    found = catalog.status(attempts, masked, cooling)
    return found.select("requests", "errors", F.size(F.map_filter("served", lambda _, n: n > 0)).cast("long").alias("served_by"), "entities", "blocked")


@query("SELECT 3::BIGINT AS entries, 2::BIGINT AS named, 1::BIGINT AS tool")
def vault_counts(spark, sf_dir):
    return catalog.vault_counts(spark.createDataFrame([("a", "x", True), ("b", "y", False), (None, "z", None)], "name string, value string, tool boolean"))


CHUNKS = [("a", 0, 0, "data: 1\n\n"), ("a", 1, 25, "data: 2"), ("a", 2, 45, "\n\n"), ("b", 0, 0, "data: x\n\n"), ("b", 1, 70, "data: y\n\n"), ("c", 0, 0, "data: half"), ("c", 1, 61, "\n\n")]
SEEN = [("a", 0, 0, 9), ("a", 0, 1, 26), ("a", 1, 0, 7), ("a", 2, 0, 2), ("b", 0, 0, 9), ("b", 0, 1, 65), ("b", 0, 2, None), ("c", 0, 0, 10), ("c", 0, 2, None)]


@query(f"SELECT stream_id, seq, part, length FROM {values(SEEN, 'stream_id, seq, part, length')}")
def stream_decorated(spark, sf_dir):
    """Keep-alives every ten seconds of silence between events, and an error once a minute is over."""
    chunks = spark.createDataFrame(CHUNKS, "stream_id string, seq int, at int, chunk string")
    return sse.decorated(chunks, 10, 60).select("stream_id", "seq", "part", F.when(F.col("part") < 2, F.length("text")).alias("length"))
