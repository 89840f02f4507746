"""Named queries, continued: taggers, names, routing, shapes and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import scalars, spans
from .operators import mask, names, ner, rehydrate, surrogate
from .plans import routing, shape
from .queries import query, table, values
from .sources.scratch import saved
from .streaming import dialects, sse

# ---- taggers and names ---------------------------------------------------------


def _chunk_sizes(docs):
    return ner.chunks(docs, "doc_id", "text").groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.max(F.octet_length("chunk")).cast("long").alias("longest"))


@query("SELECT doc_id, count(*) AS chunks, max(strlen(p)) AS longest FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10) || chr(10))) AS p FROM documents) GROUP BY doc_id HAVING max(strlen(p)) <= 4096")
def ner_chunks(spark, sf_dir):
    """The documents that the chunker need not cut, as in the SQL; ner_chunks_whole has them all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    short = F.forall(F.split(F.coalesce("text", F.lit("")), "\n\n"), lambda p: F.octet_length(p) <= ner.CHUNK)
    return _chunk_sizes(docs.join(docs.where(short).select("doc_id"), "doc_id", "left_semi"))


@query()
def ner_chunks_whole(spark, sf_dir):
    """Every document, also those with paragraphs that are cut; tests hold it against brute force."""
    return _chunk_sizes(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("SELECT count(*) AS different, sum(uses)::BIGINT AS uses FROM (SELECT text, count(*) AS uses FROM conversations WHERE regexp_matches(text, '[A-Za-zÀ-ÿ]') GROUP BY text)")
def ner_chunk_dedup(spark, sf_dir):
    """Turns have no blank lines, so a turn is a chunk."""
    turns = table(spark, sf_dir, "conversations")
    return ner.to_tag(turns.select("conv_id", F.col("text").alias("chunk")), "conv_id").agg(F.count(F.lit(1)).alias("different"), F.sum("uses").alias("uses"))


TAGGED = [
    (1, "Please call Mr Rao today", 7, "call Mr Rao", "PERSON", 0.9, "Rao"), (2, "Acme Widgets shipped it", 0, "Acme Widgets", "ORG", 0.71, "Acme Widgets"), (3, "Acme shipped it", 0, "Acme", "ORG", 0.8, None), (4, "Hope is here", 0, "Hope", "PERSON", 0.95, None),
    (5, "we met Hope there", 7, "Hope", "PERSON", 0.95, "Hope"), (6, "in Paris now", 3, "Paris", "LOCATION", 0.6, "Paris"), (7, "in Nice now", 3, "Nice", "LOCATION", 0.9, "Nice"), (8, "in field now", 3, "field", "LOCATION", 0.9, None), (9, "ask Python people", 4, "Python people", "ORG", 0.99, None),
    (10, "from Lena Ohm's desk", 5, "Lena Ohm's", "PERSON", 0.7, "Lena Ohm"), (11, "low Lena Ohm", 4, "Lena Ohm", "PERSON", 0.4, None), (12, "R2D2 came", 0, "R2D2", "PERSON", 0.9, None),
]
COMMON = [("hope", False), ("nice", True), ("field", False), ("rose", True)]


@query(f"SELECT id, raw FROM (SELECT id, raw FROM {values([(t[0], t[6]) for t in TAGGED], 'id, raw')}) WHERE raw IS NOT NULL")
def ner_accept(spark, sf_dir):
    found = spark.createDataFrame([t[:6] for t in TAGGED], "id int, text string, start int, value string, kind string, score double")
    return ner.accepted(found, spark.createDataFrame(COMMON, "word string, proper boolean")).select("id", "raw")


SCORED = [(1, 0, 5, "PERSON", 0.9), (1, 4, 8, "ORG", 0.8), (1, 8, 12, "ORG", 0.7), (1, 9, 10, "PERSON", 0.95), (2, 0, 4, "PERSON", 0.5), (2, 0, 4, "ORG", 0.5), (2, 4, 6, "ORG", 0.4)]


@query(f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, start, stop, kind) AS r FROM {values(SCORED, 'id, start, stop, kind, score')}),
k AS (SELECT id, 1 AS r, [struct_pack(start := start, stop := stop, kind := kind)] AS kept FROM s WHERE r = 1
 UNION ALL SELECT k.id, s.r, CASE WHEN len(list_filter(kept, lambda x: x.start < s.stop AND s.start < x.stop)) > 0 THEN kept ELSE list_append(kept, struct_pack(start := s.start, stop := s.stop, kind := s.kind)) END FROM k JOIN s ON s.id = k.id AND s.r = k.r + 1)
SELECT id, unnest(kept).start AS start, unnest(kept).stop AS stop, unnest(kept).kind AS kind FROM k WHERE r = (SELECT max(r) FROM s WHERE s.id = k.id)""")
def ner_greedy(spark, sf_dir):
    rows = spark.createDataFrame(SCORED, "id int, start int, stop int, kind string, score double")
    lists = rows.groupBy("id").agg(F.collect_list(F.struct("start", F.col("stop").alias("end"), "kind", "score")).alias("s"))
    return lists.select("id", F.explode(spans.greedy(F.col("s"))).alias("k")).select("id", "k.start", F.col("k.end").alias("stop"), "k.kind")


TAGS = [(1, 0, "B-PER", 0.9), (1, 1, "I-PER", 0.5), (1, 2, "O", 0.9), (1, 3, "I-ORG", 0.8), (1, 4, "B-ORG", 0.8), (1, 5, "I-PER", 0.3), (2, 0, "O", 1.0), (2, 1, "B-LOC", 0.6)]


@query(f"""WITH t AS (SELECT *, CASE WHEN tag <> 'O' THEN substr(tag, 3) END AS kind FROM {values(TAGS, 'text_id, n, tag, score')}),
b AS (SELECT *, lag(kind) OVER (PARTITION BY text_id ORDER BY n) AS prev FROM t),
r AS (SELECT *, sum(CASE WHEN kind IS NOT NULL AND (tag LIKE 'B-%' OR prev IS NULL OR prev <> kind) THEN 1 ELSE 0 END) OVER (PARTITION BY text_id ORDER BY n) AS run FROM b)
SELECT text_id, min(n) AS first, max(n) AS last, min(kind) AS kind, avg(score)::DOUBLE AS score FROM r WHERE kind IS NOT NULL GROUP BY text_id, run HAVING avg(score) >= 0.5""")
def ner_bio_decode(spark, sf_dir):
    return ner.bio_decoded(spark.createDataFrame(TAGS, "text_id int, n int, tag string, score double"))


@query()
def ner_windows(spark, sf_dir):
    rows = [(n, a, b) for n, sizes in enumerate(([1] * 400, [5] * 50, [200, 1, 1])) for a, b in ner.windows(sizes, 120)]
    return spark.createDataFrame(rows, "text_id int, first int, stop int")


@query("""WITH w AS (SELECT DISTINCT lower(word) AS word FROM (SELECT unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS word FROM conversations) WHERE length(word) >= 5),
p AS (SELECT DISTINCT word AS part FROM w WHERE length(word) >= 8), k AS (SELECT part AS word FROM p UNION SELECT 'raw' || part FROM p),
d AS (SELECT word, part, levenshtein(word, part) AS distance FROM w JOIN p ON left(word, 1) = left(part, 1) WHERE word NOT IN (SELECT word FROM k)),
n AS (SELECT * FROM d WHERE distance BETWEEN 1 AND 2), b AS (SELECT word, min(distance) AS distance FROM n GROUP BY word)
SELECT word, 'raw' || min(part) AS raw, distance FROM n JOIN b USING (word, distance) GROUP BY word, distance HAVING count(DISTINCT part) = 1""")
def fuzzy_name_match(spark, sf_dir):
    """Long words of the conversations stand for names; the other words are matched to them."""
    text = table(spark, sf_dir, "conversations")
    words = text.select(F.explode(F.split(F.col("text"), "[^A-Za-z]+")).alias("w")).select(F.lower("w").alias("word")).where(F.length("word") >= 5).distinct()
    names = words.where(F.length("word") >= 8).select(F.col("word").alias("surrogate"), F.concat(F.lit("raw"), "word").alias("raw"))
    return rehydrate.fuzzy_matches(words, names)


INDIC = [("कमला", "KML"), ("কমলা", "KML"), ("अनिल", None), ("शर्मा", "SRM"), ("राजेश", "RJS"), ("ववबक", None), ("abc", None), ("आनंदी", None), ("आनंदीका", "ANDK"), ("गोविन्द", "GBND")]


@query(f"SELECT word, want AS skeleton FROM {values(INDIC, 'word, want')}")
def skeleton_match(spark, sf_dir):
    return spark.createDataFrame(INDIC, "word string, want string").select("word", rehydrate.skeleton(F.col("word")).alias("skeleton"))


BENGALI = [("कमला", "কমলা"), ("रवि", "রবি"), ("अनिता", "অনিতা")]


@query(f"SELECT word, want AS bengali FROM {values(BENGALI, 'word, want')}")
def bengali_map(spark, sf_dir):
    return spark.createDataFrame(BENGALI, "word string, want string").select("word", rehydrate.bengali_of(F.col("word")).alias("bengali"))


@query()
def surrogate_pick(spark, sf_dir):
    rows = [(kind, n, surrogate.whole(kind, surrogate.fnv("seed"), n)) for kind in ("ORG", "LOCATION", "ADDRESS") for n in range(4)]
    return spark.createDataFrame(rows, "kind string, n int, surrogate string")


@query()
def surrogate_person(spark, sf_dir):
    """Customers as values of conversations of their nation: one for each kind, as a conversation's entities are limited."""
    kinds = F.explode(F.array(*(F.struct(F.lit(1000 * n).alias("n"), F.lit(kind).alias("kind")) for n, kind in enumerate(("ADDRESS", "PERSON", "ORG", "LOCATION")))))
    people = table(spark, sf_dir, "customer").select("*", kinds.alias("k")).select((F.col("c_nationkey") + F.col("k.n")).alias("conv_id"), F.col("c_custkey").alias("at"), F.col("k.kind").alias("kind"), F.col("c_name").alias("raw"))
    return surrogate.assign(people.withColumn("words", F.split("raw", " ")))


# ---- routing -------------------------------------------------------------------

TIER_RULES = [("src1*", "trusted_raw"), ("src*", "trusted_masked"), ("*1", "local"), ("src12", "public"), ("*9", "public")]


@query(f"""WITH r AS (SELECT *, '^' || replace(pattern, '*', '.*') || '$' AS re, length(replace(pattern, '*', '')) AS spec, list_position(['local', 'trusted_raw', 'trusted_masked', 'public'], tier) AS rank FROM {values(TIER_RULES, 'pattern, tier')})
SELECT source, any_value(t) AS tier, n AS documents FROM (SELECT source, count(*) AS n FROM documents GROUP BY source) d, LATERAL (SELECT coalesce(arg_max(tier, (spec, rank)), 'public') AS t FROM r WHERE regexp_matches(d.source, re)) GROUP BY source, n""")
def tier_resolution(spark, sf_dir):
    sources = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("documents"))
    return routing.tier_of(sources, spark.createDataFrame(TIER_RULES, "pattern string, tier string"), spec="source").select("source", "tier", "documents")


CHAINS = [("smart", 0, "EUROPE/*"), ("smart", 1, "fast"), ("smart", 2, "x/one"), ("fast", 0, "x/one"), ("fast", 1, "ASIA/*"), ("loop", 0, "loop"), ("loop", 1, "y/two")]
REQUESTS = [(1, "smart"), (2, "gw/fast | z/three"), (3, "plain"), (4, "AMERICA/*"), (5, "loop"), (6, "a/b|a/b|c/d"), (7, "|"), (8, "NOWHERE/*")]


def _models(spark, sf_dir):
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nations.join(F.broadcast(regions), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("pos"), F.col("r_name").alias("provider"), F.col("n_name").alias("id"))


def _expand_sql(parts: str) -> str:
    place = "lpad(pos::VARCHAR, 6, '0')"
    return f"""WITH RECURSIVE m AS (SELECT n_nationkey AS pos, r_name AS provider, n_name AS id FROM nation JOIN region ON n_regionkey = r_regionkey),
c AS (SELECT * FROM {values(CHAINS, 'name, pos, entry')}), parts AS ({parts}),
e AS (SELECT id, {place} AS path, part AS target, 0 AS depth FROM parts UNION ALL
  SELECT e.id, e.path || '/' || lpad(c.pos::VARCHAR, 6, '0'), c.entry, depth + 1 FROM e JOIN c ON c.name = e.target WHERE depth < 4),
flat AS (SELECT id, path, target FROM e WHERE NOT (depth < 4 AND target IN (SELECT name FROM c))),
done AS (SELECT f.id, f.path || coalesce('/' || lpad(m.pos::VARCHAR, 6, '0'), '') AS path, coalesce(m.provider || '/' || m.id, target) AS target FROM flat f LEFT JOIN m ON f.target = m.provider || '/*' WHERE NOT ends_with(f.target, '/*') OR m.id IS NOT NULL)"""


@query(_expand_sql(f"SELECT id, 0 AS pos, model AS part FROM {values(REQUESTS, 'id, model')}") + " SELECT id, path, target FROM done")
def chain_expand(spark, sf_dir):
    parts = spark.createDataFrame(REQUESTS, "id int, part string").select("id", F.lit(0).alias("pos"), "part")
    return routing.expand(parts, spark.createDataFrame(CHAINS, "name string, pos int, entry string"), _models(spark, sf_dir))


_PARTS = f"""SELECT id, unnest(range(len(ps))) AS pos, regexp_replace(unnest(ps), '^gw/', '') AS part FROM (
  SELECT id, list_filter(list_transform(string_split(regexp_replace(model, '^gw/', ''), '|'), lambda p: trim(p)), lambda p: p <> '') AS ps FROM {values(REQUESTS, 'id, model')})
  WHERE len(ps) <> 1 OR ps[1] IN (SELECT name FROM c) OR ends_with(ps[1], '/*')"""


@query(_expand_sql(_PARTS) + ", one AS (SELECT id, target, min(path) AS path FROM done GROUP BY id, target) SELECT id, n::INT AS n, target FROM (SELECT id, target, row_number() OVER (PARTITION BY id ORDER BY path) AS n FROM one) WHERE n <= 40")
def chain_resolve(spark, sf_dir):
    requests = spark.createDataFrame(REQUESTS, "id int, model string")
    return routing.resolve(requests, spark.createDataFrame(CHAINS, "name string, pos int, entry string"), _models(spark, sf_dir), prefix="gw/")


@query(f"SELECT DISTINCT name AS id, 'group' AS owner FROM {values(CHAINS, 'name, pos, entry')} UNION ALL SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'home', 'target'")
def model_union(spark, sf_dir):
    groups = spark.createDataFrame(CHAINS, "name string, pos int, entry string").select(F.col("name").alias("id"), F.lit("group").alias("owner")).distinct()
    return groups.unionByName(_models(spark, sf_dir).select("id", F.col("provider").alias("owner"))).unionByName(spark.createDataFrame([("home", "target")], "id string, owner string"))


def _attempts(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select(F.col("user_id").alias("target"), F.date_trunc("second", "ts").alias("ts"), F.col("event_id").alias("id"), (F.col("event_type") == "error").alias("failed"))


_RUNS = """WITH a AS (SELECT user_id AS target, date_trunc('second', ts) AS ts, event_id AS id, event_type = 'error' AS failed FROM events),
r AS (SELECT *, sum((NOT failed)::INT) OVER (PARTITION BY target ORDER BY ts, id) AS run FROM a),
f AS (SELECT *, row_number() OVER (PARTITION BY target, run ORDER BY ts, id) AS fails0 FROM r WHERE failed),
c AS (SELECT target, ts, id, fails0::INT AS fails, least(30 * power(2, least(fails0 - 1, 5)), 600)::BIGINT AS seconds FROM f)"""


@query(_RUNS + " SELECT target, id, fails, seconds FROM c")
def cooldown_seconds(spark, sf_dir):
    return routing.failure_runs(_attempts(spark, sf_dir)).select("target", "id", "fails", "seconds")


@query(_RUNS + """, last AS (SELECT target, max((ts, id)) AS l FROM a GROUP BY target), now AS (SELECT max(ts) AS t FROM a)
SELECT c.target, fails, seconds - (epoch(t)::BIGINT - epoch(ts)::BIGINT) + 86400 AS seconds_left FROM c JOIN last ON last.target = c.target AND (c.ts, c.id) = last.l, now WHERE seconds - (epoch(t)::BIGINT - epoch(ts)::BIGINT) + 86400 > 0""")
def cooling_now(spark, sf_dir):
    """A day before the last event, in effect: its cooldowns are counted from a clock set back by 86,400 s."""
    attempts = _attempts(spark, sf_dir)
    now = attempts.agg(F.timestamp_seconds(F.unix_timestamp(F.max("ts")) - 86_400).alias("_now"))
    rows = attempts.crossJoin(F.broadcast(now))
    last = rows.groupBy("target").agg(F.max(F.struct("ts", "id")).alias("_last"))
    runs = routing.failure_runs(rows).join(last, "target").where(F.struct("ts", "id") == F.col("_last"))
    left = F.col("seconds") - (F.unix_timestamp("_now") - F.unix_timestamp("ts"))
    return runs.select("target", "fails", left.alias("seconds_left")).where("seconds_left > 0")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 12 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS fresh, event_id FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM e)
SELECT user_id, floor(epoch(min(ts)))::BIGINT AS set_at, floor(epoch(max(ts)))::BIGINT AS last_used, count(*) AS uses, floor(epoch(max(ts)))::BIGINT + 43200 AS expires_at FROM s GROUP BY user_id, n""")
def sticky_pin_sessions(spark, sf_dir):
    return routing.sessions(table(spark, sf_dir, "events"))


@query("""SELECT user_id, day_end, count(*) AS uses FROM (SELECT user_id, (floor((floor(epoch(ts)) + 19800) / 86400)::BIGINT + 1) * 86400 - 19800 AS day_end FROM events) GROUP BY ALL""")
def pin_day_scope(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", scalars.next_midnight(F.unix_timestamp("ts")).alias("day_end"))
    return events.groupBy("user_id", "day_end").agg(F.count(F.lit(1)).alias("uses"))


PINS = [("g1", "s1", "a", "until_changed", "same"), ("g1", "s2", "a", "until_changed", "other"), ("g2", "s1", "z", "until_changed", "same"), ("g3", "s1", "a", "conversation", ""), ("g4", "s1", "a", "day", ""), ("g9", "s1", "a", "day", "")]
LISTS = [("g1", "until_changed", "a,b"), ("g2", "until_changed", "a,b"), ("g3", "conversation", "a,b"), ("g4", "conversation", "a,b")]
STATES = [("g1", "s1", "live"), ("g1", "s2", "changed"), ("g2", "s1", "left"), ("g3", "s1", "expired"), ("g4", "s1", "scope"), ("g9", "s1", "left")]


@query(f"SELECT grp AS \"group\", session, state FROM {values(STATES, 'grp, session, state')}")
def pin_until_changed(spark, sf_dir):
    pins = spark.createDataFrame(PINS, "group string, session string, model string, scope string, sig string")
    sig = F.when(F.col("sig") == "same", scalars.signature(F.array(F.lit("a"), F.lit("b")))).otherwise("0")
    pins = pins.withColumn("sig", sig).withColumns({"set_at": F.lit(1_000_000), "last_used": F.when(F.col("group") == "g3", 0).otherwise(1_000_000), "ttl_minutes": F.lit(10)})
    lists = spark.createDataFrame(LISTS, "group string, scope string, models string").withColumn("models", F.split("models", ","))
    return routing.live_pins(pins, lists, F.lit(1_000_100)).select("group", "session", "state")


OUTCOMES = [("failover", "a", None, "a", None, "none"), ("sticky", "a", None, "b", "presence", "held"), ("sticky", None, "a", "a", None, "explicit"), ("sticky", None, "a", "b", "status 500", "moved"), ("sticky", "a", None, "b", "status 500", "moved"), ("sticky", "a", None, "a", None, "kept"), ("sticky", None, None, "a", None, "new"), ("strict", None, None, "a", "presence", "new")]


@query(f"SELECT mode, pinned, explicit, served, why, want AS outcome FROM {values(OUTCOMES, 'mode, pinned, explicit, served, why, want')}")
def pin_outcome(spark, sf_dir):
    rows = spark.createDataFrame(OUTCOMES, "mode string, pinned string, explicit string, served string, why string, want string")
    return rows.select("mode", "pinned", "explicit", "served", "why", routing.pin_outcome(*(F.col(c) for c in ("mode", "pinned", "explicit", "served", "why"))).alias("outcome"))


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def recent_100(spark, sf_dir):
    return routing.keep_latest(table(spark, sf_dir, "events"), 100, "ts", "event_id").select("event_id", "user_id", "event_type")


@query("SELECT user_id, count(*) FILTER (event_type <> 'error') AS served, count(*) FILTER (event_type = 'error') AS errors, count(*) AS requests FROM events GROUP BY user_id")
def served_counts(spark, sf_dir):
    bad = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(~bad).alias("served"), F.count_if(bad).alias("errors"), F.count(F.lit(1)).alias("requests"))


@query("SELECT * FROM (SELECT event_id, user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS came_from, event_type AS went_to, ts FROM events) WHERE came_from = 'error' AND went_to <> 'error' ORDER BY ts DESC, event_id DESC LIMIT 200")
def failover_events(spark, sf_dir):
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", before.alias("came_from"), F.col("event_type").alias("went_to"), "ts").where("came_from = 'error' AND went_to <> 'error'")
    return routing.keep_latest(rows, routing.MOST_EVENTS, "ts", "event_id")


@query("SELECT user_id, last_used FROM (SELECT user_id, max(ts) AS last_used FROM events GROUP BY user_id) ORDER BY last_used DESC, user_id DESC LIMIT 50")
def lru_keep(spark, sf_dir):
    used = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last_used"))
    return routing.keep_latest(used, 50, "last_used", "user_id")


_WALK = """SELECT l_orderkey AS request, (l_linenumber - 1)::INT AS pos, l_suppkey::VARCHAR AS target, CASE WHEN l_returnflag = 'R' THEN 429 WHEN l_returnflag = 'A' THEN 400 ELSE 200 END AS status, CASE WHEN l_orderkey % 7 = 0 THEN 'strict' ELSE 'failover' END AS mode FROM lineitem"""


@query(f"""WITH a AS ({_WALK}), b AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY pos, target, status) - 1 AS n FROM a), r AS (SELECT request, n AS pos, target, status, mode FROM b WHERE mode <> 'strict' OR n = 0),
w AS (SELECT request, arg_min(target, pos) FILTER (status = 200) AS served_by, min(pos) FILTER (status = 200) AS won, count(*) AS k, arg_min(status, pos) AS first FROM r GROUP BY request)
SELECT request, served_by, coalesce(won + 1, k)::BIGINT AS attempts, coalesce(won, k)::BIGINT AS skipped, CASE first WHEN 200 THEN NULL WHEN 400 THEN 'rejected 400' ELSE 'status 429' END AS first_reason FROM w""")
def failover_walk(spark, sf_dir):
    """An order is a request, its lines the targets in turn, their return flags the answers."""
    lines = table(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_returnflag") == "R", 429).when(F.col("l_returnflag") == "A", 400).otherwise(200)
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", F.col("l_suppkey").cast("string"), status)) - 1
    mode = F.when(F.col("l_orderkey") % 7 == 0, "strict").otherwise("failover")
    attempts = lines.select(F.col("l_orderkey").alias("request"), nth.cast("long").alias("pos"), F.col("l_suppkey").cast("string").alias("target"), status.alias("status"), F.lit(None).cast("string").alias("error"), mode.alias("mode"))
    return routing.walk(attempts)


NODES = [("n1", 1000, True, "direct", "", False), ("n1", 9000, True, "direct", "", True), ("n2", 9000, False, "direct", "off", False), ("n3", 9000, True, "relay", "", False), ("n4", 9000, True, "direct", "", False)]
WANTED = [("n1", True, "n1 busy"), ("n1", False, None), ("n2", False, "n2 off"), ("n3", False, "n3 relay"), ("n4", True, None), ("n5", True, "n5 unknown")]


@query(f"SELECT node, skip_busy, reason FROM {values(WANTED, 'node, skip_busy, reason')}")
def presence_eligibility(spark, sf_dir):
    nodes = spark.createDataFrame(NODES, "node string, at long, enabled boolean, route string, reason string, busy boolean")
    return routing.eligibility(spark.createDataFrame([w[:2] for w in WANTED], "node string, skip_busy boolean"), nodes, F.lit(10_000))


SETTINGS = [("timeout", 90.0, None), ("timeout", 1.0, "timeout must be between 5 and 600"), ("idle", None, "idle must be between 10 and 600"), ("colour", 1.0, "unknown setting colour")]


@query(f"SELECT key, value, want AS error FROM {values(SETTINGS, 'key, value, want')}")
def config_validate(spark, sf_dir):
    rows = spark.createDataFrame(SETTINGS, "key string, value double, want string")
    return rows.select("key", "value", routing.setting_error(F.col("key"), F.col("value")).alias("error"))


POLICIES = [("mode", '"strict"', None), ("mode", '"loose"', "mode must be one of sticky, strict, failover"), ("mode", "3", "mode must be one of sticky, strict, failover"), ("retry_same_model", "2", None), ("retry_same_model", "2.5", "retry_same_model must be a whole number between 0 and 5"), ("ttfb_seconds", "null", None), ("ttfb_seconds", "2", "ttfb_seconds must be a number between 3 and 300, or null"), ("speed", "1", "unknown policy field speed"), ("cooldown_seconds", '"x"', "cooldown_seconds must be a whole number between 0 and 3600")]


@query(f"SELECT key, value, want AS error FROM {values(POLICIES, 'key, value, want')}")
def policy_validate(spark, sf_dir):
    rows = spark.createDataFrame(POLICIES, "key string, value string, want string")
    return rows.select("key", "value", routing.policy_error(F.col("key"), F.col("value")).alias("error"))


# ---- shapes, usage, streams -----------------------------------------------------


@query("""SELECT conv_id, greatest(floor(sum(strlen(role) + strlen(text)) / 3.5), 1)::BIGINT AS tokens FROM conversations GROUP BY conv_id""")
def token_estimate(spark, sf_dir):
    sizes = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.octet_length("role") + F.octet_length("text")).alias("_n"))
    return sizes.select("conv_id", F.greatest(F.floor(F.col("_n") / F.lit(3.5)), F.lit(1)).cast("long").alias("tokens"))


@query("""SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY (role = 'system') DESC, turn) - 1 AS n, role, md5(text) AS content_md5 FROM conversations
WHERE text <> '' AND (role <> 'system' OR turn = (SELECT min(turn) FROM conversations c WHERE c.conv_id = conversations.conv_id AND c.role = 'system'))""")
def to_openai_messages(spark, sf_dir):
    """Conversations as requests of one shape, then as messages of the other."""
    turns = table(spark, sf_dir, "conversations")
    block = F.struct(F.lit("text").alias("type"), F.col("text"))
    rest = F.transform(F.array_sort(F.collect_list(F.when(F.col("role") != "system", F.struct("turn", "role", block.alias("b"))))), lambda m: F.struct(m["role"].alias("role"), F.array(m["b"]).alias("content")))
    grouped = turns.groupBy("conv_id").agg(F.min_by(F.when(F.col("role") == "system", F.col("text")), F.when(F.col("role") == "system", F.col("turn"))).alias("system"), rest.alias("messages"))
    request = F.from_json(F.to_json(F.struct("system", "messages")), shape.REQUEST)
    messages = grouped.select("conv_id", F.posexplode(shape.openai_messages(request)).alias("n", "m"))
    return messages.select("conv_id", F.col("n").cast("long").alias("n"), "m.role", F.md5("m.content").alias("content_md5"))


REPLIES = [
    (1, '{"choices":[{"message":{"content":"hi"},"finish_reason":"stop"}],"usage":{"prompt_tokens":3,"completion_tokens":2}}', "text:hi", "end_turn", 3, 2),
    (2, '{"choices":[{"message":{"content":null,"tool_calls":[{"id":"c1","function":{"name":"f","arguments":"{\\"a\\":1}"}}]},"finish_reason":"tool_calls"}]}', 'tool_use:{"a":1}', "tool_use", 0, 0),
    (3, '{"choices":[{"message":{"tool_calls":[{"id":"c1","function":{"name":"f","arguments":"{bad"}}]}}]}', "tool_use:{}", "tool_use", 0, 0),
    (4, '{"choices":[{"message":{"content":""},"finish_reason":"length"}]}', "text:", "max_tokens", 0, 0),
]


@query(f"SELECT id, want AS blocks, stop AS stop_reason, i::BIGINT AS input_tokens, o::BIGINT AS output_tokens FROM {values([(r[0], *r[2:]) for r in REPLIES], 'id, want, stop, i, o')}")
def from_openai_blocks(spark, sf_dir):
    rows = spark.createDataFrame([r[:2] for r in REPLIES], "id int, reply string").withColumn("r", shape.anthropic_blocks(F.from_json("reply", shape.REPLY)))
    shown = F.array_join(F.transform("r.blocks", lambda b: F.concat(b["type"], F.lit(":"), F.coalesce(b["text"], b["input"]))), "|")
    return rows.select("id", shown.alias("blocks"), "r.stop_reason", "r.input_tokens", "r.output_tokens")


USAGE = [(1, 1, '{"usage":{"prompt_tokens":5,"completion_tokens":0}}'), (1, 2, '{"usage":{"completion_tokens":7}}'), (1, 3, "[DONE]"), (2, 1, '{"message":{"usage":{"input_tokens":11,"output_tokens":1}}}'), (2, 2, '{"usage":{"output_tokens":9}}'), (3, 1, "{}")]


@query("SELECT * FROM (VALUES (1, 5::BIGINT, 7::BIGINT), (2, 11, 9), (3, NULL, NULL)) t(stream_id, input_tokens, output_tokens)")
def usage_last(spark, sf_dir):
    lines = spark.createDataFrame(USAGE, "stream_id int, seq int, line string")
    last = lambda *names: F.max_by(shape.usage_of(F.col("line"), *names), F.when(shape.usage_of(F.col("line"), *names).isNotNull(), F.col("seq")))
    return lines.groupBy("stream_id").agg(last("prompt_tokens", "input_tokens").alias("input_tokens"), last("completion_tokens", "output_tokens").alias("output_tokens"))


def _chunks(spark, sf_dir, size=7):
    """Each turn's text as an event, the stream of a conversation cut every `size` characters."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    whole = turns.select(F.col("conv_id").alias("stream_id"), F.array_join(F.transform("t", lambda x: F.concat(F.lit("data: "), F.regexp_replace(x["text"], r"\s+", " "), F.lit("\n\n"))), "").alias("s"))
    n = F.ceil(F.length("s") / size).cast("int")
    return whole.select("stream_id", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr("s", i * size + 1, F.lit(size)))).alias("seq", "chunk"))


@query("SELECT conv_id AS stream_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS n, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS data_md5 FROM conversations")
def sse_reassemble(spark, sf_dir):
    return sse.reassembled(_chunks(spark, sf_dir)).select("stream_id", "n", F.md5("data").alias("data_md5"))


@query()
def sse_stream_equals_batch(spark, sf_dir):
    """Placeholders put into streams, restored from chunks of 3 and of 11 characters."""
    mapping = {"<PERSON_A>": "Ann Lee", "<CARD_B>": "4111"}
    text = F.array_join(F.array(F.lit("Dear <PERSON_A>, <CARD_B> <"), F.lit("x> and <PERSON_A>")), "")
    whole = spark.range(20).select(F.col("id").alias("stream_id"), F.concat(F.repeat(F.lit("x"), F.col("id").cast("int")), text).alias("s"))
    cut = lambda size: whole.select("stream_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.ceil(F.length("s") / size).cast("int") - 1), lambda i: F.substr("s", i * size + 1, F.lit(size)))).alias("seq", "chunk"))
    a, b = sse.restored_streams(cut(3), mapping), sse.restored_streams(cut(11), mapping).withColumnRenamed("text", "other")
    return a.join(b, "stream_id").select("stream_id", "text", (F.col("text") == F.col("other")).alias("same"))


DELTAS = [(1, 1, 'data: {"choices":[{"delta":{"content":"He"}}]}\n\nda'), (1, 2, 'ta: {"choices":[{"delta":{"content":"y"}}]}\n\n'), (1, 3, 'data: {"choices":[{"delta":{"tool_calls":[{"index":0,"function":{"arguments":"{}"}}]}}]}\n\ndata: [DONE]\n\n')]
BLOCKS = [(1, 0, "content_block_start", 0, "text"), (1, 1, "content_block_delta", 0, "He"), (1, 2, "content_block_delta", 0, "y"), (1, 3, "content_block_stop", 0, ""), (1, 4, "content_block_start", 1, "tool_use"), (1, 5, "content_block_delta", 1, "{}"), (1, 6, "content_block_stop", 1, ""), (1, 7, "message_stop", -1, "tool_use")]


@query(f"SELECT stream_id, n::BIGINT AS n, kind AS type, block::BIGINT AS block, body FROM {values(BLOCKS, 'stream_id, n, kind, block, body')}")
def sse_to_blocks(spark, sf_dir):
    return sse.to_blocks(spark.createDataFrame(DELTAS, "stream_id int, seq int, chunk string"))


@query("SELECT user_id, event_id, silence FROM (SELECT user_id, event_id, floor(epoch(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)))::BIGINT - floor(epoch(ts))::BIGINT AS silence FROM events) WHERE silence > 86400")
def stream_gaps(spark, sf_dir):
    return sse.gaps(table(spark, sf_dir, "events"), "user_id", "ts", 86_400, "event_id").select("user_id", "event_id", "silence")


@query("""WITH w AS (SELECT DISTINCT lang, lower(unnest(regexp_split_to_array(text, '[^A-Za-zÀ-ÿ]+'))) AS word FROM documents), x AS (SELECT lang, word FROM w WHERE word <> '')
SELECT word FROM x WHERE lang = 'en' INTERSECT SELECT word FROM x WHERE lang = 'fr' EXCEPT SELECT word FROM x WHERE lang = 'de'""")
def word_list_ops(spark, sf_dir):
    """One aggregation over all words: in which languages each occurs."""
    words = table(spark, sf_dir, "documents").select("lang", F.explode(F.array_distinct(F.transform(F.split("text", "[^A-Za-zÀ-ÿ]+"), F.lower))).alias("word")).where("word <> ''")
    within = words.groupBy("word").agg(*(F.max(F.coalesce(F.col("lang") == lang, F.lit(False))).alias(lang) for lang in ("en", "fr", "de")))
    return within.where("en AND fr AND NOT de").select("word")


@query("""WITH r AS (SELECT p_partkey % 20 AS conv_id, p_partkey AS turn, p_brand, p_type FROM part),
f AS (SELECT conv_id, p_brand, min(turn) AS first_turn FROM r GROUP BY 1, 2), e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY first_turn) - 1 AS n FROM f),
t AS (SELECT *, '<ORG_' || chr((65 + n)::INT) || '>' AS tag FROM e)
SELECT turn, r.p_type || ' by ' || tag || ' and ' || tag || ' and x' || lower(p_brand) || ', ' || tag || '.' AS masked FROM r JOIN t USING (conv_id, p_brand)""")
def mask_known_values(spark, sf_dir):
    """A brand is detected once in each row; its other occurrences, in any case, are masked as well, but not within longer words."""
    parts = table(spark, sf_dir, "part").select((F.col("p_partkey") % 20).alias("conv_id"), F.col("p_partkey").alias("turn"), "p_type", "p_brand")
    start = (F.length("p_type") + 4).cast("int")
    span = F.struct(start.alias("start"), (start + F.length("p_brand")).cast("int").alias("end"), F.lit("ORG").alias("kind"), F.col("p_brand").alias("value"))
    text = F.concat("p_type", F.lit(" by "), "p_brand", F.lit(" and "), F.lower("p_brand"), F.lit(" and x"), F.lower("p_brand"), F.lit(", "), F.upper("p_brand"), F.lit("."))
    rows = parts.select("conv_id", "turn", text.alias("text"), F.array(span).alias("spans"))
    tags = mask.assign_tags(rows.select("conv_id", "turn", F.explode("spans").alias("s")).select("conv_id", "turn", "s.*"))
    return mask.mask_rows(rows, tags).select("turn", "masked")


@query("SELECT c_custkey, true AS hidden, true AS restored FROM customer")
def mask_surrogates(spark, sf_dir):
    """Names of customers replaced by stand-ins in upper case, and restored: nothing of the name is left, and the round trip gives the text back. A nation may have any number of customers."""
    people = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("conv_id"), F.col("c_custkey").alias("turn"), F.translate("c_name", "#0123456789", "zabcdefghij").alias("name"))
    span = F.struct(F.lit(5).alias("start"), (F.length("name") + 5).cast("int").alias("end"), F.lit("PERSON").alias("kind"), F.col("name").alias("value"))
    rows = people.select("conv_id", "turn", "name", F.concat(F.lit("Dear "), "name", F.lit(", "), F.upper("name"), F.lit("!")).alias("text"), F.array(span).alias("spans"))
    tags = mask.assign_tags(rows.select("conv_id", "turn", F.explode("spans").alias("s")).select("conv_id", "turn", "s.*"), most=None)
    entities = tags.select("conv_id", F.xxhash64("norm").alias("at"), "kind", "raw", F.array(F.lit("dear")).alias("words"))
    styled = saved(mask.with_surrogates(tags, surrogate.assign(entities, most=None, coins=True), ["PERSON"]), "customer-surrogates")
    masked = mask.mask_rows(rows, styled)
    back = masked.join(styled.select("conv_id", F.col("raw").alias("name"), "tag"), ["conv_id", "name"])
    again = F.regexp_replace(F.replace("masked", F.upper("tag"), F.upper("name")), F.col("tag"), F.col("name"))
    return back.select(F.col("turn").alias("c_custkey"), (~F.lower("masked").contains(F.lower("name"))).alias("hidden"), (again == F.col("text")).alias("restored"))


@query("""SELECT o_orderkey, '{"model":"Clerk","messages":[{"role":"user","content":"<ORG_A> for <CODE_A>, not x' || o_orderpriority || '"}],"f":{"arguments":"{\\"p\\":\\"<ORG_A>\\"}"}}' AS body FROM orders""")
def mask_body(spark, sf_dir):
    """A body's own values masked in its strings and in the JSON inside its arguments; models and longer words stay."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.concat(F.lit("k"), F.col("o_orderkey").cast("string")).alias("code"))
    body = F.concat(F.lit('{"model":"Clerk","messages":[{"role":"user","content":"'), "o_orderpriority", F.lit(" for "), "code", F.lit(", not x"), "o_orderpriority", F.lit('"}],"f":{"arguments":"{\\"p\\":\\"'), "o_orderpriority", F.lit('\\"}"}}'))
    known = F.create_map(F.col("o_orderpriority"), F.lit("<ORG_A>"), F.col("code"), F.lit("<CODE_A>"), F.lit("Clerk"), F.lit("<ORG_B>"))
    return orders.select("o_orderkey", names.masked_body(body, known).alias("body"))


_EVENTS = """[('chat', 'data: {"choices":[{"index":0,"delta":{"content":"Dear ' || {0} || '"}}]}' || chr(10) || chr(10) || 'data: [DONE]' || chr(10) || chr(10)),
  ('blocks', 'event: content_block_delta' || chr(10) || 'data: {"type":"content_block_delta","index":1,"delta":{"type":"text_delta","text":"Dear ' || {0} || '"}}' || chr(10) || chr(10) || 'event: content_block_stop' || chr(10) || 'data: {"type":"content_block_stop","index":1}' || chr(10) || chr(10)),
  ('items', 'data: {"type":"response.output_text.delta","item_id":"i","delta":"Dear ' || {0} || '"}' || chr(10) || chr(10) || 'data: {"type":"response.completed"}' || chr(10) || chr(10))]"""


def _streams(spark, sf_dir):
    """One stream for each nation and dialect, cut into pieces of seven characters that come in no order."""
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("<NATION_"), F.col("n_nationkey").cast("string"), F.lit(">")).alias("tag"))
    text = {"chat": 'data: {"choices":[{"index":0,"delta":{"content":"Dear %"}}]}\n\ndata: [DONE]\n\n', "blocks": 'event: content_block_delta\ndata: {"type":"content_block_delta","index":1,"delta":{"type":"text_delta","text":"Dear %"}}\n\nevent: content_block_stop\ndata: {"type":"content_block_stop","index":1}\n\n', "items": 'data: {"type":"response.output_text.delta","item_id":"i","delta":"Dear %"}\n\ndata: {"type":"response.completed"}\n\n'}
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("dialect"), F.replace(F.lit(t), F.lit("%"), F.col("tag")).alias("text")) for k, t in text.items())))
    whole = nations.select("tag", kinds.alias("k")).select(F.concat("k.dialect", F.lit(" "), "tag").alias("stream_id"), F.col("k.text").alias("text"))
    pieces = F.posexplode(F.regexp_extract_all("text", F.lit(r"[\s\S]{1,7}"), F.lit(0))).alias("seq", "chunk")
    return whole.select("stream_id", pieces).select("stream_id", F.col("seq").cast("long").alias("seq"), "chunk").orderBy(F.xxhash64("chunk"))


@query("SELECT e[1] || ' <NATION_' || n_nationkey || '>' AS stream_id, e[2] AS text FROM (SELECT n_nationkey, n_name, unnest(" + _EVENTS.replace("{0}", "n_name") + ") AS e FROM nation)")
def sse_dialects(spark, sf_dir):
    """Placeholders that cuts have split are restored inside the events of all three dialects."""
    mapping = {r["tag"]: r["n_name"] for r in table(spark, sf_dir, "nation").select(F.concat(F.lit("<NATION_"), F.col("n_nationkey").cast("string"), F.lit(">")).alias("tag"), "n_name").collect()}
    return dialects.rehydrated(_streams(spark, sf_dir), mapping)


_POLICY_WALK = """SELECT l_orderkey AS request, (l_linenumber - 1)::INT AS pos, l_linenumber::VARCHAR AS target, CASE l_returnflag WHEN 'R' THEN 503 WHEN 'A' THEN NULL ELSE 200 END AS status, CASE l_returnflag WHEN 'A' THEN 'timeout' END AS error,
  CASE WHEN l_orderkey % 7 = 0 THEN 'strict' ELSE 'failover' END AS mode, l_orderkey % 3 = 0 AS stops, l_quantity AS size, CASE WHEN l_linenumber = 2 THEN 30.0 END AS most, CASE WHEN l_linestatus = 'F' AND l_linenumber = 3 THEN 'n1 busy' END AS presence, l_linenumber = 1 AND l_orderkey % 5 = 0 AS cooling FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_suppkey, l_partkey, l_quantity) AS copy FROM lineitem) WHERE copy = 1"""


@query(f"""WITH a AS ({_POLICY_WALK}), b AS (SELECT *, CASE WHEN size > most THEN 'input-too-large' WHEN presence IS NOT NULL THEN 'presence' END AS skip, CASE WHEN mode <> 'strict' AND cooling THEN 100 ELSE 0 END + pos AS place,
  CASE WHEN pos = 0 AND status = 503 THEN 2 ELSE 1 END AS tries FROM a WHERE mode <> 'strict' OR pos = 0),
c AS (SELECT *, skip IS NULL AND coalesce(status = 200, false) AS won, skip IS NULL AND coalesce(error = 'timeout', false) AND stops AS halt, coalesce(skip, CASE WHEN error = 'timeout' THEN 'timeout' WHEN status = 503 THEN 'status 503' END) AS why FROM b),
e AS (SELECT request, min(place) FILTER (won OR halt) AS last, arg_min(won, place) FILTER (won OR halt) AS served, arg_min(target, place) FILTER (won OR halt) AS target, any_value(mode) AS mode, arg_min(target, pos) FILTER (pos = 0) AS first_target, arg_min(CASE WHEN cooling AND mode <> 'strict' THEN 'cooldown' ELSE why END, pos) FILTER (pos = 0) AS first_why FROM c GROUP BY request),
n AS (SELECT c.request, sum(CASE WHEN skip IS NULL THEN tries ELSE 1 END)::BIGINT AS attempts FROM c JOIN e USING (request) WHERE last IS NULL OR place <= last GROUP BY c.request)
SELECT request, CASE WHEN served THEN target END AS served_by, attempts, coalesce(served AND target <> first_target, false) AS failover,
  CASE WHEN NOT coalesce(served, false) OR coalesce(target <> first_target, false) THEN first_why END AS reason,
  CASE WHEN served THEN NULL WHEN mode = 'strict' THEN 'gateway_strict' WHEN last IS NOT NULL THEN 'gateway_timeout' ELSE 'gateway_exhausted' END AS error FROM e JOIN n USING (request)""")
def failover_policies(spark, sf_dir):
    """Orders as requests under policies, with one repeated try, timeouts that stop, size limits, presence and cooldowns. A line that repeats a number counts once."""
    by = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_suppkey", "l_partkey", "l_quantity")
    lines = table(spark, sf_dir, "lineitem").withColumn("copy", F.row_number().over(by)).where("copy = 1")
    flag, number = F.col("l_returnflag"), F.col("l_linenumber")
    rows = lines.select(
        F.col("l_orderkey").alias("request"), (number - 1).alias("pos"), number.cast("string").alias("target"), F.explode(F.array(F.lit(0), F.lit(1))).alias("nth"), F.when(flag == "R", 503).when(flag != "A", 200).alias("status"), F.when(flag == "A", "timeout").alias("error"),
        F.when(F.col("l_orderkey") % 7 == 0, "strict").otherwise("failover").alias("mode"), F.lit(1).alias("retries"), (F.col("l_orderkey") % 3 == 0).alias("stop_on_timeout"), F.col("l_quantity").alias("size"), F.when(number == 2, 30.0).alias("max_input"),
        F.when((F.col("l_linestatus") == "F") & (number == 3), "n1 busy").alias("presence"), ((number == 1) & (F.col("l_orderkey") % 5 == 0)).alias("cooling"),
    )
    return routing.policy_walk(rows)
