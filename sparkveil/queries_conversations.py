"""Named queries, continued: names in other scripts, and conversations over calls."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import rules, spans
from .operators import conversation, mask, scripts, surrogate
from .plans import asof
from .queries import _conversation_values, _rule, _values_sql, query, table
from .sources.scratch import shared_dir
from .streaming import numbering

# ---- names in other scripts ------------------------------------------------------

#: Customers of a conversation; 48 stand-ins serve 60 of them, so some stand for two and are ambiguous.
NEIGHBOURS, STAND_INS = 60, surrogate.GIVEN_FIRST[:48]


@query(f"""WITH c AS (SELECT *, c_custkey // {NEIGHBOURS} AS conv, c_custkey * 7 % {len(STAND_INS)} AS stand_in FROM customer),
u AS (SELECT *, count(*) OVER (PARTITION BY conv, stand_in) AS uses FROM c)
SELECT o_orderkey, CASE WHEN uses = 1 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'आदेश ' || o_orderkey || ': ' || c_name || ' को भेजा, धन्यवाद।'
  ELSE 'অর্ডার ' || o_orderkey || ': ' || c_name || ['', 'কে', 'ের'][o_orderkey // 2 % 3 + 1] || ' পাঠানো হয়েছে।' END END AS restored
FROM orders JOIN u ON o_custkey = c_custkey""")
def names_cross_script(spark, sf_dir):
    """A notice for each order writes its customer's stand-in in Devanagari or Bengali, in any of its spellings; those that stand for one customer only are restored."""
    pool = spark.createDataFrame(list(enumerate(STAND_INS)), "n int, surrogate string")
    customers = table(spark, sf_dir, "customer").withColumn("conv_id", F.expr(f"c_custkey div {NEIGHBOURS}")).withColumn("n", (F.col("c_custkey") * 7 % len(STAND_INS)).cast("int")).join(pool, "n")
    names = customers.select("conv_id", "surrogate", F.lit("PERSON").alias("kind"), F.col("c_name").alias("raw"))
    forms = scripts.written(pool.withColumn("kind", F.lit("PERSON"))).where(F.col("how") == scripts.FORM)
    by_script = forms.groupBy("surrogate", F.col("key").rlike("[\\u0980-\\u09FF]").cast("long").alias("bengali")).agg(F.array_sort(F.collect_set("key")).alias("forms"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 2).alias("bengali"))
    met = orders.join(customers.select("c_custkey", "conv_id", "surrogate"), F.col("o_custkey") == F.col("c_custkey")).join(by_script, ["surrogate", "bengali"])
    form = F.element_at("forms", (F.col("o_orderkey") % F.size("forms") + 1).cast("int"))
    ending = F.element_at(F.array(F.lit(""), F.lit("কে"), F.lit("ের")), (F.expr("o_orderkey div 2") % 3 + 1).cast("int"))
    hindi = F.concat(F.lit("आदेश "), "o_orderkey", F.lit(": "), form, F.lit(" को भेजा, धन्यवाद।"))
    bengali = F.concat(F.lit("অর্ডার "), "o_orderkey", F.lit(": "), form, ending, F.lit(" পাঠানো হয়েছে।"))
    texts = met.select("o_orderkey", "conv_id", F.when(F.col("bengali") == 1, bengali).otherwise(hindi).alias("text"))
    done = scripts.restored(texts, names)
    return done.select("o_orderkey", F.when(F.col("restored") != F.col("text"), F.col("restored")).alias("restored"))


# ---- one order, one mask, one numbering ------------------------------------------

_NAME = "[A-Z][a-z]+ [A-Z][a-z]+"
_NAMES_SQL = rf"""SELECT conv_id, turn, doc_id, 1 AS source, 0 AS rank, 'PERSON' AS kind, sum_before AS start, v AS value FROM (
  SELECT conv_id, turn, doc_id, unnest(parts) AS v, unnest(range(1, len(parts) + 1)) AS i, unnest(list_transform(parts, lambda p, i: coalesce(list_sum(list_transform(parts[1:i - 1], lambda q: length(q))), 0))) AS sum_before FROM (
  SELECT doc_id % 50 AS conv_id, doc_id % 7 AS turn, doc_id, string_split(regexp_replace(text, '({_NAME})', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS parts FROM documents)) WHERE i % 2 = 0"""
_LETTERS = "CASE WHEN n >= 702 THEN chr((65 + (n - 702) // 676)::INT) ELSE '' END || CASE WHEN n >= 26 THEN chr((65 + (n - 26) // 26 % 26)::INT) ELSE '' END || chr((65 + n % 26)::INT)"


@query(f"""{_values_sql()}, every AS (SELECT conv_id, turn, doc_id, 0 AS source, CASE kind WHEN 'CARD' THEN {rules.RULES.index(_rule('CARD'))} ELSE {rules.RULES.index(_rule('EMAIL'))} END AS rank, kind, start, value FROM found UNION ALL {_NAMES_SQL}),
placed AS (SELECT *, (turn, -len(list_filter(regexp_split_to_array(value, '\\s+'), lambda w: w <> '')), source, doc_id, rank, start) AS place,
  CASE kind WHEN 'CARD' THEN regexp_replace(value, '[^0-9]', '', 'g') WHEN 'EMAIL' THEN lower(value) ELSE lower(regexp_replace(value, '[^A-Za-z0-9]+', ' ', 'g')) END AS norm FROM every),
entity AS (SELECT conv_id, kind, norm, min(place) AS place, arg_min(value, place) AS raw FROM placed GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id, kind ORDER BY place) - 1 AS n FROM entity)
SELECT conv_id, kind, raw, '<' || kind || '_' || {_LETTERS} || '>' AS tag FROM numbered""")
def mask_candidate_order(spark, sf_dir):
    """Cards and emails of documents, found by rules, and pairs of capitalised words, as a tagger would give them, numbered in one order."""
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("conv_id"), (F.col("doc_id") % 7).alias("turn"), "doc_id", spans.unmarked(F.col("text")).alias("_t"))
    names = docs.select("conv_id", "turn", "doc_id", F.explode(spans.matches(F.col("_t"), "PERSON", _NAME)).alias("s")).select("conv_id", "turn", "doc_id", "s.kind", "s.start", "s.value")
    rank = F.when(F.col("kind") == "CARD", rules.RULES.index(_rule("CARD"))).otherwise(rules.RULES.index(_rule("EMAIL")))
    found = _conversation_values(spark, sf_dir).withColumn("rank", rank).withColumn("source", F.lit(mask.DETECTED))
    every = found.unionByName(names.withColumn("rank", F.lit(0)).withColumn("source", F.lit(mask.TAGGED)))
    return mask.assign_candidates(every, visit=("doc_id",), most=None).select("conv_id", "kind", "raw", "tag")


def _notices(spark, sf_dir):
    """A notice for each order, as a turn of its customer's conversation: o_custkey, o_orderkey, name, mail, text."""
    people = table(spark, sf_dir, "customer").select("c_custkey", F.translate("c_name", "#0123456789", "zabcdefghij").alias("name"))
    mail = F.concat(F.lit("c"), "o_custkey", F.lit("."), F.col("o_orderkey") % 3, F.lit("@mail.example.org"))
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", mail.alias("mail")).join(people, F.col("o_custkey") == F.col("c_custkey"))
    return rows.withColumn("text", F.concat(F.lit("From "), "mail", F.lit(" for "), "name", F.lit(" at blue falcon ("), F.upper("name"), F.lit("): key hunter-two.")))


_MAILS = """o AS (SELECT o_orderkey, o_custkey, 'c' || o_custkey || '.' || (o_orderkey % 3) || '@mail.example.org' AS mail FROM orders JOIN customer ON o_custkey = c_custkey),
f AS (SELECT o_custkey, mail, min(o_orderkey) AS first FROM o GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY first) - 1 AS n FROM f)"""
VAULT = [("falcon", "ORG", "Blue Falcon", True), (None, "KEY", "hunter-two")]


@query(f"""WITH {_MAILS}
SELECT o_orderkey, 'From <EMAIL_' || chr((65 + n)::INT) || '> for <PERSON_A> at <SECRET:falcon> (<PERSON_A>): key <KEY_A>.' AS masked, 4 AS occurrences FROM o JOIN n USING (o_custkey, mail)""")
def mask_one_call(spark, sf_dir):
    """Emails by rule, names by a tagger, and two vault values, masked in one call; the name in capitals is found because it is known."""
    rows = _notices(spark, sf_dir)
    start = F.length("mail") + 10
    tagged = rows.select(F.col("o_custkey").alias("conv_id"), F.col("o_orderkey").alias("turn"), start.cast("int").alias("start"), (start + F.length("name")).cast("int").alias("end"), F.lit("PERSON").alias("kind"), F.col("name").alias("value"))
    turns = rows.select(F.col("o_custkey").alias("conv_id"), F.col("o_orderkey").alias("turn"), "text")
    tiers = turns.select("conv_id", F.lit("public").alias("tier")).distinct()
    none = spark.createDataFrame([], "tier string, kind string")
    out = conversation.masked(turns, tiers, none, none.select("kind"), vault=VAULT, tagged=tagged)
    return out.select(F.col("turn").alias("o_orderkey"), "masked", "occurrences")


@query(f"""WITH {_MAILS}, t AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS turn FROM o)
SELECT o_custkey AS conv_id, turn, mail AS value, '<EMAIL_' || chr((65 + n)::INT) || '>' AS tag FROM t JOIN n USING (o_custkey, mail)""")
def mask_tags_stream(spark, sf_dir):
    """The numbering of mask_one_call as a stream: every customer's turns are dealt to four micro-batches that are not in their order."""
    rows = _notices(spark, sf_dir).withColumn("turn", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1)
    span = F.struct(F.lit(5).alias("start"), (F.length("mail") + 5).alias("end"), F.lit("EMAIL").alias("kind"), F.col("mail").alias("value"))
    at = F.timestamp_seconds(F.lit(1_714_521_600) + F.col("turn") * 60)
    turns = rows.select(F.col("o_custkey").alias("conv_id"), "turn", at.alias("ts"), F.array(span).alias("spans"), F.hash("o_orderkey").alias("dealt"))
    # every file has turns of all customers, so four equal shares of the files are dealt turns
    share = spark.sparkContext.defaultParallelism
    root = f"{shared_dir(spark)}/tags-stream-{uuid.uuid4().hex}"
    turns.repartition(4 * share, "dealt").drop("dealt").write.parquet(f"{root}/in")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, numbering.ROCKS)
    try:
        stream = spark.readStream.schema(turns.drop("dealt").schema).option("maxFilesPerTrigger", share).parquet(f"{root}/in").withWatermark("ts", "30 days")
        out = numbering.numbered(stream)
        query_ = out.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").option("path", f"{root}/out").trigger(availableNow=True).start()
        query_.awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(out.schema).parquet(f"{root}/out").select("conv_id", "turn", "value", "tag")


# ---- pins in force ----------------------------------------------------------------


@query("""WITH e AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS who FROM events), p AS (SELECT * FROM e WHERE event_id % 10 = 0),
j AS (SELECT e.event_id, e.ts, p.event_id AS pin, p.ts AS since FROM (SELECT * FROM e WHERE event_id % 10 <> 0) e ASOF LEFT JOIN p ON e.who = p.who AND e.ts >= p.ts)
SELECT event_id, CASE WHEN epoch_us(ts) - epoch_us(since) <= 21600 * 1000000::BIGINT THEN pin END AS pin FROM j""")
def pin_in_force(spark, sf_dir):
    """Every tenth event sets a pin for six hours; the others have the one in force. A third of all events belong to one user."""
    events = table(spark, sf_dir, "events").withColumn("who", F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("user_id")).cast("long"))
    pins = events.where(F.col("event_id") % 10 == 0)
    rest = events.where(F.col("event_id") % 10 != 0).select("event_id", "who", "ts")
    return asof.in_force(rest, pins, "who", "ts", F.col("event_id"), "pin", valid=21_600).select("event_id", "pin")
