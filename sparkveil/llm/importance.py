"""Target-distribution importance resampling over bucket-partitioned inverted postings.

A text's features are its runs of 1 to `ngrams` consecutive words, and a feature's bucket is its CRC32 modulo `buckets`.
1. Every row becomes postings (bucket, row, count), written once to the shared folder, those of neighbouring
   buckets of a row together.
2. Postings of both corpora are summed by bucket, and the totals of a group of buckets make one row.
3. Postings are shuffled by (group of buckets, part), where a part is a hash of the row and there are more parts
   with more rows. Each partition is a sorted stream in which a group's totals of both corpora come first; from
   them a task computes the gains of the group's buckets and turns the postings behind them into contributions.
4. Contributions are summed by row: count of features, count of words, sum of gains.
A bucket that every row hits is thus as many postings as any other group of its size, in as many parts.

gain = floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))), where t and s are a bucket's features in target and
raw corpus, T and S all of them. A row's weight is the floored mean of the gains of its features (none: 0). Its score adds Gumbel
noise drawn from sha256("<seed>:<id>"), so that taking the highest scores of rows with at least `least` words resamples
without replacement. Ranks come from a count of each score (whole numbers between fixed limits, so there is a bounded
number of them), and from ranks by id inside a score.

Null and empty texts have no features, weight 0 and are never drawn. A null id takes part as any other, drawn
as empty text and last among ties. Rows that repeat an id are separate rows; those equal in all results share them
but for ranks, which follow each other. With an empty target or raw corpus all counts of it are 0. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, on_workers, remove, saved_at

BUCKETS, NGRAMS, SEED, LEAST_WORDS, PERCENT = 10_000, 1, 2024, 20, 10
#: Groups of neighbouring buckets, the least number of parts of a group, and the rows of a part.
GROUPS, PARTS, PART_ROWS = 32, 4, 500_000
#: Different features of which a task remembers the bucket, and features of texts that it holds before it emits their postings.
REMEMBERED, HELD = 1_000_000, 1_000_000
#: Letters of ASCII in lower case, digits, and all bytes of longer UTF-8 sequences are of words; the rest are borders.
_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() and not chr(b).isupper() else b + 32 if chr(b).isupper() else 0x20 for b in range(256))
POSTINGS = "_part int, _group int, _row long, _id string, _words long, _buckets array<int>, _counts array<long>"


class Buckets(dict):
    """The bucket of each feature that a task has met, forgotten all at once when there are too many."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.buckets
        return found


def words(text: str) -> list[bytes]:
    return text.encode().translate(_BYTES).split()


def features(found: list[bytes], ngrams: int) -> list[bytes]:
    if ngrams == 1:
        return found
    out = list(found)
    for n in range(2, ngrams + 1):
        out += [b" ".join(found[k : k + n]) for k in range(len(found) - n + 1)]
    return out


def _runs(rows: np.ndarray, ids: pa.Array, n_words: np.ndarray, keys: list[np.ndarray], buckets: int, groups: int, parts: int) -> pa.RecordBatch:
    """Rows of POSTINGS of some texts; every text has at least one, and its first alone has its number of words."""
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    doc, bucket = key // buckets, key % buckets
    # each change of text or group begins a new list
    starts = np.flatnonzero(np.diff(doc * groups + bucket * groups // buckets, prepend=-1))
    at, group = doc[starts], bucket[starts] * groups // buckets
    bare = np.setdiff1d(np.arange(len(rows)), at)  # texts without a feature
    offsets = np.concatenate([starts, np.full(len(bare) + 1, len(bucket))]).astype(np.int32)
    first = np.concatenate([np.diff(at, prepend=-1) > 0, np.ones(len(bare), bool)])
    at, group = np.concatenate([at, bare]), np.concatenate([group, np.zeros(len(bare), np.int64)])
    part = (rows[at] ^ (rows[at] >> 33)) % parts
    lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x, kind)) for x, kind in ((bucket, pa.int32()), (count, pa.int64()))]
    columns = [pa.array(part, pa.int32()), pa.array(group, pa.int32()), pa.array(rows[at]), ids.take(pa.array(at)), pa.array(np.where(first, n_words[at], 0)), *lists]
    return pa.RecordBatch.from_arrays(columns, ["_part", "_group", "_row", "_id", "_words", "_buckets", "_counts"])


def _postings(buckets: int, ngrams: int, groups: int, parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    of = Buckets(buckets)
    for batch in batches:
        ids, rows, texts = batch.column("_id"), batch.column("_row").to_numpy(), batch.column("_text")
        n_words, keys, begin, held = [], [], 0, 0
        for k in range(batch.num_rows):
            found = words(texts[k].as_py() or "")
            hit = features(found, ngrams)
            n_words.append(len(found))
            keys.append(np.fromiter((of[f] for f in hit), np.int64, len(hit)) + (k - begin) * buckets)
            held += len(hit)
            if held >= HELD or k + 1 == batch.num_rows:
                yield _runs(rows[begin : k + 1], ids.slice(begin, k + 1 - begin), np.array(n_words, np.int64), keys, buckets, groups, parts)
                n_words, keys, begin, held = [], [], k + 1, 0


def postings(docs: DataFrame, doc_id: str, text: str, buckets: int = BUCKETS, ngrams: int = NGRAMS, groups: int = GROUPS, parts: int = 1) -> DataFrame:
    """Inverted postings: of each row and each group of buckets that it hits, the buckets and their counts."""
    on_workers(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(doc_id).cast("string").alias("_id"), F.col(text).alias("_text"))
    return rows.mapInArrow(lambda batches: _postings(buckets, ngrams, groups, parts, batches), POSTINGS)


def _sums(buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(buckets, np.int64)
    for batch in batches:
        np.add.at(total, batch.column("_buckets").flatten().to_numpy(), batch.column("_counts").flatten().to_numpy())
    hit = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(total[hit])], ["bucket", "n"])


def totals(found: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: all features of a corpus by bucket, summed in each task first."""
    return found.select("_buckets", "_counts").mapInArrow(lambda batches: _sums(buckets, batches), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(s: np.ndarray, t: np.ndarray, all_s: int, all_t: int, buckets: int) -> np.ndarray:
    """The gain of each bucket; logarithms one by one, as libraries for arrays may round them otherwise."""
    return np.array([math.floor(1000 * math.log((int(b) + 1) * (all_s + buckets) / ((int(a) + 1) * (all_t + buckets)))) for a, b in zip(s, t, strict=True)], np.int64)


def _contributions(buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A stream sorted by (_part, _group, totals first): totals have both corpora's counts of a group's buckets in _counts, the sums of all in _row and _words."""
    lo, gain = 0, np.zeros(0, np.int64)
    for batch in batches:
        is_totals = np.flatnonzero(batch.column("_totals").to_numpy(zero_copy_only=False))
        for a, b in zip([0, *is_totals], [*is_totals, batch.num_rows], strict=True):
            piece = batch.slice(a, b - a)
            if a in is_totals and piece.num_rows:
                lo = piece.column("_buckets")[0].as_py()[0]
                both = np.array(piece.column("_counts")[0].as_py(), np.int64).reshape(2, -1)
                gain = gains(both[0], both[1], piece.column("_row")[0].as_py(), piece.column("_words")[0].as_py(), buckets)
                piece = piece.slice(1)
            if not piece.num_rows:
                continue
            bucket, count = (piece.column(c).flatten().to_numpy() for c in ("_buckets", "_counts"))
            sizes = piece.column("_buckets").value_lengths().to_numpy()
            of = np.repeat(np.arange(len(sizes)), sizes)
            gained, n = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            np.add.at(gained, of, gain[bucket - lo] * count)
            np.add.at(n, of, count)
            yield pa.RecordBatch.from_arrays([piece.column("_row"), piece.column("_id"), piece.column("_words"), pa.array(n), pa.array(gained)], ["_row", "_id", "_words", "_n", "_gained"])


def weighted(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = BUCKETS, ngrams: int = NGRAMS, groups: int = GROUPS) -> tuple[DataFrame, list[str]]:
    """One row for each row of docs: _id (as string), n_words, n_features, weight; and the folders that it reads, for removal after use."""
    spark = docs.sparkSession
    groups = min(groups, buckets)
    parts = max(PARTS, -(-docs.count() // PART_ROWS))
    at, totals_at = new_path(spark, "importance-postings"), new_path(spark, "importance-totals")
    raw = saved_at(postings(docs, doc_id, text, buckets, ngrams, groups, parts), at)
    wanted = postings(target.withColumn("_none", F.lit(None).cast("string")), "_none", target_text, buckets, ngrams, groups)
    s, t = totals(raw, buckets), totals(wanted, buckets).withColumnRenamed("n", "t")
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(s, "bucket", "left").join(t, "bucket", "left").fillna(0)
    # the corpora's totals of each group of buckets, one row a group
    by_group = both.groupBy(F.floor(F.col("bucket").cast("long") * groups / buckets).cast("int").alias("_group")).agg(F.array_sort(F.collect_list(F.struct("bucket", "n", "t"))).alias("b"), F.sum("n").alias("s"), F.sum("t").alias("t"))
    by_group = saved_at(by_group, totals_at)
    sums = by_group.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t")).first()
    both_counts = F.concat(F.transform("b", lambda x: x["n"]), F.transform("b", lambda x: x["t"]))
    heads = by_group.select(
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"), "_group", F.lit(sums["all_s"]).cast("long").alias("_row"), F.lit(None).cast("string").alias("_id"),
        F.lit(sums["all_t"]).cast("long").alias("_words"), F.transform("b", lambda x: x["bucket"]).alias("_buckets"), both_counts.alias("_counts"), F.lit(True).alias("_totals"),
    )
    stream = heads.unionByName(raw.withColumn("_totals", F.lit(False))).repartition("_part", "_group").sortWithinPartitions("_part", "_group", F.desc("_totals"))
    given = stream.mapInArrow(lambda batches: _contributions(buckets, batches), "_row long, _id string, _words long, _n long, _gained long")
    summed = given.groupBy("_row", "_id").agg(F.sum("_words").alias("n_words"), F.sum("_n").alias("n_features"), F.sum("_gained").alias("_gained"))
    mean = F.when(F.col("n_features") > 0, F.expr("_gained div n_features - cast(_gained % n_features < 0 as long)")).otherwise(F.lit(0))
    return summed.select("_id", "n_words", "n_features", mean.cast("long").alias("weight")), [at, totals_at]


def noise(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln(u))) with u from the id's hash."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id, F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resampled(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED, **options) -> DataFrame:
    """One row for each row of docs: doc_id, n_features, weight, score, rank (1, 2, ... of the drawn, null for the rest)."""
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType
    found, used = weighted(docs, target, doc_id, text, target_text, **options)
    rows = found.withColumn("score", (F.col("weight") + noise(F.col("_id"), seed)).cast("long"))
    # rows equal in everything are one row with a count
    scored = rows.groupBy(F.col("_id").cast(kind).alias("doc_id"), "n_features", "weight", "score", (F.col("n_words") >= least).alias("_able")).agg(F.count(F.lit(1)).alias("_copies"))
    scored = saved_at(scored, new_path(spark, "importance-scores"))
    for path in used:
        remove(spark, path)
    counts = scored.where("_able").groupBy("score").agg(F.sum("_copies").alias("_n"), F.min("doc_id").alias("_least"), F.max("doc_id").alias("_most"))
    # a row for each score, which has fixed limits, in one small window
    before = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    known = counts.select(F.col("score").alias("_score"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    known = known.withColumn("_draw", F.floor(F.col("_all") * percent / 100)).where(F.col("_before") < F.col("_draw"))
    able = scored.where("_able").join(known, F.col("score") == F.col("_score"), "left").drop("_score")
    drawn, rest = able.where(F.col("_before").isNotNull()), able.where(F.col("_before").isNull())
    nth = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_features", "weight").rowsBetween(Window.unboundedPreceding, -1)
    nth_row = F.col("_before") + F.coalesce(F.sum("_copies").over(nth), F.lit(0))
    drawn = drawn.withColumn("_first", nth_row)
    columns = ["doc_id", "n_features", "weight", "score"]
    ranked = drawn.select(*columns, "_draw", F.explode(F.sequence(F.col("_first") + 1, F.col("_first") + F.col("_copies"))).alias("rank"))
    ranked = ranked.select(*columns, F.when(F.col("rank") <= F.col("_draw"), F.col("rank")).cast("long").alias("rank"))
    unranked = rest.select(*columns, "_copies").unionByName(scored.where("not _able").select(*columns, "_copies"))
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))
    return ranked.unionByName(unranked.select(*columns, copies.alias("_copy")).select(*columns, F.lit(None).cast("long").alias("rank")))


def sql(table: str = "documents", target: str = "benchmark", buckets: int = BUCKETS, percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED) -> str:
    """The same for single words; CRC32 is built over the bytes of each different word."""
    return rf"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, i::BIGINT)) AS tab),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {table}),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {target}),
f AS (SELECT r, word, count(*) AS c FROM (SELECT r, unnest(w) AS word FROM d) GROUP BY ALL),
g AS (SELECT word, count(*) AS c FROM (SELECT unnest(w) AS word FROM b) GROUP BY ALL),
v AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM f UNION SELECT word FROM g)),
k AS (SELECT word, xor(list_reduce(list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % {buckets} AS bucket FROM v, crc),
s AS (SELECT bucket, sum(c) AS s FROM f JOIN k USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(c) AS t FROM g JOIN k USING (word) GROUP BY bucket),
n AS (SELECT (SELECT coalesce(sum(c), 0) FROM f)::DOUBLE AS all_s, (SELECT coalesce(sum(c), 0) FROM g)::DOUBLE AS all_t),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + {buckets}) / ((s + 1)::DOUBLE * (all_t + {buckets}))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), n),
m AS (SELECT r, sum(c)::BIGINT AS n_features, floor(sum(gain * c)::DOUBLE / sum(c))::BIGINT AS mean FROM f JOIN k USING (word) JOIN gain USING (bucket) GROUP BY r),
w AS (SELECT d.r, doc_id, coalesce(n_features, 0) AS n_features, coalesce(mean, 0) AS weight, ('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN m USING (r)),
z AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score, n_features >= {least} AS able FROM w),
o AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS nth, floor({percent} * (SELECT count(*) FROM z WHERE able) / 100) AS draw FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND nth <= draw THEN nth END AS rank FROM o"""
