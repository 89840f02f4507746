"""Exact top-k search by inner product: the three-phase uniform threshold over lists of partial scores.

Components are floor(1024 x). The dimensions are dealt to `lists` lists, kept apart; a list knows of a query and a
vector only the partial score over its own dimensions, and a score is the sum over all lists.
1. Every slice of every list hands in its `depth` highest partial scores of each query. The vectors that the lists
   put first are scored exactly, and the k-th highest of these scores, a safe cutoff, goes out to all slices with the query.
2. A vector that reaches the cutoff has in some list at least its uniform share, cutoff / lists. Every slice hands in all
   entries that do. Of vectors that all lists handed in the score is now known, which may raise the cutoff; the others
   go if what is known plus just under the share for each missing list stays below the cutoff.
3. The scores of what is left are resolved exactly, and the k best rows of each query are its result.
Nothing that could be among the first k is lost in any phase, and there is no limit on entries.

Equal vectors are one class (of a group of copies only the k + 1 least ids can be in any result), searched for once, so a
vector with a third of all rows costs as any other. Slices and blocks of queries are matrices packed in rows and meet by an
equi-join on (list, part): each block once with each slice. Query blocks hold BLOCK_QUERIES queries, whatever their number.

Vectors that are null or hold a null or non-finite component take no part; shorter ones are as if filled up with
zeros, so an empty one scores 0 with all. Rows that repeat an id are rows of their own: each is a query and a candidate of the
other. A null id is no query; as a candidate it comes after all ids of the same score. A query has fewer rows than k if
there are fewer candidates. If vectors are so long that a score might not fit a long (length over 2 ** 21 in units of 1),
components beyond what is sure to fit are set to that limit. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_ROWS, hot_keys, new_path, on_workers, remove, saved_at, split_join

K, LISTS, DEPTH, SCALE, EVERY = 10, 2, 48, 1024, 100
#: Queries of a block, queries scored at once, and slices that share a part.
BLOCK_QUERIES, AT_ONCE, PART_SLICES = 1024, 128, 4
NO_CUTOFF = -(2**63) + 1
PACKED = "_list int, _slice long, _ids binary, _values binary"


def whole_numbers(vectors: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, int, float]:
    """_id and _body, the components of all vectors that take part, filled up to one length; that length; the largest squared length of a vector."""
    e = F.col("_e")
    rows = vectors.select(F.col(vec_id).alias("_id"), F.col(embedding).cast("array<double>").alias("_e"))
    rows = rows.where(e.isNotNull() & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).withColumn("_e", F.transform(e, lambda x: F.floor(x * SCALE)))
    size = rows.agg(F.max(F.size("_e")), F.max(F.aggregate("_e", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).first()
    dims, longest = max(1, size[0] or 0), size[1] or 0.0
    if longest >= 2.0**62:
        limit = math.isqrt(2**62 // dims)
        rows = rows.withColumn("_e", F.transform(e, lambda x: F.greatest(F.lit(-limit).cast("long"), F.least(F.lit(limit).cast("long"), x))))
        longest = float(limit) ** 2 * dims
    return rows.select("_id", F.concat(e, F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size(e))).alias("_body")), dims, longest


def classes(rows: DataFrame, k: int, every: int) -> DataFrame:
    """One row for each different _body: _members (its k + 1 least ids), _asks (whether one of its rows is a query), _n (its rows)."""
    # a class's rows are numbered by id up to k + 1 on the map side already
    nth = F.row_number().over(Window.partitionBy("_body").orderBy(F.asc_nulls_last("_id")))
    least = rows.withColumn("_nth", nth).where(F.col("_nth") <= k + 1).groupBy("_body").agg(F.array_sort(F.collect_list(F.struct("_nth", "_id"))).alias("_m"))
    sizes = rows.groupBy(F.col("_body").alias("_of")).agg(F.max(F.coalesce(F.col("_id") % every == 0, F.lit(False))).alias("_asks"), F.count(F.lit(1)).alias("_n"))
    return least.join(sizes, F.col("_body") == F.col("_of")).select("_body", F.transform("_m", lambda m: m["_id"]).alias("_members"), "_asks", "_n")


def _pack(dims: int, lists: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each list and batch: the classes and the list's part of their components."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("_class").to_numpy()
        values = batch.column("_body").flatten().to_numpy().reshape(len(ids), dims)
        cuts = [dims * j // lists for j in range(lists + 1)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(lists), pa.int32()), pa.array([int(ids[0])] * lists), pa.array([ids.tobytes()] * lists), pa.array([np.ascontiguousarray(values[:, a:b]).tobytes() for a, b in zip(cuts, cuts[1:], strict=False)])],
            ["_list", "_slice", "_ids", "_values"],
        )


def packed(rows: DataFrame, dims: int, lists: int) -> DataFrame:
    return rows.select("_class", "_body").mapInArrow(lambda batches: _pack(dims, lists, batches), PACKED)


def _matrix(values: bytes, rows: int, exact: bool) -> np.ndarray:
    """Whole numbers; as doubles where every sum stays below 2 ** 53, for which products of matrices are exact and fast."""
    found = np.frombuffer(values, np.int64).reshape(rows, -1)
    return found.astype(np.float64) if exact else found


def _scores(exact: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """list, queries, their cutoffs, classes, partial scores (a row for each query) of each slice and some queries of a block."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
            ids, asking = np.frombuffer(row["_ids"], np.int64), np.frombuffer(row["_queries"], np.int64)
            x, q = _matrix(row["_values"], len(ids), exact), _matrix(row["_asked"], len(asking), exact)
            cutoffs = np.frombuffer(row["_cutoffs"], np.int64) if row["_cutoffs"] is not None else None
            for at in range(0, len(asking), AT_ONCE):
                part = slice(at, at + AT_ONCE)
                yield row["_list"], asking[part], None if cutoffs is None else cutoffs[part], ids, (q[part] @ x.T).astype(np.int64)


def _entries(which: int, queries: np.ndarray, classes: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(queries), pa.array(classes), pa.array(np.full(len(queries), which, np.int32)), pa.array(scores)], ["_query", "_class", "_list", "_score"])


ENTRIES = "_query long, _class long, _list int, _score long"


def _highest(depth: int, exact: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for which, asking, _, ids, scores in _scores(exact, batches):
        n = min(depth, len(ids))
        at = np.argpartition(-scores, n - 1, axis=1)[:, :n]
        yield _entries(which, np.repeat(asking, n), ids[at].ravel(), np.take_along_axis(scores, at, 1).ravel())


def _sufficient(lists: int, exact: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for which, asking, cutoffs, ids, scores in _scores(exact, batches):
        # the least whole number that reaches cutoff / lists; without a cutoff, anything does
        share = np.where(cutoffs == NO_CUTOFF, NO_CUTOFF, -(-cutoffs // lists))
        q, c = np.nonzero(scores >= share[:, None])
        for at in range(0, len(q), 1 << 20):
            part = slice(at, at + (1 << 20))
            yield _entries(which, asking[q[part]], ids[c[part]], scores[q[part], c[part]])


def _dots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        a, b = (batch.column(c).flatten().to_numpy().reshape(n, -1) if n else np.zeros((0, 1), np.int64) for c in ("_a", "_b"))
        yield pa.RecordBatch.from_arrays([batch.column("_query"), batch.column("_class"), pa.array(np.einsum("ij,ij->i", a, b))], ["_query", "_class", "_total"])


def resolved(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """_query, _class, _total: the exact score of each pair of classes."""
    a, b = of.select(F.col("_class").alias("_query"), F.col("_body").alias("_a")), of.select("_class", F.col("_body").alias("_b"))
    return pairs.select("_query", "_class").join(a, "_query").join(b, "_class").mapInArrow(_dots, "_query long, _class long, _total long")


def _kth(scores: DataFrame, k: int) -> DataFrame:
    """_query and _cutoff, its k-th highest _total; queries with fewer have no row."""
    nth = F.row_number().over(Window.partitionBy("_query").orderBy(F.desc("_total")))
    return scores.withColumn("_nth", nth).where(F.col("_nth") <= k).groupBy("_query").agg(F.min("_total").alias("_cutoff"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == k).drop("_n")


def _blocks(asking: DataFrame, dims: int, lists: int) -> DataFrame:
    """Blocks of queries: _list, _block, _queries, _asked, _cutoffs (null before the first cutoff)."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_QUERIES):
                part = batch.slice(at, BLOCK_QUERIES)
                cutoffs = part.column("_cutoff")
                known = None if cutoffs.null_count else cutoffs.to_numpy().tobytes()
                for made in _pack(dims, lists, [part]):
                    yield pa.RecordBatch.from_arrays([*made.columns, pa.array([known] * lists, pa.binary())], ["_list", "_block", "_queries", "_asked", "_cutoffs"])

    return asking.select("_class", "_body", "_cutoff").mapInArrow(pack, "_list int, _block long, _queries binary, _asked binary, _cutoffs binary")


def best_classes(of: DataFrame, dims: int, longest: float, k: int, lists: int, depth: int) -> tuple[DataFrame, list[str]]:
    """_query, _class, _total of all pairs of classes whose score is among the k highest of the query, and maybe more; the folders that it reads."""
    spark = of.sparkSession
    lists = max(1, min(lists, dims))
    exact = longest < 2.0**53
    slices_at, firsts_at, asking_at, known_at = (new_path(spark, f"search-{x}") for x in ("slices", "firsts", "asking", "entries"))
    slices = saved_at(packed(of, dims, lists), slices_at)
    parts = max(1, -(-slices.select("_slice").distinct().count() // PART_SLICES))
    part = F.pmod(F.xxhash64("_slice"), F.lit(parts)).alias("_part")
    dealt = slices.select(part, "*")

    def met(blocks: DataFrame) -> DataFrame:
        copies = blocks.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
        return dealt.join(copies, ["_list", "_part"]).select("_list", "_ids", "_values", "_queries", "_asked", "_cutoffs")

    # phase 1: the lists' first entries and a safe cutoff
    unasked = of.where("_asks").withColumn("_cutoff", F.lit(None).cast("long"))
    handed = met(_blocks(unasked, dims, lists)).mapInArrow(lambda batches: _highest(depth, exact, batches), ENTRIES)
    nth = F.row_number().over(Window.partitionBy("_query", "_list").orderBy(F.desc("_score")))
    firsts = handed.withColumn("_nth", nth).where(F.col("_nth") <= depth).select("_query", "_class").distinct()
    cutoffs = saved_at(_kth(resolved(firsts, of), k), firsts_at)
    # phase 2: all entries with their share of the cutoff; a query with fewer than k classes takes every entry
    lowest = F.lit(NO_CUTOFF).cast("long")
    asking = of.where("_asks").join(cutoffs.withColumnRenamed("_query", "_class"), "_class", "left").withColumn("_cutoff", F.coalesce("_cutoff", lowest))
    asking = saved_at(asking.select("_class", "_body", "_cutoff"), asking_at)
    entries = met(_blocks(asking, dims, lists)).mapInArrow(lambda batches: _sufficient(lists, exact, batches), ENTRIES)
    known = saved_at(entries.groupBy("_query", "_class").agg(F.sum("_score").alias("_known"), F.count(F.lit(1)).alias("_lists")), known_at)
    complete = known.where(F.col("_lists") == lists).select("_query", "_class", F.col("_known").alias("_total"))
    raised = asking.select(F.col("_class").alias("_query"), F.col("_cutoff").alias("_first")).join(_kth(complete, k), "_query", "left")
    raised = raised.select("_query", F.ceil(F.col("_first") / lists).alias("_share"), F.greatest("_first", F.coalesce("_cutoff", lowest)).alias("_cutoff"))
    # phase 3: the rest of what may still be among the first
    open_ = known.where(F.col("_lists") < lists).join(raised, "_query")
    most = F.col("_known").cast("decimal(38,0)") + (F.col("_share") - 1).cast("decimal(38,0)") * (F.lit(lists) - F.col("_lists"))
    left = open_.where(most >= F.col("_cutoff"))
    return complete.unionByName(resolved(left, of)), [slices_at, firsts_at, asking_at, known_at]


def top(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, every: int = EVERY, lists: int = LISTS, depth: int = DEPTH, split: int = HOT_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of every row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    on_workers(spark)
    of_at, best_at = new_path(spark, "search-classes"), new_path(spark, "search-best")
    rows, dims, longest = whole_numbers(vectors, vec_id, embedding)
    of = saved_at(classes(rows, k, every).select(F.monotonically_increasing_id().alias("_class"), "*"), of_at)
    best, used = best_classes(of, dims, longest, k + 1, lists, depth)  # one may be the query itself
    # k + 1 classes and as many rows of each hold the k best rows besides the query's own
    by_score: list[Column] = [F.desc("_total"), F.asc_nulls_last(F.col("_members")[0]), F.asc("_class")]
    high = best.withColumn("_nth", F.rank().over(Window.partitionBy("_query").orderBy(F.desc("_total")))).where(F.col("_nth") <= k + 1).drop("_nth")  # and ties
    first = high.join(of.select("_class", "_members"), "_class").withColumn("_nth", F.row_number().over(Window.partitionBy("_query").orderBy(*by_score))).where(F.col("_nth") <= k + 1)
    last = F.row_number().over(Window.partitionBy("_query").orderBy(F.desc("_total"), F.asc_nulls_last("_member"), F.asc("_class")))
    found = first.select("_query", "_class", "_total", F.explode("_members").alias("_member")).withColumn("_nth", last).where(F.col("_nth") <= k + 1)
    lists_of = saved_at(found.groupBy("_query").agg(F.array_sort(F.collect_list(F.struct("_nth", "_class", "_member", "_total"))).alias("_best")), best_at)
    for path in used:
        remove(spark, path)
    # every row that asks finds its class's list and leaves itself out
    answers = of.join(lists_of, F.col("_class") == F.col("_query")).select("_body", F.col("_class").alias("_own"), "_best", "_n")
    asking = split_join(rows.where(F.col("_id") % every == 0), answers.drop("_n"), "_body", ["_id"], hot_keys(answers, "_body", "_n", split))
    own = F.filter("_best", lambda b: (b["_class"] == F.col("_own")) & b["_member"].eqNullSafe(F.col("_id")))
    others = F.filter("_best", lambda b: F.size(own).eqNullSafe(0) | (b["_nth"] != own[0]["_nth"]))
    listed = asking.select(F.col("_id").alias("query_id"), F.posexplode(F.slice(others, 1, k)))
    return listed.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("col._member").alias("vec_id"), F.col("col._total").alias("score"))


def sql(table: str = "embeddings", k: int = K, every: int = EVERY) -> str:
    """The same for vectors of one length, all pairs scored. Sums of squares stay below 2 ** 53, so doubles are exact."""
    return f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM {table}
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % {every} = 0),
n AS (SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM n WHERE rank <= {k}"""
