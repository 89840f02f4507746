"""SimHash near-duplicates: fingerprints, pivot distance tables, components.

A fingerprint has 64 bits; a bit is set if it is set in over half of the XXH64 (seed 42) values of
the text's three-word shingles. Two fingerprints link at DISTANCE or fewer differing bits.

Equal fingerprints are one vertex. Each vertex carries a row of the pivot table: its Hamming distances to
PIVOTS reference fingerprints, one byte each, seven to a long. By the triangle inequality two fingerprints at
distance d differ by at most d in every coordinate. Pairs are found and thinned out in three steps:

1. Join keys. Of BANDS bit ranges at least BANDS - DISTANCE are equal in any linked pair, and each choice of that many is one
   table. Each table has a pivot of its own, whose distance, in cells of 2 x DISTANCE + 1, is part of the key: a vertex stands
   in its own cell and asks its own and, if it is near a border, the next one. No link is lost by either.
2. Pairs whose largest difference over all coordinates exceeds DISTANCE are discarded: five subtractions of longs.
3. The survivors are verified by XOR and bit count.

A key whose own cell holds more than HOT different fingerprints has its pairs found in another exact way, which is linear in the cell: its
fingerprints x emit x ^ e for every error e of one bit or none, and of two bits; x and y are within 3
bits exactly if some x ^ e1 = y ^ e2 with |e1| <= 1 and |e2| <= 2, so joining each value z to the
least x that reaches it with one error or none links the same components.

Null and empty texts, and texts of white space only, have fingerprint zero and link like others. Repeated rows each have their row in the
result. Null ids link like others, and are a component's id only if it has no other. Texts of any length are counted in blocks. An
empty table gives an empty result. Other columns are kept by deduplicated, whatever their names, and not read elsewhere.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, hot_keys, new_path, on_workers, remove, saved, saved_at, split_join
from .graph import connected_components

SEED, SHINGLE, DISTANCE, BANDS, PIVOTS, HOT = 42, 3, 3, 5, 35, 4096
_EACH = 7  # coordinates in a long; its highest byte stays free, so no sum overflows
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of one text; the hash values are counted in blocks, so long texts need no more memory than short ones."""
    words = _SPACE.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return 0
    size = min(SHINGLE, len(words))
    n, counts, digest = len(words) - size + 1, np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, 65_536):
        part = words[at : at + 65_536 + size - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(size)), strict=False)) if size > 1 else part
        values = np.fromiter((digest(s, SEED) for s in shingles), dtype=np.uint64)
        counts += np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(t.as_py()) for t in batch.column("_text")), dtype=np.uint64, count=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(prints.view(np.int64))], ["_id", "fp"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """_id and fp, the fingerprint as a signed long."""
    on_workers(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    return rows.mapInArrow(_prints, f"_id {rows.schema['_id'].dataType.simpleString()}, fp long")


def pivots(count: int = PIVOTS) -> list[int]:
    """Reference fingerprints from a fixed seed, as signed longs."""
    return [int(x) for x in np.random.default_rng(20240501).integers(-(2**63), 2**63 - 1, count)]


def pivot_table(fp: Column, references: list[int]) -> list[Column]:
    """The distances of fp to the references, _EACH bytes to a long."""
    away = [F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("long") for p in references]
    packed = []
    for at in range(0, len(away), _EACH):
        packed.append(functools.reduce(lambda x, y: x + y, (F.shiftleft(d, 8 * k) for k, d in enumerate(away[at : at + _EACH]))))
    return packed


def _apart(a: Column, b: Column, most: int) -> Column:
    """Whether a byte of a and b differs by over `most`. Each byte of `moved` is 128 + most + the difference, so it must lie in 128 .. 128 + 2 * most."""
    every = lambda byte: F.lit(sum(byte << 8 * k for k in range(_EACH))).cast("long")
    moved = a + every(0x80 + most) - b
    low = moved.bitwiseAND(every(0x80)) != every(0x80)
    return low | ((moved.bitwiseAND(every(0x7F)) + every(0x7F - 2 * most)).bitwiseAND(every(0x80)) != F.lit(0).cast("long"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _tables(fp: Column, references: list[int], bands: int, distance: int, ask: bool) -> Column:
    """array<struct<place, key>>: place is a table and a cell of its pivot; key has the bits of the table's bands. With ask, all cells in which links may stand."""
    cuts = [64 * k // bands for k in range(bands + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(cuts)]
    width, out = 2 * distance + 1, []
    cell = lambda d: F.floor(d / width).cast("int")

    def stand(n: int, key: Column):
        return lambda c: F.struct((c + 1 + 128 * n).alias("place"), key.alias("key"))

    for n, chosen in enumerate(itertools.combinations(masks, bands - distance)):
        at = stand(n, fp.bitwiseAND(F.lit(_signed(sum(chosen)))))
        if not references:
            out.append(F.array(at(F.lit(0))))
            continue
        away = F.bit_count(fp.bitwiseXOR(F.lit(references[n % len(references)])))
        out.append(F.transform(F.sequence(cell(away - distance), cell(away + distance)), at) if ask else F.array(at(cell(away))))
    return F.concat(*out)


def candidates(vertices: DataFrame, distance: int = DISTANCE, bands: int = BANDS, references: list[int] | None = None, without: DataFrame | None = None) -> DataFrame:
    """vertices(fp), distinct -> pairs u < v that the keys bring together and no coordinate discards. `without` has (place, key) of cells to leave out."""
    references = pivots() if references is None else references
    coordinates = [c.alias(f"t{k}") for k, c in enumerate(pivot_table(F.col("fp"), references))]
    rows = vertices.select("fp", *coordinates)
    sides = [rows.select(*rows.columns, F.explode(_tables(F.col("fp"), references, bands, distance, ask)).alias("at")).select(*rows.columns, "at.place", "at.key") for ask in (False, True)]
    if without is not None:
        sides = [x.join(without, ["place", "key"], "left_anti") for x in sides]
    a, b = sides[0].alias("a"), sides[1].alias("b")
    meet = (F.col("a.place") == F.col("b.place")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp"))
    for c in rows.columns[1:]:
        meet = meet & ~_apart(F.col(f"a.{c}"), F.col(f"b.{c}"), distance)
    return a.join(b, meet).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))


def links(vertices: DataFrame, distance: int = DISTANCE, bands: int = BANDS, hot: int = HOT) -> DataFrame:
    """vertices(fp), distinct -> edges u < v that have the components of all pairs within `distance`."""
    own, asked = (vertices.select("fp", F.explode(_tables(F.col("fp"), pivots(), bands, distance, ask)).alias("at")).select("fp", "at.place", "at.key") for ask in (False, True))
    sizes_at = new_path(vertices.sparkSession, "simhash-cells")
    sizes = saved_at(own.groupBy("place", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("place", "key"), sizes_at)
    some = sizes.limit(1).count() > 0
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance
    pairs = candidates(vertices, distance, bands, without=sizes if some else None).where(near)
    if some:
        pairs = pairs.union(_hot_links(asked.join(sizes, ["place", "key"], "left_semi").select("fp").distinct(), distance))
    else:
        remove(vertices.sparkSession, sizes_at)
    return pairs.distinct()


def _errors(most: int) -> list[int]:
    return [_signed(sum(1 << b for b in bits)) for k in range(most + 1) for bits in itertools.combinations(range(64), k)]


def _hot_links(prints: DataFrame, distance: int) -> DataFrame:
    low = distance // 2
    errors = F.array(*(F.struct(F.lit(e).cast("long").alias("e"), F.lit(e.bit_count() if e >= 0 else (e + (1 << 64)).bit_count()).alias("r")) for e in _errors(distance - low)))
    reached = prints.select("fp", F.explode(errors).alias("x")).select(F.col("fp").bitwiseXOR(F.col("x.e")).alias("z"), "fp", F.col("x.r").alias("r"))
    centre = reached.where(F.col("r") <= low).groupBy("z").agg(F.min("fp").alias("u"))
    return reached.join(centre, "z").where("u <> fp").select("u", F.col("fp").alias("v"))


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE, hot: int = HOT, split: int = HOT_ROWS) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (least doc_id that links lead to)."""
    spark = docs.sparkSession
    prints = saved(fingerprints(docs, doc_id, text), "simhash-prints")
    vertices_at, links_at = new_path(spark, "simhash-vertices"), new_path(spark, "simhash-components")
    vertices = saved_at(prints.groupBy("fp").agg(F.min("_id").alias("least"), F.count(F.lit(1)).alias("n")), vertices_at)
    found, rounds_at = connected_components(links(vertices.select("fp"), distance, hot=hot), split=split)
    rooted = vertices.join(found, vertices["fp"] == found["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    parts = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("parts"))
    joined = split_join(rooted, parts.select("root", "component_id"), "root", ["fp"], hot_keys(parts, "root", "parts", split))
    of = saved_at(joined.select("fp", "component_id", "n"), links_at)
    for used in (rounds_at, vertices_at):
        remove(spark, used)
    # a fingerprint of a third of all rows is cut into parts
    rows = split_join(prints, of.select("fp", "component_id"), "fp", ["_id"], hot_keys(of, "fp", "n", split))
    return rows.select(F.col("_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """The rows whose doc_id is their component's least; all other members go. Repeated rows of that id stay, null ids stay only if no member has an id."""
    found = components(docs, doc_id, text, distance)
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_stays")).distinct()
    return docs.join(stay, docs[doc_id].eqNullSafe(stay["_stays"]), "left_semi")
