"""Token-id files with a minimal perfect hash index.

Documents are range-partitioned and sorted by id; each task tokenises its range and writes blocks.
A block is one row of a table that Spark writes (so lost tasks leave nothing behind, on any store):

  shard, block     place in the order: shards ascend with the ids, blocks inside them
  base             ids in the shard before this block
  n_ids            ids in this block
  least, most      its least and largest document id, null for none
  payload          the ids, little-endian unsigned, 2 bytes each if the vocabulary allows, else 4
  index            see Index

The index maps a document's key to (offset, length) in the payload by hash and displace: a key falls
into a bucket; the bucket's stored displacement sends each of its keys to a slot of its own among
exactly as many slots as keys; the slot's stored 32-bit fingerprint turns strange keys away. It holds
no ids, so files are read by keys that come from elsewhere: `lookup` takes one, `read` a table of them.

Documents with null text count as empty and hold only the end id. Rows repeated with one id follow
each other and have keys (id, 0), (id, 1), ...; null ids come first. An empty table makes no block.
"""

from __future__ import annotations

import itertools
import os
import struct
import sys
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import new_path, on_workers

END_ID = 2
BLOCK_IDS, BLOCK_DOCS, SLICE_DOCS, SLICE_BYTES = 1 << 20, 2048, 1024, 8 << 20
CACHE_WORDS, CACHE_LENGTH = 900_000, 48
SCHEMA = "shard int, block int, n_docs int, n_ids long, base long, least long, most long, payload binary, index binary"
_HEAD = struct.Struct("<4sBIIQ")
#: A Latin letter, the marks after it and the white space after those. The marks are a pre-token of their own (they
#: join neither side: no combining character, no apostrophe, no special token among them), so a space may part them.
#: U+0130 is left out, as its lower case ends in a combining character.
_MARKS = "([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F])([!-&(-/:;=?@\\[-`{}~]+)(\\s|$)"
_M64 = (1 << 64) - 1
_NO_ID, _NTH = 0xA5A5_5A5A_0F0F_F0F0, 0xD1342543DE82EF95


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """splitmix64 of unsigned keys."""
    with np.errstate(over="ignore"):
        x = keys + np.uint64((seed * 0x9E3779B97F4A7C15) & _M64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def keys_of(ids: list[int | None]) -> np.ndarray:
    """Unsigned 64-bit keys of ids in order; the n-th repetition of an id counts in its key."""
    seen: dict[int | None, int] = {}
    out = np.empty(len(ids), dtype=np.uint64)
    for at, i in enumerate(ids):
        n = seen[i] = seen.get(i, -1) + 1
        out[at] = key_of(i, n)
    return out


def key_of(doc_id: int | None, n: int = 0) -> int:
    return ((_NO_ID if doc_id is None else doc_id) + n * _NTH) & _M64


class Index:
    """Build, pack, unpack and ask the index of one block."""

    def __init__(self, displacement, prints, offsets, lengths, seed, width):
        self.displacement, self.prints, self.offsets, self.lengths, self.seed, self.width = displacement, prints, offsets, lengths, seed, width

    @classmethod
    def build(cls, ids: list[int | None], lengths: list[int], width: int) -> Index:
        keys, n = keys_of(ids), len(ids)
        if len(np.unique(keys)) < n:
            raise ValueError("two documents of a block have the same 64-bit key")
        offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype("<u8") if n else np.zeros(0, "<u8")
        for seed in range(1, 1000):
            got = cls._displace(keys, n, seed)
            if got is not None:
                displacement, slot = got
                prints, off, length = np.zeros(n, "<u4"), np.zeros(n, "<u8"), np.zeros(n, "<u4")
                prints[slot], off[slot], length[slot] = mix(keys, seed + 7919) >> np.uint64(32), offsets, lengths
                return cls(displacement, prints, off, length, seed, width)
        raise RuntimeError("no displacement found")

    @staticmethod
    def _displace(keys: np.ndarray, n: int, seed: int):
        n_buckets = max(1, -(-n // 3))
        bucket = (mix(keys, seed) % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=n_buckets)
        ends = np.cumsum(sizes)
        taken, slot = np.zeros(n, dtype=bool), np.zeros(n, dtype=np.int64)
        displacement = np.zeros(n_buckets, dtype="<i4")
        tries = np.arange(1, 65, dtype=np.uint64)
        for b in np.argsort(-sizes, kind="stable"):
            k = sizes[b]
            if k < 2:
                break
            members = order[ends[b] - k : ends[b]]
            for start in range(0, 1 << 17, 64):
                at = _slots(keys[members][:, None], (tries + np.uint64(start))[None, :], seed, n)
                good = ~taken[at].any(axis=0)
                for j in np.flatnonzero(good):
                    if len(set(at[:, j].tolist())) == k:
                        displacement[b] = start + j + 1
                        slot[members], taken[at[:, j]] = at[:, j], True
                        break
                if displacement[b]:
                    break
            else:
                return None
        free = iter(np.flatnonzero(~taken).tolist())
        for b in np.flatnonzero(sizes == 1):  # a bucket of one names its slot
            member = order[ends[b] - 1]
            slot[member] = s = next(free)
            displacement[b] = -1 - s
        return displacement, slot

    def find(self, doc_id: int | None, n: int = 0) -> tuple[int, int] | None:
        """(offset, length) of a document, in constant time; None for strange ids (but for one in 2**32)."""
        slot, known = self.find_all(np.array([key_of(doc_id, n)], dtype=np.uint64))
        return (int(self.offsets[slot[0]]), int(self.lengths[slot[0]])) if known[0] else None

    def find_all(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = len(self.prints)
        if not size:
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        d = self.displacement[(mix(keys, self.seed) % np.uint64(len(self.displacement))).astype(np.int64)].astype(np.int64)
        slot = np.where(d < 0, -1 - d, _slots(keys, np.maximum(d, 0).astype(np.uint64), self.seed, size))
        return slot, self.prints[slot] == (mix(keys, self.seed + 7919) >> np.uint64(32)).astype("<u4")

    def pack(self) -> bytes:
        arrays = (self.displacement, self.prints, self.offsets, self.lengths)
        return _HEAD.pack(b"TKIX", self.width, len(self.prints), len(self.displacement), self.seed) + b"".join(a.tobytes() for a in arrays)

    @classmethod
    def unpack(cls, data: bytes) -> Index:
        magic, width, n, n_buckets, seed = _HEAD.unpack_from(data)
        if magic != b"TKIX":
            raise ValueError("not an index")
        at, out = _HEAD.size, []
        for kind, size in (("<i4", n_buckets), ("<u4", n), ("<u8", n), ("<u4", n)):
            out.append(np.frombuffer(data, kind, size, at))
            at += out[-1].nbytes
        return cls(*out, seed, width)


def _slots(keys: np.ndarray, d: np.ndarray, seed: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(keys ^ (d * np.uint64(0xC2B2AE3D27D4EB4F)), seed + 104729) % np.uint64(n)).astype(np.int64)


class Encoder:
    """Ids of whole texts, as little-endian bytes of `width` each.

    The tokenizer never joins what spaces part, so a text's ids are those of its space-parted
    words in order; words seen before come from a cache of bounded size. Other white space stays
    inside its word, and the tokenizer sees it as it is.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"  # native order; the format's order is little-endian
        ends = sorted(i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith("</w>"))
        self.ends = np.isin(np.arange(self.tokenizer.get_vocab_size(with_added_tokens=True)), ends) if ends else None  # None: the vocabulary does not mark ends of words
        self.known: dict[str, bytes] = {"": b""}

    def _packed(self, encoding) -> bytes:
        ids = array(self.code, encoding.ids)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words of letters only. Such a word is one pre-token, whose last id (and no other) ends a word, so many can go as one text."""
        out: dict[str, bytes] = {}
        for at in range(0, len(words), 2048):
            part = words[at : at + 2048]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype=f"<u{self.width}")
            ends = (np.flatnonzero(self.ends[ids]) + 1) * self.width
            if len(ends) != len(part):  # letters whose lower case is no letter
                out.update(zip(part, map(self._packed, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)), strict=True))
                continue
            data, ends = ids.tobytes(), ends.tolist()
            out.update((w, data[a:b]) for w, a, b in zip(part, [0, *ends[:-1]], ends, strict=True))
        return out

    def _learned(self, missing: list[str]) -> dict[str, bytes]:
        letters = [w for w in missing if w.isalpha()] if self.ends is not None else []
        rest = list(set(missing).difference(letters)) if len(letters) < len(missing) else []
        return self._words(letters) | dict(zip(rest, map(self._packed, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)), strict=True))

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        parted = pc.replace_substring(pc.replace_substring_regex(pc.fill_null(texts, ""), _MARKS, r"\1 \2\3"), "\n", " ")
        split = pc.split_pattern(parted, " ")
        words = split.flatten().dictionary_encode()
        different = words.dictionary.to_pylist()
        if len(self.known) > CACHE_WORDS:
            self.known = {"": b""}
        ids = list(map(self.known.get, different))
        missing = [k for k, got in enumerate(ids) if got is None]
        if missing:
            fresh = self._learned([different[k] for k in missing])
            for k in missing:
                ids[k] = fresh[different[k]]
            self.known.update((w, got) for w, got in fresh.items() if len(w) <= CACHE_LENGTH)
        return self._joined(ids, words.indices.to_numpy(), np.asarray(split.offsets))

    def _joined(self, ids: list[bytes], word: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Documents are runs word[ends[k] : ends[k + 1]] of numbers of different words; ids are those words' ids."""
        all_ids = np.frombuffer(b"".join(ids), f"<u{self.width}")
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width
        start = np.cumsum(size) - size
        each = size[word]
        until = np.concatenate([[0], np.cumsum(each)])
        data = all_ids[np.repeat(start[word] - until[:-1], each) + np.arange(until[-1])].tobytes()
        cut = (until[ends - ends[0]] * self.width).tolist()
        return [data[a:b] for a, b in itertools.pairwise(cut)]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def slices(texts: pa.Array, docs: int = SLICE_DOCS, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, count) of runs of at most `docs` texts and, but for a single longer one, `size` bytes."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start = total = 0
    for at, n in enumerate(lengths):
        if at > start and (at - start >= docs or total + n > size):
            yield start, at - start
            start, total = at, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths) - start


def _write(path: str, end_id: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder, shard = _encoder(path), TaskContext.get().partitionId()
    end = int(end_id).to_bytes(encoder.width, "little")
    ids: list[int | None] = []
    bodies: list[bytes] = []
    size, block, base = 0, 0, 0

    def row() -> pa.RecordBatch:
        nonlocal size, block, base, ids, bodies
        index = Index.build(ids, [len(b) // encoder.width for b in bodies], encoder.width).pack()
        values = ([shard], [block], [len(ids)], [size], [base], [next((i for i in ids if i is not None), None)], [ids[-1]], [b"".join(bodies)], [index])
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        out = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])
        block, base, size, ids, bodies = block + 1, base + size, 0, [], []
        return out

    for batch in batches:
        keys, texts = batch.column("_id"), batch.column("_text")
        for at, n in slices(texts):
            for i, body in zip(keys.slice(at, n).to_pylist(), encoder.encode(texts.slice(at, n)), strict=True):
                # all rows of an id stand in one block, or a later one would count its repetitions anew
                if ids and i != ids[-1] and (size >= BLOCK_IDS or len(ids) >= BLOCK_DOCS):
                    yield row()
                ids.append(i)
                bodies.append(body + end)
                size += len(body) // encoder.width + 1
    if ids:
        yield row()


def write(docs: DataFrame, to: str, tokenizer_path: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> None:
    """Tokenise whole texts and write the blocks to the folder `to`, in ascending order of doc_id."""
    on_workers(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"))
    ordered = rows.repartitionByRange("_id").sortWithinPartitions("_id")
    ordered.mapInArrow(lambda batches: _write(tokenizer_path, end_id, batches), SCHEMA).write.option("compression", "zstd").parquet(to)


def _to_shards(starts: np.ndarray, shards: np.ndarray, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the shard that holds each key if any does: the last one that starts at or before it; null ids stand in the first."""
    for batch in batches:
        ids = pc.fill_null(batch.column("_at"), int(starts[0])).to_numpy(zero_copy_only=False)
        shard = shards[np.maximum(np.searchsorted(starts, ids, side="right") - 1, 0)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard, pa.int32())], [*batch.schema.names, "shard"])


def _find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (shard, _at), a block (no _copies) before its keys: each key asks the last block before it."""
    shard = base = index = ids = None
    for batch in batches:
        at, copies = batch.column("_at"), batch.column("_copies")
        block = copies.is_null().to_numpy(zero_copy_only=False)
        turns = np.flatnonzero(block).tolist()
        for first, last in itertools.pairwise([0, *turns, batch.num_rows]):
            if first < last and block[first]:
                shard, base = batch.column("shard")[first].as_py(), batch.column("base")[first].as_py()
                index = Index.unpack(batch.column("index")[first].as_py())
                ids = np.frombuffer(batch.column("payload")[first].as_py(), f"<u{index.width}")
                first += 1
            if first == last:
                continue
            if index is None or batch.column("shard")[first].as_py() != shard:
                raise ValueError("no block can hold a key")
            asked, times = at.slice(first, last - first), copies.slice(first, last - first).to_numpy()
            nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            whole = asked.take(pa.array(np.repeat(np.arange(len(times)), times)))
            given = np.where(whole.is_valid().to_numpy(zero_copy_only=False), pc.fill_null(whole, 0).to_numpy(zero_copy_only=False).view(np.uint64), np.uint64(_NO_ID))
            slot, known = index.find_all(given + nth.astype(np.uint64) * np.uint64(_NTH))
            if not known.all():
                raise ValueError("the files do not hold a key that was asked for")
            offset, length = index.offsets[slot].astype(np.int64), index.lengths[slot].astype(np.int64)
            crc = [zlib.crc32(ids[o : o + n].astype("<u4").tobytes()) for o, n in zip(offset.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [whole, pa.array([shard] * len(crc), pa.int32()), pa.array(offset + base), pa.array(length), pa.array(crc, pa.int64())],
                ["doc_id", "shard", "in_shard", "n_tokens", "ids_crc32"],
            )


def read(spark, at: str, docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of each row of `docs`, which only gives the keys.

    A key goes to its shard by the shards' ranges, meets the blocks of that shard in order and asks the one block whose
    range holds it; a key that is in no block is an error. The one thing gathered on the driver is the total and the
    least id of each shard: one row per writing task.
    """
    on_workers(spark)
    files = spark.read.schema(SCHEMA).parquet(at)
    found, before, starts = sorted(files.groupBy("shard").agg(F.sum("n_ids").alias("n"), F.min("least").alias("least")).collect()), 0, []
    for r in found:
        starts.append((r["shard"], before))
        before += r["n"]
    before_shards = spark.createDataFrame(starts, T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("_before", T.LongType())]))
    keys = docs.groupBy(F.col(doc_id).cast("long").alias("_at")).agg(F.count(F.lit(1)).alias("_copies"))
    named = [(r["least"], r["shard"]) for r in found if r["least"] is not None]
    # a shard of null ids alone is the first; without any shard there is no key to find
    low, numbers = np.array([x for x, _ in named] or [0], np.int64), np.array([x for _, x in named] or [r["shard"] for r in found] or [0], np.int32)
    if found and found[0]["least"] is None and named:
        low, numbers = np.concatenate([[np.iinfo(np.int64).min], low]), np.concatenate([[found[0]["shard"]], numbers])
    keys = keys.mapInArrow(lambda batches: _to_shards(low, numbers, batches), "_at long, _copies long, shard int")
    # null ids come first of all, so the block that may begin with them stands before them
    first = (F.col("shard") == F.lit(int(numbers[0]))) & (F.col("block") == 0)
    blocks = files.select("shard", F.when(~first, F.col("least")).alias("_at"), F.lit(None).cast("long").alias("_copies"), "base", "payload", "index")
    nothing = {"base": F.lit(None).cast("long"), "payload": F.lit(None).cast("binary"), "index": F.lit(None).cast("binary")}
    met = blocks.unionByName(keys.withColumns(nothing)).repartitionById(1 + max((r["shard"] for r in found), default=0), "shard").sortWithinPartitions("shard", F.col("_at").asc_nulls_first(), F.col("_copies").asc_nulls_first())
    located = met.mapInArrow(_find, "doc_id long, shard int, in_shard long, n_tokens long, ids_crc32 long")
    return located.join(F.broadcast(before_shards), "shard").select("doc_id", (F.col("_before") + F.col("in_shard")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark, at: str, doc_id: int | None, n: int = 0) -> list[int] | None:
    """The ids of the n-th row with this document id, None if there is none.

    The filter on least and most reaches the files' own statistics, so only the one block whose range holds the key is
    read; its index leads to one slot, whose fingerprint turns strange keys away, and the slot to one stretch of the payload.
    """
    blocks = spark.read.schema(SCHEMA).parquet(at)
    # null ids come first of all
    fits = F.col("block") == 0 if doc_id is None else (F.col("least") <= doc_id) & (F.col("most") >= doc_id)
    order = blocks.where(fits).select("shard", "block", "index", "payload").orderBy("shard", "block").limit(1)
    for r in order.collect():
        index = Index.unpack(bytes(r["index"]))
        if got := index.find(doc_id, n):
            return np.frombuffer(bytes(r["payload"]), f"<u{index.width}")[got[0] : got[0] + got[1]].tolist()
    return None


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the files to a new folder in the shared one and read them back by the documents' keys."""
    to = new_path(docs.sparkSession, "token-files")
    write(docs, to, tokenizer_path, end_id, doc_id, text)
    return read(docs.sparkSession, to, docs, doc_id)
