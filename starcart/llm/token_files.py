"""Token ids in binary shards, with a minimal perfect hash index over them (operator 2).

Shard files are raw streams of little-endian ids in ascending ``doc_id`` order, every
document closed by the end id; a directory of the shard's documents (ids, lengths)
follows the last one. Spark's own text writer produces them, with the end id as line
separator, so they are committed task by task on any file system and a lost executor
only repeats its own shards. Documents are range-partitioned and sorted as text and
encoded behind the shuffle.

The index maps a document key to (shard, offset, length, checksum of its ids). Keys are
hashed into index parts of about ``part_keys`` keys; each part holds a minimal perfect
hash (levels of bit arrays: a key sits at the first level where no other key of the part
shares its bit, and its slot is the number of bits set before it) and, by slot, a 32-bit
fingerprint that rejects unknown keys and the entry itself. A key costs a few bit tests.
Parts are built and probed by Spark groups of bounded size; no part of the index passes
through the driver.

Edge cases: null text is an empty document (just the end id), a null ``doc_id`` is a key
of its own and sorts first, rows with equal ids are told apart by their ordinal (0, 1, ...
in order of text), an empty table gives no shards and an empty result.
"""

from __future__ import annotations

import uuid
import zlib
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, materialize
from .common import running_base, texts, total_bytes
from .tokens import PieceEncoder, id_type

MAGIC = b"TOKSHARD"
_KEY = "doc_id long, ordinal long"
_ENTRY = "shard int, offset long, n_tokens long, ids_crc32 long"


# --- shard files -----------------------------------------------------------------------


def separator(end_id: int, dtype: str) -> str:
    raw = np.array([end_id], dtype=dtype).tobytes()
    if max(raw) > 127:
        raise ValueError("the end id's bytes must be ASCII to serve as a line separator")
    return raw.decode("ascii")


def footer(doc_ids: list, lengths: list[int]) -> bytes:
    """Directory of a shard: ids (null as 0 with a flag), flags, lengths, count, magic."""
    ids = np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes()
    nulls = np.array([d is None for d in doc_ids], dtype="u1").tobytes()
    return ids + nulls + np.array(lengths, dtype="<i8").tobytes() + len(doc_ids).to_bytes(8, "little") + MAGIC


def read_footer(content: bytes, width: int) -> tuple[list, np.ndarray]:
    """doc_ids and lengths (with the end id) of a shard file's content."""
    end = len(content) - width  # the last separator closes the directory
    if content[end - 8 : end] != MAGIC:
        raise ValueError("not a token shard")
    n = int.from_bytes(content[end - 16 : end - 8], "little")
    at = end - 16 - 17 * n
    ids = np.frombuffer(content, "<i8", n, at)
    nulls = np.frombuffer(content, "u1", n, at + 8 * n)
    lengths = np.frombuffer(content, "<i8", n, at + 9 * n)
    return [None if x else int(i) for i, x in zip(ids, nulls, strict=True)], lengths


def write_shards(docs: DataFrame, tokenizer: str, style: str, end_id: int, vocabulary: int, shard_bytes: int = 16 << 20) -> str:
    """Encode every text and write the shard files; returns their folder.

    ``shard_bytes``: text that goes into one shard, about.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    dtype = id_type(vocabulary)
    width = np.dtype(dtype).itemsize
    shards = max(1, -(-total_bytes(docs) // shard_bytes))

    def encode(batches):
        encoder = PieceEncoder.of_worker(tokenizer, style)
        ids, lengths = [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            for payloads in batched(encoder.encode_all(texts(batch.column(1))), 1000):
                lengths += [len(p) // width + 1 for p in payloads]
                yield pa.RecordBatch.from_arrays([pa.array(payloads, pa.binary())], names=["payload"])
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([footer(ids, lengths)], pa.binary())], names=["payload"])

    path = f"{checkpoint_dir(spark).rstrip('/')}/starcart-token-shards-{uuid.uuid4().hex[:12]}"
    (
        docs.repartitionByRange(shards, "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(encode, "payload binary")
        .select(F.col("payload").cast("string").alias("value"))
        .write.option("lineSep", separator(end_id, dtype))
        .option("compression", "none")
        .text(path)
    )
    return path


def _shard_files(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.format("binaryFile").load(path)
        .where(F.col("length") > 0)
        .select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("shard"), "content")
    )


def read_directory(spark: SparkSession, path: str, vocabulary: int) -> DataFrame:
    """doc_id, ordinal, shard, offset, n_tokens, ids_crc32 of every document, read from the files."""
    dtype = id_type(vocabulary)
    width = np.dtype(dtype).itemsize

    def parse(batches):
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                content = content.as_py()
                ids, lengths = read_footer(content, width)
                ends = np.cumsum(lengths)
                stream = np.frombuffer(content, dtype, int(ends[-1])).astype("<u4")
                rows, ordinal, before = [], 0, object()
                for doc_id, n, end in zip(ids, lengths.tolist(), ends.tolist(), strict=True):
                    ordinal = ordinal + 1 if doc_id == before else 0
                    before = doc_id
                    rows.append((doc_id, ordinal, shard, end - n, n, zlib.crc32(stream[end - n : end])))
                yield _batch(rows, f"{_KEY}, {_ENTRY}")

    return _shard_files(spark, path).mapInArrow(parse, f"{_KEY}, {_ENTRY}")


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64()}
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields]
    )


# --- minimal perfect hash index ----------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def key_hash(doc_id: pa.Array, ordinal: pa.Array) -> np.ndarray:
    ids = doc_id.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    nulls = doc_id.is_null().to_numpy(zero_copy_only=False).astype(np.uint64)
    twice = _mix(ids) + (ordinal.to_numpy(zero_copy_only=False).astype(np.uint64) << np.uint64(1)) + nulls
    return _mix(twice)


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    return (_mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)).astype("<u4")


def _positions(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    return (_mix(hashes + np.uint64(level * 0x632BE59BD9B4E019 & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)


def build_mph(hashes: np.ndarray, gamma: float = 2.0) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit arrays of the levels, and the slot (0..n-1) of every key."""
    levels, slots, base = [], np.full(len(hashes), -1, dtype=np.int64), 0
    left = np.arange(len(hashes))
    while len(left):
        if len(levels) > 200:
            raise ValueError("two keys share a 64-bit hash")
        size = max(8, int(gamma * len(left)))
        at = _positions(hashes[left], len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        mine = alone[at]
        slots[left[mine]] = base + (np.cumsum(alone) - 1)[at[mine]]
        base += int(alone.sum())
        left = left[~mine]
    return levels, slots


def find_slots(levels: list[np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """Slots of the hashes; -1 where no level has the key's bit."""
    slots, base = np.full(len(hashes), -1, dtype=np.int64), 0
    for level, bits in enumerate(levels):
        left = np.flatnonzero(slots < 0)
        at = _positions(hashes[left], level, len(bits))
        hit = bits[at]
        slots[left[hit]] = base + (np.cumsum(bits) - 1)[at[hit]]
        base += int(bits.sum())
    return slots


_PART = "part int, sizes binary, bits binary, fingerprints binary, shards binary, offsets binary, lengths binary, checksums binary"


def _part_of(parts: int):
    return F.pmod(F.xxhash64("doc_id", "ordinal"), F.lit(parts)).cast("int").alias("part")


def build_index(directory: DataFrame, part_keys: int = 1 << 16) -> tuple[DataFrame, int]:
    """The index (a row for each part, as files in the shared folder) and its number of parts."""
    parts = max(1, -(-directory.count() // part_keys))

    def build(key, table):
        table = table.combine_chunks()
        hashes = key_hash(*(pa.concat_arrays(table[c].chunks) for c in ("doc_id", "ordinal")))
        levels, slots = build_mph(hashes)
        order = np.empty(len(slots), dtype=np.int64)
        order[slots] = np.arange(len(slots))
        column = lambda name, kind: table[name].to_numpy()[order].astype(kind).tobytes()
        row = (
            key[0].as_py(),
            np.array([len(x) for x in levels], dtype="<i8").tobytes(),
            b"".join(np.packbits(x).tobytes() for x in levels),
            fingerprint(hashes[order]).tobytes(),
            column("shard", "<i4"), column("offset", "<i8"), column("n_tokens", "<i8"), column("ids_crc32", "<u4"),
        )
        return pa.Table.from_batches([_batch([row], _PART)])

    index = directory.select("*", _part_of(parts)).groupBy("part").applyInArrow(build, _PART)
    return materialize(index, "token-index"), parts


def lookup(keys: DataFrame, index: DataFrame, parts: int) -> DataFrame:
    """``keys`` (doc_id, ordinal) with shard, offset, n_tokens and ids_crc32 from the index; unknown keys are left out."""

    def probe(_, wanted, part):
        columns = [pa.concat_arrays(wanted[c].chunks) if wanted.num_rows else pa.array([], pa.int64()) for c in ("doc_id", "ordinal")]
        if not (wanted.num_rows and part.num_rows):
            return pa.Table.from_batches([_batch([], f"{_KEY}, {_ENTRY}")])
        blob = {name: part[name][0].as_py() for name in part.column_names if name != "part"}
        levels, at = [], 0
        for size in np.frombuffer(blob["sizes"], "<i8"):
            packed = -(-int(size) // 8)
            levels.append(np.unpackbits(np.frombuffer(blob["bits"], "u1", packed, at), count=int(size)).astype(bool))
            at += packed
        hashes = key_hash(*columns)
        slots = find_slots(levels, hashes)
        prints = np.frombuffer(blob["fingerprints"], "<u4")
        known = (slots >= 0) & (prints[slots] == fingerprint(hashes))
        slots = slots[known]
        entry = lambda name, kind, to: pa.array(np.frombuffer(blob[name], kind)[slots].astype(to))
        return pa.Table.from_arrays(
            [
                *[c.filter(pa.array(known)) for c in columns],
                entry("shards", "<i4", np.int32), entry("offsets", "<i8", np.int64),
                entry("lengths", "<i8", np.int64), entry("checksums", "<u4", np.int64),
            ],
            names=["doc_id", "ordinal", "shard", "offset", "n_tokens", "ids_crc32"],
        )

    wanted = keys.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ordinal").cast("long").alias("ordinal"))
    wanted = wanted.select("*", _part_of(parts))
    return wanted.groupBy("part").cogroup(index.groupBy("part")).applyInArrow(probe, f"{_KEY}, {_ENTRY}")


def read_ids(spark: SparkSession, path: str, entries: DataFrame, vocabulary: int) -> DataFrame:
    """The ids (with the end id) of looked-up documents: doc_id, ordinal, ids, cut from their shards."""
    width = np.dtype(id_type(vocabulary)).itemsize
    cut = F.expr(f"substring(content, cast(offset * {width} + 1 as int), cast(n_tokens * {width} as int))")
    return _shard_files(spark, path).join(entries, "shard").select("doc_id", "ordinal", cut.alias("ids"))


def document_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, ordinal) of every row."""
    counts = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    return counts.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("_n").cast("int") - 1)).alias("ordinal"))


def token_table(docs: DataFrame, tokenizer: str, style: str, end_id: int, vocabulary: int, shard_bytes: int = 16 << 20) -> DataFrame:
    """Write shards and index, then look every document up: doc_id, start, n_tokens, ids_crc32, shard, offset, ordinal.

    ``start`` counts the ids of all documents before it in the order of the files.
    """
    spark = docs.sparkSession
    path = write_shards(docs, tokenizer, style, end_id, vocabulary, shard_bytes)
    directory = materialize(read_directory(spark, path, vocabulary), "token-directory")
    index, parts = build_index(directory)
    found = lookup(document_keys(docs), index, parts)
    totals = directory.groupBy("shard").agg(F.sum("n_tokens").alias("_ids"))
    bases = running_base(totals, "shard", "_ids", "_base").select("shard", "_base")
    return found.join(bases, "shard").select(
        "doc_id", (F.col("_base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", "shard", "offset", "ordinal"
    )
