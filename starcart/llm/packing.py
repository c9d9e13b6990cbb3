"""Packing documents into fixed-length sequences (operator 8).

Bounded-space online best fit: a packer keeps a fixed number of open sequences. A
bitset has a bit for every amount of free space that some open sequence has; the next
piece goes where the least space would be left, found by the lowest bit at or above its
length, and opens a sequence if none has room. When too many are open the fullest closes
first; a full one closes at once.

Documents are encoded where they lie; only a short row for each piece (document, start,
length, checksum) is shuffled. Pieces are dealt at random into groups of about
``group_tokens`` tokens, whose number grows with the input; every group is one packer's
stream, longest pieces first (Spark sorts it, the packer holds only its open sequences).
The deal is by the pieces' content, so copies of one row meet in a group; a group that this
makes twice as large as meant is dealt again, by the number that each piece is written with.

A document of more than ``length`` tokens is cut into pieces of ``length``, of which the
first may be shorter; others stay whole.

Edge cases: null and empty texts are one end token, repeated rows and ids are packed like
any other rows, an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import texts
from .tokens import PieceEncoder

_PIECE = [
    ("doc_id", "long", pa.int64()), ("piece", "int", pa.int32()), ("start", "long", pa.int64()),
    ("length", "long", pa.int64()), ("ids_crc32", "long", pa.int64()), ("ids", "binary", pa.binary()),
]

BROADCAST_GROUPS = 100_000  # group numbers up to which they are broadcast


def piece_starts(n: int, length: int) -> list[int]:
    """Starts of a document's pieces: the first takes what is left over."""
    return [0, *range(n % length or length, n, length)]


class BestFit:
    """Open sequences by free space; ``add`` gives (sequence, offset) of a piece."""

    def __init__(self, length: int, open_limit: int):
        self.length, self.limit = length, open_limit
        self.free: dict[int, list[int]] = {}  # free space -> open sequences
        self.bits = 0  # bit f: some open sequence has f tokens free
        self.open = self.made = 0

    def _take(self, space: int) -> int:
        stack = self.free[space]
        sequence = stack.pop()
        if not stack:
            self.bits ^= 1 << space
        self.open -= 1
        return sequence

    def _keep(self, sequence: int, space: int) -> None:
        if space == 0:
            return
        self.free.setdefault(space, []).append(sequence)
        self.bits |= 1 << space
        self.open += 1
        if self.open > self.limit:
            self._take((self.bits & -self.bits).bit_length() - 1)

    def add(self, piece: int) -> tuple[int, int]:
        fitting = self.bits >> piece
        if fitting:
            space = piece + (fitting & -fitting).bit_length() - 1
            sequence = self._take(space)
        else:
            space, sequence = self.length, self.made
            self.made += 1
        self._keep(sequence, space - piece)
        return sequence, self.length - space


def encode_pieces(docs: DataFrame, tokenizer: str, style: str, end_id: int, length: int, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if asked for) of every piece of every text."""
    fields = _PIECE if with_ids else _PIECE[:-1]
    names = [n for n, _, _ in fields]

    def encode(batches):
        encoder = PieceEncoder.of_worker(tokenizer, style)
        for batch in batches:
            rows = []
            encoded = encoder.encode_all(texts(batch.column(1)))
            for doc_id, raw in zip(batch.column(0).to_pylist(), encoded, strict=True):
                ids = np.append(np.frombuffer(raw, encoder.dtype).astype("<u4"), np.uint32(end_id))
                starts = piece_starts(len(ids), length)
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    row = (doc_id, k, a, b - a, zlib.crc32(ids[a:b]))
                    rows.append((*row, ids[a:b].tobytes()) if with_ids else row)
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, _, t) in zip(columns, fields, strict=True)], names=names)

    schema = ", ".join(f"{n} {t}" for n, t, _ in fields)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_skip_empty(encode), schema)


def _skip_empty(make):
    return lambda batches: make(b for b in batches if b.num_rows)


def _dealt(pieces: DataFrame, groups: int, group_tokens: int, number: str | None) -> DataFrame:
    """``pieces`` with the ``_group`` of each."""
    content = F.xxhash64("doc_id", "piece", "start", "ids_crc32")
    dealt = pieces.withColumn("_group", F.pmod(content, F.lit(groups)))
    if groups == 1 or not number:
        return dealt
    large = dealt.groupBy("_group").agg(F.sum("length").alias("_tokens")).where(F.col("_tokens") > 2 * group_tokens)
    large = materialize(large.select("_group", F.lit(True).alias("_large")), "large-groups")
    found = large.count()
    if not found:
        return dealt
    large = F.broadcast(large) if found <= BROADCAST_GROUPS else large
    anew = F.pmod(F.xxhash64(content, number), F.lit(groups))
    return dealt.join(large, "_group", "left").withColumn("_group", F.when(F.col("_large"), anew).otherwise(F.col("_group"))).drop("_large")


def pack(
    pieces: DataFrame, length: int, open_limit: int = 4096, group_tokens: int = 20_000_000, number: str | None = None
) -> DataFrame:
    """``pieces`` (with a ``length`` column) plus sequence_id and offset.

    ``number``: a column, written with the pieces, that tells equal rows apart; it is left out.
    """
    total = pieces.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-int(total) // group_tokens))
    kept = [c for c in pieces.columns if c != number]
    at = kept.index("length")

    def place(batches):
        group, packer = None, None
        for batch in batches:
            sequences, offsets = [], []
            for g, n in zip(batch.column(len(kept)).to_pylist(), batch.column(at).to_pylist(), strict=True):
                if g != group:
                    group, packer = g, BestFit(length, open_limit)
                sequence, offset = packer.add(n)
                sequences.append((g << 40) + sequence)
                offsets.append(offset)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(kept)], pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())],
                names=[*kept, "sequence_id", "offset"],
            )

    schema = ", ".join(f"{n} {pieces.schema[n].dataType.simpleString()}" for n in kept) + ", sequence_id long, offset long"
    return (
        _dealt(pieces, groups, group_tokens, number)
        .select(*kept, "_group")
        .repartition(groups, "_group")
        .sortWithinPartitions("_group", F.desc("length"), "doc_id", "piece", "ids_crc32")
        .mapInArrow(place, schema)
    )


def pack_documents(
    docs: DataFrame, tokenizer: str, style: str, end_id: int = 0, length: int = 2048,
    open_limit: int = 4096, group_tokens: int = 20_000_000,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs``."""
    pieces = encode_pieces(docs, tokenizer, style, end_id, length).withColumn("number", F.monotonically_increasing_id())
    return pack(materialize(pieces, "pieces"), length, open_limit, group_tokens, number="number")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces with ids: sequence_id, n_tokens, ids (uint32 bytes)."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
