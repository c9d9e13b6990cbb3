"""Sharding on a consistent-hash ring with virtual nodes and bounded loads (operator 6).

Every shard owns ``vnodes`` points on a ring of 60-bit positions. A document sits
at the hash of its ``doc_id`` and belongs to the next point clockwise; when that
point's shard is full it continues clockwise to the next shard with room. The
capacities add up to the number of rows and differ by at most one, so the law is
``rows``: counts at most one apart, while a document moves only when its own arc
or an overflow upstream of it changes.

The outcome equals "insert the rows in ring order, each at the first shard
clockwise with room", but rows are never visited one by one: they are counted per
arc (``shards * vnodes`` numbers, a parameter and not data), the walk runs over
those counts, and its outcome is a table of at most ``shards * (vnodes + 1)`` runs
"ranks a..b of arc k go to shard s" which rows look up by their rank within the
arc. Ranks are counted in cells of the ring whose number grows with the input, so
that no task sorts more than about ``cell_rows`` rows. A null ``doc_id`` has no
position of its own; such rows are placed by their text. A position with more than
``cell_rows`` rows (one id, or null ids of one text) is hot: its rows are dealt to
several positions, as if its key were that many, so no cell holds them all.

Edge cases: null text has size 8, rows with equal ids follow each other on the
ring (ordered by size and checksum), repeated rows get a slot each, an empty table
gives an empty result, other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import running_base

RING_BITS = 60
HOT_CELLS = 10_000  # up to so many numbers go into a filter or a broadcast; more are joined


def _position(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def ring_points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """The ring: (position, shard) in clockwise order."""
    return sorted((_position(f"shard-{s}-{v}"), s) for s in range(shards) for v in range(vnodes))


def capacities(rows: int, shards: int) -> list[int]:
    """Loads that add up to ``rows`` and differ by at most one."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def walk(counts: list[int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int]]:
    """Runs (arc, first rank, length, shard) of the clockwise walk over the arcs' counts.

    Arc k ends at point k; the arc behind the last point belongs to point 0.
    """
    room, runs = list(room), []
    for arc, count in enumerate(counts):
        at, rank = arc, 0
        while rank < count:
            shard = owners[at % len(owners)]
            take = min(count - rank, room[shard])
            if take:
                runs.append((arc, rank, take, shard))
                room[shard] -= take
                rank += take
            at += 1
    return runs


def _position_of(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def spread_hot_positions(rows: DataFrame, bits: int, cell_rows: int) -> DataFrame:
    """``rows`` with the rows of hot positions dealt over about one position for each half ``cell_rows`` of them.

    Hashes fill the cells of the ring evenly, so only cells of over twice the mean can hold a hot
    position; without one no row is shuffled. ``_row``, written with the rows, tells equal rows apart.
    """
    if not bits:
        return rows  # fewer rows than a cell takes
    full = rows.groupBy(_cell_of(bits).alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
    full = [r["_cell"] for r in full.where(F.col("_n") > 2 * cell_rows).limit(HOT_CELLS + 1).collect()]
    if not full:
        return rows
    inside = rows if len(full) > HOT_CELLS else rows.where(_cell_of(bits).isin(full))
    hot = inside.groupBy("_pos").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > cell_rows)
    hot = materialize(hot, "ring-hot-positions")
    hot = F.broadcast(hot) if hot.count() <= HOT_CELLS else hot
    ways = F.ceil(2 * F.col("_n") / cell_rows)
    salt = F.pmod(F.xxhash64("text_crc32", "_row"), ways)
    moved = _position_of(F.concat_ws("#", F.col("_pos"), salt).cast("binary"))
    return rows.join(hot, "_pos", "left").withColumn("_pos", F.when(F.col("_n").isNull(), F.col("_pos")).otherwise(moved)).drop("_n")


def _cell_of(bits: int) -> Column:
    return F.shiftright("_pos", RING_BITS - bits) if bits else F.lit(0).cast("long")  # all of the ring


def shard_documents(docs: DataFrame, shards: int = 24, vnodes: int = 128, cell_rows: int = 50_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of ``docs``."""
    points = ring_points(shards, vnodes)
    owners = [s for _, s in points]
    ladder = np.array([p for p, _ in points], dtype=np.int64)

    @F.arrow_udf("int")
    def arc_of(position: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(ladder, position.to_numpy(zero_copy_only=False)).astype(np.int32))

    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    key = F.coalesce(F.col("doc_id").cast("string").cast("binary"), data)
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(data) + 8).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        _position_of(key).alias("_pos"),
        F.monotonically_increasing_id().alias("_row"),
    )
    rows = materialize(rows, "ring-rows")

    n = rows.count()
    bits = min(RING_BITS, (n // cell_rows).bit_length())
    rows = spread_hot_positions(rows, bits, cell_rows).withColumn("_arc", arc_of("_pos")).withColumn("_cell", _cell_of(bits))
    cells = materialize(rows.groupBy("_arc", "_cell").agg(F.count(F.lit(1)).alias("_n")), "ring-cells")
    per_arc = {r["_arc"]: r["n"] for r in cells.groupBy("_arc").agg(F.sum("_n").alias("n")).collect()}
    runs = walk([per_arc.get(a, 0) for a in range(len(points) + 1)], owners, capacities(n, shards))

    # Runs in ring order; a shard's slots go on from run to run.
    starts = np.array([(arc << 40) + first for arc, first, _, _ in runs], dtype=np.int64)
    homes = np.array([shard for *_, shard in runs], dtype=np.int32)
    filled, slots = [0] * shards, []
    for _, _, length, shard in runs:
        slots.append(filled[shard])
        filled[shard] += length
    slots = np.array(slots, dtype=np.int64)

    @F.arrow_udf("shard int, slot long")
    def place(arc: pa.Array, rank: pa.Array) -> pa.Array:
        at = (arc.to_numpy(zero_copy_only=False).astype(np.int64) << 40) + rank.to_numpy(zero_copy_only=False)
        run = np.searchsorted(starts, at, side="right") - 1
        return pa.StructArray.from_arrays([pa.array(homes[run]), pa.array(slots[run] + at - starts[run])], ["shard", "slot"])

    in_cell = Window.partitionBy("_arc", "_cell").orderBy("_pos", "doc_id", "size", "text_crc32", "_row")
    bases = running_base(cells, "_cell", "_n", "_before", part="_arc").select("_arc", "_cell", "_before")
    return (
        rows.withColumn("_rank", F.row_number().over(in_cell) - 1)
        .join(bases, ["_arc", "_cell"])
        .withColumn("_at", place("_arc", F.col("_before") + F.col("_rank")))
        .select(
            "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("_at.shard").alias("shard"),
            F.col("_at.slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )
