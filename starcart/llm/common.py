"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else (``lower`` would change other scripts)."""
    return F.translate(col, _ASCII_UPPER, _ASCII_UPPER.lower())


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def total_bytes(df: DataFrame, text: str = "text", per_row: int = 16) -> int:
    """UTF-8 bytes of a text column plus ``per_row`` for each row (one aggregate, no shuffle of rows)."""
    row = df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    return int(row["b"]) + per_row * int(row["n"])


def running_base(df: DataFrame, key: str, value: str, out: str, part: str | None = None, block: int = 4096) -> DataFrame:
    """Exclusive prefix sum of ``value`` in ``key`` order, within ``part`` if given.

    ``key`` is a non-negative integer, one row per (part, key). Two levels: totals
    of blocks of ``block`` keys are accumulated first (one row per block), then
    rows within each block, so that no window holds all rows.
    """
    parts = [part] if part else []
    blocks = df.withColumn("_block", F.floor(F.col(key) / block))
    totals = blocks.groupBy(*parts, "_block").agg(F.sum(value).alias("_total"))
    over_blocks = Window.partitionBy(*(parts or [F.lit(0)])).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.withColumn("_block_base", F.coalesce(F.sum("_total").over(over_blocks), F.lit(0))).drop("_total")
    inside = Window.partitionBy(*parts, "_block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    summed = blocks.withColumn("_inner", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return (
        summed.join(bases, [*parts, "_block"])
        .withColumn(out, F.col("_block_base") + F.col("_inner"))
        .drop("_block", "_block_base", "_inner")
    )


def texts(column: pa.Array, step: int = 256) -> Iterator[str]:
    """Arrow strings as Python strings, null as empty, few at a time."""
    for at in range(0, len(column), step):
        for text in column.slice(at, step).to_pylist():
            yield text or ""


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


def release() -> None:
    """Give memory that a Python worker no longer uses back to the machine (workers live as long as the executor)."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def worker_value(key, make: Callable[[], object]):
    """A value kept by the Python worker from task to task (made once per process).

    A worker keeps one value: the next operator's replaces it, so the stages of a pipeline
    do not add up in memory.
    """
    kept = sys.modules.setdefault("_starcart_worker", types.ModuleType("_starcart_worker")).__dict__.setdefault("kept", {})
    if key not in kept:
        if kept:
            kept.clear()
            release()
        kept[key] = make()
    return kept[key]


class BoundedCache(dict):
    """A dict that empties itself when a batch would carry it over ``limit`` entries or ``most_bytes`` of keys.

    Bounds a worker's memory whatever the number and length of the keys in its partition.
    """

    def __init__(self, limit: int, most_bytes: int = 32 << 20):
        super().__init__()
        self.limit, self.most_bytes, self.held = limit, most_bytes, 0

    def fill(self, keys, make: Callable[[list], list]) -> None:
        """Add the missing ``keys``; ``make`` computes their values in one call."""
        missing = [k for k in keys if k not in self]
        if not missing:
            return
        size = sum(map(len, missing))
        if len(self) + len(missing) > self.limit or self.held + size > self.most_bytes:
            self.clear()
            missing = list(keys)
            self.held, size = 0, sum(map(len, missing))
        self.held += size
        self.update(zip(missing, make(missing), strict=True))


class Codes(dict):
    """Consecutive numbers for keys in the order in which they are first looked up."""

    def __missing__(self, key) -> int:
        code = self[key] = len(self)
        return code


class Ragged:
    """Number lists by code: added at the end, gathered by numpy."""

    def __init__(self, dtype):
        self.flat = np.empty(1 << 16, dtype)
        self.ends = np.zeros(1 << 12, np.int64)  # ends[i]: where list i - 1 ends
        self.count = 0

    def __len__(self) -> int:
        return self.count

    @staticmethod
    def _room(array: np.ndarray, size: int) -> np.ndarray:
        if size <= len(array):
            return array
        wider = np.empty(max(size, 2 * len(array)), array.dtype)
        wider[: len(array)] = array
        return wider

    def extend(self, values: np.ndarray, lengths: np.ndarray) -> None:
        used = int(self.ends[self.count])
        self.flat = self._room(self.flat, used + len(values))
        self.ends = self._room(self.ends, self.count + len(lengths) + 1)
        self.flat[used : used + len(values)] = values
        self.ends[self.count + 1 : self.count + 1 + len(lengths)] = used + np.cumsum(lengths)
        self.count += len(lengths)

    def take(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of ``codes`` one after the other, and the length of each."""
        starts = self.ends[codes]
        lengths = self.ends[codes + 1] - starts
        before = np.cumsum(lengths) - lengths
        return self.flat[np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))], lengths
