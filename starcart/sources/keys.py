"""Dense surrogate keys that stay put when rows are appended.

What AUTO_INCREMENT gives a table: the rows of a load get the numbers after the highest
one given so far, and a row that is known keeps its number. ``KeyRegistry`` stores the
(natural key, surrogate key) pairs in one folder per load:

    <folder>/load=0/...parquet   <folder>/load=1/...parquet   ...

A load's new natural keys are those without a stored partner (one anti join on the key);
they are numbered in parallel (``global_row_number``: ranges, counts per range, no single
task) from the stored maximum on. A load counts once its ``_SUCCESS`` mark is written: a
failed one is invisible and its folder is written over by the next attempt. One writer at a
time is assumed, as with the table it numbers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranking import global_row_number
from ..session import finished


class KeyRegistry:
    """Surrogate keys ``name`` (1, 2, 3, ...) of the natural keys ``natural``."""

    def __init__(self, spark: SparkSession, folder: str, natural: list[str], name: str):
        self.spark, self.folder, self.natural, self.name = spark, folder.rstrip("/"), natural, name

    def _path(self, load: int) -> str:
        return f"{self.folder}/load={load}"

    def loads(self) -> int:
        """Number of finished loads."""
        load = 0
        while finished(self.spark, self._path(load)):
            load += 1
        return load

    def keys(self) -> DataFrame | None:
        """All stored pairs; None before the first load."""
        paths = [self._path(i) for i in range(self.loads())]
        return self.spark.read.parquet(*paths).select(*self.natural, self.name) if paths else None

    def append(self, rows: DataFrame, order: list[Column] | None = None) -> DataFrame:
        """Number the natural keys of ``rows`` that are new, in ``order`` (the natural key by
        default); returns the pairs of this load. Repeated keys are one, a null part is a
        value like any other."""
        load, known = self.loads(), self.keys()
        new, highest = rows.select(*self.natural).distinct(), 0
        if known is not None:
            same = reduce(lambda a, b: a & b, [F.col(f"n.{c}").eqNullSafe(F.col(f"k.{c}")) for c in self.natural])
            new = new.alias("n").join(known.select(*self.natural).alias("k"), same, "left_anti")
            highest = known.agg(F.coalesce(F.max(self.name), F.lit(0))).first()[0]
        order = order or [F.col(c).asc_nulls_first() for c in self.natural]
        numbered = global_row_number(new, order, "_number").select(*self.natural, (F.col("_number") + highest).alias(self.name))
        numbered.write.mode("overwrite").parquet(self._path(load))
        return self.spark.read.parquet(self._path(load))

    def keyed(self, rows: DataFrame) -> DataFrame:
        """``rows`` with their surrogate key (null for a natural key that was never loaded)."""
        known = self.keys()
        if known is None:
            return rows.withColumn(self.name, F.lit(None).cast("long"))
        renamed = known.select(*[F.col(c).alias(f"_key_{c}") for c in self.natural], self.name)
        same = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(renamed[f"_key_{c}"]) for c in self.natural])
        return rows.join(renamed, same, "left").drop(*[f"_key_{c}" for c in self.natural])
