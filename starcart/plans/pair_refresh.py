"""Keep the co-purchase pairs current as lines arrive, without recounting all orders.

State, in one folder:

    items/batch=i   (order, product, n_dates, last_date) as it stands after batch i, for the
                    items that the batch changed; the highest batch holds
    days/batch=i    the (order, product, day) triples first seen in batch i
    pairs/batch=i   what batch i adds to the pairs: (source, candidate, count, last day)

A batch's changed items are joined with all items of their orders (new x old and
new x new): a pair's count grows by n'a n'b - na nb, its last day is the later one. Counts
add up and days only grow, so the mart is the sum and the maximum over the batches, and a
batch costs its own orders only. ``compact`` folds the batches into one.

A batch counts once its pairs are marked ``_SUCCESS`` (they are written last); a failed batch
is written over by its repetition. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.basket import DEFAULT_BLOCK_SIZE, aggregate_pairs
from ..session import finished
from ..sources.schema import Star

PAIR = ["source_product_key", "candidate_product_key"]


class PairMart:
    """Incrementally kept pairs."""

    def __init__(self, spark: SparkSession, folder: str, block_size: int = DEFAULT_BLOCK_SIZE):
        self.spark, self.folder, self.block_size = spark, folder.rstrip("/"), block_size

    def _path(self, table: str, batch: int) -> str:
        return f"{self.folder}/{table}/batch={batch}"

    def batches(self) -> int:
        n = 0
        while finished(self.spark, self._path("pairs", n)):
            n += 1
        return n

    def _read(self, table: str) -> DataFrame | None:
        n = self.batches()
        if not n:
            return None
        return self.spark.read.option("basePath", f"{self.folder}/{table}").parquet(*[self._path(table, i) for i in range(n)])

    def _write(self, df: DataFrame, table: str, batch: int) -> DataFrame:
        df.write.mode("overwrite").parquet(self._path(table, batch))
        return self.spark.read.parquet(self._path(table, batch))

    def items(self) -> DataFrame | None:
        """Every item as it stands now."""
        stored = self._read("items")
        if stored is None:
            return None
        if self.batches() == 1:  # a batch holds an item once
            return stored.drop("batch")
        now = F.max_by(F.struct("n_dates", "last_date"), "batch").alias("now")
        return stored.groupBy("order_id", "product_key").agg(now).select("order_id", "product_key", "now.*")

    def pairs(self) -> DataFrame | None:
        """The pairs over all batches."""
        stored = self._read("pairs")
        if stored is None:
            return None
        return stored.groupBy(*PAIR).agg(
            F.sum("co_purchase_count").alias("co_purchase_count"), F.max("last_together_date").alias("last_together_date")
        )

    def add(self, star: Star, lines: DataFrame) -> DataFrame:
        """Take in new fact lines (dates by the star's calendar); returns the pairs that changed, with the growth of each."""
        batch = self.batches()
        cal = star.date.select("date_key", "full_date")
        days = lines.select("order_id", "product_key", "date_key").join(F.broadcast(cal), "date_key")
        days = days.select("order_id", "product_key", "full_date").distinct()
        known_days, known = self._read("days"), self.items()
        if known_days is not None:
            days = days.join(known_days.drop("batch"), ["order_id", "product_key", "full_date"], "left_anti")
        days = self._write(days, "days", batch)
        fresh = days.groupBy("order_id", "product_key").agg(F.count(F.lit(1)).alias("more"), F.max("full_date").alias("latest"))
        if known is None:
            old = fresh.select("order_id", "product_key", F.lit(0).cast("long").alias("n_dates"), F.lit(None).cast("date").alias("last_date")).limit(0)
        else:  # of the orders that changed
            old = known.join(days.select("order_id").distinct(), "order_id", "left_semi")
        merged = fresh.join(old, ["order_id", "product_key"], "full_outer").select(
            "order_id", "product_key", F.coalesce("n_dates", F.lit(0)).alias("before"),
            (F.coalesce("n_dates", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n_dates"),
            F.greatest("latest", "last_date").alias("last_date"), F.col("more").isNotNull().alias("changed"),
        )
        touched = self._write(merged, "touched", batch)
        self._write(touched.where("changed").select("order_id", "product_key", "n_dates", "last_date"), "items", batch)
        return self._write(self._growth(touched), "pairs", batch)

    def _growth(self, touched: DataFrame) -> DataFrame:
        """What the changed items add to the pairs of their orders; large orders are joined in blocks."""
        blocks = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("order_id")) / self.block_size).cast("int")
        spread = touched.withColumn("blocks", blocks)
        block = F.pmod(F.xxhash64("product_key"), F.col("blocks")).cast("int")
        # A changed item meets every block of its order.
        new = spread.where("changed").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).alias("x")
        every = spread.withColumn("block", block).alias("y")
        same = (F.col("x.order_id") == F.col("y.order_id")) & (F.col("x.block") == F.col("y.block"))
        once = (F.col("x.product_key") != F.col("y.product_key")) & (~F.col("y.changed") | (F.col("x.product_key") < F.col("y.product_key")))
        rows = new.join(every, same & once).select(
            F.least("x.product_key", "y.product_key").alias(PAIR[0]), F.greatest("x.product_key", "y.product_key").alias(PAIR[1]),
            (F.col("x.n_dates") * F.col("y.n_dates") - F.col("x.before") * F.col("y.before")).alias("cnt"),
            F.greatest("x.last_date", "y.last_date").alias("last"),
        )
        return aggregate_pairs(rows)

    def touched_sources(self, batch: int) -> DataFrame:
        """The products whose recommendations a batch can change through their pairs."""
        changed = self.spark.read.parquet(self._path("pairs", batch))
        both = F.explode(F.array(*PAIR)).alias("source_product_key")
        return changed.select(both).distinct()

    def compact(self, folder: str) -> PairMart:
        """The same mart with all batches folded into one, in another folder."""
        other = PairMart(self.spark, folder, self.block_size)
        other._write(self._read("days").drop("batch"), "days", 0)
        other._write(self.items(), "items", 0)
        other._write(self.pairs(), "pairs", 0)
        return other
