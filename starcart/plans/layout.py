"""Two physical layouts of the fact: buckets by order, partitions by month.

Buckets. The warehouse's indexes serve lookups of one order and joins of lines that share
an order. ``bucketed_lines`` writes the (order, product) aggregate and the lines hashed into
buckets by order and sorted inside them. Then the aggregate of an order's lines and the
co-purchase self join read the buckets as they lie, without an exchange, and a lookup of an
order opens one bucket.

Months. ``month_lines`` writes the fact in one folder per calendar month. A predicate on the
calendar (a quarter, say) reaches the fact at run time: the months that survive are known
once the calendar is filtered, and only their folders are read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import basket, kpi
from ..session import stage_path
from ..sources.schema import Star
from .warehouse import COMPRESSION, once_per_star

ROWS_A_BUCKET = 2_000_000
LINES = "lines-by-order"
_TABLES: dict[tuple, str] = {}


def bucket_count(rows: int, least: int) -> int:
    """A power of two with about ``ROWS_A_BUCKET`` rows in each, and ``least`` at least."""
    wanted = max(least, -(-rows // ROWS_A_BUCKET))
    return 1 << (wanted - 1).bit_length()


def save_bucketed(df: DataFrame, name: str, key: str, sort: list[str], buckets: int, in_place: bool = False) -> str:
    """Write ``df`` as a table of sorted buckets in the shared folder; returns its name in the catalog.

    ``in_place``: the rows come from as many buckets of the same key and still lie in them."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    table = re.sub(r"\W", "_", path.rsplit("/", 1)[1])
    # One task for each bucket, so that each is one sorted file.
    rows = df if in_place else df.repartition(buckets, key)
    rows.write.bucketBy(buckets, key).sortBy(*sort).option("path", path).option("compression", COMPRESSION).mode("overwrite").saveAsTable(table)
    return table


def _bucketed(star: Star, name: str, make, sort: list[str], from_lines: bool = False) -> DataFrame:
    """A bucketed table of a star, written once per application for a materialised star.

    ``from_lines``: made from the bucketed lines, bucket by bucket."""
    spark = star.product.sparkSession
    key = (spark.sparkContext.applicationId, star.origin or id(star), name)
    if key not in _TABLES:
        rows = make()
        if from_lines:
            buckets = int(spark.sql(f"DESCRIBE EXTENDED {_TABLES[(*key[:2], LINES)]}").where("col_name = 'Num Buckets'").first()["data_type"])
        else:
            least = int(spark.conf.get("spark.sql.shuffle.partitions"))
            buckets = bucket_count(rows.count(), min(least, 4096))
        _TABLES[key] = save_bucketed(rows, name, "order_id", sort, buckets, in_place=from_lines)
    return spark.table(_TABLES[key])


def bucketed_lines(star: Star) -> DataFrame:
    """The fact's lines in buckets by order."""
    return _bucketed(star, LINES, lambda: star.lines, ["order_id", "product_key"])


def bucketed_products(star: Star) -> DataFrame:
    """(order, product, n_dates, last_date) in buckets by order, made from the bucketed lines without an exchange."""
    return _bucketed(star, "products-by-order", lambda: order_products_in_place(star), ["order_id", "product_key"], from_lines=True)


def order_products_in_place(star: Star) -> DataFrame:
    """The (order, product) aggregate of the bucketed lines."""
    return basket.order_products(star, basket.order_product_facts(star.with_fact(bucketed_lines(star))))


def pairs_in_place(items: DataFrame, block_size: int = basket.DEFAULT_BLOCK_SIZE) -> DataFrame:
    """Pair rows of every order, joined bucket by bucket.

    Orders of more than ``block_size`` products are few (their number is bounded by
    rows / block_size); they leave for the blocked join, so no order's pairs are all made in
    one task.
    """
    sizes = items.groupBy("order_id").agg(F.count(F.lit(1)).alias("m"))
    big = sizes.where(F.col("m") > block_size).select("order_id")
    rest, out = items, None
    if big.take(1):
        rest = items.join(big, "order_id", "left_anti")
        out = basket.pair_rows(items.join(big, "order_id", "left_semi"), block_size).select(
            "source_product_key", "candidate_product_key", "cnt", "last"
        )
    rows = basket.pair_rows_of_orders(rest)
    return rows if out is None else rows.unionByName(out)


def product_pairs_bucketed(star: Star) -> DataFrame:
    """U18 from the bucketed tables: the fact is shuffled once, when it is written."""
    return basket.aggregate_pairs(pairs_in_place(bucketed_products(star)))


def order_lookup(star: Star, order_id: str) -> DataFrame:
    """The lines of one order; one bucket is opened."""
    lines = bucketed_lines(star)
    return lines.where(F.col("order_id") == order_id)


# --- months --------------------------------------------------------------------------------


def with_month_key(fact: DataFrame) -> DataFrame:
    """``month_key``: year and month of the date key (yyyymm)."""
    return fact.withColumn("month_key", F.floor(F.col("date_key") / 100).cast("int"))


def write_months(fact: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per month; a month's lines are spread over as many files as they need."""
    keyed = with_month_key(fact)
    keyed.hint("rebalance", "month_key").write.mode(mode).partitionBy("month_key").parquet(path)


_MONTHS: dict[tuple, str] = {}


def month_lines(star: Star) -> DataFrame:
    """The fact in month folders, written once per application for a materialised star."""
    spark = star.product.sparkSession
    key = (spark.sparkContext.applicationId, star.origin or id(star))
    if key not in _MONTHS:
        _MONTHS[key] = stage_path(spark, "lines-by-month")
        write_months(star.fact, _MONTHS[key])
    return spark.read.parquet(_MONTHS[key])


def quarter_kpis(star: Star, year: int, quarter: int) -> DataFrame:
    """U1 for one quarter: the calendar's predicate picks the month folders that are read."""
    days = star.date.where((F.col("year") == year) & (F.ceil(F.col("month") / 3) == quarter))
    months = days.select(F.floor(F.col("date_key") / 100).cast("int").alias("month_key")).distinct()
    # At most a row a month: the broadcast is bounded by the calendar.
    fact = month_lines(star).join(F.broadcast(months), "month_key")
    return kpi.monthly_kpis(star.with_fact(fact))


def latest_quarter_kpis(star: Star) -> DataFrame:
    """U1 for the last quarter of the calendar that has all its three months."""
    quarter = F.ceil(F.col("month") / 3).cast("int").alias("quarter")
    whole = star.date.select("year", quarter, "month").distinct().groupBy("year", "quarter").agg(F.count(F.lit(1)).alias("m")).where("m = 3")
    last = whole.orderBy(F.desc("year"), F.desc("quarter")).first()
    return quarter_kpis(star, *((last["year"], last["quarter"]) if last else (0, 1)))


# --- distinct counts that merge -------------------------------------------------------------


def distinct_state(star: Star, column: str) -> DataFrame:
    """(year, month, bucket, bits): which values of a dense positive key occur in each month, as bitmaps.

    A bitmap covers 32 768 keys, so a month has as many rows as the key's range has buckets;
    bitmaps of months merge by OR into those of any longer period.
    """
    cal = star.date.select("date_key", "year", "month")
    lines = star.fact.select("date_key", F.col(column).cast("long").alias("k")).where("k is not null").join(F.broadcast(cal), "date_key")
    return lines.groupBy("year", "month", F.bitmap_bucket_number("k").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("k")).alias("bits")
    )


def distinct_by_period(star: Star, column: str, count: str) -> DataFrame:
    """Exact distinct values of ``column`` by month, quarter and year from one stored state:
    (period, year, part, ``count``); ``part`` is the month or quarter number, 0 for years."""
    state = once_per_star(star, f"distinct-{column}", lambda: distinct_state(star, column))
    parts = {"month": F.col("month"), "quarter": F.ceil(F.col("month") / 3), "year": F.lit(0)}
    out = None
    for period, part in parts.items():
        merged = state.groupBy("year", part.cast("int").alias("part"), "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        counted = merged.groupBy("year", "part").agg(F.sum(F.bitmap_count("bits")).cast("long").alias(count))
        counted = counted.select(F.lit(period).alias("period"), F.col("year").cast("int").alias("year"), "part", count)
        out = counted if out is None else out.unionByName(counted)
    return out


def lookup_first_order(star: Star) -> DataFrame:
    """The lines of the first order (by id), looked up in its bucket."""
    first = star.fact.agg(F.min("order_id")).first()[0]
    return order_lookup(star, first) if first is not None else star.fact.limit(0)


def drop_tables(spark: SparkSession) -> None:
    """Forget the bucketed tables of this application (their files go with it)."""
    application = spark.sparkContext.applicationId
    for key in [k for k in _TABLES if k[0] == application]:
        spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop(key)}")
