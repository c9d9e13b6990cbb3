"""Baskets and co-purchase pairs (calculation 17).

Semantics: a basket item is a DISTINCT (order, product, ship date) triple, so a
product bought on two dates of one order counts twice. For a pair a < b the
co-purchase count is the number of joined triples, i.e. the sum over orders of
n_a * n_b (n = distinct dates of the product in the order), and the last date
is the latest of the two products' dates within any shared order.

Scale: items are first collapsed to (order, product, n_dates, last_date), so
the self-join sees distinct products, not lines. The self-join keys on
(order, lo_block, hi_block): an order with more than ``block_size`` distinct
products is split into hash blocks and every block pair becomes its own join
key, so one huge basket is spread over many tasks (each at most block_size^2
pairs) instead of enumerating all of its pairs in one task. Ordinary orders
have one block and no replication. The list of big orders is joined by AQE's
runtime choice, or -- when the caller counts it first -- skipped when empty,
broadcast when small, shuffle-joined beyond that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.schema import Star

DEFAULT_BLOCK_SIZE = 2048


def basket_items(star: Star) -> DataFrame:
    """DISTINCT (order_id, product_key, full_date) of lines with a known date."""
    cal = star.date.select("date_key", "full_date")
    return (
        star.fact.select("order_id", "product_key", "date_key")
        .join(F.broadcast(cal), "date_key")
        .select("order_id", "product_key", "full_date")
        .distinct()
    )


MARGIN_UNITS = 10 ** 8  # line margins are summed as exact longs in 1e-8 units


def line_margin_units(profit, net):
    """profit / net of one line in 1e-8 units (round half up), 0 when net = 0.

    IEEE double operations on the two decimals, then an exact long: the sums
    are the same whatever the partitioning, and cheap (no 38-digit division).
    """
    q = F.floor(profit.cast("double") / net.cast("double") * F.lit(1e8) + F.lit(0.5)).cast("long")
    return F.when(net == 0, F.lit(0).cast("long")).otherwise(q)


def order_product_facts(star: Star) -> DataFrame:
    """One pass over the fact: per (order, product) the distinct dated days,
    the latest date, the line count and the summed line margins.

    Serves the basket (n_dates > 0), popularity (one row = one distinct order of
    the product) and margin (sums of sums). The calendar is LEFT joined
    (bounded by days, broadcast), so undated lines still count for popularity
    and margin, as they do in the fact-only signals. The days of a group are
    gathered as a set (bounded by the calendar) in the same aggregate, so the
    lines are shuffled once, on (order_id, product_key), after a partial
    aggregation.
    """
    cal = star.date.select("date_key", "full_date")
    lines = star.lines.select("order_id", "product_key", "date_key", "profit_amount", "net_amount").join(
        F.broadcast(cal), "date_key", "left"
    )
    return lines.groupBy("order_id", "product_key").agg(
        F.size(F.collect_set("full_date")).cast("long").alias("n_dates"),
        F.max("full_date").alias("last_date"),
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(line_margin_units(F.col("profit_amount"), F.col("net_amount"))).alias("margin_units"),
    )


def order_products(star: Star, facts: DataFrame | None = None) -> DataFrame:
    """(order, product) -> number of distinct dates and the latest date (dated lines only)."""
    facts = facts if facts is not None else order_product_facts(star)
    return facts.where(F.col("n_dates") > 0).select("order_id", "product_key", "n_dates", "last_date")


BIG_ORDER_BROADCAST_LIMIT = 1_000_000  # rows of the big-order list we broadcast


def big_orders(items: DataFrame, block_size: int = DEFAULT_BLOCK_SIZE) -> DataFrame:
    """Orders with more than ``block_size`` distinct products, and their number of blocks."""
    sizes = items.groupBy("order_id").agg(F.count(F.lit(1)).alias("_m"))
    return sizes.filter(F.col("_m") > block_size).select(
        "order_id", F.ceil(F.col("_m") / F.lit(block_size)).cast("int").alias("_nb")
    )


def tag_blocks(items: DataFrame, block_size: int = DEFAULT_BLOCK_SIZE,
               sizes_from: DataFrame | None = None) -> DataFrame:
    """Tag each item with its block inside its order (0 for ordinary orders).

    Orders with more than ``block_size`` distinct products get
    ceil(m / block_size) hash blocks. Lazy by default: the join with the
    big-order list is left to AQE, which broadcasts it at run time when it is
    small. With ``sizes_from`` (a materialised items table) the list is
    counted first -- one small job -- and the join is skipped when no order is
    big, broadcast when the list has at most BIG_ORDER_BROADCAST_LIMIT rows,
    and a shuffle join beyond that.
    """
    big = big_orders(sizes_from if sizes_from is not None else items, block_size)
    if sizes_from is not None:
        n_big = big.count()
        if n_big == 0:
            return items.withColumn("_nb", F.lit(1)).withColumn("_blk", F.lit(0))
        if n_big <= BIG_ORDER_BROADCAST_LIMIT:
            big = F.broadcast(big)
    tagged = items.join(big, "order_id", "left").withColumn(
        "_nb", F.coalesce(F.col("_nb"), F.lit(1))
    )
    return tagged.withColumn(
        "_blk", F.pmod(F.xxhash64("product_key"), F.col("_nb")).cast("int")
    )


def pair_rows(items: DataFrame | None = None, block_size: int = DEFAULT_BLOCK_SIZE,
              carry: list[str] | None = None, tagged: DataFrame | None = None) -> DataFrame:
    """Per-order pair rows (a, b) with a != b, each unordered pair once per order.

    ``items`` has order_id, product_key, n_dates, last_date and optional
    ``carry`` attribute columns. Output: order_id, source/candidate keys with
    source < candidate, cnt = n_a * n_b, last = greatest(last_a, last_b) and the
    carried attributes suffixed _s / _c.

    ``tagged`` lets a caller pass its own ``tag_blocks`` output, e.g. one whose
    big-order list was counted first (no join at all when no order is big).
    """
    carry = carry or []
    t = tagged if tagged is not None else tag_blocks(items, block_size)
    cols = ["product_key", "n_dates", "last_date", *carry]
    left = t.select(
        "order_id",
        F.col("_blk").alias("_lo"),
        F.explode(F.sequence(F.col("_blk"), F.col("_nb") - 1)).alias("_hi"),
        *[F.col(c).alias(f"{c}_l") for c in cols],
    )
    right = t.select(
        "order_id",
        F.explode(F.sequence(F.lit(0), F.col("_blk"))).alias("_lo"),
        F.col("_blk").alias("_hi"),
        *[F.col(c).alias(f"{c}_r") for c in cols],
    )
    joined = left.join(right, ["order_id", "_lo", "_hi"]).where(
        (F.col("_lo") < F.col("_hi")) | (F.col("product_key_l") < F.col("product_key_r"))
    )
    l_first = F.col("product_key_l") < F.col("product_key_r")

    def pick(c: str, smaller: bool):
        a, b = F.col(f"{c}_l"), F.col(f"{c}_r")
        return F.when(l_first, a if smaller else b).otherwise(b if smaller else a)

    return joined.select(
        "order_id",
        pick("product_key", True).alias("source_product_key"),
        pick("product_key", False).alias("candidate_product_key"),
        (F.col("n_dates_l") * F.col("n_dates_r")).alias("cnt"),
        F.greatest(F.col("last_date_l"), F.col("last_date_r")).alias("last"),
        *[pick(c, True).alias(f"{c}_s") for c in carry],
        *[pick(c, False).alias(f"{c}_c") for c in carry],
    )


def pair_rows_of_orders(items: DataFrame) -> DataFrame:
    """``pair_rows`` of orders that all have one block. Both sides of the self-join are the same
    rows as they stand, so one exchange (or none, of buckets) serves both."""
    a, b = items.alias("a"), items.alias("b")
    joined = a.join(b, (F.col("a.order_id") == F.col("b.order_id")) & (F.col("a.product_key") < F.col("b.product_key")))
    return joined.select(
        F.col("a.product_key").alias("source_product_key"), F.col("b.product_key").alias("candidate_product_key"),
        (F.col("a.n_dates") * F.col("b.n_dates")).alias("cnt"), F.greatest("a.last_date", "b.last_date").alias("last"),
    )


def aggregate_pairs(rows: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Sum counts / latest date per unordered pair (partial aggregation map-side,
    so a pair shared by a third of all orders collapses before the shuffle).

    Carried attributes depend only on the product keys, so they join the
    grouping key: the aggregate stays a hash aggregate (string-valued buffers
    such as any_value would force a sort-based one).
    """
    carry = carry or []
    extra = [f"{c}_{r}" for c in carry for r in ("s", "c")]
    return rows.groupBy("source_product_key", "candidate_product_key", *extra).agg(
        F.sum("cnt").alias("co_purchase_count"),
        F.max("last").alias("last_together_date"),
    )


def product_pairs(star: Star, block_size: int = DEFAULT_BLOCK_SIZE) -> DataFrame:
    """Unordered co-purchase pairs (source < candidate), count and last date."""
    return aggregate_pairs(pair_rows(order_products(star), block_size))


def mirrored(pairs: DataFrame) -> DataFrame:
    """Every pair in both directions (the UNION ALL of pair and mirror)."""
    mirror = pairs.select(
        F.col("candidate_product_key").alias("source_product_key"),
        F.col("source_product_key").alias("candidate_product_key"), "co_purchase_count", "last_together_date",
    )
    return pairs.unionByName(mirror)


def directed_pairs(star: Star, block_size: int = DEFAULT_BLOCK_SIZE) -> DataFrame:
    """U19 on the star."""
    return mirrored(product_pairs(star, block_size))
