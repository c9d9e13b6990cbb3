"""Top-4 co-purchase recommendations (calculations 17-21).

For every source product, candidates are the *active* products bought in the
same orders. Each directed pair is scored

    100 * (0.40 freq + 0.25 recency + 0.10 category + 0.10 popularity
           + 0.10 margin + 0.05)

with freq = count / max count of the source, recency = exp(-age / 90) / its
maximum over the source, popularity and margin divided by their maxima over all
scored rows, category = 1.0 same subcategory, 0.5 same parent, else 0; NULL
signals count as 0. Rank 1..4 per source by the unrounded score, ties by
candidate key. Maxima are taken after the joins and the active filter.

Plan (one large shuffle per step, none on a single partition):
  * product signals (popularity, mean line margin) come from the (order, product)
    aggregate and are written with the product attributes, one narrow row a product;
  * the aggregated pairs are written once with four columns; attributes join them
    where they are used, by a broadcast of checked size;
  * pairs come from the self-join in ``basket`` (huge baskets split into blocks; without
    one the two sides share an exchange);
  * per-source maxima are a partial aggregate (a hot source collapses
    map-side); hot sources (bounded in number) are split over salts and their
    maxima copied per salt, so the scored rows shuffle once, on
    (source, salt), for both the join and the first ranking window; the
    second ranking sees at most 4 rows per salt of a source;
  * per-source maxima and counts are a small table written beside the pairs; the
    global maxima are one scalar subquery over it;
  * names are attached after the <= 4 filter.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import round_dec
from ..functions.skew import hot_keys, split_join
from ..plans.warehouse import once_per_star
from ..session import materialize
from ..sources.schema import Star
from .basket import (
    DEFAULT_BLOCK_SIZE,
    MARGIN_UNITS,
    aggregate_pairs,
    big_orders,
    mirrored,
    line_margin_units,
    order_product_facts,
    order_products,
    pair_rows,
    pair_rows_of_orders,
    tag_blocks,
)

# Score weights and the recency time constant (days).
WEIGHTS = {
    "freq": 0.40,
    "recency": 0.25,
    "category": 0.10,
    "popularity": 0.10,
    "margin": 0.10,
    "availability": 0.05,
}
RECENCY_DAYS = 90.0
TOP_K = 4
SALT_BUDGET = 4096  # most salts over all hot sources
MIN_HOT_ROWS = 100_000  # a source below this many scored rows is never split

# ------------------------------------------------------------ signals ----

def product_signals(star: Star, facts: DataFrame | None = None) -> DataFrame:
    """Per product in the fact: distinct orders and the mean line margin (double).

    Aggregates the per-(order, product) facts, so the fact is scanned once for
    the basket and the signals together; margin sums are exact longs.
    """
    facts = facts if facts is not None else order_product_facts(star)
    agg = facts.groupBy("product_key").agg(
        F.count(F.lit(1)).alias("product_order_count"),
        # a product of any size: the sum of its orders' margins outgrows a long
        F.sum(F.col("margin_units").cast("decimal(20,0)")).alias("_msum"),
        F.sum("n_lines").alias("_mcnt"),
    )
    return agg.select(
        "product_key", "product_order_count",
        (F.col("_msum").cast("double") / F.col("_mcnt").cast("double") / F.lit(float(MARGIN_UNITS)))
        .alias("margin_avg"),
        "_msum", "_mcnt",
    )


def candidate_popularity(star: Star) -> DataFrame:
    """Distinct orders per product."""
    return star.fact.groupBy("product_key").agg(F.countDistinct("order_id").alias("product_order_count"))


def candidate_margin(star: Star) -> DataFrame:
    """Mean of line profit / net (0 for a zero net); lines in 1e-8 units, mean
    rounded half up to 8 decimals. The lines are grouped by product at once: one
    partial row per product leaves each task."""
    units = line_margin_units(F.col("profit_amount"), F.col("net_amount")).cast("decimal(20,0)")
    s = star.fact.groupBy("product_key").agg(F.sum(units).alias("_msum"), F.count(F.lit(1)).alias("_mcnt"))
    # Narrow before scaling: decimal(38,0) * decimal(9,8) would exceed 38 digits
    # and Spark would cut the scale to 6.
    mean = F.round(F.col("_msum").cast("decimal(38,0)") / F.col("_mcnt"), 0).cast("decimal(20,0)")
    return s.select(
        "product_key",
        (mean * F.lit("0.00000001").cast("decimal(9,8)")).cast("decimal(22,8)").alias("avg_margin_ratio"),
    )


# ------------------------------------------------------------- scoring ----

ATTRS_BROADCAST_ROWS = 2_000_000  # product rows (some 60 bytes each) that are broadcast to the pairs


def _product_attrs(star: Star, facts: DataFrame) -> DataFrame:
    """Attributes and signals of every product of the fact (``in_dim`` false without a dimension row)."""
    prod = star.product.select(
        "product_key", "subcategory",
        F.coalesce(F.col("is_active"), F.lit(False)).alias("is_active"),
        F.lit(True).alias("in_dim"),
    )
    signals = product_signals(star, facts).select("product_key", "product_order_count", "margin_avg")
    return signals.join(prod, "product_key", "left").withColumn("in_dim", F.coalesce(F.col("in_dim"), F.lit(False)))


def _basket_facts(star: Star) -> DataFrame:
    """``order_product_facts``, written once: items, signals and order sizes prune it differently."""
    return once_per_star(star, "order-products", lambda: order_product_facts(star))


def product_attrs(star: Star) -> DataFrame:
    """Attributes and signals of every product of the fact, written once (one narrow row a product)."""
    return once_per_star(star, "product-attrs", lambda: _product_attrs(star, _basket_facts(star)))


def pair_mart(star: Star, block_size: int = DEFAULT_BLOCK_SIZE) -> DataFrame:
    """The co-purchase pairs as parquet: two keys, count and last date.

    Pairs are aggregated and stored on the two keys alone, so the largest shuffle and
    every later read carry four narrow columns; attributes join where they are used.
    Written once to the shared checkpoint folder (this also cuts the lineage back through
    the self-join if executors are lost). For a materialised star (``star.origin``) the
    mart is built once per application and reused by every recommendation query on it.
    """
    def make() -> DataFrame:
        items = order_products(star, _basket_facts(star))
        if big_orders(items, block_size).isEmpty():
            return aggregate_pairs(pair_rows_of_orders(items))
        return aggregate_pairs(pair_rows(tagged=tag_blocks(items, block_size, sizes_from=items)))

    return once_per_star(star, f"pairs-{block_size}", make)


def directed_candidates(star: Star, block_size: int = DEFAULT_BLOCK_SIZE, broadcast_rows: int | None = None, again: bool = False) -> DataFrame:
    """Directed pairs whose source is a known product and candidate an active one.

    The attributes of a product are joined to the mirrored pairs once for each side: by
    broadcast while ``product_attrs`` (one row a product) counts no more than
    ``broadcast_rows`` (ATTRS_BROADCAST_ROWS), else by a join that takes the hot products
    apart (``functions/skew.py``) and shuffles the rest. ``again``: the rows are read more
    than once, so what such a join gives is written.
    """
    attrs = product_attrs(star)
    limit = ATTRS_BROADCAST_ROWS if broadcast_rows is None else broadcast_rows
    few = attrs.count() <= limit  # a written table: read from its footers

    def named(side: str, key: str, rows: DataFrame, columns: list[str]) -> DataFrame:
        return F.broadcast(rows.select(F.col("product_key").alias(key), *[F.col(c).alias(f"{c}_{side}") for c in columns]))

    known = attrs.where("in_dim")
    is_candidate = F.expr("is_active and product_order_count is not null and margin_avg is not null")
    if not few:
        def joined() -> DataFrame:
            return _joined_by_shuffle(pair_mart(star, block_size), known.withColumn("ok", is_candidate))

        return _both_directions(once_per_star(star, f"joined-pairs-{block_size}", joined) if again else joined())
    active = known.where(is_candidate)
    sources = named("s", "source_product_key", known, ["subcategory"])
    candidates = named("c", "candidate_product_key", active, ["subcategory", "product_order_count", "margin_avg"])
    pairs = mirrored(pair_mart(star, block_size))
    return pairs.join(candidates, "candidate_product_key").join(sources, "source_product_key")


def _joined_by_shuffle(pairs: DataFrame, attrs: DataFrame) -> DataFrame:
    """Pairs with both products' attributes by shuffle joins, before they are mirrored: half as
    many rows move as there are directed pairs."""
    columns = ["subcategory", "product_order_count", "margin_avg", "ok"]

    def side(name: str, key: str) -> DataFrame:
        return attrs.select(F.col("product_key").alias(key), *[F.col(c).alias(f"{c}_{name}") for c in columns])

    # Mirrored pairs hold a product as often on either side: one sketch serves both joins.
    hot = hot_keys(mirrored(pairs), "source_product_key")
    known = split_join(pairs, side("a", "source_product_key"), "source_product_key", hot)
    known = split_join(known, side("b", "candidate_product_key"), "candidate_product_key", hot)
    return known.where("ok_a or ok_b")


def _both_directions(known: DataFrame) -> DataFrame:
    """The directed candidates of ``_joined_by_shuffle``: a row is one of the forward pair if the
    second product may be a candidate, and one of the backward pair if the first may."""
    def direction(source: str, candidate: str, s: str, c: str) -> Column:
        return F.struct(
            F.col(source).alias("source_product_key"), F.col(candidate).alias("candidate_product_key"),
            "co_purchase_count", "last_together_date", F.col(f"subcategory_{c}").alias("subcategory_c"),
            F.col(f"product_order_count_{c}").alias("product_order_count_c"), F.col(f"margin_avg_{c}").alias("margin_avg_c"),
            F.col(f"subcategory_{s}").alias("subcategory_s"), F.col(f"ok_{c}").alias("_ok"),
        )

    keys = ["source_product_key", "candidate_product_key"]
    both = F.array(direction(*keys, "a", "b"), direction(*reversed(keys), "b", "a"))
    return known.select(F.inline(both)).where("_ok").drop("_ok")


def source_stats(star: Star, block_size: int = DEFAULT_BLOCK_SIZE) -> DataFrame:
    """Per source: maxima over its candidates and their number, written beside the mart."""
    def make() -> DataFrame:
        return directed_candidates(star, block_size, again=True).groupBy("source_product_key").agg(
            F.max("co_purchase_count").alias("_max_cnt"),
            F.max("last_together_date").alias("_max_last"),
            F.max("product_order_count_c").alias("_max_pop"),
            F.max("margin_avg_c").alias("_max_margin"),
            F.count(F.lit(1)).alias("_n"),
        )

    return once_per_star(star, f"source-stats-{block_size}", make)


def copurchase_pairs(star: Star, block_size: int = DEFAULT_BLOCK_SIZE) -> DataFrame:
    """U18 read from the pair mart: every co-purchased pair (source < candidate)."""
    return pair_mart(star, block_size).select(
        "source_product_key", "candidate_product_key", "co_purchase_count", "last_together_date"
    )


def copurchase_directed(star: Star, block_size: int = DEFAULT_BLOCK_SIZE) -> DataFrame:
    """U19 read from the pair mart: every pair in both directions."""
    return mirrored(copurchase_pairs(star, block_size))


def _text(c: Column, collation: str | None) -> Column:
    """Text for comparison: binary by default, or under a collation such as
    UNICODE_CI_AI (case- and accent-insensitive, like the warehouse's
    utf8mb4_unicode_ci)."""
    return F.collate(c, collation) if collation else c


def _with_parents(d: DataFrame, star: Star, collation: str | None = None) -> DataFrame:
    """LEFT JOIN the category of source and candidate subcategory (by name).

    The category dimension is short; the runtime broadcasts it when its size says so.
    Duplicate category names fan out rows exactly as the SQL join does.
    """
    cat = star.category.select("category_name", "parent_category")
    sc = cat.select(F.col("category_name").alias("_sn"), F.col("parent_category").alias("parent_s"))
    cc = cat.select(F.col("category_name").alias("_cn"), F.col("parent_category").alias("parent_c"))
    d = d.join(sc, _text(d["subcategory_s"], collation) == _text(sc["_sn"], collation),
               "left").drop("_sn")
    return d.join(cc, _text(d["subcategory_c"], collation) == _text(cc["_cn"], collation),
                  "left").drop("_cn")


def category_match_expr(collation: str | None = None) -> Column:
    s, c = F.col("subcategory_s"), F.col("subcategory_c")
    ps, pc = F.col("parent_s"), F.col("parent_c")
    same_sub = _text(F.coalesce(s, F.lit("")), collation) == _text(F.coalesce(c, F.lit("")), collation)
    same_parent = _text(ps, collation) == _text(pc, collation)
    return (
        F.when(same_sub & s.isNotNull(), F.lit(1.0))
        .when(same_parent & ps.isNotNull(), F.lit(0.5))
        .otherwise(F.lit(0.0))
    )


BOUND_CLASSES = 16  # hash classes of candidates whose best scores bound a source's k-th


def prune_candidates(cands: DataFrame, stats: DataFrame, raw, k: int = TOP_K, classes: int = BOUND_CLASSES) -> DataFrame:
    """The candidates that can be among the ``k`` best of their source, whatever their category.

    ``raw(match)`` is a pair's score given its category signal, which lies between 0 and 1, so
    every pair has a least and a most possible score before the category is known. A source's
    k-th largest least score is bounded from below by the k-th of its hash classes' largest
    ones (each is another pair's): a plain aggregate of maxima that collapses map-side. Pairs
    whose most possible score is below that bound have k better ones and leave, before the
    category joins, the salting and the ranking. Rounding is monotone, so the bounds hold for
    the floating-point scores as they are computed.
    """
    few = stats.count() <= ATTRS_BROADCAST_ROWS  # a written table, one row a source

    def by_source(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if few else table

    known = cands.join(by_source(stats.select("source_product_key", "_max_cnt", "_max_last")), "source_product_key")
    without, same = raw(F.lit(0.0)), raw(F.lit(1.0))
    known = known.withColumns({"_least": F.least(without, same), "_most": F.greatest(without, same)})
    part = F.pmod(F.xxhash64("candidate_product_key"), F.lit(classes))
    tops = known.groupBy("source_product_key").agg(*[F.max(F.when(part == j, F.col("_least"))).alias(f"_c{j}") for j in range(classes)])
    best = F.sort_array(F.array_compact(F.array(*[F.col(f"_c{j}") for j in range(classes)])), asc=False)
    floors = materialize(tops.select("source_product_key", F.get(best, F.lit(k - 1)).alias("_floor")), "score-floors")
    kept = known.join(by_source(floors), "source_product_key").where("_floor is null or _most >= _floor")
    return kept.select(*cands.columns)


def scored_pairs(
    star: Star,
    zero: str = "null",
    as_of: _dt.date | None = None,
    block_size: int = DEFAULT_BLOCK_SIZE,
    salt_budget: int = SALT_BUDGET,
    min_hot_rows: int = MIN_HOT_ROWS,
    weights: dict[str, float] | None = None,
    collation: str | None = None,
    prune: int = 0,
    broadcast_rows: int | None = None,
) -> DataFrame:
    """Every scored directed pair (U22-U26), with the raw double score ``_score``.

    prune: if not 0, only the pairs that can be among so many best of their source
    (see ``prune_candidates``).

    zero="null" (default): normalisation by the maxima with NULL on zero; the
    recency ratio then equals exp(-(newest - last) / 90) and needs no clock.
    zero="floor": the embedded copy's guards (max(x, 1), max(x, 0.001)) and a
    clock ``as_of`` for the recency decay.
    collation: compare subcategory / category text under a collation
    (e.g. "UNICODE_CI_AI"); default binary.
    salt_budget / min_hot_rows: a source is hot when it owns more than
    max(N / salt_budget, min_hot_rows) of the N scored rows; it is then split
    into that many salts (see ``_salt_hot_sources``).
    """
    w = {**WEIGHTS, **(weights or {})}
    stats = source_stats(star, block_size)
    cands = directed_candidates(star, block_size, broadcast_rows, again=True)
    # Global maxima and the row count from the small table of sources.
    glob = stats.select(F.struct(F.max("_max_pop").alias("pop"), F.max("_max_margin").alias("margin"))).scalar()
    max_pop = F.col("_glob.pop")
    max_margin = F.col("_glob.margin")

    cnt = F.col("co_purchase_count").cast("double")
    pop = F.col("product_order_count_c").cast("double")
    margin = F.col("margin_avg_c")
    if zero == "floor":
        if as_of is None:
            raise ValueError("zero='floor' needs as_of for the recency clock")
        clock = F.lit(as_of).cast("date")
        decay = F.exp(-F.datediff(clock, F.col("last_together_date")) / F.lit(RECENCY_DAYS))
        best = F.exp(-F.datediff(clock, F.col("_max_last")) / F.lit(RECENCY_DAYS))
        freq = cnt / F.greatest(F.col("_max_cnt").cast("double"), F.lit(1.0))
        recency = decay / F.greatest(best, F.lit(0.001))
        popularity = pop / F.greatest(max_pop.cast("double"), F.lit(1.0))
        margin_n = margin / F.greatest(max_margin, F.lit(0.001))
    else:
        freq = F.when(F.col("_max_cnt") == 0, F.lit(None)).otherwise(cnt / F.col("_max_cnt").cast("double"))
        recency = F.exp(-F.datediff(F.col("_max_last"), F.col("last_together_date")) / F.lit(RECENCY_DAYS))
        popularity = F.when(max_pop == 0, F.lit(None)).otherwise(pop / max_pop.cast("double"))
        margin_n = F.when(max_margin == 0, F.lit(None)).otherwise(margin / max_margin)

    def raw(match: Column) -> Column:
        return (
            F.lit(w["freq"]) * F.coalesce(freq, F.lit(0.0))
            + F.lit(w["recency"]) * F.coalesce(recency, F.lit(0.0))
            + F.lit(w["category"]) * F.coalesce(match, F.lit(0.0))
            + F.lit(w["popularity"]) * F.coalesce(popularity, F.lit(0.0))
            + F.lit(w["margin"]) * F.coalesce(margin_n, F.lit(0.0))
            + F.lit(w["availability"]) * F.lit(1.0)
        )

    if prune:
        cands = prune_candidates(cands.withColumn("_glob", glob), stats, raw, prune).drop("_glob")
    d = _with_parents(cands, star, collation).withColumn("category_match", category_match_expr(collation))
    # Statistics are taken before the category joins: the fan-out cannot change a
    # maximum, and the row count only steers salting.
    rows = stats.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    d = _salt_hot_sources(d, stats, rows, salt_budget, min_hot_rows)
    # Bound to a column once, so the subquery appears (and runs) once; after the rows have moved.
    d = d.withColumn("_glob", glob)

    d = d.select(
        "source_product_key", "candidate_product_key", "_salt", "co_purchase_count",
        "last_together_date",
        F.col("product_order_count_c").alias("product_order_count"),
        F.col("margin_avg_c").alias("avg_margin_ratio"),
        "category_match",
        freq.alias("freq_norm"),
        recency.alias("recency_norm"),
        popularity.alias("popularity_norm"),
        margin_n.alias("margin_norm"),
        raw(F.col("category_match")).alias("_score"),
    )
    return d


def _rounded_score() -> Column:
    """The shown score: taken where it is read, so that the rows which are ranked do not carry it."""
    return round_dec(F.lit(100.0) * F.col("_score")).alias("recommendation_score")


def recommendation_scores(star: Star, **kw) -> DataFrame:
    """U23-U26 as a table: every scored pair with its signals (6 decimals)."""
    s = scored_pairs(star, **kw)
    return s.select(
        "source_product_key", "candidate_product_key", "co_purchase_count", "last_together_date",
        "product_order_count",
        round_dec(F.col("category_match"), 1, 3).alias("category_match"),
        round_dec(F.col("freq_norm"), 6).alias("freq_norm"),
        round_dec(F.col("recency_norm"), 6).alias("recency_norm"),
        round_dec(F.col("popularity_norm"), 6).alias("popularity_norm"),
        round_dec(F.col("margin_norm"), 6).alias("margin_norm"),
        _rounded_score(),
    )


def category_match(star: Star, **kw) -> DataFrame:
    """The category signal of every scored pair (1.0 / 0.5 / 0.0); needs no statistics."""
    collation = kw.get("collation")
    pairs = directed_candidates(star, kw.get("block_size", DEFAULT_BLOCK_SIZE), kw.get("broadcast_rows"))
    d = _with_parents(pairs, star, collation)
    return d.select(
        "source_product_key", "candidate_product_key",
        round_dec(category_match_expr(collation), 1, 3).alias("category_match"),
    )


def _salt_hot_sources(d: DataFrame, stats: DataFrame, rows_bound: int, budget: int,
                      min_rows: int) -> DataFrame:
    """Attach the per-source maxima, splitting hot sources over several salts.

    ``stats`` is the written table of per-source maxima and row counts. With N <= rows_bound scored rows and
    unit = max(rows_bound / budget, min_rows), a source owning n > unit rows
    gets ceil(n / unit) salts, every other source one. Fewer than ``budget``
    sources can exceed rows_bound / budget, so the hot list has a proven bound
    and is broadcast; rows take their salt from a hash of
    the candidate. The maxima are copied once per salt of their source (at most
    #sources + budget rows), so rows and maxima meet in one shuffle on
    (source, salt), which the first ranking window reuses. A source holding a
    third of all pairs is thus spread over about budget / 3 tasks.
    """
    unit = max(-(-rows_bound // budget), min_rows)
    stats = stats.withColumn("_ns", F.greatest(F.ceil(F.col("_n") / F.lit(unit)), F.lit(1)).cast("int"))
    hot = stats.where(F.col("_ns") > 1).select("source_product_key", "_ns")
    rows = d.join(F.broadcast(hot), "source_product_key", "left").withColumn(
        "_salt", F.pmod(F.xxhash64("candidate_product_key"), F.coalesce(F.col("_ns"), F.lit(1))).cast("int")
    ).drop("_ns")
    maxima = stats.select(
        "source_product_key", "_max_cnt", "_max_last",
        F.explode(F.sequence(F.lit(0), F.col("_ns") - 1)).alias("_salt"),
    )
    return rows.join(maxima, ["source_product_key", "_salt"])


def _rank_top_k(scored: DataFrame, k: int) -> DataFrame:
    order = [F.col("_score").desc(), F.col("candidate_product_key").asc()]
    # Stage 1 on (source, salt): the partitioning the maxima join already has.
    first = scored.withColumn(
        "_rn1", F.row_number().over(Window.partitionBy("source_product_key", "_salt").orderBy(*order))
    ).where(F.col("_rn1") <= k)
    # Stage 2 on source: at most k rows per salt of the source.
    return first.withColumn(
        "recommendation_rank",
        F.row_number().over(Window.partitionBy("source_product_key").orderBy(*order)),
    ).where(F.col("recommendation_rank") <= k)


def recommendation_top4(star: Star, k: int = TOP_K, **kw) -> DataFrame:
    """<= k recommendations per source product, with product attributes."""
    ranked = _rank_top_k(scored_pairs(star, **kw), k).select(
        "source_product_key", "candidate_product_key", _rounded_score(),
        F.col("recommendation_rank").cast("int").alias("recommendation_rank"),
    )
    p = star.product
    src = p.select(
        F.col("product_key").alias("source_product_key"),
        F.col("product_id").alias("source_product_id"),
        F.col("product_name").alias("source_product_name"),
    )
    cand = p.select(
        F.col("product_key").alias("candidate_product_key"),
        F.col("product_id").alias("candidate_product_id"),
        F.col("product_name").alias("candidate_product_name"),
        F.col("brand").alias("candidate_brand"),
        F.col("subcategory").alias("candidate_subcategory"),
        F.col("unit_price").alias("candidate_price"),
    )
    out = ranked.join(src, "source_product_key").join(cand, "candidate_product_key")
    return out.select(
        "source_product_key", "source_product_id", "source_product_name",
        "candidate_product_key", "candidate_product_id", "candidate_product_name",
        "candidate_brand", "candidate_subcategory", "candidate_price",
        "recommendation_score", "recommendation_rank",
    )


def recommendations_for_product(star: Star, product_key: int, **kw) -> DataFrame:
    """The <= 4 recommendations of one product, in rank order.

    On demand this recomputes the batch table and filters it; the serving path
    (``plans.build``) reads the persisted table instead, where the key filter
    prunes files.
    """
    recs = recommendation_top4(star, **kw)
    return recs.where(F.col("source_product_key") == F.lit(product_key)).orderBy("recommendation_rank")
