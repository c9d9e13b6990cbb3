"""Data-quality checks: row counts, orphan keys, arithmetic, declared constraints.

The warehouse's database enforced keys, NOT NULL, enums and lengths at write
time; Spark does not, so these checks report violations as
(check_name, issue_count) rows. Every check is an aggregate: nothing is
collected, and each fact pass is pruned to the columns it needs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import schema as S
from ..sources.schema import Star

TOLERANCE = "0.02"  # fixed value: absolute tolerance of the arithmetic checks


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def dq_row_counts(star: Star) -> DataFrame:
    """Rows per table."""
    return _union([
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )
        for name, df in star.tables().items()
    ])


ORPHAN_CHECKS = [  # fixed values: (check name, fact key, dimension table)
    ("missing_date", "date_key", "dim_date"),
    ("missing_customer", "customer_key", "dim_customer"),
    ("missing_product", "product_key", "dim_product"),
    ("missing_category", "category_key", "dim_category"),
    ("missing_payment", "payment_key", "dim_payment"),
    ("missing_shipping", "shipping_key", "dim_shipping"),
]


def dq_orphans(star: Star) -> DataFrame:
    """Fact rows whose key has no dimension row, per foreign key.

    The fact is first counted per key value (partial aggregation: one row per
    distinct key leaves each task), then anti-joined with the dimension keys,
    so the join sees distinct keys rather than order lines.
    """
    tables = star.tables()
    frames = []
    for name, key, dim in ORPHAN_CHECKS:
        per_key = star.fact.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        keys = tables[dim].select(key)
        missing = per_key.join(keys, per_key[key].eqNullSafe(keys[key]), "left_anti")
        frames.append(
            missing.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("issue_count"))
            .select(F.lit(name).alias("check_name"), "issue_count")
        )
    return _union(frames)


def dq_arithmetic(star: Star) -> DataFrame:
    """net = gross - discount and profit = net - cost within 0.02; quantity > 0.

    One pass over the fact with three conditional counts, unpivoted to rows.
    """
    tol = F.lit(TOLERANCE).cast("decimal(4,2)")
    f = star.fact
    agg = f.agg(
        F.count_if(F.abs(F.col("net_amount") - (F.col("gross_amount") - F.col("discount_amount"))) > tol)
        .alias("invalid_net_formula"),
        F.count_if(F.abs(F.col("profit_amount") - (F.col("net_amount") - F.col("cost_amount"))) > tol)
        .alias("invalid_profit_formula"),
        F.count_if(F.col("quantity") <= 0).alias("invalid_quantity"),
    )
    return agg.select(F.expr(
        "stack(3, 'invalid_net_formula', invalid_net_formula, "
        "'invalid_profit_formula', invalid_profit_formula, "
        "'invalid_quantity', invalid_quantity) as (check_name, issue_count)"
    ))


def constraint_rules(columns: dict[str, list[str]]) -> list[tuple[str, str, str, object]]:
    """The declared rules that apply to the columns a star actually has.

    ``columns`` maps table name -> its columns. Returns
    (check_name, table, kind, argument); kind is pk / unique / not_null / enum / length.
    """
    cols = {name: set(c) for name, c in columns.items()}
    rules: list[tuple[str, str, str, object]] = []
    for table, key in S.PRIMARY_KEYS.items():
        if set(key) <= cols[table]:
            rules.append((f"pk_{table}_{'_'.join(key)}", table, "pk", key))
    for table, key in S.UNIQUE_KEYS.items():
        if set(key) <= cols[table]:
            rules.append((f"unique_{table}_{'_'.join(key)}", table, "unique", key))
    for table, schema in S.SCHEMAS.items():
        for field in schema:
            if not field.nullable and field.name in cols[table] and [field.name] != S.PRIMARY_KEYS.get(table):
                rules.append((f"not_null_{table}_{field.name}", table, "not_null", field.name))
    for (table, c), allowed in S.ENUM_RULES.items():
        if c in cols[table]:
            rules.append((f"enum_{table}_{c}", table, "enum", (c, allowed)))
    for (table, c), limit in S.VARCHAR_LIMITS.items():
        if c in cols[table]:
            rules.append((f"length_{table}_{c}", table, "length", (c, limit)))
    return rules


def dq_constraints(star: Star) -> DataFrame:
    """Violations of the declared PK / UNIQUE / NOT NULL / ENUM / length rules.

    pk / unique: number of key values present more than once; a primary key
    also counts rows with a NULL key part (UNIQUE allows NULLs). not_null /
    enum / length: offending rows. Row-level rules of one table are folded into
    one aggregate pass; key rules are a partial aggregate per key.
    """
    tables = star.tables()
    rules = constraint_rules({name: df.columns for name, df in tables.items()})
    frames = []
    row_rules: dict[str, list[tuple[str, object]]] = {}
    for name, table, kind, arg in rules:
        df = tables[table]
        if kind in ("pk", "unique"):
            key = list(arg)
            any_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])
            groups = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
            dups = F.count_if((F.col("_n") > 1) & ~any_null)
            if kind == "pk":
                dups = dups + F.coalesce(F.sum(F.when(any_null, F.col("_n"))), F.lit(0))
            frames.append(groups.agg(dups.cast("long").alias("issue_count"))
                          .select(F.lit(name).alias("check_name"), "issue_count"))
        else:
            if kind == "not_null":
                cond = F.col(arg).isNull()
            elif kind == "enum":
                c, allowed = arg
                cond = F.col(c).isNotNull() & ~F.col(c).isin(list(allowed))
            else:
                c, limit = arg
                cond = F.length(F.col(c)) > F.lit(limit)
            row_rules.setdefault(table, []).append((name, cond))
    for table, checks in row_rules.items():
        # One pass per table; the single result row is unpivoted with stack, so
        # the aggregate is not recomputed once per check.
        agg = tables[table].agg(*[F.count_if(cond).alias(f"c{i}") for i, (_, cond) in enumerate(checks)])
        pairs = ", ".join(f"'{name}', c{i}" for i, (name, _) in enumerate(checks))
        frames.append(agg.select(F.expr(f"stack({len(checks)}, {pairs}) as (check_name, issue_count)")))
    return _union(frames)


def corrupted_fact(fact: DataFrame) -> DataFrame:
    """The fault-injected copy of the fact used to prove the checks fire (FIXTURES D).

    Every row is kept; rules read the original columns: product -> -1 where
    customer % 97 = 0; net + 0.03 where product % 101 = 0; quantity -> 0 where
    product % 103 = 0.
    """
    pk = F.col("product_key")
    return fact.select(
        *[c for c in fact.columns if c not in ("product_key", "net_amount", "quantity")],
        F.when(F.col("customer_key") % 97 == 0, F.lit(-1).cast("long")).otherwise(pk).alias("product_key"),
        F.when(pk % 101 == 0, F.col("net_amount") + F.lit("0.03").cast("decimal(4,2)"))
        .otherwise(F.col("net_amount")).cast("decimal(10,2)").alias("net_amount"),
        F.when(pk % 103 == 0, F.lit(0).cast("decimal(10,2)")).otherwise(F.col("quantity"))
        .alias("quantity"),
    )


def scattered_fact(fact: DataFrame) -> DataFrame:
    """The whole fact with few baskets left: a line whose product key % 40 is not 1 moves
    to an order of its own product, so few products keep a pair and the coverage and
    missing-recommendation checks have something to find."""
    alone = F.concat(F.col("order_id"), F.lit("-"), F.col("product_key").cast("string"))
    return fact.withColumn("order_id", F.when(F.col("product_key") % 40 != 1, alone).otherwise(F.col("order_id")))


def zero_revenue_fact(fact: DataFrame) -> DataFrame:
    """The whole fact with the lines of every 7th product given away (net and profit 0)."""
    free = F.col("product_key") % 7 == 0
    zero = F.lit(0).cast("decimal(10,2)")
    for c in ("net_amount", "profit_amount"):
        fact = fact.withColumn(c, F.when(free, zero).otherwise(F.col(c)))
    return fact


def corrupted_star(star: Star) -> Star:
    """A star that breaks declared constraints by rule, all rows kept.

    Customers: a gender column with a value outside the enum for every 7th, no name for every
    13th. Products: every 50th twice, a name of 250 characters for every 60th. Payments: every
    method twice. Fact: no quantity where product % 89 = 0.
    """
    customer, product, payment = star.customer, star.product, star.payment
    key = F.col("customer_key")
    customer = customer.withColumn("gender", F.when(key % 7 == 0, "Unknown").otherwise("Other")).withColumn(
        "customer_name", F.when(key % 13 == 0, F.lit(None)).otherwise(F.col("customer_name"))
    )
    key = F.col("product_key")
    product = product.withColumn("product_name", F.when(key % 60 == 0, F.repeat(F.lit("x"), F.lit(250))).otherwise(F.col("product_name")))
    product = product.unionByName(product.where(key % 50 == 0))
    fact = star.fact.withColumn("quantity", F.when(key % 89 == 0, F.lit(None)).otherwise(F.col("quantity")))
    return Star(star.date, customer, star.category, product, payment.unionByName(payment), star.shipping, fact)
