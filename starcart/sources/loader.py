"""Typed load with defaults and a reject table.

A database in strict mode refuses a row that breaks a rule; here the rules of a table are
compiled into one projection over the incoming rows. Per row it

1. casts every declared column to its declared type (a value that does not fit is a reason),
2. fills column defaults where the value is NULL,
3. gathers the reasons why the row cannot be loaded, in rule order:
   ``type:c``, ``not_null:c``, ``enum:c``, ``length:c``, ``key:c`` (no row of the referenced
   dimension) and ``duplicate:c`` (a later row with a primary or unique key that is taken).

Rows without a reason are loaded; the others go to the reject table with all their reasons
and the values they came with, so loaded plus rejected is the input.

Row rules cost no shuffle. References join the distinct keys of the dimension (a broadcast
when the dimension is small, which the runtime decides by its size). A duplicate is told by
a row number within its key; of rows with one key the first in ``first`` order is loaded.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schema as S
from .schema import TABLE_FIELDS, Star


@dataclass(frozen=True)
class TableRules:
    """What a table declares about the columns that are being loaded."""

    types: dict[str, T.DataType]
    required: list[str] = field(default_factory=list)
    defaults: dict[str, object] = field(default_factory=dict)
    enums: dict[str, list[str]] = field(default_factory=dict)
    lengths: dict[str, int] = field(default_factory=dict)
    unique: list[str] = field(default_factory=list)
    references: dict[str, tuple[str, str]] = field(default_factory=dict)  # column -> (table, its key)


def declared_rules(table: str, columns: list[str]) -> TableRules:
    """The declared rules of a warehouse table, for the columns present."""
    here = lambda rules: {c: v for (t, c), v in rules.items() if t == table and c in columns}
    fields = [f for f in S.SCHEMAS[table] if f.name in columns]
    single = [keys[table][0] for keys in (S.PRIMARY_KEYS, S.UNIQUE_KEYS) if table in keys and set(keys[table]) <= set(columns)]
    references = {c: (t, k) for _, c, t, k in S.FOREIGN_KEYS if table == "fact_order_line" and c in columns}
    return TableRules(
        types={f.name: f.dataType for f in fields}, required=[f.name for f in fields if not f.nullable],
        defaults=here(S.DEFAULTS), enums=here(S.ENUM_RULES), lengths=here(S.VARCHAR_LIMITS), unique=single, references=references,
    )


def _reason(broken: Column, kind: str, column: str) -> Column:
    return F.when(broken, F.lit(f"{kind}:{column}"))


def split(rows: DataFrame, rules: TableRules, dimensions: dict[str, DataFrame] | None = None, first: list[Column] | None = None) -> DataFrame:
    """``rows`` boxed as (came, row, reasons): as they came, typed and filled, and why not (empty: loaded)."""
    boxed = rows.select(F.struct("*").alias("came"))
    typed, reasons = [], []
    for name in rows.columns:
        came = F.col("came").getField(name)
        if name not in rules.types:
            typed.append(came.alias(name))
            continue
        value = came.try_cast(rules.types[name])
        reasons.append(_reason(came.isNotNull() & value.isNull(), "type", name))
        if name in rules.defaults:
            value = F.coalesce(value, F.lit(rules.defaults[name]).cast(rules.types[name]))
        typed.append(value.alias(name))
    boxed = boxed.select("came", F.struct(*typed).alias("row"), F.array(*reasons).alias("of_types"))
    value = lambda name: F.col("row").getField(name)
    reasons = [_reason(value(c).isNull() & F.col("came").getField(c).isNull(), "not_null", c) for c in rules.required]
    reasons += [_reason(~value(c).isin(list(allowed)), "enum", c) for c, allowed in rules.enums.items()]
    reasons += [_reason(F.length(value(c)) > most, "length", c) for c, most in rules.lengths.items()]
    for column, (table, key) in rules.references.items():
        known = dimensions[table].select(F.col(key).alias(f"_{column}")).distinct()
        boxed = boxed.join(known, value(column) == F.col(f"_{column}"), "left")
        reasons.append(_reason(value(column).isNotNull() & F.col(f"_{column}").isNull(), "key", column))
    for column in rules.unique:
        order = first or [F.xxhash64("came")]
        place = F.row_number().over(Window.partitionBy(value(column)).orderBy(*order))
        boxed = boxed.withColumn(f"_{column}", F.when(value(column).isNotNull(), place))
        reasons.append(_reason(F.col(f"_{column}") > 1, "duplicate", column))
    return boxed.select("came", "row", F.array_compact(F.concat("of_types", F.array(*reasons))).alias("reasons"))


def loaded(done: DataFrame) -> DataFrame:
    return done.where(F.size("reasons") == 0).select("row.*")


def rejected(done: DataFrame) -> DataFrame:
    """The rows that were refused, as they came, with ``reject_reasons``."""
    return done.where(F.size("reasons") > 0).select("came.*", F.col("reasons").alias("reject_reasons"))


def load_star(star: Star) -> dict[str, DataFrame]:
    """``split`` of every table of a star: dimensions first, the fact against what was loaded of them."""
    tables = star.tables()
    done = {name: split(tables[name], declared_rules(name, tables[name].columns)) for name in tables if name != "fact_order_line"}
    dimensions = {name: loaded(rows) for name, rows in done.items()}
    done["fact_order_line"] = split(star.fact, declared_rules("fact_order_line", star.fact.columns), dimensions)
    return {name: done[name] for name in TABLE_FIELDS}


def load_report(star: Star) -> DataFrame:
    """Rows of every table by outcome: (table_name, reasons, row_count, key_sum); loaded rows have the reasons ''.

    ``key_sum`` adds up the rows' first key column, so a row that changed sides shows.
    """
    reports = []
    for name, done in load_star(star).items():
        key = star.tables()[name].columns[0] if name != "fact_order_line" else "customer_key"
        reports.append(done.groupBy(F.array_join("reasons", ",").alias("reasons")).agg(
            F.count(F.lit(1)).alias("row_count"), F.sum(F.col("came").getField(key).cast("long")).alias("key_sum")
        ).select(F.lit(name).alias("table_name"), "reasons", "row_count", "key_sum"))
    out = reports[0]
    for report in reports[1:]:
        out = out.unionByName(report)
    return out
