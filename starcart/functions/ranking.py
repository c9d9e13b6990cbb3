"""Global ranks without a single-partition window.

``Window.orderBy(...)`` with no partition moves every row to one task. For the
ranks over all products / all customers we number rows in parallel instead:

1. range-partition by the full sort key (value + entity key, so ties split too)
   and sort within partitions;
2. tag each row with its partition id and its position inside the partition,
   and write that once to the shared checkpoint folder (``materialize``), so
   the layout cannot move between the counting pass and the numbering pass,
   also when executors are lost;
3. count rows per partition (one row per partition), prefix-sum the counts
   (a window over #partitions rows) and broadcast that small table;
4. global row number = partition offset + local position.

NTILE and DENSE_RANK are derived from that number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

_PID = "_rk_pid"
BROADCAST_ROWS = 2_000_000  # most ranked values joined back by broadcast
_LOCAL = "_rk_local"


def global_row_number(
    df: DataFrame,
    order: list[Column],
    name: str = "row_number",
    total: str | None = None,
    num_partitions: int | None = None,
) -> DataFrame:
    """Append a 1..N row number following ``order`` (make it a total order).

    If ``total`` is given, the row count N is appended under that name too.
    """
    # Without an explicit count AQE may coalesce adjacent ranges (to its
    # advisory size), which keeps the order: partition ids stay increasing.
    ranged = df.repartitionByRange(num_partitions, *order) if num_partitions else df.repartitionByRange(*order)
    ranged = (
        ranged
        .sortWithinPartitions(*order)
        .withColumn(_PID, F.spark_partition_id())
        .withColumn(
            _LOCAL,
            F.monotonically_increasing_id() - F.col(_PID).cast("long") * F.lit(1 << 33),
        )
    )
    # Partition id and position are stored as columns, so the written copy
    # carries the layout with it however the files are split on re-read.
    fixed = materialize(ranged, "rownum")
    counts = fixed.groupBy(_PID).agg(F.count(F.lit(1)).alias("_rk_n"))
    # One row per partition: the unpartitioned window and the broadcast are bounded.
    before = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        _PID,
        F.coalesce(F.sum("_rk_n").over(before), F.lit(0)).alias("_rk_off"),
        F.sum("_rk_n").over(Window.partitionBy()).alias("_rk_total"),
    )
    out = fixed.join(F.broadcast(offsets), _PID).withColumn(
        name, F.col("_rk_off") + F.col(_LOCAL) + 1
    )
    if total:
        out = out.withColumn(total, F.col("_rk_total"))
    return out.drop(_PID, _LOCAL, "_rk_off", "_rk_total")


def ntile_from_row_number(rn: Column, total: Column, k: int) -> Column:
    """NTILE(k) of row ``rn`` among ``total`` rows (SQL semantics: the first
    total mod k tiles get one extra row)."""
    q = F.floor(total / k).cast("long")
    r = (total % k).cast("long")
    big = r * (q + 1)
    head = F.floor((rn + q) / (q + 1))  # ceil(rn / (q + 1))
    safe_q = F.greatest(q, F.lit(1))  # q = 0 only when total < k; the tail is then unused
    tail = r + F.floor((rn - big + safe_q - 1) / safe_q)  # r + ceil((rn - big) / q)
    return F.when(rn <= big, head).otherwise(tail).cast("int")


def ntile(df: DataFrame, order: list[Column], k: int, name: str,
          num_partitions: int | None = None) -> DataFrame:
    numbered = global_row_number(df, order, "_nt_rn", "_nt_total", num_partitions)
    return numbered.withColumn(
        name, ntile_from_row_number(F.col("_nt_rn"), F.col("_nt_total"), k)
    ).drop("_nt_rn", "_nt_total")


def dense_rank_desc(df: DataFrame, value: str, name: str,
                    num_partitions: int | None = None) -> DataFrame:
    """DENSE_RANK() OVER (ORDER BY value DESC), distributed.

    The distinct values are numbered (the aggregate collapses repeated values
    map-side, so a value shared by a third of the rows costs nothing), then the
    rank is joined back on the value. The join is many-to-one; a hot value is
    handled by AQE's skew-join split of the big side.
    """
    values = df.select(F.col(value).alias("_dr_v")).distinct()
    ranked = global_row_number(values, [F.col("_dr_v").desc_nulls_last()], "_dr_rank",
                               num_partitions=num_partitions)
    # The ranked values are a written table: counting them reads metadata only.
    # Broadcast them when that count is small, else a shuffle join.
    if ranked.count() <= BROADCAST_ROWS:
        ranked = F.broadcast(ranked)
    return df.join(ranked, df[value].eqNullSafe(ranked["_dr_v"])).select(
        *[df[c] for c in df.columns], F.col("_dr_rank").cast("int").alias(name)
    )


def assign_keys(df: DataFrame, order: list[Column], name: str,
                num_partitions: int | None = None) -> DataFrame:
    """Dense surrogate keys 1..N in ``order`` (what AUTO_INCREMENT gives on
    insert); monotonically_increasing_id is unique but not dense."""
    return global_row_number(df, order, name, num_partitions=num_partitions)
