"""A join that takes the heavy hitters of its key apart.

Rows of a key that holds a large share of the big side would meet in one task of a shuffle
join. A sketch of the key's most frequent values names them (at most ``most``, whatever the
input); their rows join by broadcast where they lie, all others by the join that the
optimizer picks. The sketch only decides which way a row takes, never the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_HOT = 1024  # heavy hitters that are taken apart at most
HOT_SHARE = 1 / 4096  # a key above this share of the rows is one


def hot_keys(df: DataFrame, key: str, most: int = MOST_HOT, share: float = HOT_SHARE) -> list:
    """At most ``most`` values of ``key`` that hold more than ``share`` of the rows with a key.

    Counts come from a mergeable sketch (one partial aggregate, one small row a task); a value
    near the share may be missed or named without need, which costs time only.
    """
    tops = F.expr(f"approx_top_k(`{key}`, {most}, {10 * most})")
    row = df.agg(F.count(key).alias("n"), tops.alias("tops")).first()
    return [t["item"] for t in row["tops"] or [] if t["item"] is not None and t["count"] > share * row["n"]]


def split_join(big: DataFrame, small: DataFrame, key: str, hot: list, how: str = "inner") -> DataFrame:
    """``big`` joined with ``small`` on ``key`` (``inner`` or ``left``), the keys in ``hot`` by broadcast.

    ``small`` has few rows for a key (one in a dimension), so what is broadcast is bounded by
    the length of ``hot``. Rows of ``big`` without a key match nothing; in a left join they
    stay where they lie. Column order is that of a join by name.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"split_join cannot do {how}")
    if not hot and how == "inner":
        return big.join(small, key, how)

    def is_hot(null: bool) -> Column:
        return F.coalesce(F.col(key).isin(hot), F.lit(null)) if hot else F.isnull(key) & F.lit(null)

    apart = big.where(is_hot(True)).join(F.broadcast(small.where(is_hot(False))), key, how)
    rest = big.where(~is_hot(True)).join(small.where(~is_hot(False)), key, how)
    return apart.unionByName(rest)
