"""NTILE by its cut rows: selection instead of a sort.

NTILE(k) needs only the last row of each of the first k - 1 tiles. These rows are found by
refining histograms: each pass counts, for every cut still open, the rows of its interval
in ``bins`` bins, and the interval becomes the bin that holds the cut's place. A pass is one
partial aggregate whose result, at most (k - 1) x ``bins`` counts whatever the input, goes to
the driver. After log(span) / log(bins) passes the cut's value is known, then in the same way
its key among the rows with that value. No row is sorted, numbered, shuffled or written; the
tile of a row is the number of cuts before it.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

BINS = 4096
_WHOLE = "decimal(38,0)"


def _lit(number: int) -> Column:
    return F.lit(Decimal(number)).cast(_WHOLE)


def _select(rows: DataFrame, number: str, groups: list[Column], places: list[int], lo: int, hi: int, bins: int) -> list[tuple[int, int]]:
    """For each place (1 is the smallest) the number there, among the rows of its group, and how many of them are smaller."""
    found = [(lo, hi, 0) for _ in places]
    while any(a < b for a, b, _ in found):
        widths = {i: -(-(b - a + 1) // bins) for i, (a, b, _) in enumerate(found) if a < b}
        entries = [
            F.when(
                groups[i] & F.col(number).between(_lit(found[i][0]), _lit(found[i][1])),
                F.struct(F.lit(i).alias("cut"), F.call_function("div", F.col(number) - _lit(found[i][0]), _lit(w)).alias("bin")),
            )
            for i, w in widths.items()
        ]
        inside = rows.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).groupBy("e.cut", "e.bin")
        counts: dict[int, list] = {i: [] for i in widths}
        for r in inside.agg(F.count(F.lit(1)).alias("n")).collect():  # at most cuts x bins rows
            counts[r["cut"]].append((r["bin"], r["n"]))
        for i, w in widths.items():
            a, b, before = found[i]
            for at, n in sorted(counts[i]):
                if before + n >= places[i]:
                    break
                before += n
            a += at * w
            found[i] = (a, min(b, a + w - 1), before)
    return [(a, before) for a, _, before in found]


def _whole(df: DataFrame, name: str) -> Column:
    """A decimal or integer column in units of its last digit."""
    kind = df.schema[name].dataType
    scale = kind.scale if isinstance(kind, DecimalType) else 0
    return (F.col(name).cast(f"decimal(38,{scale})") * F.lit(Decimal(10**scale)).cast("decimal(38,0)")).cast(_WHOLE) if scale else F.col(name).cast(_WHOLE)


def ntile_cuts(df: DataFrame, value: str, key: str, k: int, bins: int = BINS) -> tuple[DataFrame, list[tuple[int, int]]]:
    """``df`` with the two columns it is ordered by, and the (value, key) of the last row of tiles 1 to k - 1 in them."""
    rank, tie = "_cut_rank", "_cut_tie"
    numbered = df.withColumns({rank: -_whole(df, value), tie: _whole(df, key)})
    total, lo, hi, low_key, high_key = numbered.agg(F.count(F.lit(1)), F.min(rank), F.max(rank), F.min(tie), F.max(tie)).first()
    last = int(hi) + 1 if hi is not None else 0  # rows without a value come last
    numbered = numbered.withColumn(rank, F.coalesce(rank, _lit(last)))
    if not total:
        return numbered, []
    size, longer = divmod(total, k)
    places = [min(total, i * size + min(i, longer)) for i in range(1, k)]
    everything = [F.lit(True)] * len(places)
    values = _select(numbered, rank, everything, places, int(lo) if lo is not None else last, last, bins)
    ties = [F.col(rank) == _lit(v) for v, _ in values]
    keys = _select(numbered, tie, ties, [p - before for p, (_, before) in zip(places, values, strict=True)], int(low_key), int(high_key), bins)
    return numbered, [(v, t) for (v, _), (t, _) in zip(values, keys, strict=True)]


def ntile_by_cuts(df: DataFrame, value: str, key: str, k: int, name: str, bins: int = BINS) -> DataFrame:
    """Append NTILE(k) OVER (ORDER BY value DESC NULLS LAST, key) without sorting.

    ``value`` and ``key`` are integers or decimals; ``key`` is not null and unique among rows of
    one value. ``df`` is read once for each pass, so it should be a written table.
    """
    numbered, cuts = ntile_cuts(df, value, key, k, bins)
    rank, tie = F.col("_cut_rank"), F.col("_cut_tie")
    tile = F.lit(1)
    for v, t in cuts:
        tile = tile + ((rank > _lit(v)) | ((rank == _lit(v)) & (tie > _lit(t)))).cast("int")
    return numbered.withColumn(name, tile).drop("_cut_rank", "_cut_tie")
