"""Column helpers: null-safe arithmetic, rolling statistics, ranks, buckets, correlation.

A missing value is NULL everywhere and a division by zero gives NULL, so no
helper depends on the session's ANSI setting.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: ColumnLike, b: ColumnLike) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("date")


def rolling(fn, c: ColumnLike, n: int, over: WindowSpec | None = None) -> Column:
    """``fn`` over the last ``n`` rows, NULL unless all of them have a value."""
    frame = (over or by_symbol()).rowsBetween(-(n - 1), 0)
    return F.when(F.count(col(c)).over(frame) == n, fn(col(c)).over(frame))


def cumulative_product(growth: ColumnLike, over: WindowSpec) -> Column:
    return F.product(col(growth)).over(over.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def finite(c: ColumnLike) -> Column:
    """NaN and infinities as NULL."""
    x = col(c).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def average_rank(c: ColumnLike, partition: list[ColumnLike]) -> Column:
    """Ascending rank with ties averaged among the rows that have a value; NULL for the others."""
    x = col(c)
    over = Window.partitionBy(*[col(p) for p in partition], x.isNull()).orderBy(x)
    last = F.count(F.lit(1)).over(over)  # up to the last of the ties: places come from one order, with no sort of their own
    return F.when(x.isNotNull(), (F.rank().over(over) + last).cast("double") / 2)


def percent_rank_average(c: ColumnLike, partition: list[ColumnLike] | None = None) -> Column:
    """``average_rank`` over the number of values; NULL counts as 0."""
    keys = partition or [F.lit(1)]
    return F.coalesce(average_rank(c, keys) / F.count(col(c)).over(Window.partitionBy(*[col(k) for k in keys])), F.lit(0.0))


def first_rank(c: ColumnLike, partition: list[ColumnLike], tie: ColumnLike = "symbol", descending: bool = False) -> Column:
    """1..n by value, ties by ``tie``; NULL for rows without a value."""
    x = col(c)
    over = Window.partitionBy(*[col(p) for p in partition], x.isNull()).orderBy(x.desc() if descending else x.asc(), col(tie))
    return F.when(x.isNotNull(), F.row_number().over(over))


def bucket(rank: ColumnLike, n: ColumnLike, q: ColumnLike) -> Column:
    """Right-closed quantile bucket 1..q of rank 1..n, in whole numbers: max(1, ceil((rank - 1) * q / (n - 1)))."""
    r, n, q = col(rank).cast("long"), col(n).cast("long"), (F.lit(q) if isinstance(q, int) else col(q)).cast("long")
    up = F.floor(F.try_divide((r - 1) * q + n - 2, n - 1)).cast("int")
    return F.when(r.isNotNull(), F.greatest(F.lit(1), F.coalesce(up, F.lit(1))))


def correlation(a: ColumnLike, b: ColumnLike) -> Column:
    """Pearson correlation as an aggregate over rows with both values; NULL for a constant side."""
    both = col(a).isNotNull() & col(b).isNotNull()
    x, y = F.when(both, col(a).cast("double")), F.when(both, col(b).cast("double"))
    flat = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
    return F.when(~flat, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def information_ratio(c: ColumnLike) -> Column:
    """Mean over population deviation as an aggregate, 0 where that is 0 or missing."""
    return F.coalesce(F.when(F.stddev_pop(col(c)) > 0, ratio(F.avg(col(c)), F.stddev_pop(col(c)))), F.lit(0.0))


def positive_share(c: ColumnLike) -> Column:
    """Share of rows over 0 as an aggregate; a missing value is not."""
    return F.avg(F.coalesce((col(c) > 0).cast("double"), F.lit(0.0)))


def rounded(c: ColumnLike, digits: int = 6) -> Column:
    return F.round(col(c).cast("double"), digits)
