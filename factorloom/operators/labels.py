"""Forward-return labels, the tradable universe, rebalance calendars, relevance labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.windows import bucket, by_symbol, first_rank, ratio, rolling


def add_labels(panel: DataFrame, horizons: tuple[int, ...] = (5, 10)) -> DataFrame:
    """``future_return_{h}d``: bought at the next open, sold at the close ``h`` rows ahead."""
    w = by_symbol()
    return panel.withColumns({f"future_return_{h}d": ratio(F.lead("close", h).over(w), F.lead("open", 1).over(w)) - 1 for h in horizons})


def add_universe(panel: DataFrame, min_listed_days: int = 250, min_amount: float = 30_000_000.0, window: int = 20) -> DataFrame:
    """``amount_20d`` and ``tradable_universe``: member, not special treatment, listed long enough, traded enough."""
    out = panel.withColumn("amount_20d", rolling(F.avg, "amount", window))
    open_to = F.col("in_universe") & ~F.col("is_st") & (F.col("listed_days") >= min_listed_days) & (F.col("amount_20d") >= min_amount)
    return out.withColumn("tradable_universe", F.coalesce(open_to, F.lit(False)))


def rebalance_dates(dates: DataFrame, weekday: int = 4) -> DataFrame:
    """Per ISO week the target weekday (Monday is 0) if it is a date, else the last date."""
    d = dates.select("date").distinct()
    best = F.max_by("date", F.struct(F.weekday("date") == weekday, F.col("date")))
    return d.groupBy(F.extract(F.lit("YEAROFWEEK"), "date").alias("y"), F.weekofyear("date").alias("w")).agg(best.alias("date")).select("date")


def every_nth_date(dates: DataFrame, n: int) -> DataFrame:
    """The first, and every n-th after it. One row per date meets in one task."""
    k = F.row_number().over(Window.orderBy("date")) - 1
    return dates.select("date", k.alias("k")).where(F.col("k") % n == 0).select("date")


def add_relevance(rows: DataFrame, target: str, output: str = "relevance", bins: int = 20) -> DataFrame:
    """0-based quantile bucket of the target per date, in at most ``bins`` and at least 2; no target: 0."""
    day = Window.partitionBy("date")
    r, n = first_rank(target, ["date"]), F.count(target).over(day)
    place = F.dense_rank().over(Window.partitionBy("date", F.col(target).isNull()).orderBy(target))
    staged = rows.withColumns({"__r": r, "__n": n, "__p": F.when(F.col(target).isNotNull(), place)})
    distinct = F.coalesce(F.max("__p").over(day), F.lit(0))  # the last place is the number of distinct values
    staged = staged.withColumn("__q", F.greatest(F.lit(2), F.least(F.lit(bins), distinct))).drop("__p")
    return staged.withColumn(output, F.coalesce(bucket("__r", "__n", "__q") - 1, F.lit(0))).drop("__r", "__n", "__q")
