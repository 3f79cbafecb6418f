"""Positions, backtests, performance metrics, benchmarks and exposures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.windows import average_rank, correlation, cumulative_product, ratio
from factorloom.operators.crosssection import bucket_returns
from factorloom.operators.labels import rebalance_dates


@dataclass(frozen=True)
class PortfolioConfig:
    top_n: int = 12
    rebalance_weekday: int = 4
    fee_rate: float = 0.0003
    slippage_rate: float = 0.0007
    max_weight: float = 0.12


def positions(scored: DataFrame, score: str, cfg: PortfolioConfig = PortfolioConfig(), dates: DataFrame | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, date, symbol, target_weight): on rebalance dates the best tradable names, evenly weighted up to a cap.

    Rows without a score are left out; ties go to the smaller symbol. With
    ``keys`` every variant has positions of its own, and ``dates`` has them too.
    """
    days = rebalance_dates(scored, cfg.rebalance_weekday) if dates is None else dates
    best = Window.partitionBy(*keys, "date").orderBy(F.desc("__score"), "symbol")
    rows = scored.where("tradable_universe").select(*keys, "date", "symbol", F.col(score).alias("__score")).where("__score is not null")
    top = rows.join(days, [*keys, "date"], "left_semi").withColumn("__rank", F.row_number().over(best)).where(F.col("__rank") <= cfg.top_n)
    weight = F.least(F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy(*keys, "date")), F.lit(cfg.max_weight))
    return top.withColumn("target_weight", weight).select(*keys, "date", "symbol", "target_weight")


def universe_positions(scored: DataFrame, weekday: int = 4, dates: DataFrame | None = None) -> DataFrame:
    """All tradable names of the rebalance dates, evenly weighted."""
    days = rebalance_dates(scored, weekday) if dates is None else dates
    rows = scored.where("tradable_universe").select("date", "symbol").join(days, "date", "left_semi")
    return rows.withColumn("target_weight", F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy("date")))


def trades(panel: DataFrame, held: DataFrame, cfg: PortfolioConfig = PortfolioConfig(), keys: tuple[str, ...] = ()) -> DataFrame:
    """Positions that could be entered, with trade_date, entry_open, exit_open, net_ret, weighted_ret.

    Signals trade at the next panel date's open and leave at the open after the
    next rebalance. Names that are paused, limit-up or without a price at either
    end are dropped; their weight stays in cash. ``keys`` tell variants apart:
    each has its own rebalances, all share the panel and its calendar.
    """
    calendar = panel.select("date").distinct().withColumn("next", F.lead("date").over(Window.orderBy("date")))
    signals = held.select(*keys, "date").distinct().withColumn("exit_signal", F.lead("date").over(Window.partitionBy(*keys).orderBy("date")))
    signals = signals.join(calendar, "date", "left").withColumnRenamed("next", "trade_date")
    exits = calendar.select(F.col("date").alias("exit_signal"), F.col("next").alias("exit_date"))
    schedule = signals.join(exits, "exit_signal", "left").select(*keys, "date", "trade_date", "exit_date")
    closed = F.coalesce("is_paused", F.lit(False)) | F.coalesce("is_limit_up", F.lit(False))
    entry = panel.where(~closed).select(F.col("date").alias("trade_date"), "symbol", F.col("open").alias("entry_open"))
    leave = panel.select(F.col("date").alias("exit_date"), "symbol", F.col("open").alias("exit_open"))
    done = held.join(schedule, [*keys, "date"]).join(entry, ["trade_date", "symbol"]).join(leave, ["exit_date", "symbol"])
    done = done.where("entry_open is not null and exit_open is not null")
    net = ratio("exit_open", "entry_open") - 1 - 2 * (cfg.fee_rate + cfg.slippage_rate)
    return done.withColumn("net_ret", net).withColumn("weighted_ret", F.col("target_weight") * F.col("net_ret"))


def with_equity(returns: DataFrame, ret: str = "portfolio_ret", output: str = "equity", keys: tuple[str, ...] = ()) -> DataFrame:
    """Add the running product of 1 + return (missing: 0) in date order; one row per date and key."""
    over = Window.partitionBy(*keys).orderBy("date")
    return returns.withColumn(output, cumulative_product(1 + F.coalesce(F.col(ret), F.lit(0.0)), over))


def backtest(panel: DataFrame, held: DataFrame, cfg: PortfolioConfig = PortfolioConfig(), keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, date, portfolio_ret, equity) by trade date."""
    rows = trades(panel, held, cfg, keys).groupBy(*keys, F.col("trade_date").alias("date")).agg(F.sum("weighted_ret").alias("portfolio_ret"))
    return with_equity(rows, keys=keys)


def metrics(portfolio: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Status, periods, periods_per_year_est, annual return and volatility, Sharpe ratio, largest drawdown; a row per key.

    Periods per year come from the median gap between dates (52 without one).
    """
    over = Window.partitionBy(*keys).orderBy("date")
    rows = portfolio.withColumns(
        {
            "__gap": F.datediff("date", F.lag("date").over(over)),
            "__ret": F.coalesce(F.col("portfolio_ret"), F.lit(0.0)),
            "__peak": F.max("equity").over(over.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("periods"), F.median("__gap").alias("__g"), F.max_by("equity", "date").alias("__end"), F.avg("__ret").alias("__m"),
        F.when(F.min("__ret") == F.max("__ret"), 0.0).otherwise(F.stddev_pop("__ret")).alias("__s"),
        F.min(ratio("equity", "__peak") - 1).alias("max_drawdown"),
    )
    per_year = F.when(F.col("__g") > 0, ratio(F.lit(365.25), "__g")).otherwise(52.0)
    out = out.withColumn("periods_per_year_est", per_year)
    growth = F.when(F.col("__end") > 0, F.pow("__end", ratio("periods_per_year_est", "periods")) - 1).otherwise(-1.0)
    some = F.col("periods") > 0
    return out.select(
        *keys, F.when(some, "ok").otherwise("empty").alias("status"), "periods", F.when(some, F.col("periods_per_year_est")).alias("periods_per_year_est"),
        F.when(some, growth).alias("annual_return_est"), (F.col("__s") * F.sqrt("periods_per_year_est")).alias("annual_vol_est"),
        F.when(some, F.coalesce(ratio("__m", "__s"), F.lit(0.0)) * F.sqrt("periods_per_year_est")).alias("sharpe_est"), "max_drawdown",
    )


def excess(strategy: DataFrame, benchmark: DataFrame, benchmark_ret: str = "portfolio_ret") -> DataFrame:
    """(date, strategy_ret, benchmark_ret, portfolio_ret, equity) of the strategy less a benchmark on common dates."""
    s = strategy.select("date", F.col("portfolio_ret").alias("strategy_ret"))
    rows = s.join(benchmark.select("date", F.col(benchmark_ret).alias("benchmark_ret")), "date")
    return with_equity(rows.withColumn("portfolio_ret", F.col("strategy_ret") - F.col("benchmark_ret")))


def aligned_index_returns(schedule: DataFrame, index: DataFrame) -> DataFrame:
    """Index return over each holding period (trade_date to exit_date) instead of on one day."""
    levels = index.select("date", F.col("benchmark_equity").alias("level"))
    entry = levels.select(F.col("date").alias("trade_date"), F.col("level").alias("l0"))
    leave = levels.select(F.col("date").alias("exit_date"), F.col("level").alias("l1"))
    rows = schedule.select("trade_date", "exit_date").distinct().join(entry, "trade_date").join(leave, "exit_date")
    return rows.select(F.col("trade_date").alias("date"), (ratio("l1", "l0") - 1).alias("benchmark_ret"))


def index_metrics(index: DataFrame) -> DataFrame:
    """``metrics`` of a benchmark (date, benchmark_ret, benchmark_equity)."""
    return metrics(index.select("date", F.col("benchmark_ret").alias("portfolio_ret"), F.col("benchmark_equity").alias("equity")))


def group_curves(returns: DataFrame, q: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, bucket, date, portfolio_ret, equity) of every bucket and of long_short."""
    names = [*(f"Q{b}" for b in range(1, q + 1)), "long_short"]
    long = returns.select(*keys, "date", *names).unpivot([*keys, "date"], names, "bucket", "portfolio_ret")
    return with_equity(long.withColumn("portfolio_ret", F.coalesce("portfolio_ret", F.lit(0.0))), keys=(*keys, "bucket"))


def group_summary(returns: DataFrame, q: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row (per key): coverage, estimates of the end buckets and long_short, order of the buckets' means.

    Daily returns over several days overlap, so the estimates are scores and not
    returns to be had.
    """
    names = [f"Q{b}" for b in range(1, q + 1)]
    m = metrics(group_curves(returns, q, keys), (*keys, "bucket"))
    pick = lambda b, c: F.max(F.when(F.col("bucket") == b, F.col(c)))
    est = m.groupBy(*keys).agg(
        pick("long_short", "annual_return_est").alias("long_short_annual_return_est"), pick("long_short", "sharpe_est").alias("long_short_sharpe_est"),
        pick(names[-1], "annual_return_est").alias("top_bucket_annual_return_est"), pick(names[0], "annual_return_est").alias("bottom_bucket_annual_return_est"),
    )
    means = returns.groupBy(*keys).agg(F.count(F.lit(1)).alias("coverage_dates"), *[F.avg(n).alias(n) for n in names])
    steps = [F.col(b) - F.col(a) for a, b in zip(names, names[1:], strict=False)]
    every = lambda test: F.coalesce(F.forall(F.array(*steps), test), F.lit(False)) if steps else F.lit(False)
    order = means.select(*keys, F.posexplode(F.array(*names)).alias("i", "v")).withColumn("r", average_rank("v", list(keys) or [F.lit(1)]))
    spearman = order.where("v is not null").groupBy(*keys).agg(correlation("i", "r").alias("bucket_return_spearman"))
    flat = means.select(*keys, "coverage_dates", every(lambda s: s >= 0).alias("bucket_return_monotonic_increasing"),
                        every(lambda s: s <= 0).alias("bucket_return_monotonic_decreasing"))
    if keys:
        return flat.join(est, list(keys), "left").join(spearman, list(keys), "left")
    return flat.crossJoin(est).crossJoin(spearman)  # one row each


def single_factor_backtest(scored: DataFrame, score: str, target: str, q: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Daily bucket returns, metrics of each curve, and the summary row."""
    returns = bucket_returns(scored, score, target, q)
    return returns, metrics(group_curves(returns, q), ("bucket",)), group_summary(returns, q)


def _exposed(scored: DataFrame) -> DataFrame:
    mv = F.coalesce(F.col("float_mv").cast("double"), F.lit(0.0))
    return scored.select(
        "date", "symbol", "tradable_universe", F.coalesce("industry", F.lit("UNKNOWN")).alias("industry"), mv.alias("float_mv"),
        F.ln(F.greatest(mv, F.lit(1.0))).alias("float_mv_log"),
    )


def industry_exposure(scored: DataFrame, held: DataFrame) -> DataFrame:
    """(date, industry, strategy_weight, universe_weight, active_weight) against the evenly weighted universe, on all its dates."""
    base = _exposed(scored)
    s = held.join(base.drop("tradable_universe"), ["date", "symbol"], "left").groupBy("date", F.coalesce("industry", F.lit("UNKNOWN")).alias("industry"))
    u = base.where("tradable_universe").withColumn("w", F.lit(1.0) / F.count("symbol").over(Window.partitionBy("date"))).groupBy("date", "industry")
    both = s.agg(F.sum("target_weight").alias("strategy_weight")).join(u.agg(F.sum("w").alias("universe_weight")), ["date", "industry"], "full")
    both = both.fillna(0.0, ["strategy_weight", "universe_weight"])
    return both.withColumn("active_weight", F.col("strategy_weight") - F.col("universe_weight"))


def industry_summary(exposure: DataFrame) -> DataFrame:
    """Per industry: mean, mean absolute, largest and least active weight, dates."""
    return exposure.groupBy("industry").agg(
        F.avg("active_weight").alias("mean_active_weight"), F.avg(F.abs("active_weight")).alias("mean_abs_active_weight"),
        F.max("active_weight").alias("max_overweight"), F.min("active_weight").alias("max_underweight"), F.count_distinct("date").alias("coverage_dates"),
    )


def top_industries(summary: DataFrame, k: int = 10) -> dict[str, DataFrame]:
    """The report's lists: most over, most under, largest bias."""
    return {
        "top_overweights": summary.orderBy(F.desc("mean_active_weight"), "industry").limit(k),
        "top_underweights": summary.orderBy("mean_active_weight", "industry").limit(k),
        "top_abs_bias": summary.orderBy(F.desc("mean_abs_active_weight"), "industry").limit(k),
    }


def size_exposure(scored: DataFrame, held: DataFrame) -> DataFrame:
    """Per date: weighted mean size and log size, plain median size, of strategy and universe, and their gaps."""
    base = _exposed(scored)

    def side(rows: DataFrame, weight: str, name: str) -> DataFrame:
        mean = lambda c: ratio(F.sum(F.col(weight) * F.col(c)), F.sum(weight))
        return rows.groupBy("date").agg(
            F.sum(weight).alias("__w"), mean("float_mv").alias(f"{name}_avg_float_mv"), mean("float_mv_log").alias(f"{name}_avg_log_float_mv"),
            F.median("float_mv").alias(f"{name}_median_float_mv"),
        ).where("__w > 0").drop("__w")

    s = held.join(base, ["date", "symbol"], "left").fillna(0.0, ["float_mv", "float_mv_log"])
    u = base.where("tradable_universe").withColumn("w", F.lit(1.0) / F.count("symbol").over(Window.partitionBy("date")))
    out = side(s, "target_weight", "strategy").join(side(u, "w", "universe"), "date")
    return out.withColumns({f"active_{c}": F.col(f"strategy_{c}") - F.col(f"universe_{c}") for c in ("avg_float_mv", "avg_log_float_mv", "median_float_mv")})


def size_summary(exposure: DataFrame) -> DataFrame:
    return exposure.agg(
        F.count(F.lit(1)).alias("coverage_dates"), *[F.avg(f"active_{c}").alias(f"mean_active_{c}") for c in ("avg_float_mv", "avg_log_float_mv", "median_float_mv")],
        *[F.max_by(f"active_{c}", "date").alias(f"latest_active_{c}") for c in ("avg_float_mv", "avg_log_float_mv")],
    )
