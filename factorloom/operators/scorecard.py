"""Yearly evidence condensed: stability, quality score, tiers, gate, whitelist; summaries over splits."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.windows import percent_rank_average, ratio

_EXCESS = "top_bucket_official_index_excess_annual_return_est"

#: Weight of each percent rank in the quality score.
SCORE_WEIGHTS = {
    "abs_rank_ic_ir_mean": 0.30, "abs_mean_rank_ic_mean": 0.20, "bucket_return_spearman_mean": 0.15, "positive_top_bucket_excess_year_ratio": 0.15,
    f"latest_{_EXCESS}": 0.10, "monotonic_year_ratio": 0.05, "positive_ic_year_ratio": 0.05, "mean_rank_ic_std": -0.10,
}


@dataclass(frozen=True)
class GateConfig:
    min_years_single: int = 1
    min_years_multi: int = 2
    max_years: int = 4
    min_abs_rank_ic_ir: float = 0.10
    min_bucket_spearman: float = 0.20
    min_excess_year_ratio: float = 0.50
    min_latest_excess: float = 0.0
    core_quantile: float = 0.80
    candidate_quantile: float = 0.50
    whitelist_min: int = 30
    whitelist_max: int = 50
    weights: dict[str, float] = field(default_factory=lambda: dict(SCORE_WEIGHTS))


def _share(test: Column) -> Column:
    return F.avg(F.coalesce(test, F.lit(False)).cast("double"))


def stability(annual: DataFrame) -> DataFrame:
    """Per feature: years, usual direction (ties: the smaller), means, deviations and shares over its yearly rows, and the latest year's values."""
    latest = lambda c: F.max_by(c, "year").alias(f"latest_{c}")
    return annual.groupBy("feature").agg(
        F.count_distinct("year").alias("years_covered"), F.mode("direction", True).alias("direction"), F.max("sign_flipped").alias("sign_flipped"),
        F.avg("mean_rank_ic").alias("mean_rank_ic_mean"), F.stddev_samp("mean_rank_ic").alias("mean_rank_ic_std"),
        F.avg("rank_ic_ir").alias("rank_ic_ir_mean"), F.avg("positive_rank_ic_ratio").alias("positive_rank_ic_ratio_mean"),
        F.avg("mean_top_bottom_spread").alias("mean_top_bottom_spread_mean"),
        F.avg("long_short_annual_return_est").alias("long_short_annual_return_est_mean"),
        F.stddev_samp("long_short_annual_return_est").alias("long_short_annual_return_est_std"),
        F.avg(_EXCESS).alias(f"{_EXCESS}_mean"), F.stddev_samp(_EXCESS).alias(f"{_EXCESS}_std"),
        F.avg("bucket_return_spearman").alias("bucket_return_spearman_mean"),
        _share(F.col("bucket_return_monotonic_increasing")).alias("monotonic_year_ratio"), _share(F.col("mean_rank_ic") > 0).alias("positive_ic_year_ratio"),
        _share(F.col("long_short_annual_return_est") > 0).alias("positive_long_short_year_ratio"),
        _share(F.col(_EXCESS) > 0).alias("positive_top_bucket_excess_year_ratio"), F.max("year").alias("latest_year"),
        latest("mean_rank_ic"), latest("rank_ic_ir"), latest("long_short_annual_return_est"), latest("long_short_sharpe_est"), latest(_EXCESS),
        latest("bucket_return_spearman"),
    )


def evaluate(annual: DataFrame, registry: DataFrame, cfg: GateConfig = GateConfig()) -> DataFrame:
    """Registry rows with stability, quality_score, quality_tier and pass_single_factor_gate."""
    years = annual.agg(F.count_distinct("year").alias("__years"))
    need = F.when(F.col("__years") <= 1, cfg.min_years_single).otherwise(
        F.greatest(F.lit(cfg.min_years_multi), F.least(F.lit(cfg.max_years), F.col("__years")))
    )
    rows = registry.join(stability(annual), "feature", "left").crossJoin(F.broadcast(years))  # one row
    rows = rows.withColumns({"abs_mean_rank_ic_mean": F.abs("mean_rank_ic_mean"), "abs_rank_ic_ir_mean": F.abs("rank_ic_ir_mean")})
    score = sum((F.lit(w) * percent_rank_average(c) for c, w in cfg.weights.items()), F.lit(0.0))
    rows = rows.withColumn("quality_score", F.round(score, 6))
    cuts = rows.agg(F.percentile("quality_score", cfg.core_quantile).alias("__core"), F.percentile("quality_score", cfg.candidate_quantile).alias("__cand"))
    rows = rows.crossJoin(F.broadcast(cuts))  # one row
    s = F.col("quality_score")
    tier = F.when(s >= F.col("__core"), "core").when(s >= F.col("__cand"), "candidate").otherwise("watch")
    or_ = lambda c, v: F.coalesce(F.col(c), F.lit(v))
    gate = (
        (or_("years_covered", 0) >= need)
        & (or_("abs_rank_ic_ir_mean", 0.0) >= cfg.min_abs_rank_ic_ir)
        & (or_("bucket_return_spearman_mean", 0.0) >= cfg.min_bucket_spearman)
        & (or_("positive_top_bucket_excess_year_ratio", 0.0) >= cfg.min_excess_year_ratio)
        & (or_(f"latest_{_EXCESS}", -1.0) > cfg.min_latest_excess)
    )
    return rows.withColumns({"quality_tier": tier, "pass_single_factor_gate": gate}).drop("__years", "__core", "__cand")


def whitelist(evaluation: DataFrame, cfg: GateConfig = GateConfig()) -> DataFrame:
    """(feature, selected_reason, priority_rank, ...): gate rows first, then core and candidate, then watch up to the least count."""
    group = F.when(F.col("pass_single_factor_gate"), 0).when(F.col("quality_tier").isin("core", "candidate"), 1).otherwise(2)
    order = [
        F.desc("pass_single_factor_gate"), F.desc("quality_score"), F.desc_nulls_last("abs_rank_ic_ir_mean"),
        F.desc_nulls_last("bucket_return_spearman_mean"), F.col("feature"),
    ]
    rows = evaluation.withColumn("__g", group)
    rows = rows.withColumn("priority_rank", F.row_number().over(Window.orderBy("__g", *order)))  # one row per factor
    kept = (F.col("__g") < 2) | (F.col("priority_rank") <= max(1, cfg.whitelist_min))
    rows = rows.where(kept & (F.col("priority_rank") <= max(1, cfg.whitelist_min, cfg.whitelist_max)))
    reasons = F.array(F.lit("pass_single_factor_gate"), F.lit("quality_tier_relaxed"), F.lit("watch_fill_to_min_count"))
    return rows.withColumn("selected_reason", reasons[F.col("__g")]).drop("__g")


#: The factors of each family study.
FAMILY_FACTORS = {
    "sma": (
        "close_to_ma_5", "close_to_ma_8", "close_to_ma_13", "close_to_ma_16", "close_to_ma_20", "close_to_ma_21", "close_to_ma_32", "close_to_ma_34",
        "close_to_ma_55", "close_to_ma_60", "trend_5_13", "trend_5_20", "trend_8_16", "trend_8_21", "trend_13_34", "trend_16_48", "trend_20_60",
        "trend_21_55",
    ),
    "reversal": (
        "ret_1", "ret_3", "ret_5", "ret_10", "ret_20", "ret_60", "ret_reversal_5_20", "ret_reversal_10_60", "gap_1", "intraday_ret_1",
        "overnight_ret_5", "price_volume_div_5", "price_volume_div_20", "rebound_from_low_20",
    ),
}


def family_registry(rows: DataFrame, family: str) -> DataFrame:
    """Status and reason of a family's factors from their ``stability``.

    Two later tests overrule the reason, ordering last.
    """
    excess, order = F.coalesce(F.col(f"latest_{_EXCESS}"), F.lit(-1.0)), F.coalesce(F.col("latest_bucket_return_spearman"), F.lit(0.0))
    recent = (excess > 0) & (order >= 0.5)
    share = F.coalesce(F.col("positive_top_bucket_excess_year_ratio"), F.lit(0.0))
    keep = recent & (share >= 2.0 / 3.0) & (F.coalesce(F.col("years_covered"), F.lit(0)) >= 4)
    status = F.when(keep, "keep").when(recent, "recent_only").otherwise("discard")
    reason = (
        F.when(order < 0.5, "weak_bucket_ordering")
        .when(excess <= 0, "recently_ineffective")
        .when(keep, "stable_excess_and_recent_effective")
        .when(recent, "recent_effective_but_long_term_unstable")
        .otherwise("weak_recent_or_unstable")
    )
    return rows.withColumns({"family": F.lit(family), "status": status, "reason": reason})


def importance_summary(importance: DataFrame) -> DataFrame:
    """Per feature the mean importance over folds, and its size."""
    rows = importance.groupBy("feature").agg(F.avg("importance").alias("mean_importance"))
    return rows.withColumn("abs_mean_importance", F.abs("mean_importance"))


def coefficient_table(coefficients: DataFrame, directions: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Oriented coefficients (keys, feature, coef) times the direction give those of the original factor; ranked by size within ``keys``."""
    rows = coefficients.join(directions.select(*keys, "feature", "direction"), [*keys, "feature"], "left")
    rows = rows.withColumn("direction", F.coalesce("direction", F.lit(1)))
    rows = rows.withColumns({"original_coef": F.col("coef") * F.col("direction"), "abs_coef": F.abs("coef")})
    return rows.withColumn("coef_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("abs_coef"), "feature")))


def selection_frequency(selected: DataFrame, splits: int) -> DataFrame:
    """Per feature: splits that chose it, and their share of all."""
    rows = selected.groupBy("feature").agg(F.count_distinct("split_id").alias("selected_splits"))
    return rows.withColumn("selection_ratio", ratio("selected_splits", F.lit(splits)))


def coefficient_stability(rows: DataFrame) -> DataFrame:
    """Per feature over splits: mean, deviation, mean size, share of positive, coefficient of variation."""
    out = rows.groupBy("feature").agg(
        F.count_distinct("split_id").alias("splits"), F.avg("coef").alias("mean_coef"), F.stddev_samp("coef").alias("std_coef"),
        F.avg(F.abs("coef")).alias("mean_abs_coef"), _share(F.col("coef") > 0).alias("positive_coef_ratio"),
    )
    return out.withColumn("coef_cv", ratio("std_coef", "mean_abs_coef"))


def ranker_pool(coefficients: DataFrame, diagnostics: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Features of a split whose pool_score (.60 coefficient, .25 rank IC ratio, .15 positive share) is at or over the median of ``keys``."""
    rows = coefficients.select(*keys, "feature", F.abs("coef").alias("abs_coef")).join(diagnostics.drop("coef"), [*keys, "feature"], "left")
    rows = rows.withColumn("abs_ir", F.abs("rank_ic_ir"))
    part = [F.col(k) for k in keys] or None
    score = 0.60 * percent_rank_average("abs_coef", part) + 0.25 * percent_rank_average("abs_ir", part) + 0.15 * F.coalesce("positive_rank_ic_ratio", F.lit(0.0))
    cut = F.percentile("pool_score", 0.5).over(Window.partitionBy(*keys))  # one row per factor
    return rows.withColumn("pool_score", score).withColumn("__cut", cut).where("pool_score >= __cut").drop("__cut")


def split_pool(coefficients: DataFrame, evidence: DataFrame, keep_quantile: float = 0.5, keys: tuple[str, ...] = ()) -> DataFrame:
    """A split's features with their ridge_split_score, those at or over its quantile (within ``keys`` where given).

    .60 percent rank of the oriented coefficient's size, .25 of the mining rank
    IC ratio's size, .15 if the oriented coefficient is positive. One row is
    always at the quantile or over it, so no fall-back is needed.
    """
    rows = coefficients.join(evidence, [*keys, "feature"], "left").withColumns({"abs_coef": F.abs("coef"), "abs_ir": F.abs("rank_ic_ir")})
    part = [F.col(k) for k in keys] or None
    score = 0.60 * percent_rank_average("abs_coef", part) + 0.25 * percent_rank_average("abs_ir", part) + 0.15 * F.coalesce((F.col("coef") > 0).cast("double"), F.lit(0.0))
    rows = rows.withColumn("ridge_split_score", score)
    cut = F.percentile("ridge_split_score", keep_quantile).over(Window.partitionBy(*keys))  # one row per factor
    return rows.withColumn("__cut", cut).where("ridge_split_score >= __cut").drop("__cut")


def best_by_quality(evaluation: DataFrame, count: int) -> DataFrame:
    """What stands in for an empty whitelist: the ``count`` best rows by quality score, none of which passed."""
    order = Window.orderBy(F.desc_nulls_last("quality_score"), "feature")  # one row per factor
    rows = evaluation.withColumn("priority_rank", F.row_number().over(order)).where(F.col("priority_rank") <= count)
    return rows.withColumns({"pass_single_factor_gate": F.lit(False), "selected_reason": F.lit("fallback_top_quality_score")})


@dataclass(frozen=True)
class RidgeGate:
    min_selection_rate_multi: float = 0.5
    min_selection_rate_single: float = 1.0
    max_original_coef_cv: float = 1.5


def whitelist_summary(whitelists: DataFrame, splits: int) -> DataFrame:
    """Per feature of the splits' whitelists: in how many, their share, mean quality score and mean latest excess."""
    rows = whitelists.groupBy("feature").agg(
        F.count_distinct("split_id").alias("whitelist_count"), F.avg("quality_score").alias("whitelist_quality_score_mean"),
        F.avg(f"latest_{_EXCESS}").alias("whitelist_latest_top_bucket_excess_mean"),
    )
    return rows.withColumn("whitelist_rate", ratio("whitelist_count", F.lit(max(1, splits))))


def ridge_screen(summary: DataFrame, selected: DataFrame, stability: DataFrame, splits: int, gate: RidgeGate = RidgeGate()) -> DataFrame:
    """Whitelisted features with how often they were selected, how steady their original coefficient is, and ``pass_ridge_gate``.

    A coefficient without a variation (one split) counts as steady; a feature
    that was never selected has a rate of 0.
    """
    least = gate.min_selection_rate_multi if splits > 1 else gate.min_selection_rate_single
    rows = summary.join(selected.select("feature", F.col("selected_splits").alias("selection_count"), F.col("selection_ratio").alias("selection_rate")), "feature", "left")
    steady = stability.select(
        "feature", F.col("mean_coef").alias("ridge_original_coef_mean"), F.col("std_coef").alias("ridge_original_coef_std"),
        F.col("mean_abs_coef").alias("ridge_original_abs_coef_mean"), F.col("coef_cv").alias("ridge_original_coef_cv"),
    )
    rows = rows.join(steady, "feature", "left").withColumn("selection_rate", F.coalesce("selection_rate", F.lit(0.0)))
    passed = (F.col("selection_rate") >= least) & (F.coalesce("ridge_original_coef_cv", F.lit(0.0)) <= gate.max_original_coef_cv)
    return rows.withColumns({"pass_ridge_gate": passed, "quality_score": F.col("whitelist_quality_score_mean")})


def final_pool(screen: DataFrame, used: DataFrame) -> DataFrame:
    """The screened features that the ranker used in some split, with in how many and their share.

    Column names and the status are those of the survey's artefact, whatever ranker is behind them.
    """
    rows = used.select("feature", F.col("selected_splits").alias("lgbm_selection_count"), F.col("selection_ratio").alias("lgbm_selection_rate"))
    return screen.join(rows, "feature").where("lgbm_selection_count > 0").withColumn("final_status", F.lit("used_by_lgbm"))


def best_per_phase(summary: DataFrame, metric: str = "sharpe_est") -> DataFrame:
    """Best feature of each split and phase by a metric, ties to the smaller name."""
    over = Window.partitionBy("split_id", "phase").orderBy(F.desc_nulls_last(metric), "feature")
    return summary.withColumn("__r", F.row_number().over(over)).where("__r = 1").drop("__r")
