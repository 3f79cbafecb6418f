"""Research runs: strategy bundles, yearly single-factor evaluation, rolling splits, daily scoring."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.functions.lineage import cut
from factorloom.operators import crosssection as xs
from factorloom.operators import factors, labels, models, moments, portfolio, scorecard
from factorloom.sources.panel import benchmark_on, between_dates, window_dates
from factorloom.sources.rawstore import RawStore


@dataclass(frozen=True)
class ResearchConfig:
    horizon: int = 10
    buckets: int = 5
    train_months: int = 24
    test_months: int = 6
    step_months: int = 6
    mining_months: int = 60
    warmup_months: int = 12
    valid_ratio: float = 0.2
    embargo_rows: int = 0
    min_listed_days: int = 250
    min_amount: float = 30_000_000.0
    top_k: int = 50
    min_rank_ic: float = 0.0
    max_corr: float = 0.9
    alpha: float = 1.0
    neutralize: bool = False
    neutralize_industry: bool = True
    neutralize_size: bool = True
    train_dates: int = 504
    min_rows: int = 20_000
    fallback_top_n: int = 50
    data_start: str | None = None
    data_end: str | None = None
    portfolio: portfolio.PortfolioConfig = portfolio.PortfolioConfig()
    gate: scorecard.GateConfig = field(default_factory=scorecard.GateConfig)
    ridge_gate: scorecard.RidgeGate = scorecard.RidgeGate()
    boost: models.BoostConfig = models.BoostConfig()
    ranker: models.RankerConfig = models.RankerConfig()

    @property
    def target(self) -> str:
        return f"future_return_{self.horizon}d"


def add_months(day: date, months: int) -> date:
    """The same day so many months on, or the month's last."""
    import calendar

    y, m = divmod(day.year * 12 + day.month - 1 + months, 12)
    return date(y, m + 1, min(day.day, calendar.monthrange(y, m + 1)[1]))


def clamp(split: dict[str, str], first: str | None = None, last: str | None = None) -> dict[str, str]:
    """A split's bounds within the data: none before ``first``, none after the day that follows ``last``."""
    from datetime import timedelta

    out = {k: max(v, first[:10]) if first and k != "split_id" else v for k, v in split.items()}
    stop = (date.fromisoformat(last[:10]) + timedelta(days=1)).isoformat() if last else None
    return {k: min(v, stop) if stop and k != "split_id" else v for k, v in out.items()}


def prepare(panel: DataFrame, features: list[str], cfg: ResearchConfig, start: str | None = None, end: str | None = None) -> DataFrame:
    """Factors, label and universe of a window, computed with its warm-up and cut afterwards."""
    if start:
        first = add_months(date.fromisoformat(start[:10]), -cfg.warmup_months).isoformat()
        panel = panel.where(F.col("date") >= F.lit(first).cast("timestamp"))
    rows = labels.add_universe(labels.add_labels(panel, (cfg.horizon,)), cfg.min_listed_days, cfg.min_amount)
    rows = factors.add_factors(rows, features, as_float=False)
    return window_dates(rows, start or "0001-01-01", end or "9999-12-31")


def strategy(panel: DataFrame, scored: DataFrame, score: str, cfg: ResearchConfig, index: DataFrame | None = None, dates: DataFrame | None = None) -> dict[str, DataFrame]:
    """All results of one score: signal, buckets, positions, backtest, excess, exposures and their metrics.

    What several results rest on is written once: positions, curves and daily
    statistics, a row per date or per date and name held.
    """
    days = labels.rebalance_dates(scored, cfg.portfolio.rebalance_weekday) if dates is None else dates
    days = cut(days, "days")
    held = cut(portfolio.positions(scored, score, cfg.portfolio, days), "positions")
    book = cut(portfolio.backtest(panel, held, cfg.portfolio), "portfolio")
    bench = cut(portfolio.backtest(panel, portfolio.universe_positions(scored, dates=days), cfg.portfolio), "benchmark")
    over = portfolio.excess(book, bench)
    daily = cut(xs.daily_signal(scored, score, cfg.target, cfg.buckets), "signal")
    industry = portfolio.industry_exposure(scored, held)
    size = cut(portfolio.size_exposure(scored, held), "size")
    out = {
        "signal_daily": daily, "signal_summary": xs.signal_summary(daily), "bucket_returns": xs.bucket_returns(scored, score, cfg.target, cfg.buckets),
        "positions": held, "portfolio": book, "metrics": portfolio.metrics(book), "benchmark": bench, "benchmark_metrics": portfolio.metrics(bench), "excess": over, "excess_metrics": portfolio.metrics(over),
        "industry_exposure": industry, "industry_summary": portfolio.industry_summary(industry), "size_exposure": size,
        "size_summary": portfolio.size_summary(size),
    }
    if index is not None:
        on = cut(benchmark_on(index, book), "index")
        vs = portfolio.excess(book, on, "benchmark_ret")
        out |= {"index": on, "index_metrics": portfolio.index_metrics(on), "index_excess": vs, "index_excess_metrics": portfolio.metrics(vs)}
    return out


def yearly_report(rows: DataFrame, features: list[str], cfg: ResearchConfig, index: DataFrame | None = None, top_k: int | None = None) -> DataFrame:
    """One row per year and feature, in the shape that ``scorecard`` reads: diagnostics, then bucket curves of the oriented factor.

    One pass for all years and features: the long rows are shuffled once by
    (date, feature) and condensed to a row each, which is written, as all that
    follows reads it several times; buckets are made in both orders there, so the direction
    that a year turns out to have is chosen on the daily means. ``top_k``: each
    year's strongest features only. Without an index the top bucket is held
    against nothing (returns of 0).
    """
    keys, q = ("year", "feature"), cfg.buckets
    daily = cut(xs.feature_days(rows, features, cfg.target, q).withColumn("year", F.year("date")), "feature_days")
    found = xs.with_direction(xs.feature_means(daily.where("rows >= 2"), keys)).withColumn("sign_flipped", F.col("direction") < 0)
    if top_k:
        strength = [F.abs("mean_rank_ic").desc_nulls_last(), F.col("rank_ic_ir").desc_nulls_last(), F.col("mean_top_bottom_spread").desc_nulls_last(), F.col("feature")]
        best = F.row_number().over(Window.partitionBy("year").orderBy(*strength))  # one row per feature
        found = found.withColumn("__r", best).where(F.col("__r") <= top_k).drop("__r")
    sides = daily.join(found.select(*keys, "direction"), list(keys)).withColumn("means", F.when(F.col("direction") < 0, F.col("down")).otherwise(F.col("up")))
    means = [F.col("means")[b].alias(f"Q{b + 1}") for b in range(q)]
    returns = sides.where("means is not null").select(*keys, "date", *means, (F.col("means")[q - 1] - F.col("means")[0]).alias("long_short"))
    top = returns.select(*keys, "date", F.coalesce(f"Q{q}", F.lit(0.0)).alias("strategy_ret"))
    bench = top.withColumn("benchmark_ret", F.lit(0.0)) if index is None else top.join(index.select("date", "benchmark_ret"), "date")
    over = portfolio.with_equity(bench.withColumn("portfolio_ret", F.col("strategy_ret") - F.col("benchmark_ret")), keys=keys)
    gain = portfolio.metrics(over, keys).select(*keys, *[F.col(c).alias(f"top_bucket_official_index_excess_{c}") for c in ("annual_return_est", "sharpe_est")])
    kept = ("direction", "sign_flipped", "mean_rank_ic", "rank_ic_ir", "positive_rank_ic_ratio", "mean_top_bottom_spread")
    out = found.select(*keys, *kept).join(portfolio.group_summary(returns, q, keys), list(keys), "left").join(gain, list(keys), "left")
    return out.withColumns({f"bucket_return_monotonic_{d}": F.coalesce(f"bucket_return_monotonic_{d}", F.lit(False)) for d in ("increasing", "decreasing")})


def single_factor_run(spark: SparkSession, panel: DataFrame, features: list[str], cfg: ResearchConfig, start: str, end: str, index=None) -> dict[str, DataFrame]:
    """Yearly report, evaluation and whitelist of a window."""
    report = cut(yearly_report(prepare(panel, features, cfg, start, end), features, cfg, index), "annual_report")
    registry = factors.registry(spark, features)
    evaluation = cut(scorecard.evaluate(report, registry, cfg.gate), "evaluation")
    return {"factor_registry": registry, "annual_report": report, "evaluation": evaluation, "whitelist": scorecard.whitelist(evaluation, cfg.gate)}


def family_lab(spark: SparkSession, panel: DataFrame, family: str, cfg: ResearchConfig, start: str, end: str, index=None) -> DataFrame:
    """Status and reason of each factor of a family."""
    if family not in scorecard.FAMILY_FACTORS:
        raise ValueError(f"no such family: {family}")
    report = single_factor_run(spark, panel, list(scorecard.FAMILY_FACTORS[family]), cfg, start, end, index)["annual_report"]
    return scorecard.family_registry(scorecard.stability(report), family)


def splits(start: str, end: str, cfg: ResearchConfig) -> list[dict[str, str]]:
    """Rolling windows: the first test begins at ``start``, training and mining lie before it; ends are not included."""
    out, at, last = [], date.fromisoformat(start), date.fromisoformat(end)
    while True:
        train_start, test_end = add_months(at, -cfg.train_months), add_months(at, cfg.test_months)
        if (test_end - last).days > 1:
            return out
        bounds = {"mining_start": add_months(train_start, -cfg.mining_months), "train_start": train_start, "train_end": at, "test_end": test_end}
        out.append({"split_id": str(len(out) + 1), **{k: v.isoformat() for k, v in bounds.items()}})
        at = add_months(at, cfg.step_months)


_SCORED = ("date", "symbol", "open", "is_paused", "is_limit_up", "tradable_universe", "industry", "float_mv")


def _phases(rows: DataFrame, split: dict[str, str], cfg: ResearchConfig) -> dict[str, DataFrame] | None:
    """Tradable rows with a target of training, validation and test; None where a side has too few."""
    rows = rows.where(F.col("tradable_universe") & F.col(cfg.target).isNotNull())
    window = window_dates(rows, split["train_start"], split["train_end"])
    test = window_dates(rows, split["train_end"], split["test_end"])
    if window.count() < max(1, cfg.min_rows) or test.isEmpty() or window.select("date").distinct().limit(2).count() < 2:
        return None
    train, valid = models.chronological_split(window, cfg.valid_ratio, cfg.embargo_rows)
    return {"train": train, "valid": valid, "test": test} if train.count() >= max(1, cfg.min_rows) else None


def _modelled(phases: dict[str, DataFrame], names: list[str], cfg: ResearchConfig) -> dict:
    """Ridge and ranker fitted on training (the ranker stops on validation), and both other phases scored."""
    fit = models.fit_ridge(phases["train"], names, cfg.target, cfg.alpha)
    ranker = models.fit_ranker(phases["train"], names, cfg.target, cfg.ranker, phases["valid"])
    scored = {p: ranker.scores(phases[p].withColumn("ridge_score", fit.column()), "lgbm_score") for p in ("valid", "test")}
    return {"fit": fit, "ranker": ranker, **scored}


def _fit_table(spark: SparkSession, values: dict[str, float], name: str) -> DataFrame:
    return spark.createDataFrame(list(values.items()), f"feature string, {name} double")


def _phase_results(spark, panel, found: dict, names: list[str], cfg: ResearchConfig, index) -> dict[str, DataFrame]:
    """Predictions, strategies, importances and the features' diagnostics of validation and test."""
    ridge = _fit_table(spark, found["fit"].coefficients, "importance")
    out = {"feature_importance_summary": importance_table(ridge, _fit_table(spark, found["ranker"].importance(), "importance"))}
    for phase in ("valid", "test"):
        scored = cut(found[phase].select(*_SCORED, cfg.target, "ridge_score", "lgbm_score", *names), "predictions")
        out |= {f"predictions_{phase}": scored, f"feature_diagnostics_{phase}": cut(xs.feature_diagnostics(scored, names, cfg.target), "diagnostics")}
        out |= strategies(panel, scored, cfg, index, f"{phase}_")
    return out


def chosen_features(train: DataFrame, listed: DataFrame, cfg: ResearchConfig) -> DataFrame:
    """Whitelisted features with a mining rank IC of the least size (all, if none has), without those that correlate with a better one."""
    found = listed.where(F.abs("mean_rank_ic_mean") >= cfg.min_rank_ic)
    found = listed if found.isEmpty() else found
    order = [r.feature for r in found.orderBy("priority_rank").select("feature", "priority_rank").collect()]  # one row per factor
    return found.where(F.col("feature").isin(xs.drop_correlated(train, order, cfg.max_corr)))


def run_split(spark: SparkSession, panel: DataFrame, features: list[str], split: dict[str, str], cfg: ResearchConfig, index=None) -> dict | str:
    """A split from its mining window to strategies on validation and test; a text where one of its windows has too little to work on.

    Whitelist of the mining window (the best by quality score where it is empty)
    -> features over the thresholds without correlated ones, in the mining's
    directions -> ridge gate -> ridge and ranker scores.
    """
    mining = window_dates(panel, split["mining_start"], split["train_start"])
    if mining.isEmpty():
        return "no rows to mine"
    mined = single_factor_run(spark, panel, features, cfg, split["mining_start"], split["train_start"], index)
    listed = mined["whitelist"].orderBy("priority_rank").limit(cfg.top_k or len(features))
    if listed.isEmpty():
        count = max(1, cfg.top_k) if cfg.top_k else cfg.fallback_top_n
        listed = scorecard.best_by_quality(mined["evaluation"], count)
    listed = cut(listed, "listed")
    names = sorted(r.feature for r in listed.select("feature").collect())
    if not names:
        return "no feature to start from"
    rows = cut(prepare(panel, names, cfg, split["train_start"], split["test_end"]), "rows")
    phases = _phases(rows, split, cfg)
    if phases is None:
        return "too few rows to train or test on"
    selected = cut(chosen_features(phases["train"], listed, cfg), "selected")
    chosen = {r.feature: r.direction for r in selected.select("feature", "direction").collect()}
    oriented = {p: xs.orient(v, chosen) for p, v in phases.items()}
    screen = models.fit_ridge(oriented["train"], sorted(chosen), cfg.target, cfg.alpha)
    coefficients = cut(scorecard.coefficient_table(_fit_table(spark, screen.coefficients, "coef"), selected), "coefficients")
    evidence = selected.select("feature", F.col("rank_ic_ir_mean").alias("rank_ic_ir"), "quality_score")
    pool = cut(scorecard.split_pool(coefficients.select("feature", "coef"), evidence), "pool")
    kept = sorted(r.feature for r in pool.select("feature").collect())
    found = _modelled(oriented, kept, cfg)
    gate = {"selected_features": selected, "ridge_coefficients": coefficients, "ranker_pool": pool}
    train = {"feature_diagnostics_train": xs.feature_diagnostics(phases["train"], names, cfg.target)}
    return mined | gate | train | _phase_results(spark, panel, found, kept, cfg, index)


def _over(spark, done: dict[str, dict], name: str, schema: str) -> DataFrame:
    """(split_id, ...) of a small table of every split."""
    out = spark.createDataFrame([], f"split_id int, {schema}")
    for k, v in done.items():
        out = out.unionByName(v[name].select(F.lit(int(k)).alias("split_id"), *[F.col(c.split()[0]).cast(c.split()[1]) for c in schema.split(", ")]))
    return out


#: Results that a split's summary takes from a strategy: the prefix of each column, and which ones.
_SUMMARY = {
    "metrics": ("", ("annual_return_est", "annual_vol_est", "sharpe_est", "max_drawdown")), "excess_metrics": ("excess_", ("annual_return_est", "sharpe_est")),
    "index_metrics": ("official_index_", ("annual_return_est", "sharpe_est")), "index_excess_metrics": ("official_index_excess_", ("annual_return_est", "sharpe_est")),
    "signal_summary": ("", ("mean_rank_ic", "rank_ic_ir", "positive_rank_ic_ratio", "mean_top_bottom_spread")), "size_summary": ("", ("mean_active_avg_log_float_mv",)),
}


def split_summary(spark: SparkSession, done: dict[str, dict], windows: DataFrame) -> DataFrame | None:
    """A row per split, phase and model: its window, metrics, excess over the universe and the index, and signal summary."""
    names = [prefix + c for prefix, columns in _SUMMARY.values() for c in columns]
    rows = []
    for k, v in done.items():
        for phase in ("valid", "test"):
            for model in ("ridge", "lgbm", "lgbm_neutralized"):
                if f"{phase}_{model}_metrics" not in v:
                    continue
                values: list[float | None] = []
                for part, (_, columns) in _SUMMARY.items():
                    found = v.get(f"{phase}_{model}_{part}")
                    row = found.select(*columns).head() if found is not None else None  # one row each
                    values += [None if row is None or row[c] is None else float(row[c]) for c in columns]
                rows.append((int(k), phase, model, *values))
    if not rows:
        return None
    table = spark.createDataFrame(rows, f"split_id int, phase string, model string, {', '.join(f'{n} double' for n in names)}")
    return windows.drop("skipped", "reason").join(table, "split_id")


def _windows(spark, windows: list[dict], results: dict) -> DataFrame:
    bounds = ("mining_start", "train_start", "train_end", "test_end")
    why = {k: v if isinstance(v, str) else None for k, v in results.items()}
    rows = [(int(s["split_id"]), *(s[c] for c in bounds), why[s["split_id"]] is not None, why[s["split_id"]]) for s in windows]
    return spark.createDataFrame(rows, f"split_id int, {', '.join(f'{b} string' for b in bounds)}, skipped boolean, reason string")


def pools(spark: SparkSession, done: dict[str, dict], cfg: ResearchConfig) -> dict[str, DataFrame]:
    """What the splits say together: frequencies, coefficient stability, screening, ridge screen, final pool."""
    n = max(1, len(done))
    whitelists = _over(spark, done, "whitelist", "feature string, quality_score double, latest_top_bucket_official_index_excess_annual_return_est double")
    coefficients = _over(spark, done, "ridge_coefficients", "feature string, direction int, coef double, original_coef double")
    ranked = _over(spark, done, "ranker_pool", "feature string")
    selected, used = scorecard.selection_frequency(coefficients, n), scorecard.selection_frequency(ranked, n)
    stable = scorecard.coefficient_stability(coefficients.select("split_id", "feature", F.col("original_coef").alias("coef")))
    summary = scorecard.whitelist_summary(whitelists, n)
    screen = scorecard.ridge_screen(summary, selected, stable, n, cfg.ridge_gate)
    diagnostics = "feature string, mean_rank_ic double, rank_ic_ir double, positive_rank_ic_ratio double, mean_top_bottom_spread double"
    phases = [_over(spark, done, f"feature_diagnostics_{p}", diagnostics).withColumn("phase", F.lit(p)) for p in ("valid", "test")]
    best = scorecard.best_per_phase(phases[0].unionByName(phases[1]), "mean_rank_ic")
    best = best.withColumnsRenamed({"feature": "best_feature", **{c.split()[0]: f"best_feature_{c.split()[0]}" for c in diagnostics.split(", ")[1:]}})
    return {
        "ridge_coefficients": coefficients, "ridge_coefficient_stability": stable, "selected_feature_frequency": selected, "lgbm_selected_feature_frequency": used,
        "whitelist_summary": summary, "ridge_screen": screen, "lgbm_feature_pool": scorecard.final_pool(screen, used), "feature_screening_summary": best,
    }


def factor_chain_run(spark: SparkSession, panel: DataFrame, features: list[str], cfg: ResearchConfig, start: str, end: str, index=None) -> dict:
    """All splits of the chain: results by split, then ``pools`` over them, ``split_summary``, and ``windows`` with why a split was skipped."""
    windows = [clamp(s, cfg.data_start, cfg.data_end) for s in splits(start, end, cfg)]
    results = {s["split_id"]: run_split(spark, panel, features, s, cfg, index) for s in windows}
    done = {k: v for k, v in results.items() if not isinstance(v, str)}
    table = _windows(spark, windows, results)
    return {"splits": done, "windows": table, "split_summary": split_summary(spark, done, table)} | pools(spark, done, cfg)


def research_run(spark: SparkSession, panel: DataFrame, features: list[str], cfg: ResearchConfig, start: str, end: str, index=None) -> dict:
    """Every split with all features as they are: models on training, strategies on validation and test, and their summary."""
    windows = [clamp(s, cfg.data_start, cfg.data_end) for s in splits(start, end, cfg)]
    results: dict = {}
    for s in windows:
        phases = _phases(cut(prepare(panel, features, cfg, s["train_start"], s["test_end"]), "rows"), s, cfg)
        results[s["split_id"]] = "too few rows to train or test on" if phases is None else _phase_results(spark, panel, _modelled(phases, features, cfg), features, cfg, index)
    done = {k: v for k, v in results.items() if not isinstance(v, str)}
    table = _windows(spark, windows, results)
    return {"splits": done, "windows": table, "split_summary": split_summary(spark, done, table)}


def tune_run(spark: SparkSession, panel: DataFrame, features: list[str], cfg: ResearchConfig, start: str, middle: str, end: str, trials: int = 20, seed: int = 42,
             space: dict[str, tuple] | None = None) -> DataFrame:
    """Random search of the ranker: fitted on [start, middle), judged on [middle, end); a row per trial, the best first."""
    from json import dumps

    rows = cut(prepare(panel, features, cfg, start, end).where(F.col("tradable_universe") & F.col(cfg.target).isNotNull()), "rows")
    sides = window_dates(rows, start, middle), window_dates(rows, middle, end)
    found = models.tune_ranker(*sides, features, cfg.target, cfg.ranker, trials, seed, **({"space": space} if space else {}))
    results = ("trees", "ndcg_20", "ndcg_50", "seconds")
    table = [(k + 1, dumps({n: v for n, v in t.items() if n not in results}), *(t[n] for n in results)) for k, t in enumerate(found)]
    return spark.createDataFrame(table, "place int, config string, trees int, ndcg_20 double, ndcg_50 double, seconds double")


def rolling_scores(rows: DataFrame, features: list[str], cfg: ResearchConfig) -> dict[str, DataFrame]:
    """A ridge fit for each rebalance date on the ``train_dates`` dates before it: ``fits``, and ``scores`` of that date's rows with a target.

    All fits come from one pass of sums by date; see ``moments.rolling_ridge``.
    """
    modeling = rows.where(F.col("tradable_universe") & F.col(cfg.target).isNotNull())
    days = labels.rebalance_dates(modeling, cfg.portfolio.rebalance_weekday)
    fits = moments.rolling_ridge(modeling, features, cfg.target, days, cfg.train_dates, cfg.min_rows, cfg.alpha)
    scored = modeling.join(fits.select("date", "intercept", "coefficients"), "date")
    return {"fits": fits, "scores": scored.withColumn("ridge_score", moments.fitted_score(features)).drop("intercept", "coefficients")}


def retrain(spark: SparkSession, panel: DataFrame, features: list[str], cfg: ResearchConfig, start: str | None = None, end: str | None = None, index=None,
            folds: int | None = None) -> dict[str, DataFrame]:
    """The rolling retrain: predictions of every rebalance date from models of the dates before it, importances, and each score's strategy.

    Ridge fits of all dates are one plan. The ranker is a fit per rebalance
    date (``folds``: of the last so many only); both score the same dates.
    """
    rows = cut(prepare(panel, features, cfg, start, end), "rows")
    found = rolling_scores(rows, features, cfg)
    fits = cut(found["fits"], "fits")
    windows = fits.select("date", "first", "last").orderBy("date").collect()[-folds if folds else 0 :]  # one row per rebalance date
    if not windows:
        raise ValueError("no date has enough dates and rows before it to train on")
    modeling = rows.where(F.col("tradable_universe") & F.col(cfg.target).isNotNull())
    scores = modeling.join(fits.select("date", "intercept", "coefficients"), "date").withColumn("ridge_score", moments.fitted_score(features))
    parts, importance = [], []
    for w in windows:
        ranker = models.fit_ranker(modeling.where(F.col("date").between(w["first"], w["last"])), features, cfg.target, cfg.ranker)
        parts.append(cut(ranker.scores(scores.where(F.col("date") == w["date"])).select(*_SCORED, cfg.target, "ridge_score", "lgbm_score"), "fold"))
        importance += [(str(w["date"]), f, v) for f, v in ranker.importance().items()]
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p)
    scored = cut(scored, "predictions")
    ridge = moments.fit_coefficients(fits, features, "date").select("feature", F.col("coef").alias("importance"))
    gain = spark.createDataFrame(importance, "date string, feature string, importance double")
    return {"predictions": scored, "feature_importance_summary": importance_table(ridge, gain)} | strategies(rows, scored, cfg, index)


def importance_table(ridge: DataFrame, gain: DataFrame) -> DataFrame:
    """Per feature the mean ridge coefficient and its size, and the mean gain of the ranker, over folds."""
    a = scorecard.importance_summary(ridge).withColumnsRenamed({"mean_importance": "ridge_coef_mean", "abs_mean_importance": "ridge_abs_coef_mean"})
    b = scorecard.importance_summary(gain).select("feature", F.col("mean_importance").alias("lgbm_importance_mean"))
    return a.join(b, "feature", "full")


def strategies(panel: DataFrame, scored: DataFrame, cfg: ResearchConfig, index=None, prefix: str = "") -> dict[str, DataFrame]:
    """Results of the ridge score, the ranker's, and the ranker's neutralised where the configuration says so, and one table of all their metrics."""
    scores = {"ridge": ("ridge_score", scored), "lgbm": ("lgbm_score", scored)}
    if cfg.neutralize:
        flat = xs.neutralize(scored, "lgbm_score", cfg.neutralize_industry, cfg.neutralize_size, "lgbm_score_neutralized")
        scores["lgbm_neutralized"] = ("lgbm_score_neutralized", flat)
    out, tables = {}, []
    for name, (score, rows) in scores.items():
        found = strategy(panel, rows, score, cfg, index)
        out |= {f"{prefix}{name}_{k}": v for k, v in found.items()}
        for kind in ("metrics", "excess_metrics", "index_excess_metrics"):
            if kind in found:
                tables.append(found[kind].select(F.lit(f"{prefix}{name}").alias("strategy"), F.lit(kind).alias("kind"), "*"))
    table = tables[0]
    for t in tables[1:]:
        table = table.unionByName(t)
    return out | {f"{prefix}metrics": table}


#: The grid that is compared by default: name, horizon, weeks between rebalances.
EXPERIMENTS = (("10d_weekly", 10, 1), ("20d_weekly", 20, 1), ("20d_biweekly", 20, 2))


def horizon_matrix(panel: DataFrame, features: list[str], cfg: ResearchConfig, experiments=EXPERIMENTS, start: str | None = None, end: str | None = None) -> dict[str, DataFrame]:
    """Variants of horizon and rebalancing side by side: ``predictions``, ``portfolio`` and ``summary``, a row per experiment.

    A horizon's rolling ridge fits serve all its variants; positions, trades, equity
    and metrics of all variants are one plan, told apart by ``experiment``.
    ``start`` and ``end`` (both included) bound the rebalance dates.
    """
    from dataclasses import replace as with_

    horizons = sorted({h for _, h, _ in experiments})
    rows = labels.add_universe(labels.add_labels(panel, tuple(horizons)), cfg.min_listed_days, cfg.min_amount)
    rows = cut(factors.add_factors(rows, features, as_float=False), "rows")  # every horizon and variant reads them more than once
    parts = []
    for h in horizons:
        own = with_(cfg, horizon=h)
        scores = rolling_scores(rows, features, own)["scores"].select("date", "symbol", "tradable_universe", "ridge_score")
        days = labels.rebalance_dates(rows.where(F.col("tradable_universe") & F.col(own.target).isNotNull()), cfg.portfolio.rebalance_weekday)
        days = between_dates(days, start, end)
        for name, _, every in [e for e in experiments if e[1] == h]:
            kept = labels.every_nth_date(days, every)
            parts.append(scores.join(kept, "date", "left_semi").withColumns({"experiment": F.lit(name), "horizon": F.lit(h), "rebalance_every_n_weeks": F.lit(every)}))
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p)
    keys = ("experiment",)
    held = portfolio.positions(scored, "ridge_score", cfg.portfolio, scored.select("experiment", "date").distinct(), keys)
    book = portfolio.backtest(rows, held, cfg.portfolio, keys)
    counts = scored.groupBy("experiment", "horizon", "rebalance_every_n_weeks").agg(F.count_distinct("date").alias("prediction_dates"))
    return {"predictions": scored, "portfolio": book, "summary": counts.join(portfolio.metrics(book, keys), "experiment", "left")}


#: Rows before a date that the longest factor looks back on.
LOOK_BACK = 5 + max(int(n) for windows in factors.STANDARD_WINDOWS.values() for w in windows.split() for n in w.split("_"))


def refresh_factors(tables: RawStore, panel: DataFrame, features: list[str], since: str, name: str = "factors") -> DataFrame:
    """The stored factors with all rows from the month of ``since`` on computed anew; they equal those of a full run.

    Only the panel's tail is read for values: from the date on which the
    ``LOOK_BACK``-th last row before that month lies, of the symbol where it lies
    furthest back (symbols without later rows need none). Without stored
    factors everything is computed.
    """
    month = since.replace("-", "")[:6]
    if not tables.exists(name):
        rows = factors.add_factors(panel, features, as_float=False).select("symbol", "date", *features)
        tables.replace(name, rows)
        return tables.read(name)
    first_day = F.to_timestamp(F.lit(month + "01"), "yyyyMMdd")
    later, earlier = panel.where(F.col("date") >= first_day), panel.where(F.col("date") < first_day).select("symbol", "date")
    back = Window.partitionBy("symbol").orderBy(F.desc("date"))
    known = earlier.join(later.select("symbol").distinct(), "symbol", "left_semi").withColumn("k", F.row_number().over(back)).where(F.col("k") <= LOOK_BACK)
    start = known.agg(F.min("date")).head()[0]
    tail = panel.where(F.col("date") >= F.lit(start)) if start else later
    rows = factors.add_factors(tail, features, as_float=False).where(F.col("date") >= first_day).select("symbol", "date", *features)
    tables.replace_from(name, rows, month)
    return tables.read(name)
