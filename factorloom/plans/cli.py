"""Command line: ``python -m factorloom.plans.cli COMMAND ...``."""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from factorloom.operators import factors, scorecard
from factorloom.operators.ranker import SEARCH_SPACE
from factorloom.plans import research
from factorloom.plans.artefacts import named, output_health, write_artefacts
from factorloom.sources import panel as panels
from factorloom.sources import rawstore, store

COMMANDS = (
    "run", "research-run", "factor-chain-run", "tune-lgbm", "single-factor-run", "family-lab", "export-panel", "export-index-benchmark", "update-raw",
    "update-index-weight", "update-index-daily", "rebuild-fina-indicator", "prune-db", "daily-research", "horizon-matrix", "check-outputs",
    "factor-registry", "check-registry",
)
#: What a command cannot do without.
NEEDS = {
    "research-run": ("research_start", "research_end", "train_months", "test_months"), "factor-chain-run": ("research_start", "research_end", "train_months", "test_months"),
    "tune-lgbm": ("research_start", "train_months", "test_months"), "single-factor-run": ("research_start", "research_end"),
    "family-lab": ("family", "research_start", "research_end"), "update-raw": ("incoming",), "update-index-weight": ("incoming",), "update-index-daily": ("incoming",),
    "daily-research": ("incoming",), "check-registry": ("output_dir",), "factor-registry": ("output_dir",),
}
_INTS = (
    "train-days", "train-months", "test-months", "step-months", "mining-months", "warmup-months", "min-train-rows", "top-n", "lookback-days", "limit-stocks", "lgbm-n-estimators",
    "lgbm-min-boost-round", "lgbm-early-stopping-rounds", "lgbm-max-depth", "lgbm-min-child-samples", "lgbm-rank-bins", "lgbm-truncation", "factor-top-k", "factor-fallback-top-n", "factor-report-top-k",
    "single-factor-top-k", "tune-trials", "folds", "horizon", "min-listed-days",
)
_FLOATS = (
    "lgbm-learning-rate", "lgbm-subsample", "lgbm-colsample-bytree", "lgbm-reg-alpha", "lgbm-reg-lambda", "factor-min-rank-ic", "factor-max-corr",
    "factor-min-abs-rank-ic-ir", "factor-min-bucket-spearman", "factor-min-positive-top-bucket-excess-ratio", "factor-min-latest-top-bucket-excess",
    "factor-core-quantile", "factor-candidate-quantile", "ridge-min-selection-rate-multi-split", "ridge-min-selection-rate-single-split",
    "ridge-max-original-coef-cv", "min-amount", "alpha",
)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="factorloom")
    p.add_argument("command", choices=COMMANDS)
    for name in ("input", "output", "output-dir", "store", "incoming", "benchmark", "index-code", "start-date", "end-date", "research-start", "research-end", "feature-pool", "log"):
        p.add_argument(f"--{name}")
    for name in _INTS:
        p.add_argument(f"--{name}", type=int)
    for name in _FLOATS:
        p.add_argument(f"--{name}", type=float)
    p.add_argument("--family", choices=tuple(scorecard.FAMILY_FACTORS))
    p.add_argument("--features", nargs="*")
    p.add_argument("--bucket-count", type=int, choices=(5, 10), default=5)
    p.add_argument("--rebalance-weekday", type=int, choices=range(5))
    for name in ("neutralize-scores", "no-neutralize-industry", "no-neutralize-size", "execute"):
        p.add_argument(f"--{name}", action="store_true")
    return p


def _given(**values):
    return {k: v for k, v in values.items() if v is not None}


def config(args: argparse.Namespace) -> research.ResearchConfig:
    """The defaults with everything that the command line gives."""
    cfg = research.ResearchConfig()
    book = replace(cfg.portfolio, **_given(top_n=args.top_n, rebalance_weekday=args.rebalance_weekday))
    gate = replace(cfg.gate, **_given(
        min_abs_rank_ic_ir=args.factor_min_abs_rank_ic_ir, min_bucket_spearman=args.factor_min_bucket_spearman,
        min_excess_year_ratio=args.factor_min_positive_top_bucket_excess_ratio, min_latest_excess=args.factor_min_latest_top_bucket_excess,
        core_quantile=args.factor_core_quantile, candidate_quantile=args.factor_candidate_quantile,
    ))
    ridge = replace(cfg.ridge_gate, **_given(
        min_selection_rate_multi=args.ridge_min_selection_rate_multi_split, min_selection_rate_single=args.ridge_min_selection_rate_single_split,
        max_original_coef_cv=args.ridge_max_original_coef_cv,
    ))
    depth = args.lgbm_max_depth if args.lgbm_max_depth is None or args.lgbm_max_depth > 0 else None
    ranker = replace(cfg.ranker, **_given(
        rounds=args.lgbm_n_estimators, warm_up=args.lgbm_min_boost_round, patience=args.lgbm_early_stopping_rounds, learning_rate=args.lgbm_learning_rate,
        max_depth=depth, min_rows=args.lgbm_min_child_samples, subsample=args.lgbm_subsample, colsample=args.lgbm_colsample_bytree, l1=args.lgbm_reg_alpha,
        l2=args.lgbm_reg_lambda, rank_bins=args.lgbm_rank_bins, truncation=args.lgbm_truncation,
    ))
    return replace(cfg, buckets=args.bucket_count, portfolio=book, gate=gate, ridge_gate=ridge, ranker=ranker, neutralize=args.neutralize_scores,
                   neutralize_industry=not args.no_neutralize_industry, neutralize_size=not args.no_neutralize_size, data_start=args.start_date, data_end=args.end_date,
                   **_given(train_months=args.train_months, test_months=args.test_months, step_months=args.step_months or args.test_months, mining_months=args.mining_months,
                            warmup_months=args.warmup_months, train_dates=args.train_days, min_rows=args.min_train_rows, top_k=args.factor_top_k,
                            min_rank_ic=args.factor_min_rank_ic, max_corr=args.factor_max_corr, fallback_top_n=args.factor_fallback_top_n,
                            horizon=args.horizon, min_listed_days=args.min_listed_days, min_amount=args.min_amount, alpha=args.alpha))


def session() -> SparkSession:
    return SparkSession.builder.appName("factorloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _incoming(spark: SparkSession, folder: str, names) -> dict[str, DataFrame]:
    """The tables that the folder has, one Parquet file or folder each."""
    from pyspark.errors import AnalysisException

    found = {}
    for n in names:
        try:
            found[n] = spark.read.parquet(f"{folder}/{n}.parquet")
        except AnalysisException:
            continue
    if not found:
        raise ValueError(f"no table of {', '.join(names)} in {folder}")
    return found


def _update(tables: rawstore.RawStore, args, names) -> None:
    """Upsert what came; daily tables from the look-back before their last date on, unless a start is given."""
    incoming = _incoming(tables.spark, args.incoming, names)
    dated = [n for n in incoming if store.DATES[n] == "trade_date"]
    tables.create_missing(dated)
    latest = [store.status(tables.read(n)).head().max_date for n in dated]
    first, last = store.refresh_window(latest, args.start_date, args.end_date or "99991231", args.lookback_days if args.lookback_days is not None else 7)
    incoming |= {n: incoming[n].where(_between("trade_date", first, last)) for n in dated}
    print(store.format_status(rawstore.update_raw(tables, incoming)))


def _between(column: str, first: str, last: str):
    from pyspark.sql import functions as F

    return F.col(column).cast("string").between(first, last)


def _export_panel(tables: rawstore.RawStore, code: str, args, path: str) -> None:
    names = ("daily_kline", "daily_basic", "stock_basic", "index_weight", "fina_indicator_clean")
    t = {n: tables.read(n, *((args.start_date, args.end_date) if n.startswith("daily_") else ())) if tables.exists(n) else None for n in names}
    panels.export_panel(panels.build_panel(*t.values(), code, args.start_date, args.end_date), path)
    print(path)


def _export_benchmark(tables: rawstore.RawStore, code: str, args, path: str) -> None:
    panels.index_benchmark(tables.read("index_daily"), code, args.start_date, args.end_date).write.mode("overwrite").parquet(path)
    print(path)


def _store_command(spark: SparkSession, args, code: str) -> bool:
    """Commands on the raw tables; whether it was one."""
    tables = rawstore.RawStore(spark, args.store or "data/raw_store")
    if args.command == "update-raw":
        _update(tables, args, [n for n in store.COLUMNS if n not in ("index_weight", "index_daily", "fina_indicator_clean")])
    elif args.command in ("update-index-weight", "update-index-daily"):
        _update(tables, args, [args.command.removeprefix("update-").replace("-", "_")])
    elif args.command == "rebuild-fina-indicator":
        raw = _incoming(spark, args.incoming, ["fina_indicator_raw_v2"])["fina_indicator_raw_v2"] if args.incoming else None
        print(store.format_status(rawstore.rebuild_filings(tables, raw, args.limit_stocks)))
    elif args.command == "prune-db":
        plan = rawstore.prune_plan(tables, {n: "raw table" for n in store.COLUMNS}, {})
        print(store.format_plan(plan))
        rawstore.prune(tables, plan, args.execute)
    elif args.command == "export-panel":
        _export_panel(tables, code, args, args.output or "data/daily_bars.parquet")
    elif args.command == "export-index-benchmark":
        _export_benchmark(tables, code, args, args.output or panels.benchmark_path(code))
    elif args.command == "daily-research":
        _update(tables, args, [n for n in store.COLUMNS if n != "fina_indicator_clean"])
        if tables.exists("fina_indicator_raw_v2"):
            rawstore.rebuild_filings(tables)
        args.input, args.benchmark = args.output or "data/daily_bars.parquet", args.benchmark or panels.benchmark_path(code)
        _export_panel(tables, code, args, args.input)
        _export_benchmark(tables, code, args, args.benchmark)
        return False  # and then as ``run``
    else:
        return False
    return True


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    missing = [n for n in NEEDS.get(args.command, ()) if getattr(args, n) is None]
    if missing:
        raise ValueError(f"{args.command} requires: {', '.join(missing)}")
    spark, cfg = session(), config(args)
    code, out = args.index_code or panels.DEFAULT_INDEX, args.output_dir or "outputs"
    if args.command == "check-outputs":
        row = output_health(spark, out, args.log).head()
        print("\n".join(f"{k}={v}" for k, v in row.asDict().items()))
        if row.status == "error":
            raise SystemExit(1)
        return
    names = panels.feature_pool(spark, args.feature_pool) if args.feature_pool else args.features or list(factors.STANDARD_FACTORS)
    if args.command == "factor-registry":
        write_artefacts({"factor_registry.csv": factors.registry(spark, names)}, out)
    elif args.command == "check-registry":
        write_artefacts({"factor_registry_check.json": factors.registry_report(factors.registry(spark, names))}, out)
    elif not _store_command(spark, args, code):
        if args.store:
            rawstore.RawStore(spark, args.store).register(["index_daily"])  # what the benchmark falls back to
        panel = panels.load_panel(spark, panels.resolve_input(args.input or "data/daily_bars.parquet"), args.start_date, args.end_date)
        index = panels.official_benchmark(spark, panel, code, args.benchmark)
        panels.write_run_config(cfg, f"{out}/run_config.json")
        found = research_command(spark, args, cfg, panel, names, index)
        for split, frames in found.pop("splits", {}).items():
            write_artefacts(named(frames, None), f"{out}/split_{int(split):02d}")
        write_artefacts(named({k: v for k, v in found.items() if v is not None}), out)


def research_command(spark: SparkSession, args, cfg: research.ResearchConfig, panel: DataFrame, names: list[str], index: DataFrame) -> dict:
    """The results of a command on the panel, by name."""
    a, b = args.research_start, args.research_end
    if args.command in ("run", "daily-research"):
        return research.retrain(spark, panel, names, cfg, index=index, folds=args.folds)
    if args.command == "research-run":
        return research.research_run(spark, panel, names, cfg, a, b, index)
    if args.command == "factor-chain-run":
        return research.factor_chain_run(spark, panel, names, cfg, a, b, index)
    if args.command == "single-factor-run":
        return research.single_factor_run(spark, panel, names, cfg, a, b, index)
    if args.command == "family-lab":
        return {"family_registry": research.family_lab(spark, panel, args.family, cfg, a, b, index)}
    if args.command == "horizon-matrix":
        return research.horizon_matrix(panel, names, cfg, start=a, end=b)
    middle = research.date.fromisoformat(a)
    first, last = research.add_months(middle, -cfg.train_months), research.add_months(middle, cfg.test_months)
    space = None
    if args.lgbm_n_estimators:  # as many rounds for every trial
        space = SEARCH_SPACE | {"n_estimators": (args.lgbm_n_estimators,)}
    return {"tuning_trials": research.tune_run(spark, panel, names, cfg, first.isoformat(), a, last.isoformat(), args.tune_trials or 20, space=space)}


if __name__ == "__main__":
    main()
