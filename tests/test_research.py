import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.operators import crosssection as xs
from factorloom.operators import factors, models, moments, ranker
from factorloom.operators.labels import add_relevance
from factorloom.plans import cli, research
from factorloom.plans.artefacts import output_health
from factorloom.sources import panel as panels
from factorloom.plans.queries import MIN_AMOUNT, ORACLE, QUERIES
from factorloom.sources.tables import derived_panel

SF = "/root/testdata/sf0.001"


def test_every_query_but_the_trees_has_sql():
    assert set(QUERIES) - set(ORACLE) == {"boosted_scores", "ranker_scores"} and set(ORACLE) <= set(QUERIES)


def test_splits_step_and_stop():
    cfg = replace(research.ResearchConfig(), train_months=12, test_months=6, step_months=6)
    got = research.splits("2020-01-31", "2021-12-31", cfg)
    assert [(s["train_start"], s["train_end"], s["test_end"]) for s in got] == [("2019-01-31", "2020-01-31", "2020-07-31"), ("2019-07-31", "2020-07-31", "2021-01-31"), ("2020-01-31", "2021-01-31", "2021-07-31")]
    assert got[0]["mining_start"] == "2014-01-31" and [s["split_id"] for s in got] == ["1", "2", "3"]
    assert [s["test_end"] for s in research.splits("2020-01-01", "2020-06-30", cfg)] == ["2020-07-01"]  # the end is a day of the window
    assert str(research.add_months(research.date(2024, 5, 31), -3)) == "2024-02-29"


NAMES = ["ret_5", "close_to_ma_10", "trend_5_20"]


def _small(**more):
    return replace(research.ResearchConfig(), mining_months=12, train_months=24, test_months=12, step_months=12, min_listed_days=60, min_amount=MIN_AMOUNT / 100, min_rows=50,
                   ranker=models.RankerConfig(rounds=2, warm_up=1, patience=1, max_depth=2, min_rows=5), **more)


@pytest.fixture(scope="module")
def panel(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('bars')}/daily_bars.parquet"
    derived_panel(spark, SF).write.parquet(path)
    return path


@pytest.fixture(scope="module")
def chain(spark, panel):
    """Three splits; the first one alone, too."""
    got = research.factor_chain_run(spark, panels.load_panel(spark, panel), NAMES, _small(), "1999-01-01", "2002-01-02")
    one = {"1": got["splits"]["1"]}
    alone = got | {"splits": one, "windows": got["windows"].where("split_id = 1"), "split_summary": research.split_summary(spark, one, got["windows"])}
    return {3: got, 1: alone | research.pools(spark, one, _small())}


@pytest.mark.parametrize("count", [1, 3])
def test_chain_mines_gates_and_scores_both_sides(chain, count):
    got = chain[count]
    assert [r.skipped for r in got["windows"].orderBy("split_id").collect()] == [False] * count and list(got["splits"]) == [str(k + 1) for k in range(count)]
    split = got["splits"]["1"]
    assert {r.year for r in split["annual_report"].select("year").collect()} == {1996}
    listed = {r.feature for r in split["whitelist"].collect()}
    chosen, pool = {r.feature for r in split["ridge_coefficients"].collect()}, {r.feature for r in split["ranker_pool"].collect()}
    assert pool and pool <= chosen <= listed <= set(NAMES) and {r.feature for r in split["feature_importance_summary"].collect()} == pool
    ends = {p: split[f"predictions_{p}"].agg(F.min("date"), F.max("date"), F.count("lgbm_score"), F.count("ridge_score"), F.count(F.lit(1))).head() for p in ("valid", "test")}
    assert ends["valid"][1] < ends["test"][0] and str(ends["test"][0]) >= "1999-01-01" and all(e[2] == e[3] == e[4] > 0 for e in ends.values())
    screen, table = {r.feature: r for r in got["ridge_screen"].collect()}, got["ridge_coefficients"].collect()
    for f, r in screen.items():
        coefs = [x.original_coef for x in table if x.feature == f]
        assert r.selection_rate == pytest.approx(len(coefs) / count)
        spread = None if len(coefs) < 2 else np.std(coefs, ddof=1) / np.mean(np.abs(coefs))
        assert (r.ridge_original_coef_cv is None) == (spread is None) and (spread is None or r.ridge_original_coef_cv == pytest.approx(spread))
        assert r.pass_ridge_gate == (r.selection_rate >= (0.5 if count > 1 else 1.0) and (spread or 0.0) <= 1.5)
    if count == 1:  # a coefficient of one split has no variation and passes
        assert {f for f, r in screen.items() if r.pass_ridge_gate} == chosen
    final = {r.feature: (r.final_status, r.lgbm_selection_count) for r in got["lgbm_feature_pool"].collect()}
    used = {x.feature for x in got["lgbm_selected_feature_frequency"].collect()}
    assert set(final) == used & set(screen) and {s for s, _ in final.values()} == {"used_by_lgbm"}
    summary = got["split_summary"].collect()
    assert {(r.split_id, r.phase, r.model) for r in summary} == {(k + 1, p, m) for k in range(count) for p in ("valid", "test") for m in ("ridge", "lgbm")}
    assert {(r.split_id, r.phase) for r in got["feature_screening_summary"].collect()} == {(k + 1, p) for k in range(count) for p in ("valid", "test")}


def test_a_split_without_rows_says_why(spark, panel):
    cfg = replace(_small(), min_rows=10_000_000)
    got = research.factor_chain_run(spark, panels.load_panel(spark, panel), NAMES, cfg, "1999-01-01", "2000-01-02")
    assert [(r.skipped, r.reason) for r in got["windows"].collect()] == [(True, "too few rows to train or test on")] and not got["splits"]
    assert got["ridge_screen"].count() == 0 and got["split_summary"] is None


def test_rolling_fits_equal_a_fit_of_each_window(spark):
    rng = np.random.default_rng(1)
    dates = [f"2024-01-{d:02d} 00:00:00" for d in range(1, 29)]
    rows = [(d, f"s{k}", bool(k != 9), *[None if rng.random() < 0.1 else float(v) for v in rng.normal(size=3)], float(rng.normal()) if k != 8 else None) for d in dates for k in range(10)]
    frame = spark.createDataFrame(rows, "date string, symbol string, tradable_universe boolean, a double, b double, c double, y double").withColumn("date", F.to_timestamp("date"))
    names, train = ["a", "b", "c"], 7
    days = frame.select("date").distinct().where(F.dayofmonth("date") % 5 == 0)
    got = {str(r.date): r for r in moments.rolling_ridge(frame, names, "y", days, train, alpha=2.0).collect()}
    assert sorted(got) == [d for d in dates if int(d[8:10]) % 5 == 0 and int(d[8:10]) > train]
    for d, r in got.items():
        at = dates.index(d)
        own = [x for x in rows if x[0] in dates[at - train : at] and x[2] and x[6] is not None]
        x, y = np.array([[v or 0.0 for v in o[3:6]] for o in own]), np.array([o[6] for o in own])
        centred = x - x.mean(axis=0)
        want = np.linalg.solve(centred.T @ centred + 2.0 * np.eye(3), centred.T @ (y - y.mean()))
        assert r.n == len(own) and np.allclose(r.coefficients, want) and r.intercept == pytest.approx(y.mean() - want @ x.mean(axis=0))
        assert (str(r["first"]), str(r["last"])) == (dates[at - train], dates[at - 1])
    windows = spark.createDataFrame([(1, dates[0], dates[9]), (2, "2025-01-01 00:00:00", "2026-01-01 00:00:00")], "split_id int, start string, end string")
    windows = windows.withColumns({c: F.to_timestamp(c) for c in ("start", "end")})
    once = moments.window_ridge(frame, names, "y", windows, alpha=2.0).collect()
    assert [(r.split_id, str(r["last"])) for r in once] == [(1, dates[8])]


def test_pair_correlations_over_gaps(spark):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(400, 4)) + 1e6
    data[:, 1] += data[:, 0]
    data[rng.random((400, 4)) < 0.3] = np.nan
    data[:, 3] = 5.0
    frame = spark.createDataFrame([[None if np.isnan(v) else float(v) for v in r] for r in data], "a double, b double, c double, d double").repartition(5)
    got = {(r.a, r.b): r["corr"] for r in moments.pair_correlations(frame, list("abcd")).collect()}
    assert len(got) == 6
    for i, a in enumerate("abc"):
        assert got[a, "d"] is None
        for j, b in enumerate("abc"):
            if i < j:
                both = ~np.isnan(data[:, i]) & ~np.isnan(data[:, j])
                assert got[a, b] == pytest.approx(np.corrcoef(data[both, i], data[both, j])[0, 1], abs=1e-9)
    assert xs.drop_correlated(frame, list("abc"), 0.6) == ["a", "c"] and moments.pair_correlations(frame, ["a"]).count() == 0


def test_lambda_gradients_by_pairs():
    rng = np.random.default_rng(5)
    for n, k in ((1, 3), (6, 3), (12, 20), (15, 4)):
        margin, label = rng.normal(size=n).round(1), rng.integers(0, 4, n).astype(float)
        order = sorted(range(n), key=lambda i: (-margin[i], i))
        best = sum((2 ** v - 1) / math.log2(r + 2) for r, v in enumerate(sorted(label, reverse=True)[:k]))
        g, h, total = [0.0] * n, [0.0] * n, 0.0
        for a in range(n):
            for b in range(a + 1, n):
                i, j = order[a], order[b]
                if a >= k or label[i] == label[j] or best == 0:
                    continue
                change = abs(2 ** label[i] - 2 ** label[j]) * abs(1 / math.log2(a + 2) - 1 / math.log2(b + 2)) / best
                if margin[order[0]] != margin[order[-1]]:
                    change /= 0.01 + abs(margin[i] - margin[j])
                high, low = (i, j) if label[i] > label[j] else (j, i)
                p = 1 / (1 + math.exp(margin[high] - margin[low]))
                g[high] -= change * p
                g[low] += change * p
                h[i] += change * p * (1 - p)
                h[j] += change * p * (1 - p)
                total += 2 * change * p
        scale = math.log2(1 + total) / total if total else 1.0
        got = ranker.lambda_gradients(margin, label, k)
        assert np.allclose(got[0], np.array(g) * scale) and np.allclose(got[1], np.array(h) * scale)


def test_ranker_learns_the_head_of_a_list(spark):
    """What matters is who comes first: most of the target's spread is noise that a pointwise loss chases."""
    rng = np.random.default_rng(7)
    rows = []
    for d in range(60):
        a, b = rng.normal(size=(2, 40))
        y = 0.3 * a + np.where(b > 1.0, 2.0, 0.0) + rng.normal(size=40)
        rows += [(f"2024-{1 + d // 28:02d}-{1 + d % 28:02d}", f"s{k:02d}", float(a[k]), float(b[k]), float(y[k])) for k in range(40)]
    frame = spark.createDataFrame(rows, "date string, symbol string, a double, b double, y double").withColumn("date", F.to_timestamp("date")).cache()
    train, rest = models.chronological_split(frame, 0.5)
    valid, test = models.chronological_split(rest, 0.5)
    cfg = models.RankerConfig(rounds=12, warm_up=3, patience=4, max_depth=2, min_rows=20, learning_rate=0.2, bins=16, colsample=1.0)
    model = models.fit_ranker(train, ["a", "b"], "y", cfg, valid)
    assert 3 <= len(model.trees) <= 12 and max(model.history) > model.history[0] and sum(model.importance().values()) > 0
    again = models.fit_ranker(train, ["a", "b"], "y", cfg, valid)
    assert [t.value.tolist() for t in again.trees] == [t.value.tolist() for t in model.trees]
    more = models.fit_ranker(train, ["a", "b"], "y", replace(cfg, rounds=1), init=model)
    assert len(more.trees) == len(model.trees) + 1 and more.trees[0] is model.trees[0]
    judged = add_relevance(test, "y")
    value = lambda rows, c: models.ndcg(rows, c, k=20).agg(F.avg("ndcg")).head()[0]
    own = value(model.scores(judged), "lgbm_score")
    trees = models.fit_boosted(train, ["a", "b"], "y", models.BoostConfig(rounds=12, max_depth=2, learning_rate=0.2, min_rows=20), valid)
    assert own > value(judged.withColumn("none", F.rand(1)), "none") + 0.1
    assert own > value(models.boosted_scores(trees, judged, ["a", "b"]), "gbt_score") - 0.03


def test_each_research_command_runs(spark, panel, tmp_path):
    small = ["--features", *NAMES, "--min-listed-days", "60", "--min-amount", "300", "--min-train-rows", "20", "--train-days", "60", "--lgbm-n-estimators", "1", "--lgbm-min-boost-round", "1",
             "--lgbm-max-depth", "1", "--lgbm-min-child-samples", "5", "--folds", "2", "--input", panel, "--rebalance-weekday", "0"]
    cli.main(["run", *small, "--output-dir", f"{tmp_path}/run", "--neutralize-scores"])
    row = output_health(spark, f"{tmp_path}/run").head()
    assert (row.status, row.reason) == ("ok", "") and row.predictions_rows > 0
    table = spark.read.schema("strategy string, kind string, sharpe_est double").json(f"{tmp_path}/run/metrics.json").collect()
    assert {r.strategy for r in table} == {"ridge", "lgbm", "lgbm_neutralized"}
    cli.main(["check-outputs", "--output-dir", f"{tmp_path}/run"])
    with pytest.raises(SystemExit):
        cli.main(["check-outputs", "--output-dir", f"{tmp_path}/nothing"])
    cli.main(["research-run", *small, "--research-start", "2000-01-01", "--research-end", "2000-12-31", "--train-months", "18", "--test-months", "12", "--output-dir", f"{tmp_path}/research"])
    rows = spark.read.csv(f"{tmp_path}/research/split_summary.csv", header=True).collect()
    assert {(r.phase, r.model) for r in rows} == {(p, m) for p in ("valid", "test") for m in ("ridge", "lgbm")}
    cli.main(["horizon-matrix", *small, "--output-dir", f"{tmp_path}/matrix"])
    assert {r.experiment for r in spark.read.csv(f"{tmp_path}/matrix/summary.csv", header=True).collect()} == {e[0] for e in research.EXPERIMENTS}
    with pytest.raises(ValueError, match="requires: research_start"):
        cli.main(["factor-chain-run", "--research-end", "2000-01-01"])


def test_command_line_options():
    args = ["factor-chain-run", "--top-n", "5", "--bucket-count", "10", "--neutralize-scores", "--lgbm-num-rounds", "3"]
    with pytest.raises(SystemExit):
        cli.parser().parse_args(args)
    cfg = cli.config(cli.parser().parse_args([*args[:-2], "--lgbm-n-estimators", "7", "--ridge-max-original-coef-cv", "0.5", "--factor-core-quantile", "0.9", "--start-date", "2001-01-01",
                                              "--no-neutralize-size", "--test-months", "3", "--lgbm-max-depth", "-1"]))
    assert cfg.portfolio.top_n == 5 and cfg.buckets == 10 and cfg.neutralize and not cfg.neutralize_size and cfg.neutralize_industry
    assert cfg.ranker.rounds == 7 and cfg.ridge_gate.max_original_coef_cv == 0.5 and cfg.gate.core_quantile == 0.9 and cfg.data_start == "2001-01-01"
    assert cfg.test_months == cfg.step_months == 3 and cfg.ranker.max_depth == models.RankerConfig().max_depth


def test_bounds_stay_within_the_data():
    split = {"split_id": "1", "mining_start": "2015-01-31", "train_start": "2020-01-31", "train_end": "2021-01-31", "test_end": "2021-07-31"}
    assert research.clamp(split) == split
    got = research.clamp(split, "2016-01-01", "2021-06-30")
    assert (got["split_id"], got["mining_start"], got["train_start"], got["test_end"]) == ("1", "2016-01-01", "2020-01-31", "2021-07-01")


def test_registry_report(spark):
    good = factors.registry_report(factors.registry(spark)).head()
    assert good.status == "ok" and good.feature_count == len(factors.STANDARD_FACTORS) and good.missing_columns == []
    rows = factors.registry(spark, ["ret_5", "trend_5_20"])
    bad = rows.unionByName(rows.where("feature = 'ret_5'")).withColumn("calc_source", F.when(F.col("feature") == "ret_5", "vendor").otherwise(F.col("calc_source")))
    got = factors.registry_report(bad.drop("status").withColumn("production_ready", F.lit(None).cast("boolean"))).head()
    assert got.status == "error" and got.duplicated_features == ["ret_5"] and got.invalid_calc_source == ["ret_5"]
    assert got.not_production_ready == ["ret_5", "trend_5_20"] and got.missing_columns == ["status"] and got.feature_count == 3
    assert factors.registry_report(rows.limit(0)).head().feature_count == 0


def test_benchmark_from_file_then_table_then_nothing(spark, tmp_path):
    dates = spark.sql("select explode(array(timestamp'2024-01-02', timestamp'2024-01-04')) as date")
    path = str(tmp_path / "none.parquet")
    assert panels.official_benchmark(spark, dates, path=path, table="no_such_table").count() == 0
    spark.createDataFrame([(panels.DEFAULT_INDEX, "20240102", 11.0, 10.0), (panels.DEFAULT_INDEX, "20240103", 12.0, 11.0), ("x", "20240104", 5.0, 1.0)],
                          "ts_code string, trade_date string, close double, pre_close double").createOrReplaceTempView("index_for_test")
    got = panels.official_benchmark(spark, dates, path=path, table="index_for_test").collect()
    assert [(round(r.benchmark_ret, 9), round(r.benchmark_equity, 9)) for r in got] == [(0.1, 1.1)]
    spark.sql("select date, 0.5D as benchmark_ret from (select explode(array(timestamp'2024-01-04', timestamp'2024-01-05')) as date)").write.parquet(path)
    assert [r.benchmark_equity for r in panels.official_benchmark(spark, dates, path=path, table="index_for_test").collect()] == [1.5]


def test_tuning_orders_its_trials(spark):
    cfg = replace(research.ResearchConfig(), min_listed_days=60, min_amount=MIN_AMOUNT / 100, ranker=models.RankerConfig(warm_up=1, patience=1, min_rows=5))
    assert len(ranker.search_trials(10**6)) == 8748 and ranker.search_trials(3) == ranker.search_trials(5)[:3]
    space = {k: v[:1] for k, v in ranker.SEARCH_SPACE.items()} | {"n_estimators": (1, 2), "num_leaves": (2, 4), "min_child_samples": (5,)}
    got = research.tune_run(spark, derived_panel(spark, SF), ["ret_5", "trend_5_20"], cfg, "1998-01-01", "1999-01-01", "1999-07-01", trials=3, space=space).collect()
    assert [r.place for r in got] == [1, 2, 3] and [r.ndcg_20 for r in got] == sorted((r.ndcg_20 for r in got), reverse=True)
    assert all(0 <= r.ndcg_20 <= 1 and 1 <= r.trees <= 2 and "num_leaves" in r.config for r in got) and len({r.config for r in got}) == 3
    deep = ranker.trial_config(models.RankerConfig(), {k: v[-1] for k, v in ranker.SEARCH_SPACE.items()})
    assert (deep.rounds, deep.max_depth, deep.l1, deep.colsample) == (1200, 6, 1.5, 0.9)
    assert {"run", "research-run", "daily-research", "update-index-weight", "update-index-daily", "tune-lgbm", "check-registry"} <= set(cli.COMMANDS)
