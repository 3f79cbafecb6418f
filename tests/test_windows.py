"""Hand-made cases with known answers."""

import datetime as dt


from pyspark.sql import functions as F

from factorloom.functions import windows as w
from factorloom.operators import crosssection, factors, labels, models, portfolio, scorecard
from factorloom.sources import asof, panel, store


def _days(n):
    return [dt.datetime(2024, 1, 1) + dt.timedelta(days=i) for i in range(n)]


def test_bucket_of_seven_in_five(spark):
    got = spark.range(1, 8).select("id", w.bucket("id", F.lit(7), 5).alias("b")).orderBy("id").collect()
    assert [r.b for r in got] == [1, 1, 2, 3, 4, 5, 5]
    assert spark.range(1).select(w.bucket(F.lit(64), F.lit(91), 10)).head()[0] == 7
    assert spark.range(1).select(w.bucket(F.lit(1), F.lit(1), 5)).head()[0] == 1


def test_rolling_needs_every_value(spark):
    rows = [("a", d, v) for d, v in zip(_days(5), [1.0, None, 3.0, 4.0, 5.0], strict=True)]
    got = spark.createDataFrame(rows, "symbol string, date timestamp, x double").select("date", w.rolling(F.avg, "x", 3).alias("m")).orderBy("date").collect()
    assert [r.m for r in got] == [None, None, None, None, 4.0]


def test_average_rank(spark):
    rows = spark.createDataFrame([(3.0,), (1.0,), (1.0,), (None,)], "x double")
    got = [r[0] for r in rows.select(w.percent_rank_average("x").alias("p"), "x").orderBy(F.col("x").asc_nulls_last()).collect()]
    assert got == [0.5, 0.5, 1.0, 0.0]


def test_constant_section_has_no_correlation(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert rows.agg(w.correlation("a", "b")).head()[0] is None


def test_returns_pad_missing_closes(spark):
    rows = [("a", d, c) for d, c in zip(_days(4), [10.0, None, 12.0, 0.0], strict=True)]
    bars = spark.createDataFrame(rows, "symbol string, date timestamp, close double").withColumns({c: F.col("close") for c in ("open", "high", "low")})
    got = [r.ret_1 for r in factors.add_factors(bars, ["ret_1", "no_such_factor"], as_float=False).orderBy("date").collect()]
    assert got[0] is None and [round(v, 6) for v in got[1:]] == [0.0, 0.2, -1.0]


def test_standard_set():
    assert len(factors.STANDARD_FACTORS) == len(set(factors.STANDARD_FACTORS)) == 124
    assert all(factors.describe(n) for n in factors.STANDARD_FACTORS)




def test_features_do_not_look_ahead(spark):
    rows = [("a", d, 10.0 + (i * 7) % 5) for i, d in enumerate(_days(40))]
    bars = spark.createDataFrame(rows, "symbol string, date timestamp, close double").withColumns({c: F.col("close") for c in ("open", "high", "low")})
    names = ["ret_5", "close_to_ma_10", "price_zscore_20", "vol_10", "atr_14"]
    full = factors.add_factors(bars, names).where(F.col("date") <= _days(40)[29]).orderBy("date").collect()
    assert full == factors.add_factors(bars.where(F.col("date") <= _days(40)[29]), names).orderBy("date").collect()


def test_iso_week_of_new_year(spark):
    days = [(dt.datetime(2020, 12, 31),), (dt.datetime(2021, 1, 1),), (dt.datetime(2021, 1, 4),), (dt.datetime(2021, 1, 6),)]
    got = [r.date.date() for r in labels.rebalance_dates(spark.createDataFrame(days, "date timestamp")).orderBy("date").collect()]
    assert got == [dt.date(2021, 1, 1), dt.date(2021, 1, 6)]


def test_as_of_same_day_ties_and_nulls(spark):
    filings = spark.createDataFrame([("a", 2, 1, 10), ("a", 2, 2, 20), ("a", 4, 3, None), ("b", 1, 1, 7)], "k string, ann int, end int, v int")
    bars = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("a", 5), ("c", 9), (None, 3)], "k string, d int")
    got = {(r.k, r.d): (r.v, r.end) for r in asof.as_of(bars, filings, "d", "ann", ["v", "end"], ["k"], ["end"]).collect()}
    assert got == {("a", 1): (None, None), ("a", 2): (20, 2), ("a", 3): (20, 2), ("a", 5): (None, 3), ("c", 9): (None, None), (None, 3): (None, None)}


def test_biweekly_returns_are_annualised_as_such(spark):
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(days=14 * i), 0.01) for i in range(6)]
    m = portfolio.metrics(portfolio.with_equity(spark.createDataFrame(rows, "date timestamp, portfolio_ret double"))).head()
    assert abs(m.periods_per_year_est - 365.25 / 14) < 1e-9 and m.max_drawdown == 0 and m.sharpe_est == 0
    empty = portfolio.metrics(portfolio.with_equity(spark.createDataFrame([], "date timestamp, portfolio_ret double"))).head()
    assert empty.status == "empty"


def test_weights_are_capped(spark):
    rows = [(dt.datetime(2024, 1, 5), s, float(s), True) for s in range(20)]
    scored = spark.createDataFrame(rows, "date timestamp, symbol int, score double, tradable_universe boolean")
    got = portfolio.positions(scored, "score").collect()
    assert len(got) == 12 and {r.symbol for r in got} == set(range(8, 20)) and all(abs(r.target_weight - 1 / 12) < 1e-12 for r in got)
    assert portfolio.positions(scored.where("symbol < 3"), "score").agg(F.max("target_weight")).head()[0] == 0.12


def test_neutral_scores_have_no_size_slope(spark):
    rows = [(dt.datetime(2024, 1, 5), s, float((s * 37) % 11), True, "ab"[s % 2], float(10 + s * s)) for s in range(30)]
    scored = spark.createDataFrame(rows, "date timestamp, symbol int, score double, tradable_universe boolean, industry string, float_mv double")
    out = crosssection.neutralize(scored, "score")
    cov, mean, std = out.agg(F.covar_pop("score_neutralized", F.ln("float_mv")), F.avg("score_neutralized"), F.stddev_pop("score_neutralized")).head()
    assert abs(cov) < 1e-9 and abs(mean) < 1e-9 and abs(std - 1) < 1e-9


def test_upsert_twice_changes_nothing(spark):
    now = spark.createDataFrame([("a", "1", 1.0), ("b", "1", 2.0)], "ts_code string, trade_date string, close double")
    new = spark.createDataFrame([("a", "1", "5"), ("c", "2", "x")], "ts_code string, trade_date string, close string")
    once = store.upsert(now, new, ("ts_code", "trade_date"))
    want = {("a", "1", 5.0), ("b", "1", 2.0), ("c", "2", None)}
    assert {tuple(r) for r in once.collect()} == want == {tuple(r) for r in store.upsert(once, new, ("ts_code", "trade_date")).collect()}


def test_refresh_window():
    assert store.refresh_window([None, "20240110", "20240108"], end="2024-02-01") == ("20240101", "20240201")
    assert store.refresh_window([None], end="20240201") == (store.FIRST_DATE, "20240201")
    assert store.refresh_window([], start="2024-01-05", end="20240201") == ("20240105", "20240201")


def test_normalize_defaults(spark):
    rows = spark.createDataFrame([("2024-01-02", "a", "1", "x", "nan", "2", "3", None)], "date string, symbol string, open string, high string, low string, close string, volume string, in_universe boolean")
    r = panel.normalize(rows.withColumn("amount", F.lit(1))).head()
    assert (r.high, r.low, r.listed_days, r.in_universe, r.industry, r.is_st) == (None, None, 9999, False, "UNKNOWN", False)


def test_ridge_matches_closed_form(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3))
    y = x @ [1.0, -2.0, 0.5] + rng.normal(size=200)
    fit = models.fit_ridge(spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], "a double, b double, c double, y double"), ["a", "b", "c"], "y")
    xc, yc = x - x.mean(axis=0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + np.eye(3), xc.T @ yc)
    assert np.allclose([fit.coefficients[c] for c in "abc"], want, atol=1e-8)


def test_greedy_correlation_filter(spark):
    rows = spark.createDataFrame([(float(i), 2.0 * i, float((i * 7) % 5), 1.0) for i in range(20)], "a double, b double, c double, d double")
    assert crosssection.drop_correlated(rows, ["a", "b", "c", "d"]) == ["a", "c", "d"]
    assert crosssection.drop_correlated(rows, ["a", "b"], 1.0) == ["a", "b"]


def test_mode_tie_takes_the_smaller(spark):
    rows = spark.createDataFrame([("f", 1), ("f", -1)], "feature string, direction int")
    assert rows.agg(F.mode("direction", True)).head()[0] == -1
    assert scorecard.GateConfig().whitelist_max == 50
