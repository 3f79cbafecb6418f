"""Steps that several queries share: what is computed once, and what a task holds."""

import numpy as np
from pyspark.sql import functions as F

from factorloom.operators import crosssection as xs
from factorloom.operators import factors
from factorloom.plans import queries


def _bars(spark, days=30):
    rows = spark.range(3 * days).select((F.col("id") % 3).alias("symbol"), F.timestamp_seconds(F.floor(F.col("id") / 3) * 86400).alias("date"), (F.col("id") * 37 % 101 + 1.0).alias("close"))
    return rows.withColumns({c: F.col("close") + k for k, c in enumerate(("open", "high", "low", "amount", "turnover_rate"))})


def test_factors_share_rolling_statistics(spark):
    """Five factors use the mean of 5 closes; its frame is walked once, and the values are those of each factor alone."""
    names = ["close_to_ma_5", "trend_5_10", "trend_5_20", "ma_spread_5_10_20", "price_zscore_5"]
    rows = factors.add_factors(_bars(spark), names, as_float=False)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("avg(close") == 3 and plan.count("stddev_samp(close") == 1
    alone = factors.stage(_bars(spark)).select("symbol", "date", *[factors.factor_column(n).alias(n) for n in names])
    assert sorted(map(tuple, rows.select(alone.columns).collect()), key=str) == sorted(map(tuple, alone.collect()), key=str)
    assert set(rows.columns) == {*_bars(spark).columns, *names}


def test_feature_ranks_share_sorts(spark):
    """Ranks, places and counts of a feature come from one sort, those of the target from another; ties, gaps and both zeros are averaged."""
    values = [(1, 0.0), (2, -0.0), (3, None), (4, 2.0), (5, 2.0), (6, 2.0), (7, 1.0), (8, None)]
    rows = spark.createDataFrame([(s, "2020-01-01", v, s % 3 * 1.0, True) for s, v in values], "symbol long, date string, x double, target double, tradable_universe boolean")
    assert _sorts(xs.feature_daily(rows, ["x"], "target")) == 2
    has = [(s, v) for s, v in values if v is not None]
    mean_place = lambda v, among: sum(w < v for w in among) + (sum(w == v for w in among) + 1) / 2
    targets = [s % 3 * 1.0 for s, _ in values]
    a, b = [mean_place(v, [w for _, w in has]) for _, v in has], [mean_place(s % 3 * 1.0, targets) for s, _ in has]
    got = xs.feature_daily(rows, ["x"], "target").head()
    assert abs(got.rank_ic - np.corrcoef(a, b)[0, 1]) < 1e-12


def _sorts(rows):
    return rows._jdf.queryExecution().executedPlan().toString().count("Sort [")


def test_yearly_ranks_share_sorts(spark):
    """Raw places, counts and quantiles come from one sort; clipped places in both directions and the target have one each."""
    rows = spark.createDataFrame([(s, "2020-01-01", s * 1.0, s % 3 * 1.0, True) for s in range(7)], "symbol long, date string, x double, target double, tradable_universe boolean")
    assert _sorts(xs.feature_days(rows, ["x"], "target")) == 4


def test_boosted_query_fits_the_whole_model(spark, monkeypatch):
    """The registered query boosts with the operator's own defaults, not with a few shallow rounds."""
    seen = []

    class Constant:
        def transform(self, rows):
            return rows.withColumn("__score", F.lit(0.0))

    def fit(train, features, target, cfg=queries.models.BoostConfig(), valid=None):
        seen.append(cfg)
        return Constant()

    monkeypatch.setattr(queries.models, "fit_boosted", fit)
    queries.QUERIES["boosted_scores"](spark, "/root/testdata/sf0.001")
    assert seen == [queries.models.BoostConfig()] and (seen[0].rounds, seen[0].max_depth) == (100, 5)
