"""Cross-sectional statistics per date: correlations, buckets, standardised and neutralised scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.windows import average_rank, bucket, correlation, first_rank, information_ratio, positive_share, ratio
from factorloom.operators.moments import pair_correlations


def long_features(rows: DataFrame, features: list[str], target: str) -> DataFrame:
    """(date, symbol, feature, value, target): one row per feature of every tradable row that has a target."""
    base = rows.where(F.col("tradable_universe") & F.col(target).isNotNull())
    base = base.select("date", "symbol", F.col(target).cast("double").alias("target"), *[F.col(f).cast("double").alias(f) for f in features])
    return base.unpivot(["date", "symbol", "target"], features, "feature", "value")


def by_groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a group in one task, for all windows that follow: as many tasks as shuffle partitions, however small they look when packed."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def in_order(rows: DataFrame, keys: list[str], value: str, gap: str, first: str, mean: str, descending: bool = False) -> DataFrame:
    """Add ``first`` (1..n by value, ties by symbol) and ``mean`` (the average of tied places), NULL where ``gap`` is true, in one sort.

    ``gap`` is a column that says where ``value`` is missing: an expression
    would be a new column of each window, and ask for a sort of its own.
    """
    over, by = Window.partitionBy(*keys, gap), F.col(value).desc() if descending else F.col(value).asc()
    rows = rows.withColumn(first, F.when(~F.col(gap), F.row_number().over(over.orderBy(by, "symbol"))))
    tied = over.orderBy(by)
    return rows.withColumn(mean, F.when(~F.col(gap), (F.rank().over(tied) + F.count(F.lit(1)).over(tied)).cast("double") / 2)) if mean else rows


def with_buckets(rows: DataFrame, keys: list[str], value: str, q: int) -> DataFrame:
    """Add ``n`` (values per group) and ``bucket`` (1..q; NULL without a value)."""
    n = F.count(value).over(Window.partitionBy(*keys))
    staged = rows.withColumns({"n": n, "__r": first_rank(value, keys)})
    return staged.withColumn("bucket", bucket("__r", "n", q)).drop("__r")


def _signal_rows(scored: DataFrame, score: str, target: str, q: int) -> DataFrame:
    rows = scored.where(F.col("tradable_universe")).select(
        "date", "symbol", F.col(score).cast("double").alias("score"), F.col(target).cast("double").alias("target")
    )
    return with_buckets(rows.dropna(subset=["score", "target"]), ["date"], "score", q).where(F.col("n") >= q)


def daily_signal(scored: DataFrame, score: str, target: str, q: int = 5) -> DataFrame:
    """Per date: n, pearson_ic, rank_ic, top_bottom_spread. Dates with fewer rows than buckets are left out."""
    rows = _signal_rows(scored, score, target, q).withColumns({"sr": average_rank("score", ["date"]), "tr": average_rank("target", ["date"])})
    mean = lambda b: F.avg(F.when(F.col("bucket") == b, F.col("target")))
    return rows.groupBy("date").agg(
        F.first("n").alias("n"), correlation("score", "target").alias("pearson_ic"), correlation("sr", "tr").alias("rank_ic"),
        (mean(q) - mean(1)).alias("top_bottom_spread"),
    )


def bucket_returns(scored: DataFrame, score: str, target: str, q: int = 5) -> DataFrame:
    """Per date the mean target of each bucket, Q1..Q{q}, and long_short (top less bottom)."""
    rows = _signal_rows(scored, score, target, q)
    means = [F.avg(F.when(F.col("bucket") == b, F.col("target"))).alias(f"Q{b}") for b in range(1, q + 1)]
    return rows.groupBy("date").agg(*means).withColumn("long_short", F.col(f"Q{q}") - F.col("Q1"))


def signal_summary(daily: DataFrame) -> DataFrame:
    """One row over ``daily_signal``: means, information ratios, share of positive dates."""
    return daily.agg(
        F.count(F.lit(1)).alias("coverage_dates"), F.avg("pearson_ic").alias("mean_pearson_ic"), F.avg("rank_ic").alias("mean_rank_ic"),
        information_ratio("pearson_ic").alias("ic_ir"), information_ratio("rank_ic").alias("rank_ic_ir"),
        F.avg("top_bottom_spread").alias("mean_top_bottom_spread"), positive_share("rank_ic").alias("positive_rank_ic_ratio"),
    )


def feature_daily(rows: DataFrame, features: list[str], target: str) -> DataFrame:
    """Per date and feature: pearson_ic, rank_ic, top_bottom_spread, for all features in one pass.

    The target is ranked among all rows of the date, a feature among those that
    have it. Dates with one row, and features without any value on a date, are
    left out; a spread needs five values.
    """
    long = long_features(rows, features, target)
    keys = ["date", "feature"]
    over = Window.partitionBy(*keys)
    ranked = by_groups(long, keys).withColumn("__gap", F.col("value").isNull())
    ranked = in_order(ranked, keys, "value", "__gap", "__r", "vr")
    # the largest place, since a plain count would be moved below the sort and bring one of its own
    ranked = ranked.withColumns({"rows": F.count(F.lit(1)).over(over), "n": F.coalesce(F.max("__r").over(over), F.lit(0)).cast("long")})
    ranked = ranked.withColumn("tr", average_rank("target", keys)).withColumn("bucket", bucket("__r", "n", 5))
    mean = lambda b: F.avg(F.when((F.col("bucket") == b) & (F.col("n") >= 5), F.col("target")))
    return ranked.where((F.col("rows") >= 2) & (F.col("n") > 0)).groupBy(*keys).agg(
        correlation("value", "target").alias("pearson_ic"), correlation("vr", "tr").alias("rank_ic"), (mean(5) - mean(1)).alias("top_bottom_spread")
    )


def feature_days(rows: DataFrame, features: list[str], target: str, q: int = 5, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Per date and feature what the yearly report needs, in one shuffle of the long rows.

    pearson_ic, rank_ic and top_bottom_spread as in ``feature_daily``; ``up``
    and ``down``: mean target of buckets 1..q by the feature clipped to the
    date's quantiles (over all tradable rows with a value), in ascending and in
    descending order, among rows with a target; null where there are fewer than q.
    """
    base = rows.where("tradable_universe").select("date", "symbol", F.col(target).cast("double").alias("target"), *[F.col(f).cast("double").alias(f) for f in features])
    long = base.unpivot(["date", "symbol", "target"], features, "feature", "value").withColumn("__t", F.col("target").isNotNull())
    keys, labelled = ["date", "feature"], ["date", "feature", "__t"]
    over = Window.partitionBy(*labelled)
    long = by_groups(long, keys).withColumn("__gap", F.col("value").isNull())
    long = in_order(long, labelled, "value", "__gap", "__raw", "vr")
    long = long.withColumns({"rows": F.count(F.lit(1)).over(over), "n": F.coalesce(F.max("__raw").over(over), F.lit(0)).cast("long")})
    cuts = F.percentile(F.when(F.col("__raw") > 0, F.col("value")), F.array(F.lit(low), F.lit(high))).over(Window.partitionBy(*keys))
    long = long.withColumn("__q", cuts).where("__t")
    clipped = F.when(F.col("value").isNotNull(), F.least(F.greatest("value", F.col("__q")[0]), F.col("__q")[1]))
    long = long.withColumn("__x", clipped).drop("__q")
    long = in_order(in_order(long, labelled, "__x", "__gap", "__up", ""), labelled, "__x", "__gap", "__down", "", descending=True)
    long = long.withColumn("tr", average_rank("target", labelled))
    long = long.withColumns({"bucket": bucket("__raw", "n", 5), "__up": bucket("__up", "n", q), "__down": bucket("__down", "n", q)})
    mean = lambda side, b, least: F.avg(F.when((F.col(side) == b) & (F.col("n") >= least), F.col("target")))
    curve = lambda side: F.when(F.max("n") >= q, F.array(*[mean(side, b, q) for b in range(1, q + 1)]))
    return long.where("n > 0").groupBy(*keys).agg(
        F.max("rows").alias("rows"), correlation("value", "target").alias("pearson_ic"), correlation("vr", "tr").alias("rank_ic"),
        (mean("bucket", 5, 5) - mean("bucket", 1, 5)).alias("top_bottom_spread"), curve("__up").alias("up"), curve("__down").alias("down"),
    )


def feature_diagnostics(rows: DataFrame, features: list[str], target: str, batch: int | None = None) -> DataFrame:
    """Per feature: coverage, mean correlations and spread, information ratios, positive share.

    ``batch`` bounds the features that are unpivoted at once.
    """
    size = batch or max(1, len(features))
    parts = [feature_daily(rows, features[k : k + size], target) for k in range(0, len(features), size)]
    return feature_means(reduce(DataFrame.unionByName, parts), ("feature",))


def feature_means(daily: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``feature_daily`` condensed by ``keys``."""
    return daily.groupBy(*keys).agg(
        F.count_distinct("date").alias("coverage_dates"), F.avg("pearson_ic").alias("mean_pearson_ic"), F.avg("rank_ic").alias("mean_rank_ic"),
        positive_share("rank_ic").alias("positive_rank_ic_ratio"), F.avg("top_bottom_spread").alias("mean_top_bottom_spread"),
        information_ratio("pearson_ic").alias("ic_ir"), information_ratio("rank_ic").alias("rank_ic_ir"),
    )


def select_features(
    diagnostics: DataFrame, min_rank_ic: float = 0.0, min_rank_ic_ir: float | None = None, min_positive_ratio: float | None = None, top_k: int | None = None
) -> DataFrame:
    """Features over the thresholds, all of them where none is; the ``top_k`` by size of rank IC and its ratio."""
    ok = F.abs("mean_rank_ic") >= min_rank_ic
    if min_rank_ic_ir is not None:
        ok &= F.abs("rank_ic_ir") >= min_rank_ic_ir
    if min_positive_ratio is not None:
        ok &= F.col("positive_rank_ic_ratio") >= min_positive_ratio
    kept = diagnostics.where(ok)
    if not kept.limit(1).count():
        kept = diagnostics
    order = [F.abs("mean_rank_ic").desc_nulls_last(), F.abs("rank_ic_ir").desc_nulls_last(), F.col("feature")]
    return kept.orderBy(*order).limit(top_k) if top_k else kept


def with_direction(diagnostics: DataFrame) -> DataFrame:
    """Add ``direction``: the sign of the mean rank IC, +1 where it is 0 or missing."""
    return diagnostics.withColumn("direction", F.when(F.col("mean_rank_ic") < 0, -1).otherwise(1))


def orient(rows: DataFrame, directions: dict[str, int | None], suffix: str = "") -> DataFrame:
    """Multiply features by their direction (missing: +1)."""
    return rows.withColumns({f"{f}{suffix}": F.col(f) * (d if d is not None else 1) for f, d in directions.items()})


def standardize(rows: DataFrame, value: str, output: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Clip to the date's quantiles, then z-score; only tradable rows with a value, NULL for the others, 0 for a constant date."""
    x = F.when(F.col("tradable_universe"), F.col(value).cast("double"))
    day = Window.partitionBy("date")
    out = rows.withColumn("__x", x)
    out = out.withColumn("__q", F.percentile("__x", F.array(F.lit(low), F.lit(high))).over(day))
    out = out.withColumn("__x", F.when(F.col("__x").isNotNull(), F.least(F.greatest("__x", F.col("__q")[0]), F.col("__q")[1])))
    out = out.withColumns({"__m": F.avg("__x").over(day), "__s": F.stddev_pop("__x").over(day), "__flat": F.min("__x").over(day) == F.max("__x").over(day)})
    z = F.when(F.col("__flat"), 0.0).otherwise(F.coalesce(ratio(F.col("__x") - F.col("__m"), "__s"), F.lit(0.0)))
    return out.withColumn(output, F.when(F.col("__x").isNotNull(), z)).drop("__x", "__q", "__m", "__s", "__flat")


def neutralize(scored: DataFrame, score: str, by_industry: bool = True, by_size: bool = True, output: str | None = None) -> DataFrame:
    """Take the industry mean and the slope on log size out of a score per date, then z-score.

    Rows that are not tradable or have no score keep what they had. The size
    step needs three rows and sizes that differ.
    """
    name = output or f"{score}_neutralized"
    if not by_industry and not by_size:
        return scored
    day = Window.partitionBy("date", "__in")
    out = scored.withColumn("__in", F.coalesce(F.col("tradable_universe"), F.lit(False)) & F.col(score).isNotNull())
    y = F.col(score).cast("double")
    if by_industry:
        y = y - F.avg(F.col(score).cast("double")).over(Window.partitionBy("date", F.coalesce("industry", F.lit("UNKNOWN")), "__in"))
    out = out.withColumns({"__y": y, "__x": F.ln(F.greatest(F.coalesce(F.col("float_mv").cast("double"), F.lit(0.0)), F.lit(1.0)))})
    if by_size:
        flat = (F.count(F.lit(1)).over(day) < 3) | (F.min("__x").over(day) == F.max("__x").over(day))
        slope = ratio(F.covar_pop("__x", "__y").over(day), F.var_pop("__x").over(day))
        moved = F.col("__y") - slope * (F.col("__x") - F.avg("__x").over(day))
        out = out.withColumn("__y", F.when(flat, F.col("__y")).otherwise(moved))
    spread = F.stddev_pop("__y").over(day)
    z = F.when(F.min("__y").over(day) == F.max("__y").over(day), 0.0).otherwise(F.coalesce(ratio(F.col("__y") - F.avg("__y").over(day), spread), F.lit(0.0)))
    return out.withColumn(name, F.when(F.col("__in"), z).otherwise(F.col(score).cast("double"))).drop("__in", "__y", "__x")


def drop_correlated(rows: DataFrame, features: list[str], max_corr: float = 0.9) -> list[str]:
    """Features in list order without those that correlate with a kept one at ``max_corr`` or more; 1 or more keeps all.

    Spark computes all correlations; the greedy pass has one number per pair.
    """
    if max_corr >= 1 or len(features) < 2:
        return list(features)
    found = {(r.a, r.b): r["corr"] for r in pair_correlations(rows, features).collect()}
    kept: list[str] = []
    for f in features:
        values = [found.get((k, f), found.get((f, k))) for k in kept]
        if not any(v is not None and abs(v) >= max_corr for v in values):
            kept.append(f)
    return kept
