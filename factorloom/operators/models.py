"""Ridge and boosted-tree scores, ranking quality, chronological splits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.lineage import cut
from factorloom.functions.windows import ratio
from factorloom.operators.labels import add_relevance
from factorloom.operators.ranker import Ranker, RankerConfig, fit_ranker, tune_ranker  # noqa: F401


def _filled(rows: DataFrame, features: list[str]) -> DataFrame:
    """Features as doubles, missing as 0, in one vector."""
    rows = rows.withColumn("__x", F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]))


    return rows.withColumn("__features", array_to_vector("__x")).drop("__x")


@dataclass
class RidgeFit:
    intercept: float
    coefficients: dict[str, float]

    def column(self) -> Column:
        """The score as a plain column, so predictions stay inside the plan."""
        return sum((F.coalesce(F.col(f).cast("double"), F.lit(0.0)) * c for f, c in self.coefficients.items()), F.lit(self.intercept))


def fit_ridge(train: DataFrame, features: list[str], target: str, alpha: float = 1.0) -> RidgeFit:
    """Ridge regression with an intercept: squared errors plus ``alpha`` times squared coefficients.

    The solver scales the penalty by n and the target's deviation; both are
    taken out here. A constant target has coefficients 0.
    """
    known = train.where(F.col(target).isNotNull()).select(*features, F.col(target).cast("double").alias("__y"))
    rows = _filled(cut(known, "train"), features).select("__features", "__y")  # read for the moments and by the solver
    n, mean, std = rows.agg(F.count("__y"), F.avg("__y"), F.stddev_pop("__y")).head()
    if not n:
        raise ValueError("no row has a target")
    if not std:
        return RidgeFit(float(mean), dict.fromkeys(features, 0.0))
    model = LinearRegression(
        featuresCol="__features", labelCol="__y", elasticNetParam=0.0, standardization=False, solver="normal", regParam=alpha * std / n
    ).fit(rows)
    return RidgeFit(float(model.intercept), dict(zip(features, map(float, model.coefficients), strict=True)))


def ridge_scores(train: DataFrame, test: DataFrame, features: list[str], target: str, output: str = "ridge_score", alpha: float = 1.0) -> DataFrame:
    return test.withColumn(output, fit_ridge(train, features, target, alpha).column())


@dataclass(frozen=True)
class BoostConfig:
    rounds: int = 100
    learning_rate: float = 0.05
    max_depth: int = 5
    max_bins: int = 32
    subsample: float = 0.8
    rank_bins: int = 20
    min_rows: int = 20
    seed: int = 42


def fit_boosted(train: DataFrame, features: list[str], target: str, cfg: BoostConfig = BoostConfig(), valid: DataFrame | None = None):
    """Boosted trees on the per-date relevance of the target; stops early on ``valid`` where given.

    MLlib has no list-wise ranker, so this is pointwise: its order, not the
    scale of its scores, is what is used.
    """
    rows = add_relevance(train.where(F.col(target).isNotNull()), target, "__y", cfg.rank_bins).withColumn("__valid", F.lit(False))
    if valid is not None:
        more = add_relevance(valid.where(F.col(target).isNotNull()), target, "__y", cfg.rank_bins).withColumn("__valid", F.lit(True))
        rows = rows.unionByName(more)
    rows = _filled(rows, features).select("__features", F.col("__y").cast("double"), "__valid")
    trees = GBTRegressor(
        featuresCol="__features", labelCol="__y", predictionCol="__score", maxIter=cfg.rounds, stepSize=cfg.learning_rate, maxDepth=cfg.max_depth,
        maxBins=cfg.max_bins, subsamplingRate=cfg.subsample, minInstancesPerNode=cfg.min_rows, seed=cfg.seed,
    )
    return (trees.setValidationIndicatorCol("__valid") if valid is not None else trees).fit(rows)


def boosted_scores(model, test: DataFrame, features: list[str], output: str = "gbt_score") -> DataFrame:
    scored = model.transform(_filled(test, features))
    return scored.withColumn(output, F.col("__score")).drop("__features", "__score")


def boosted_importance(model, features: list[str]) -> list[tuple[str, float]]:
    return list(zip(features, map(float, model.featureImportances.toArray()), strict=True))


def ndcg(rows: DataFrame, score: str, relevance: str = "relevance", k: int = 20) -> DataFrame:
    """(date, ndcg): graded gain 2^relevance - 1 over log2(rank + 1) of the first ``k``, against the best order; 1 for a date without gain."""
    by = lambda c: F.row_number().over(Window.partitionBy("date").orderBy(F.desc_nulls_last(c), "symbol"))
    ranked = rows.withColumns({"__r": by(score), "__i": by(relevance), "__g": F.pow(F.lit(2.0), F.col(relevance)) - 1})
    part = lambda r: F.sum(F.when(F.col(r) <= k, F.col("__g") / F.log2(F.col(r) + 1.0)).otherwise(0.0))
    return ranked.groupBy("date").agg(F.coalesce(ratio(part("__r"), part("__i")), F.lit(1.0)).alias("ndcg"))


def chronological_split(rows: DataFrame, valid_ratio: float = 0.2, embargo_rows: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, valid): the last ``valid_ratio`` of distinct dates, at least one on each side.

    ``embargo_rows`` dates before the bound are left out of the training side.
    """
    dates = rows.select("date").distinct()
    n = dates.count()
    if n < 2:
        raise ValueError("at least two dates are needed")
    first = min(n - 1, max(1, n - max(1, int(n * valid_ratio))))
    numbered = dates.withColumn("__k", F.row_number().over(Window.orderBy("date")) - 1)  # one row per date
    train = rows.join(numbered.where(F.col("__k") < first - embargo_rows).select("date"), "date", "left_semi")
    return train, rows.join(numbered.where(F.col("__k") >= first).select("date"), "date", "left_semi")
