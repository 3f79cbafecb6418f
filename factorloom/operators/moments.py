"""Sums that models and correlations can be solved from: moments by date, their windows, and moments of all pairs.

Sums of x, xy and xx' add up over dates, so a ridge regression on any window of
dates is a sum of rows that are there already and one small solution; the panel
is read once however many windows there are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tasks that share a date's rows.
SALTS = 8


def date_moments(rows: DataFrame, features: list[str], target: str) -> DataFrame:
    """(date, n, moments) over tradable rows with a target, missing features as 0; up to ``SALTS`` rows per date, which add up.

    ``moments``: sum of the target, sums of the features, of features times
    target, and of features times features (upper triangle by rows).
    """
    x = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"x{k}") for k, f in enumerate(features)]
    base = rows.where(F.col("tradable_universe") & F.col(target).isNotNull())
    base = base.select(F.unix_micros(F.col("date").cast("timestamp")).alias("day"), F.pmod(F.xxhash64("symbol"), F.lit(SALTS)).alias("salt"), F.col(target).cast("double").alias("y"), *x)
    upper = np.triu_indices(len(features))

    def run(batches):
        day, n, total = None, 0, None
        for batch in batches:
            if not len(batch):
                continue
            days = batch.column(0).to_numpy()
            y, matrix = batch.column(2).to_numpy(), np.column_stack([batch.column(k).to_numpy() for k in range(3, batch.num_columns)])
            out, starts = [], np.flatnonzero(np.r_[True, days[1:] != days[:-1]])
            for a, b in zip(starts, [*starts[1:], len(days)], strict=True):
                part, target_part = matrix[a:b], y[a:b]
                sums = np.concatenate([[target_part.sum()], part.sum(axis=0), target_part @ part, (part.T @ part)[upper]])
                if day is not None and days[a] != day:
                    out.append((day, n, total))
                    day = None
                n, total = (b - a, sums) if day is None else (n + b - a, total + sums)
                day = days[a]
            if out:
                yield _moment_rows(out)
        if day is not None:
            yield _moment_rows([(day, n, total)])

    parts = base.repartition("day", "salt").sortWithinPartitions("day").mapInArrow(run, "day long, n long, moments array<double>")
    return parts.select(F.timestamp_micros("day").alias("date"), "n", "moments")


def _moment_rows(rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    days, counts, totals = zip(*rows, strict=True)
    ends = np.arange(len(rows) + 1) * len(totals[0])
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(totals)))
    return pa.record_batch([pa.array(days, pa.int64()), pa.array(counts, pa.int64()), lists], names=["day", "n", "moments"])


def solve_ridge(n: float, moments: np.ndarray, p: int, alpha: float) -> tuple[float, np.ndarray]:
    """(intercept, coefficients) of least squares plus ``alpha`` times squared coefficients, the intercept free."""
    sum_y, sum_x, sum_xy = moments[0], moments[1 : p + 1], moments[p + 1 : 2 * p + 1]
    square = np.zeros((p, p))
    square[np.triu_indices(p)] = moments[2 * p + 1 :]
    square = square + np.triu(square, 1).T
    mean_x, mean_y = sum_x / n, sum_y / n
    coefficients = np.linalg.solve(square - n * np.outer(mean_x, mean_x) + alpha * np.eye(p), sum_xy - n * mean_x * mean_y)
    return float(mean_y - coefficients @ mean_x), coefficients


_FIT = "n long, first timestamp, last timestamp, intercept double, coefficients array<double>"


def rolling_ridge(rows: DataFrame, features: list[str], target: str, fit_dates: DataFrame, train_dates: int = 504, min_rows: int = 1, alpha: float = 1.0) -> DataFrame:
    """(date, n, first, last, intercept, coefficients): for each of ``fit_dates`` a ridge fit on the ``train_dates`` dates before it.

    Dates are those with rows to train on; a date with fewer before it, or
    with fewer than ``min_rows`` rows in its window, has no fit. A window of
    dates spans two stretches of ``train_dates`` dates at most, so every date's
    sums go to two tasks, and a task holds two stretches.
    """
    sums, p = date_moments(rows, features, target), len(features)
    place = sums.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)  # one row per date
    place = place.join(fit_dates.select("date", F.lit(True).alias("fit")), "date", "left")
    base = sums.join(place, "date").select("date", "n", "moments", "i", F.coalesce("fit", F.lit(False)).alias("fit"))
    stretch = F.floor(F.col("i") / train_dates).cast("int")
    base = base.withColumn("stretch", F.explode(F.array(stretch, stretch + 1)))

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        totals: dict[int, list] = {}
        for row in part.itertuples(index=False):
            held = totals.setdefault(row.i, [row.date, row.fit, 0, np.zeros(len(row.moments))])
            held[2] += row.n
            held[3] += row.moments
        order = sorted(totals)
        counts = np.concatenate([[0], np.cumsum([totals[i][2] for i in order])])
        sums = np.concatenate([np.zeros((1, len(totals[order[0]][3]))), np.cumsum([totals[i][3] for i in order], axis=0)])
        out = []
        for at, i in enumerate(order):
            n = int(counts[at] - counts[at - train_dates]) if at >= train_dates else 0
            if totals[i][1] and i // train_dates == key[0] and n >= max(1, min_rows):
                intercept, coefficients = solve_ridge(n, sums[at] - sums[at - train_dates], p, alpha)
                out.append((totals[i][0], n, totals[order[at - train_dates]][0], totals[order[at - 1]][0], intercept, coefficients.tolist()))
        return pd.DataFrame(out, columns=["date", "n", "first", "last", "intercept", "coefficients"])

    return base.groupBy("stretch").applyInPandas(fit, f"date timestamp, {_FIT}")


def window_ridge(rows: DataFrame, features: list[str], target: str, windows: DataFrame, min_rows: int = 1, alpha: float = 1.0) -> DataFrame:
    """(split_id, n, first, last, intercept, coefficients): a ridge fit on the rows of each window (split_id, start, end) of dates, ``end`` not included."""
    sums, p = date_moments(rows, features, target), len(features)
    base = sums.join(F.broadcast(windows), (F.col("date") >= F.col("start")) & (F.col("date") < F.col("end")))  # one row per split

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        n, total = int(part["n"].sum()), np.sum(np.stack(part["moments"].to_numpy()), axis=0)
        if n < max(1, min_rows):
            return pd.DataFrame({c: [] for c in ("split_id", "n", "first", "last", "intercept", "coefficients")})
        intercept, coefficients = solve_ridge(n, total, p, alpha)
        return pd.DataFrame([(key[0], n, part["date"].min(), part["date"].max(), intercept, coefficients.tolist())], columns=["split_id", "n", "first", "last", "intercept", "coefficients"])

    return base.groupBy("split_id").applyInPandas(fit, f"split_id int, {_FIT}")


def fitted_score(features: list[str]) -> Column:
    """The score of a row beside its fit (intercept, coefficients)."""
    return sum((F.coalesce(F.col(f).cast("double"), F.lit(0.0)) * F.col("coefficients")[k] for k, f in enumerate(features)), F.col("intercept"))


def fit_coefficients(fits: DataFrame, features: list[str], key: str) -> DataFrame:
    """(key, feature, coef): a row per fit and feature."""
    names = F.array(*[F.lit(f) for f in features])
    return fits.select(key, F.posexplode("coefficients").alias("k", "coef")).select(key, names[F.col("k")].alias("feature"), "coef")


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two parts' (rows, means, means of the other, squares, products) of every pair as those of both together."""
    n = a[0] + b[0]
    share = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)
    d, e = b[1] - a[1], b[2] - a[2]
    weight = a[0] * share
    return np.stack([n, a[1] + d * share, a[2] + e * share, a[3] + b[3] + d * d * weight, a[4] + b[4] + d * e * weight])


def _batch_moments(x: np.ndarray) -> np.ndarray:
    """Of every two columns over the rows with both: how many, mean of the first and of the second, squares and products about the means."""
    has = ~np.isnan(x)
    centre = np.divide(np.where(has, x, 0.0).sum(axis=0), has.sum(axis=0), out=np.zeros(x.shape[1]), where=has.any(axis=0))
    x, one = np.where(has, x - centre, 0.0), has.astype(np.float64)
    n, total = one.T @ one, x.T @ one
    mean = np.divide(total, n, out=np.zeros_like(n), where=n > 0)
    squares = np.maximum((x * x).T @ one - total * mean, 0.0)
    return np.stack([n, np.where(n > 0, mean + centre[:, None], 0.0), np.where(n > 0, mean.T + centre[None, :], 0.0), squares, x.T @ x - total * mean.T])


def pair_moments(rows: DataFrame, features: list[str]) -> DataFrame:
    """(i, j, n, xx, yy, xy) of every two features i < j over the rows that have both: how many, squares and products about their means.

    One pass: each task adds its batches up as matrices about their own means,
    and a row of these for each feature is what leaves it.
    """
    p = len(features)
    base = rows.select(*[F.col(f).cast("double").alias(f"x{k}") for k, f in enumerate(features)])

    def partial(batches):
        total = None
        for batch in batches:
            if len(batch):
                found = _batch_moments(np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.float64) for k in range(p)]))
                total = found if total is None else _merged(total, found)
        if total is not None:
            values = pa.array(np.ascontiguousarray(total.transpose(1, 0, 2)).ravel())
            yield pa.record_batch([pa.array(np.arange(p, dtype=np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(p + 1) * 5 * p, pa.int32()), values)], names=["i", "sums"])

    def add(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        total = None
        for sums in part["sums"]:
            found = np.asarray(sums).reshape(5, p)
            total = found if total is None else _merged(total, found)
        k = np.arange(p, dtype=np.int32)
        return pd.DataFrame({"i": key[0], "j": k, "n": total[0].astype(np.int64), "xx": total[3], "xy": total[4]})

    cells = base.mapInArrow(partial, "i int, sums array<double>").groupBy("i").applyInPandas(add, "i int, j int, n long, xx double, xy double")
    low, high = F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")
    pick = lambda c, first: F.max(F.when(F.col("first") == first, F.col(c)))
    cells = cells.where("i <> j").select(low, high, (F.col("i") < F.col("j")).alias("first"), "n", "xx", "xy")
    return cells.groupBy("i", "j").agg(F.max("n").alias("n"), pick("xx", True).alias("xx"), pick("xx", False).alias("yy"), pick("xy", True).alias("xy"))


def pair_correlations(rows: DataFrame, features: list[str], flat: float = 1e-9) -> DataFrame:
    """(a, b, corr) of every two features, in list order, over the rows that have both; null where either deviates by ``flat`` or less there."""
    names = F.array(*[F.lit(f) for f in features or [""]])
    pairs = rows.sparkSession.range(len(features)).select(F.col("id").cast("int").alias("i"))
    pairs = pairs.select("i", F.explode(F.sequence(F.col("i"), F.lit(len(features)))).alias("j")).where(f"i < j and j < {len(features)}")
    if len(features) < 2:
        return pairs.limit(0).select(names[0].alias("a"), names[0].alias("b"), F.lit(0.0).alias("corr"))
    m = pairs.join(pair_moments(rows, features), ["i", "j"], "left")
    some = (F.col("n") > 1) & (F.sqrt(F.col("xx") / F.col("n")) > flat) & (F.sqrt(F.col("yy") / F.col("n")) > flat)
    return m.select(names[F.col("i")].alias("a"), names[F.col("j")].alias("b"), F.when(some, F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).alias("corr"))
