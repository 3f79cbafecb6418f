"""List-wise boosted trees: lambda gradients inside each date, histogram trees grown from Spark aggregates.

Rows are binned once and kept as one row per date (a list is what the loss
is about, so a date's rows are together; a date is all that a task has to
hold). A round is one job per tree level: every date computes its margins,
gradients and histograms per (node, feature, bin); sums by feature and the best
split of each node are found in parallel; the driver sees a row per node and feature.
The job of a round's first level also measures the trees so far on the
validation dates, for early stopping.
"""

from __future__ import annotations

import itertools
import random
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.operators.labels import add_relevance


@dataclass(frozen=True)
class RankerConfig:
    rounds: int = 500
    warm_up: int = 100
    patience: int = 50
    learning_rate: float = 0.05
    max_depth: int = 5
    min_rows: int = 100
    subsample: float = 0.8
    colsample: float = 0.8
    l1: float = 0.5
    l2: float = 1.0
    bins: int = 64
    rank_bins: int = 20
    truncation: int = 20
    sigmoid: float = 1.0
    seed: int = 42


def lambda_gradients(margin: np.ndarray, label: np.ndarray, truncation: int = 20, sigmoid: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(gradient, hessian) of one list: pairs of unlike labels of which at least one is ranked among the first ``truncation``.

    A pair weighs what exchanging its two places would change in NDCG at the
    truncation, over 0.01 plus the distance of its margins. The list's sums are
    scaled by log2(1 + total) / total, so that long lists do not outweigh others.
    """
    n = len(margin)
    order = np.argsort(-margin, kind="stable")
    s, gain = margin[order], np.exp2(label[order]) - 1.0
    discount = 1.0 / np.log2(np.arange(n) + 2.0)
    k = min(truncation, n)
    best = (np.sort(gain)[::-1][:k] * discount[:k]).sum()
    g, h = np.zeros(n), np.zeros(n)
    if best > 0 and n > 1:
        unlike = (label[order][:k, None] != label[order][None, :]) & (np.arange(n)[None, :] > np.arange(k)[:, None])
        change = np.abs(gain[:k, None] - gain[None, :]) * np.abs(discount[:k, None] - discount[None, :]) / best
        apart = s[:k, None] - s[None, :]
        if s[0] != s[-1]:
            change = change / (0.01 + np.abs(apart))
        sign = np.where(label[order][:k, None] > label[order][None, :], 1.0, -1.0)
        p = 1.0 / (1.0 + np.exp(np.clip(sigmoid * sign * apart, -50, 50)))
        push = np.where(unlike, sigmoid * change * p, 0.0)
        bend = np.where(unlike, sigmoid**2 * change * p * (1.0 - p), 0.0)
        g[:k] -= (sign * push).sum(axis=1)
        g += (sign * push).sum(axis=0)
        h[:k] += bend.sum(axis=1)
        h += bend.sum(axis=0)
        total = 2.0 * push.sum()
        if total > 0:
            g, h = g * np.log2(1.0 + total) / total, h * np.log2(1.0 + total) / total
    gradient, hessian = np.empty(n), np.empty(n)
    gradient[order], hessian[order] = g, h
    return gradient, hessian


def ndcg_at(margin: np.ndarray, label: np.ndarray, k: int) -> float:
    """NDCG of one list at ``k``, 1 where no label is over 0."""
    gain = np.exp2(label) - 1.0
    discount = 1.0 / np.log2(np.arange(min(k, len(gain))) + 2.0)
    best = (np.sort(gain)[::-1][:k] * discount).sum()
    return float((gain[np.argsort(-margin, kind="stable")][:k] * discount).sum() / best) if best > 0 else 1.0


@dataclass
class Tree:
    """Nodes by number (children of node i: 2 i + 1, 2 i + 2): feature or -1, last bin of the left side, value of a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row of a (rows, features) matrix of bins ends in."""
        at = np.zeros(len(bins), np.int64)
        for _ in range(int(np.log2(len(self.feature) + 1))):
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                break
            right = bins[np.arange(len(bins)), np.maximum(f, 0)] > self.cut[at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return at


@dataclass
class Ranker:
    features: list[str]
    edges: list[np.ndarray]
    trees: list[Tree] = field(default_factory=list)
    history: list[float] = field(default_factory=list)

    def importance(self) -> dict[str, float]:
        """How many splits use each feature."""
        used = np.concatenate([t.feature[t.feature >= 0] for t in self.trees] or [np.empty(0, np.int64)])
        return dict(zip(self.features, np.bincount(used, minlength=len(self.features)).astype(float).tolist(), strict=True))

    def margins(self, values: np.ndarray) -> np.ndarray:
        bins = np.column_stack([np.searchsorted(e, values[:, k], side="left") for k, e in enumerate(self.edges)])
        return sum((t.value[t.nodes(bins)] for t in self.trees), np.zeros(len(values)))

    def scores(self, rows: DataFrame, output: str = "lgbm_score") -> DataFrame:
        """``rows`` with the trees' score; missing features are 0."""
        model = rows.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def score(values: pd.DataFrame) -> pd.Series:
            return pd.Series(model.value.margins(values.to_numpy(np.float64)))

        filled = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"x{k}") for k, f in enumerate(self.features)]
        return rows.withColumn(output, score(F.struct(*filled)))


def _binned(rows: DataFrame, features: list[str], edges: list[np.ndarray], target: str, cfg: RankerConfig) -> DataFrame:
    """One row per date: day, valid, labels and the matrix of bins (both as bytes), in order of the symbol."""
    rows = add_relevance(rows.where(F.col(target).isNotNull()), target, "__label", cfg.rank_bins)
    x = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"x{k}") for k, f in enumerate(features)]
    rows = rows.select(F.unix_micros(F.col("date").cast("timestamp")).alias("day"), "symbol", "__valid", F.col("__label").cast("int").alias("label"), *x)

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("symbol", kind="stable")
        bins = np.column_stack([np.searchsorted(e, part[f"x{k}"].to_numpy(), side="left") for k, e in enumerate(edges)]).astype(np.uint8)
        return pd.DataFrame({"day": [key[0]], "valid": [bool(key[1])], "labels": [part["label"].to_numpy(np.uint8).tobytes()], "bins": [bins.tobytes()]})

    return rows.groupBy("day", "__valid").applyInPandas(pack, "day long, valid boolean, labels binary, bins binary")


def _edges(rows: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Up to ``bins`` - 1 upper bounds of bins of each feature, from approximate quantiles."""
    shares = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    filled = [F.percentile_approx(F.coalesce(F.col(f).cast("double"), F.lit(0.0)), shares, 10_000).alias(f"e{k}") for k, f in enumerate(features)]
    found = rows.agg(*filled).head()
    return [np.unique(np.array(e or [], np.float64)) for e in found]


def _grown(lists: DataFrame, sent, level: int, tree: Tree, round_: int, chosen: np.ndarray, cfg: RankerConfig, n_bins: int, p: int):
    """Histograms of the nodes of a level over all dates, and the best split of each node; with level 0 the validation's NDCG too."""
    width = 2**level
    first = width - 1

    def hist(batches):
        trees, partial, seen, dates = sent.value, None, 0.0, 0
        for batch in batches:
            for day, valid, labels, data in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                label = np.frombuffer(labels, np.uint8).astype(np.float64)
                bins = np.frombuffer(data, np.uint8).reshape(len(label), p)
                if valid and level:
                    continue
                margin = sum((t.value[t.nodes(bins)] for t in trees), np.zeros(len(label)))
                if valid:
                    seen, dates = seen + ndcg_at(margin, label, cfg.truncation), dates + 1
                    continue
                g, h = lambda_gradients(margin, label, cfg.truncation, cfg.sigmoid)
                node = tree.nodes(bins) - first
                kept = (node >= 0) & (np.random.default_rng([cfg.seed, round_, day & 0xFFFFFFFF]).random(len(label)) < cfg.subsample)
                g, h, node, bins = g[kept], h[kept], node[kept], bins[kept]
                if partial is None:
                    partial = np.zeros((len(chosen), width * n_bins, 3))
                for at, f in enumerate(chosen):
                    cell = node * n_bins + bins[:, f]
                    for c, w in enumerate((g, h, None)):
                        partial[at, :, c] += np.bincount(cell, weights=w, minlength=width * n_bins)
        if partial is not None:
            ends = np.arange(len(chosen) + 1) * width * n_bins * 3
            yield pa.record_batch([pa.array(chosen.astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(partial.ravel()))], names=["feature", "sums"])
        if dates:
            yield pa.record_batch([pa.array([-1], pa.int32()), pa.array([[seen, float(dates)]], pa.list_(pa.float64()))], names=["feature", "sums"])

    def split(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        total = np.sum(np.stack(part["sums"].to_numpy()), axis=0)
        names = ["feature", "node", "cut", "gain", "g", "h", "n", "gl", "hl", "nl"]
        if key[0] < 0:
            return pd.DataFrame([(-1, 0, 0, total[0] / total[1], 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)], columns=names)
        sums = total.reshape(width, n_bins, 3)
        left, whole = np.cumsum(sums, axis=1)[:, :-1], sums.sum(axis=1)
        right = whole[:, None, :] - left
        worth = lambda s: np.square(_shrunk(s[..., 0], cfg.l1)) / (s[..., 1] + cfg.l2)
        gain = worth(left) + worth(right) - worth(whole)[:, None]
        gain = np.where((left[..., 2] >= cfg.min_rows) & (right[..., 2] >= cfg.min_rows), gain, -np.inf)
        cut = gain.argmax(axis=1)
        at = np.arange(width)
        best = left[at, cut]
        rows = zip([int(key[0])] * width, at, cut, gain[at, cut], *whole.T, *best.T, strict=True)
        return pd.DataFrame([r for r in rows if r[6] > 0], columns=names)

    schema = "feature int, node int, cut int, gain double, g double, h double, n double, gl double, hl double, nl double"
    return lists.mapInArrow(hist, "feature int, sums array<double>").groupBy("feature").applyInPandas(split, schema).collect()


def _shrunk(g, l1: float):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


@dataclass
class Lists:
    """Binned rows by date, kept for as many fits as are wanted; ``release`` them then."""

    features: list[str]
    edges: list[np.ndarray]
    rows: DataFrame
    bins: int
    has_valid: bool

    def release(self) -> None:
        self.rows.unpersist()


def binned_lists(train: DataFrame, features: list[str], target: str, cfg: RankerConfig = RankerConfig(), valid: DataFrame | None = None, edges: list[np.ndarray] | None = None) -> Lists:
    """Training rows (and ``valid``) binned by the training rows' quantiles, or by ``edges``; labels have ``cfg.rank_bins`` places."""
    rows = train.withColumn("__valid", F.lit(False))
    edges = _edges(rows.where(F.col(target).isNotNull()), features, cfg.bins) if edges is None else edges
    if valid is not None:
        rows = rows.unionByName(valid.withColumn("__valid", F.lit(True)))
    return Lists(list(features), edges, _binned(rows, features, edges, target, cfg).persist(), cfg.bins, valid is not None)


def grow(lists: Lists, cfg: RankerConfig, init: Ranker | None = None) -> Ranker:
    """Trees on lists that are there; see ``fit_ranker``."""
    spark = lists.rows.sparkSession
    model = Ranker(lists.features, lists.edges, list(init.trees) if init else [])
    count, base, best = max(1, round(cfg.colsample * len(lists.features))), len(model.trees), (-np.inf, 0)
    for r in range(cfg.rounds + lists.has_valid):  # one more look at the validation dates for the last tree
        chosen = np.sort(np.random.default_rng([cfg.seed, r]).choice(len(lists.features), count, replace=False))
        size = 2 ** (cfg.max_depth + 1) - 1
        tree = Tree(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size))
        sent = spark.sparkContext.broadcast(model.trees)
        for level in range(cfg.max_depth):
            found = _grown(lists.rows, sent, level, tree, base + r, chosen, cfg, lists.bins, len(lists.features))
            if level == 0:
                model.history += [f.gain for f in found if f.feature < 0]
            grew = False
            for node in {f.node for f in found if f.feature >= 0}:
                own = max((f for f in found if f.feature >= 0 and f.node == node), key=lambda f: (f.gain, -f.feature))
                at = 2**level - 1 + node
                leaf = lambda g, h: -cfg.learning_rate * float(_shrunk(g, cfg.l1)) / (h + cfg.l2)
                tree.value[at] = leaf(own.g, own.h)
                if own.gain > 1e-12 and np.isfinite(own.gain):
                    grew, tree.feature[at], tree.cut[at] = True, own.feature, own.cut
                    tree.value[2 * at + 1], tree.value[2 * at + 2] = leaf(own.gl, own.hl), leaf(own.g - own.gl, own.h - own.hl)
            if not grew or (r == cfg.rounds and level == 0):
                break
        sent.unpersist()
        if model.history and r >= min(cfg.warm_up, cfg.rounds):
            if model.history[-1] > best[0]:
                best = (model.history[-1], len(model.trees))
            elif len(model.trees) - best[1] >= cfg.patience:
                break
        if r < cfg.rounds:
            model.trees.append(tree)
    if lists.has_valid and best[1] > base:
        model.trees = model.trees[: best[1]]
    return model


def fit_ranker(train: DataFrame, features: list[str], target: str, cfg: RankerConfig = RankerConfig(), valid: DataFrame | None = None, init: Ranker | None = None) -> Ranker:
    """Trees on the per-date relevance of the target (``add_relevance``), of lambda gradients.

    Without ``valid`` all rounds are used. With it, the first ``warm_up`` rounds
    are; from there the trees up to the best NDCG on the validation dates stay,
    and ``patience`` rounds without a better one end the search. ``init``: go on
    from another model's trees and bins. A date without rows, or a list of one
    label, adds nothing.
    """
    lists = binned_lists(train, features, target, cfg, valid, init.edges if init else None)
    try:
        return grow(lists, cfg, init)
    finally:
        lists.release()


#: What random search draws from (8,748 combinations). A tree's depth follows from its leaves and its bound.
SEARCH_SPACE = {
    "n_estimators": (800, 1000, 1200), "learning_rate": (0.05, 0.06, 0.08), "num_leaves": (127, 191), "max_depth": (-1, 6), "min_child_samples": (30, 50, 80),
    "subsample": (0.8, 0.9, 1.0), "colsample_bytree": (0.7, 0.8, 0.9), "reg_alpha": (0.5, 1.0, 1.5), "reg_lambda": (0.25, 0.5, 1.0),
}


def search_trials(trials: int = 20, seed: int = 42, space: dict[str, tuple] = SEARCH_SPACE) -> list[dict]:
    """The first ``trials`` of all combinations in a seeded order."""
    combos = [dict(zip(space, values, strict=True)) for values in itertools.product(*space.values())]
    random.Random(seed).shuffle(combos)
    return combos[: max(1, trials)]


def trial_config(cfg: RankerConfig, trial: dict) -> RankerConfig:
    depth = int(np.log2(trial["num_leaves"]))
    depth = min(depth, trial["max_depth"]) if trial["max_depth"] > 0 else depth
    return replace(cfg, rounds=trial["n_estimators"], learning_rate=trial["learning_rate"], max_depth=depth, min_rows=trial["min_child_samples"], subsample=trial["subsample"],
                   colsample=trial["colsample_bytree"], l1=trial["reg_alpha"], l2=trial["reg_lambda"])


def validation_ndcg(lists: Lists, model: Ranker, at: tuple[int, ...] = (20, 50)) -> list[float | None]:
    """Mean NDCG over the validation dates."""
    sent, p = lists.rows.sparkSession.sparkContext.broadcast(model.trees), len(lists.features)

    def run(batches):
        for batch in batches:
            rows = []
            for labels, data in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                label = np.frombuffer(labels, np.uint8).astype(np.float64)
                bins = np.frombuffer(data, np.uint8).reshape(len(label), p)
                margin = sum((t.value[t.nodes(bins)] for t in sent.value), np.zeros(len(label)))
                rows.append([ndcg_at(margin, label, k) for k in at])
            yield pa.record_batch([pa.array([r[k] for r in rows], pa.float64()) for k in range(len(at))], names=[f"k{k}" for k in at])

    means = lists.rows.where("valid").mapInArrow(run, ", ".join(f"k{k} double" for k in at)).agg(*[F.avg(f"k{k}") for k in at]).head()
    return list(means)


def tune_ranker(train: DataFrame, valid: DataFrame, features: list[str], target: str, cfg: RankerConfig = RankerConfig(), trials: int = 20, seed: int = 42,
                space: dict[str, tuple] = SEARCH_SPACE, at_once: int = 4) -> list[dict]:
    """Trials by mean NDCG at 20, then at 50, then fewer trees; each with its values, ``trees``, ``ndcg_20``, ``ndcg_50`` and ``seconds``.

    The panel is read and binned once for all; ``at_once`` trials run side by
    side on these bins, each ended early by the validation dates.
    """
    lists = binned_lists(train, features, target, cfg, valid)

    def one(trial: dict) -> dict:
        began = time.perf_counter()
        model = grow(lists, trial_config(cfg, trial))
        found = validation_ndcg(lists, model)
        return {**trial, "trees": len(model.trees), "ndcg_20": found[0], "ndcg_50": found[1], "seconds": round(time.perf_counter() - began, 3)}

    try:
        lists.rows.count()
        with ThreadPoolExecutor(at_once) as pool:
            out = list(pool.map(one, search_trials(trials, seed, space)))
    finally:
        lists.release()
    return sorted(out, key=lambda t: (-(t["ndcg_20"] or 0), -(t["ndcg_50"] or 0), t["trees"]))
