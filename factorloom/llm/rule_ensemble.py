"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted trees on a bounded labelled sample give conjunctive rules, one for each
path from the root to a node. A lasso logistic regression keeps few of them,
and these are compiled into one Spark column expression over the statistics.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm.common import bounded_sample, materialize, table
from factorloom.llm.quality_rules import dup_lines, repeat_words
from factorloom.llm.words import hash_words, words_of

#: Labelled rows that trees and weights are fitted on, those of least id hash.
TRAIN_ROWS = 20_000
TREES, DEPTH, RATE, BINS, MIN_LEAF = 40, 3, 0.3, 64, 10
LASSO = 0.001
THRESHOLD = 0.3

STATISTICS = (
    "log_chars", "log_words", "word_length", "long_words", "short_words", "letters", "upper", "digits", "symbols", "marks", "stops", "spaces",
    "wide", "line_words", "dup_lines", "repeats", "distinct", "top_word", "marked_words", "upper_words",
)

_UPPER, _LETTER, _DIGIT, _SYMBOL, _MARK, _STOP, _SPACE = (np.zeros(256) for _ in range(7))
_UPPER[65:91] = 1
_LETTER[[*range(65, 91), *range(97, 123), *range(192, 256)]] = 1  # a letter beyond ASCII counts by its first byte
_DIGIT[48:58] = 1
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
_MARK[[ord(c) for c in "!?;:()[]{}\"'_=+/\\~^`@-"]] = 1
_STOP[[ord(c) for c in ".,"]] = 1
_SPACE[[32, *range(9, 14)]] = 1


def text_statistics(text: str | None) -> list[float]:
    """The ``STATISTICS`` of a whole text; all 0 for null and empty ones."""
    words = words_of(text)
    if not text:
        return [0.0] * len(STATISTICS)
    data = text.encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    chars, n = len(text), max(1, len(words))
    share = lambda mask: float(counts @ mask) / chars
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    hashes = hash_words(words)
    _, times = np.unique(hashes, return_counts=True)
    lines = text.count("\n") + 1
    return [
        float(np.log1p(chars)), float(np.log1p(len(words))), float(lengths.sum()) / n, float((lengths > 12).sum()) / n, float((lengths <= 3).sum()) / n,
        share(_LETTER), share(_UPPER), share(_DIGIT), share(_SYMBOL), share(_MARK), share(_STOP), share(_SPACE),
        float(counts[192:].sum()) / chars, len(words) / lines, dup_lines(text) / lines, repeat_words(hashes) / n,
        len(times) / n, float(times.max()) / n if len(times) else 0.0,
        sum(not w[-1].isalnum() for w in words) / n, sum(w.isupper() for w in words) / n,
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, the statistics as doubles) of every row of ``docs`` (doc_id, text)."""

    def measure(batches):
        for batch in batches:
            values = np.array([text_statistics(t) for t in batch.column(1).to_pylist()], dtype=np.float64).reshape(-1, len(STATISTICS))
            yield pa.record_batch([batch.column(0), *[pa.array(v) for v in values.T]], names=["doc_id", *STATISTICS])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    return texts.mapInArrow(measure, "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


#: A rule is a set of (statistic, whether at most, bound); all must hold.
Rule = frozenset[tuple[int, bool, float]]


@dataclass(frozen=True)
class RuleModel:
    """score = logistic(intercept + weights of the rules that hold)."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            holds = F.lit(True)
            for stat, below, bound in sorted(rule):
                c = F.col(STATISTICS[stat])
                holds = holds & ((c <= bound) if below else (c > bound))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _split(binned: np.ndarray, rows: np.ndarray, target: np.ndarray, features: np.ndarray) -> tuple[float, int, int] | None:
    """(gain, statistic, bin) of the split that lowers the squared error most."""
    best, total, n = None, target[rows].sum(), len(rows)
    for f in features:
        bins = binned[rows, f]
        count = np.cumsum(np.bincount(bins, minlength=BINS))[:-1]
        sums = np.cumsum(np.bincount(bins, weights=target[rows], minlength=BINS))[:-1]
        ok = (count >= MIN_LEAF) & (n - count >= MIN_LEAF)
        if ok.any():
            gain = np.where(ok, sums**2 / np.maximum(count, 1) + (total - sums) ** 2 / np.maximum(n - count, 1), -np.inf) - total**2 / n
            b = int(gain.argmax())
            if gain[b] > 1e-9 and (best is None or gain[b] > best[0]):
                best = (float(gain[b]), int(f), b)
    return best


def grow_rules(x: np.ndarray, y: np.ndarray, seed: int = 3) -> list[Rule]:
    """Rules of boosted trees, each grown on half of the rows and of the statistics."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    margin, rules = np.zeros(len(y)), {}
    for _ in range(TREES):
        residual = y - 1 / (1 + np.exp(-margin))
        sample = np.sort(rng.choice(len(y), max(1, len(y) // 2), replace=False))
        features = np.sort(rng.choice(x.shape[1], (x.shape[1] + 1) // 2, replace=False))
        nodes = [(frozenset(), sample, np.arange(len(y)), 0)]
        while nodes:
            rule, rows, covered, depth = nodes.pop()
            found = _split(binned, rows, residual, features) if depth < DEPTH and len(rows) >= 2 * MIN_LEAF else None
            if rule:
                rules[rule] = None
            if found is None:
                if len(rows):
                    p = 1 / (1 + np.exp(-margin[rows]))
                    margin[covered] += RATE * residual[rows].sum() / max(1e-3, (p * (1 - p)).sum())
                continue
            _, f, b = found
            for below in (True, False):
                take = lambda r: r[(binned[r, f] <= b) == below]  # noqa: B023, E731
                nodes.append((rule | {(f, below, float(cuts[f][b]))}, take(rows), take(covered), depth + 1))
    return list(rules)


def fit_rules(x: np.ndarray, y: np.ndarray, lasso: float = LASSO, rounds: int = 600) -> RuleModel:
    """Trees, then lasso logistic weights by accelerated proximal gradient.

    Without rows the score is 0.5, with one class only that class's smoothed share.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    if len(y) == 0 or y.min() == y.max():
        return RuleModel(float(np.log(share / (1 - share))), ())
    rules = grow_rules(x, y)
    holds = np.empty((len(y), len(rules)), dtype=np.float32)
    for k, rule in enumerate(rules):
        holds[:, k] = np.logical_and.reduce([(x[:, f] <= b) == below for f, below, b in rule])
    mean = holds.mean(axis=0)
    holds -= mean
    scale = 0.25 * float(np.linalg.norm(holds, 2)) ** 2 / len(y) + 0.25
    w, v, b, vb, t = np.zeros(len(rules)), np.zeros(len(rules)), np.log(share / (1 - share)), np.log(share / (1 - share)), 1.0
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-(holds @ v.astype(np.float32) + vb))) - y
        step = v - (holds.T @ error.astype(np.float32)) / len(y) / scale
        new = np.sign(step) * np.maximum(np.abs(step) - lasso / scale, 0)
        new_b, new_t = vb - error.mean() / scale, (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / new_t * (new - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new, new_b, new_t
    kept = np.flatnonzero(np.abs(w) > 1e-4)
    return RuleModel(float(b - w @ mean), tuple((rules[k], float(w[k])) for k in kept))


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train_quality(stats: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> RuleModel:
    """Fit on the labelled rows that are not held out, about ``limit`` of them under a bound of the id's hash.

    A document with several labels counts by its best; rows that repeat a doc_id
    are examples each. Without labels the score is 0.5.
    """
    known = labels.where("quality is not null").groupBy(F.col("doc_id").alias("l")).agg(F.max("quality").alias("quality"))
    rows = stats.join(known, F.col("doc_id") == F.col("l")).where(~held_out(F.col("doc_id")))
    rows = bounded_sample(rows.select("doc_id", "quality", *STATISTICS), "doc_id", limit).sort_values(["doc_id", *STATISTICS])
    return fit_rules(rows[list(STATISTICS)].to_numpy(dtype=np.float64), rows["quality"].to_numpy(dtype=np.float64))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text).

    Scores come from the statistics of the whole text alone; null and empty
    texts have those of no text at all. Repeated rows are scored each, an empty
    table gives no rows, and other columns of ``docs`` are not read.
    """
    stats = materialize(with_statistics(docs), "statistics")
    scored = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), train_quality(stats, labels).column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op3_rule_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all documents: doc_id, held_out, score, predicted."""
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
