"""Quality rules: base statistics, and a log-likelihood ratio of hashed n-grams.

Words and word pairs are hashed into buckets; two multinomials over the
buckets are counted, one from trusted documents, one from all. A document's
score is the mean log-ratio of its n-grams (so length does not matter), and
every document at or above one fixed threshold is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm.common import materialize, table
from factorloom.llm.words import _MIX_A, hash_words, mix, pieces_of, window_hashes, words_of

SYMBOLS = "#*$%&|<>"
MIN_WORDS, REPEAT_SHARE, REPEAT_WINDOW = 10, 20, 5
#: Buckets of the multinomials; the driver and each task hold one number for each.
BUCKETS = 1 << 18
#: Pseudo-counts per bucket, in words of trusted text.
SMOOTH = 4.0
#: Mean log-ratio under which a document is rejected.
MIN_SCORE = -0.2
#: Up to so many trusted ids are sent to all tasks; more are joined, and whole texts are then shuffled once.
MAX_BROADCAST_IDS = 2_000_000


def repeat_words(hashes: np.ndarray, window: int = REPEAT_WINDOW) -> int:
    """Words that lie in a window of words which the text holds twice or more."""
    runs = window_hashes(hashes, window)
    if len(runs) < 2:
        return 0
    _, inverse, counts = np.unique(runs, return_inverse=True, return_counts=True)
    edges = np.zeros(len(hashes) + 1, dtype=np.int64)
    starts = np.flatnonzero(counts[inverse] > 1)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges) > 0).sum())


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen, n = set(), 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif line.strip(" \t\n\r\x0b\x0c"):
            seen.add(line)
    return n


def base_counts(text: str, words: list[str], hashes: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    symbols = sum(map(text.count, SYMBOLS))
    lines = dup_lines(text) if "\n" in text else 0
    return len(words), sum(map(len, words)), symbols, lines, repeat_words(hashes)


def ngram_buckets(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of the words and of the pairs of neighbours."""
    pairs = mix(hashes[:-1] * _MIX_A + hashes[1:])
    return (np.concatenate([mix(hashes), pairs]) % np.uint64(buckets)).astype(np.int64)


def ngram_counts(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Counts per bucket over trusted (row 0) and all (row 1) documents.

    ``trusted`` has the ids of trusted documents. Tasks count on their own and
    send a row per bucket, so hot words cost no more than rare ones; what the
    driver gets has ``buckets`` rows however large the corpus is.
    """

    def count(batches):
        total = np.zeros((2, buckets), dtype=np.int64)
        for batch in pieces_of(batches):
            for flag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                if words:
                    slots = ngram_buckets(hash_words(words), buckets)
                    np.add.at(total[1], slots, 1)
                    if flag:
                        np.add.at(total[0], slots, 1)
        seen = np.flatnonzero(total[1])
        yield pa.record_batch([pa.array(seen), pa.array(total[0][seen]), pa.array(total[1][seen])], names=["bucket", "trusted", "raw"])

    ids = materialize(trusted.select(F.col("doc_id").alias("__t")).distinct(), "trusted")
    ids = F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids
    flagged = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("__t"), "left")
    partial = flagged.select(F.col("__t").isNotNull(), "text").mapInArrow(count, "bucket long, trusted long, raw long")
    rows = partial.groupBy("bucket").agg(F.sum("trusted").alias("trusted"), F.sum("raw").alias("raw")).toPandas()
    out = np.zeros((2, buckets), dtype=np.int64)
    out[0, rows["bucket"]], out[1, rows["bucket"]] = rows["trusted"], rows["raw"]
    return out


def log_ratios(counts: np.ndarray, smooth: float = SMOOTH) -> np.ndarray:
    """Log of trusted over raw share per bucket; all 0 without trusted text.

    Raw counts are scaled to the mass of the trusted ones before smoothing, so
    n-grams too rare to tell anything have ratios near 0 at every corpus size.
    """
    trusted, raw = counts
    if not trusted.sum():
        return np.zeros(len(trusted))
    return np.log((trusted + smooth) / (raw * (trusted.sum() / raw.sum()) + smooth))


def judge_column(text: Column, ratios: np.ndarray, min_score: float = MIN_SCORE) -> Column:
    """Struct of the base counts, base_failed, score and kept for each text.

    A text without words has score 0 and fails the base rules, a null text too.
    """
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    @F.pandas_udf(", ".join(f"{f} long" for f in fields) + ", base_failed boolean, score double, kept boolean")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                text = text or ""
                words = words_of(text)
                hashes = hash_words(words)
                counts = base_counts(text, words, hashes)
                failed = counts[0] < MIN_WORDS or 100 * counts[4] > REPEAT_SHARE * counts[0]
                score = float(ratios[ngram_buckets(hashes, len(ratios))].mean()) if words else 0.0
                rows.append((*counts, failed, score, not failed and score >= min_score))
            yield pd.DataFrame(rows, columns=[*fields, "base_failed", "score", "kept"])

    return judge(text.cast("string"))


def quality_rules(
    docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, smooth: float = SMOOTH, min_score: float = MIN_SCORE
) -> DataFrame:
    """Add ``quality``, the struct of ``judge_column``, to every row of ``docs`` (doc_id, text).

    A column of that name is replaced. Repeated rows count and are judged each;
    trusted ids count once, null ones and those of no document not at all.
    Without trusted text all scores are 0; an empty table gives no rows. A score
    that equals ``min_score`` is kept.
    """
    ratios = log_ratios(ngram_counts(docs, trusted, buckets), smooth)
    return docs.withColumn("quality", judge_column(F.col("text"), ratios, min_score))


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the documents that ``labels`` calls good."""
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every document: doc_id, n_words, the four counts, base_failed, kept (and score)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs, trusted_ids(spark, sf_dir)).select("doc_id", "quality.*")
