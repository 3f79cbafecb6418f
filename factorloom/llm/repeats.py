"""Repeated passages of words: seeds that documents share, extended both ways.

Every ``window`` of consecutive words holds a winnowed anchor: the run of
``seed`` words of least hash among all runs in it (each of them where several
are least). The choice rests on the window's words alone, so two equal windows
hold the same anchor at the same place. Occurrences of an anchor are put side
by side and extended to the left and to the right as far as a window that holds
the anchor reaches:

* occurrences that extend alike all the way are one class; all but the first of
  a class repeat it as a whole;
* the first of each class, where an anchor has several, is extended window by
  window, so that matches which end on either side within that reach are found.

Comparing sorted hashes of the extended seeds in place of pairs of occurrences,
n occurrences cost n rows. What overlaps is merged into maximal repeats.

Groups of any size are dealt out: rows are sorted over range partitions by
(group, document, place), where a row only has to know the row before it.
What a partition's edge leaves open is settled by the next step, or by a table
of one row per partition.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm.common import materialize, shuffle_width, table
from factorloom.llm.words import hash_words, mix, pieces_of, words_of

WINDOW, SEED = 20, 8
#: Rows of a range partition, about.
PART_ROWS = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_POWERS = np.ones((2, 1), dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the base, and of its inverse, modulo 2 ** 64."""
    global _POWERS
    if _POWERS.shape[1] < n:
        steps = np.ones((2, 2 * n), dtype=np.uint64)
        steps[0, 1:], steps[1, 1:] = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
        _POWERS = np.cumprod(steps, axis=1, dtype=np.uint64)
    return _POWERS[:, :n]


class Runs:
    """Hashes of runs of a text's words of any length, from running sums."""

    def __init__(self, words: list[str]):
        hashes = hash_words(words)
        self.n = len(words)
        up, self.down = _powers(self.n + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[: self.n], dtype=np.uint64)])

    def hashes(self, start, stop) -> np.ndarray:
        """For arrays of bounds: 64-bit hashes of the words between them."""
        return mix((self.sums[stop] - self.sums[start]) * self.down[start])


def _sliding(best, values: np.ndarray, width: int) -> np.ndarray:
    """``best`` (minimum or maximum) of every ``width`` values in a row, by doubling."""
    size = 1
    while 2 * size <= width:
        values, size = best(values[:-size], values[size:]), 2 * size
    return best(values[: len(values) - (width - size)], values[width - size :]) if width > size else values


def anchors_of(runs: Runs, window: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of a text's windows."""
    if runs.n < window:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at = np.arange(runs.n - seed + 1)
    keys, reach = runs.hashes(at, at + seed), window - seed + 1
    least = np.pad(_sliding(np.minimum, keys, reach), reach - 1)
    found = at[keys == _sliding(np.maximum, least, reach)]
    return found, keys[found]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, print, text): a document is known by its id and its text's hash."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("print"), text.alias("text"))


_PROFILE = "doc_id long, print long, n_words long, sha256 string, anchors array<long>, contexts array<long>, places array<int>"


def _profiles(texts: DataFrame, window: int, seed: int) -> DataFrame:
    """Per text: number of words, hash of the words joined by blanks, anchors with what they extend to and where they are."""
    side = window - seed

    def run(batches):
        for batch in pieces_of(batches, 128):
            counts, shas, ends, keys, contexts, places = [], [], [0], [], [], []
            for text in batch.column(2):
                words = words_of(text.as_py())
                runs = Runs(words)
                at, key = anchors_of(runs, window, seed)
                left, right = np.minimum(at, side), np.minimum(runs.n - seed - at, side)
                reach = mix((left * (side + 1) + right).astype(np.uint64) + np.uint64(1))
                counts.append(len(words))
                shas.append(hashlib.sha256(" ".join(words).encode()).hexdigest())
                ends.append(ends[-1] + len(at))
                keys.append(key)
                contexts.append(mix(runs.hashes(at - left, at + seed + right) ^ reach))
                places.append(at.astype(np.int32))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), a) for a in (_signed(np.concatenate(keys)), _signed(np.concatenate(contexts)), pa.array(np.concatenate(places)))]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(shas), *lists], names=[c.split()[0] for c in _PROFILE.split(", ")])

    return texts.mapInArrow(run, _PROFILE)


def _columns(batch, names: list[str]) -> tuple[np.ndarray, ...]:
    """Columns as whole numbers, doc_id with a column for null before it."""
    out = []
    for name in names:
        column = batch.column(batch.schema.get_field_index(name))
        if name == "doc_id":
            out.append(column.is_null().to_numpy(zero_copy_only=False).astype(np.int64))
            column = column.fill_null(0)
        out.append(column.to_numpy(zero_copy_only=False).astype(np.int64))
    return tuple(out)


def _fresh(columns, before) -> np.ndarray:
    """Where a row differs from the one before it in any of the columns (the very first row does)."""
    out = np.zeros(len(columns[0]), bool)
    for k, c in enumerate(columns):
        out[1:] |= c[1:] != c[:-1]
        out[0] |= before is None or c[0] != before[k]
    return out


def _ranged(rows: DataFrame, order: list[str], count: int) -> DataFrame:
    parts = max(shuffle_width(rows.sparkSession), count // PART_ROWS + 1)
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)


_ORDER = ["key", "context", "doc_id", "print", "place"]
_FOUND = "open boolean, doc_id long, print long, start int, stop int"


def _extended(window: int, seed: int):
    """Over occurrences in order of (anchor, what it extends to, document, place): whole repeats, and places left open.

    A place is left open if it is the first of its class and its anchor has
    another, or may have one beyond the partition.
    """
    side = window - seed

    def run(batches):
        before, held, classes, first_open = None, None, 0, True
        for batch in batches:
            if not len(batch):
                continue
            columns = _columns(batch, [*_ORDER, "n_words"])
            whole = columns[:-1]  # key, context, null id, id, print, place
            distinct = _fresh(whole, before)
            new_key, new_class = _fresh(whole[:1], before)[distinct], _fresh(whole[:2], before)[distinct]
            at_start, before = before is None, tuple(c[-1] for c in whole)
            if not distinct.any():
                continue
            ids = batch.column(batch.schema.get_field_index("doc_id")).filter(pa.array(distinct))
            prints, place, n = (c[distinct] for c in columns[-3:])
            rows = pa.table({"doc_id": ids, "print": prints, "start": place, "stop": n})
            group, firsts = np.cumsum(new_key), np.flatnonzero(new_class)  # group 0 goes on from the batch before
            several = np.bincount(group[firsts], minlength=group[-1] + 1)
            several[0] += classes
            keep = several >= 2
            if first_open:  # the partition's first anchor may go on from the partition before
                keep[1 if at_start else 0] = True
                first_open = group[-1] == (1 if at_start else 0)
            if held is not None and (keep[0] or group[-1] > 0):
                if keep[0]:
                    yield _found(held, True)
                held = None
            if not keep[-1] and len(firsts) and group[firsts[-1]] == group[-1]:
                held = rows.slice(firsts[-1], 1)
            classes = int(several[-1])
            left_open = rows.take(firsts[keep[group[firsts]]])
            if len(left_open):
                yield _found(left_open, True)
            spans = np.flatnonzero(~new_class)
            if len(spans):
                at, size = place[spans], n[spans]
                bounds = {"start": at - np.minimum(at, side), "stop": at + seed + np.minimum(size - seed - at, side)}
                yield _found(pa.table({"doc_id": ids.take(pa.array(spans)), "print": prints[spans], **bounds}), False)
        if held is not None:
            yield _found(held, True)

    return run


def _found(part: pa.Table, is_open: bool) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "print": pa.int64(), "start": pa.int32(), "stop": pa.int32()}
    columns = [pa.concat_arrays(part[c].chunks).cast(k) for c, k in kinds.items()]
    return pa.record_batch([pa.array(np.full(len(part), is_open)), *columns], names=["open", *kinds])


def _windows(window: int, seed: int):
    """(key, doc_id, print, start) of the windows around the places left open in a text."""

    def run(batches):
        for batch in pieces_of(batches, 64):
            ids, prints, keys, starts = [], [], [], []
            for doc_id, mark, places, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                runs = Runs(words_of(text))
                near = (np.asarray(places)[:, None] - np.arange(window - seed + 1)[None, :]).ravel()
                at = np.unique(near[(near >= 0) & (near <= runs.n - window)])
                keys.append(runs.hashes(at, at + window))
                starts.append(at.astype(np.int32))
                ids += [doc_id] * len(at)
                prints += [mark] * len(at)
            yield pa.record_batch([_signed(np.concatenate(keys)), pa.array(ids, pa.int64()), pa.array(prints, pa.int64()), pa.array(np.concatenate(starts))], names=["key", "doc_id", "print", "start"])

    return run


_SETTLED = "state int, part int, key long, doc_id long, print long, start int"


def _settled(batches):
    """Over windows in order of (key, document, start): those that are not their key's first (state 0).

    The partition's first row is given with state 1, its last key with state 2:
    whether that row is a first shows from the partitions before it.
    """
    before, part = None, TaskContext.get().partitionId()
    for batch in batches:
        if not len(batch):
            continue
        columns = _columns(batch, ["key", "doc_id", "print", "start"])
        take = _fresh(columns, before) & ~_fresh(columns[:1], before)
        state = np.zeros(len(batch), np.int32)
        if before is None:
            take[0], state[0] = True, 1
        before = tuple(c[-1] for c in columns)
        out, mask = batch.filter(pa.array(take)), state[take]
        yield pa.record_batch([pa.array(mask), pa.array(np.full(len(out), part, np.int32)), *out.columns], names=[c.split()[0] for c in _SETTLED.split(", ")])
    if before is not None:
        yield pa.record_batch([pa.array([2], pa.int32()), pa.array([part], pa.int32()), pa.array([before[0]], pa.int64()), pa.array([None], pa.int64()), pa.array([0], pa.int64()), pa.array([0], pa.int32())], names=[c.split()[0] for c in _SETTLED.split(", ")])


def _same(a: str, b: str):
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.print") == F.col(f"{b}.print"))


def _with_texts(rows: DataFrame, texts: DataFrame, *columns: str) -> DataFrame:
    """``rows`` (one per document) with the documents' texts."""
    return rows.alias("a").join(texts.alias("b"), _same("a", "b")).select("a.doc_id", "a.print", *columns, "b.text")


def repeat_spans(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(profiles, spans) of ``docs`` (doc_id, text).

    profiles: per row doc_id, print, n_words, sha256 of its words joined by
    blanks. spans: per document that repeats something doc_id, print and
    ``spans``, an array of start << 32 | stop in words, in no order and
    overlapping; merged they are its maximal repeats of earlier places.
    """
    texts = _texts(docs)
    profiles = materialize(_profiles(texts, window, seed), "profiles")
    zipped = F.explode(F.arrays_zip("anchors", "contexts", "places")).alias("o")
    rows = profiles.select("doc_id", "print", F.col("n_words").cast("int").alias("n_words"), zipped)
    rows = rows.select(F.col("o.anchors").alias("key"), F.col("o.contexts").alias("context"), "doc_id", "print", F.col("o.places").alias("place"), "n_words")
    count = profiles.agg(F.sum(F.size("anchors"))).head()[0] or 0
    found = materialize(_ranged(rows, _ORDER, count).mapInArrow(_extended(window, seed), _FOUND), "extended")
    places = found.where("open").groupBy("doc_id", "print").agg(F.collect_list("start").alias("places"))  # places of one text
    windows = _with_texts(places, texts, "a.places").mapInArrow(_windows(window, seed), "key long, doc_id long, print long, start int")
    windows = materialize(windows, "windows")
    settled = materialize(_ranged(windows, ["key", "doc_id", "print", "start"], windows.count()).mapInArrow(_settled, _SETTLED), "settled")
    ends = settled.where("state = 2").select(F.col("key").alias("__key"), F.col("part").alias("__part"))  # one row per partition
    late = settled.where("state = 1").join(ends, (F.col("key") == F.col("__key")) & (F.col("__part") < F.col("part")), "left_semi")
    late = settled.where("state = 0").unionByName(late).select("doc_id", "print", "start", (F.col("start") + window).alias("stop"))
    spans = found.where("not open").drop("open").unionByName(late)
    spans = spans.select("doc_id", "print", F.shiftleft(F.col("start").cast("long"), 32).bitwiseOR(F.col("stop").cast("long")).alias("span"))
    return profiles.drop("anchors", "contexts", "places"), spans.groupBy("doc_id", "print").agg(F.collect_list("span").alias("spans"))  # spans of one text


def _kept(with_text: bool):
    """What is left of each text without the words of its spans."""

    def run(batches):
        for batch in pieces_of(batches, 64):
            removed, shas, left = [], [], []
            for spans, text in zip(batch.column(2), batch.column(3), strict=True):
                words, at = words_of(text.as_py()), spans.values.to_numpy()
                steps = np.zeros(len(words) + 1, np.int64)
                np.add.at(steps, at >> 32, 1)
                np.add.at(steps, at & 0xFFFFFFFF, -1)
                gone = np.cumsum(steps[:-1]) > 0
                kept = " ".join([words[k] for k in np.flatnonzero(~gone)])
                removed.append(int(gone.sum()))
                shas.append(hashlib.sha256(kept.encode()).hexdigest())
                left.append(kept if with_text else None)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(shas), pa.array(left, pa.string())], names=["doc_id", "print", "n_removed", "kept_sha256", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, with_text: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256, and kept_text if ``with_text``.

    A word goes if it is in ``window`` consecutive words that also start earlier:
    in a document of smaller doc_id (null ids are the smallest), or in the same
    text before. Of documents that share a doc_id and differ in text, the one
    whose text's hash is smaller comes first; rows repeated as a whole are one
    document, and each has its result. Words are not changed; null texts are
    empty. ``kept_text`` joins the words kept by one blank (null where nothing was
    removed: the text stands as it is). Other columns are ignored. An
    empty table gives no rows. Windows are judged on the texts as they came.
    """
    profiles, spans = repeat_spans(docs, window, seed)
    cut = _with_texts(spans, _texts(docs), "a.spans").mapInArrow(_kept(with_text), "doc_id long, print long, n_removed long, kept_sha256 string, kept_text string")
    cut = materialize(cut, "kept").dropDuplicates(["doc_id", "print"])
    out = profiles.alias("a").join(cut.alias("b"), _same("a", "b"), "left")
    columns = [F.coalesce("b.n_removed", F.lit(0)).alias("n_removed"), F.coalesce("b.kept_sha256", "a.sha256").alias("kept_sha256")]
    return out.select("a.doc_id", "a.n_words", *columns, *(["b.kept_text"] if with_text else []))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of windows of 20 that start earlier."""
    return remove_repeats(table(spark, sf_dir, "documents"))


def op13_sql() -> str:
    """Every window's text, its first place, and the words that later places cover."""
    return r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(0, len(w) - 19)) AS s, w FROM d WHERE len(w) >= 20),
x AS (SELECT doc_id, s, array_to_string(w[s + 1 : s + 20], ' ') AS t FROM s),
f AS (SELECT t, min(row(doc_id, s)) AS first FROM x GROUP BY t HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS k FROM x JOIN f USING (t) WHERE row(doc_id, s) > first),
u AS (SELECT doc_id, generate_subscripts(w, 1) - 1 AS k, unnest(w) AS word FROM d),
g AS (SELECT u.doc_id, count(c.k) AS n_removed, string_agg(word, ' ' ORDER BY k) FILTER (c.k IS NULL) AS kept FROM u LEFT JOIN c USING (doc_id, k) GROUP BY u.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)"""
