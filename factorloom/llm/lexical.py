"""Ranked lexical search with block-max pruning.

The index is a table of blocks, each a range of documents in the order of the
table: a forward index (each document's terms and their counts) and, per term
of the block, in how many of its documents it is and the largest share that it
can add to a score. A query's bound in a block is the sum of these
maxima times its weights. Queries are few against the documents, go to all
tasks in groups of bounded size, and are answered in three steps:

1. bounds of all blocks, from the maxima alone; every task names its best ones;
2. each query's best blocks are scored, its k-th score is its threshold;
3. every task sorts its blocks by a query's bound and scores them until the
   bound falls below the threshold, which rises with what the task has found.

A document can only be among the first k if its block's bound reaches the
threshold, so nothing is lost. Terms are known by 64-bit hashes.
"""

from __future__ import annotations

import contextlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.llm.common import materialize, table
from factorloom.llm.words import ascii_lower, hash_words, pieces_of

#: Runs of ASCII letters and digits and of everything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM = re.compile(TERM)
#: A block ends at so many documents or terms.
BLOCK_DOCS, BLOCK_TERMS = 128, 1 << 16
#: Queries that are answered at once: so many, or so many terms (a longer query is alone).
GROUP_QUERIES, GROUP_TERMS = 1024, 1 << 17
#: Blocks of a query that are scored for its threshold.
SEED_BLOCKS = 4

#: Blocks that Spark's Parquet reader decodes at a time. A row is a whole block of some 100,000 numbers: the usual 4,096 rows would be all that a task reads.
READ_BLOCKS = 16
_READ_ROWS = "spark.sql.parquet.columnarReaderBatchSize"

_FORWARD = "doc_ids array<long>, sizes array<int>, ends array<int>, terms array<long>, ids array<int>, counts array<int>"


@contextlib.contextmanager
def few_blocks_read(spark: SparkSession):
    """Jobs that read the index within it hold ``READ_BLOCKS`` rows of it in a reader, whatever a task's share of the index is."""
    before = spark.conf.get(_READ_ROWS, None)
    spark.conf.set(_READ_ROWS, READ_BLOCKS)
    try:
        yield
    finally:
        spark.conf.unset(_READ_ROWS) if before is None else spark.conf.set(_READ_ROWS, before)


def terms_of(text: str | None) -> list[str]:
    return _TERM.findall(ascii_lower(text)) if text else []


def _hashes(terms: list[str]) -> np.ndarray:
    return hash_words(terms).view(np.int64)


def _lists(parts: list[np.ndarray], kind) -> pa.ListArray:
    return pa.array([p.tolist() for p in parts], pa.list_(kind)) if not parts else pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts), kind))


def _forward(block_docs: int, block_terms: int):
    """Blocks of documents: ids, sizes, and per document (up to ``ends``) the places of its distinct terms in ``terms``, with counts."""

    def block(ids, hashes):
        sizes = np.array([len(h) for h in hashes])
        terms, places = np.unique(np.concatenate(hashes), return_inverse=True)
        owner = np.repeat(np.arange(len(ids)), sizes)
        pairs, counts = np.unique(owner * max(1, len(terms)) + places, return_counts=True)
        owners = pairs // max(1, len(terms))
        ends = np.searchsorted(owners, np.arange(len(ids)), side="right")
        arrays = [_lists([sizes], pa.int32()), _lists([ends], pa.int32()), _lists([terms], pa.int64()), _lists([pairs - owners * max(1, len(terms))], pa.int32()), _lists([counts], pa.int32())]
        return pa.record_batch([pa.array([ids], pa.list_(pa.int64())), *arrays], names=[c.split()[0] for c in _FORWARD.split(", ")])

    def run(batches):
        ids, hashes, size = [], [], 0
        for batch in pieces_of(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = terms_of(text.as_py())
                if not found:
                    continue
                ids.append(doc_id)
                hashes.append(_hashes(found))
                size += len(found)
                if len(ids) >= block_docs or size >= block_terms:
                    yield block(ids, hashes)
                    ids, hashes, size = [], [], 0
        if ids:
            yield block(ids, hashes)

    return run


def _shares(n_docs: int, n_terms: int, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """What a term adds per unit of its weight, for its counts in documents of these sizes."""
    norm = 75 + (25 * sizes.astype(np.int64) * n_docs) // n_terms
    return (1_000_000_000 * counts.astype(np.int64)) // (1000 * counts.astype(np.int64) + 12 * norm)


def build_index(docs: DataFrame, block_docs: int = BLOCK_DOCS, block_terms: int = BLOCK_TERMS) -> tuple[DataFrame, int, int]:
    """(index, documents with a term, terms with repeats) of ``docs`` (doc_id, text).

    The index has a row per block: ``block`` and the forward index, with per
    term of ``terms`` the number of the block's documents that hold it
    (``held``) and the largest share it adds (``most``). Documents without a
    term are left out. Rows that share a doc_id are documents of their own.
    """
    forward = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_forward(block_docs, block_terms), _FORWARD)
    forward = materialize(forward.withColumn("block", F.monotonically_increasing_id()), "forward")
    with few_blocks_read(docs.sparkSession):
        total = forward.agg(F.sum(F.size("doc_ids")), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).head()
    n_docs, n_terms = int(total[0] or 0), int(total[1] or 0)
    names = [c.split()[0] for c in _FORWARD.split(", ")] + ["block"]

    def maxima(batches):
        for batch in pieces_of(batches, 16):
            held, most = [], []
            for row in range(len(batch)):
                sizes, ends, terms, ids, counts = (batch.column(k)[row].values.to_numpy() for k in range(1, 6))
                shares = _shares(n_docs, n_terms, np.repeat(sizes, np.diff(ends, prepend=0)), counts)
                best = np.zeros(len(terms), np.int64)
                np.maximum.at(best, ids, shares)
                held.append(np.bincount(ids, minlength=len(terms)).astype(np.int32))
                most.append(best.astype(np.int32))  # below 1,000,000
            yield pa.record_batch([*batch.columns, _lists(held, pa.int32()), _lists(most, pa.int32())], names=[*names, "held", "most"])

    index = forward.select(*names).mapInArrow(maxima, f"{_FORWARD}, block long, held array<int>, most array<int>")
    with few_blocks_read(docs.sparkSession):
        return materialize(index, "block-max"), n_docs, n_terms


class _Queries:
    """A group of queries as rows of (query, term, weight), in order of the query."""

    def __init__(self, terms: list[np.ndarray]):
        kinds = [np.unique(t, return_counts=True) for t in terms]
        self.count = len(terms)
        self.owner = np.repeat(np.arange(len(terms)), [len(t) for t, _ in kinds])
        self.terms, self.place = np.unique(np.concatenate([t for t, _ in kinds]), return_inverse=True)
        self.times = np.concatenate([n for _, n in kinds]).astype(np.int64)
        self.starts = np.searchsorted(self.owner, np.arange(self.count + 1))

    def weigh(self, held: dict[int, int], n_docs: int) -> None:
        weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held.get(t, 0) + 1))) for t in self.terms.tolist()]
        self.weights = np.array(weight, np.int64)[self.place] * self.times

    def bounds(self, terms: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Each query's bound in a block."""
        at = np.minimum(np.searchsorted(terms, self.terms), len(terms) - 1)
        share = np.where(terms[at] == self.terms, most[at], 0).astype(np.int64)
        return np.bincount(self.owner, weights=self.weights * share[self.place], minlength=self.count).astype(np.int64)


class _Block:
    """A block's forward index, to be scored for several queries."""

    def __init__(self, batch, row: int, n_docs: int, n_terms: int):
        names = ("doc_ids", "sizes", "ends", "terms", "ids", "counts")
        column = {n: batch.column(batch.schema.get_field_index(n))[row].values for n in names}
        self.doc_ids = column["doc_ids"]
        sizes, ends, self.terms, self.ids, counts = (column[n].to_numpy() for n in names[1:])
        spans = np.diff(ends, prepend=0)
        self.docs, self.doc_of = len(ends), np.repeat(np.arange(len(ends)), spans)
        self.shares = _shares(n_docs, n_terms, np.repeat(sizes, spans), counts)

    def best(self, queries: _Queries, q: int, k: int) -> list[tuple[int, int | None]]:
        """The (score, doc_id) of the ``k`` best documents with a score, ties by doc_id."""
        a, b = queries.starts[q], queries.starts[q + 1]
        terms, weights = queries.terms[queries.place[a:b]], queries.weights[a:b]
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        here = self.terms[at] == terms
        by_term = np.zeros(len(self.terms), np.int64)
        by_term[at[here]] = weights[here]
        hit = np.flatnonzero(by_term[self.ids])
        scores = np.zeros(self.docs, np.int64)
        np.add.at(scores, self.doc_of[hit], by_term[self.ids[hit]] * self.shares[hit])
        some = np.flatnonzero(scores)
        if len(some) > k:
            some = some[scores[some] >= np.partition(scores[some], -k)[-k]]
        found = [(int(scores[d]), self.doc_ids[int(d)].as_py()) for d in some]
        return sorted(found, key=_place)[:k]


def _place(found: tuple[int, int | None]):
    return -found[0], found[1] is not None, found[1] or 0


def _groups(items: DataFrame, max_queries: int, max_terms: int):
    """Lists of (item_id, term hashes) that hold as many queries or terms at most; the driver holds one list at a time."""
    held, size = [], 0
    for item in items.toLocalIterator(prefetchPartitions=False):
        terms = _hashes(terms_of(item.text))
        if held and (len(held) >= max_queries or size + len(terms) > max_terms):
            yield held
            held, size = [], 0
        held.append((item.item_id, terms))
        size += len(terms)
    if held:
        yield held


def _first_k(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


_SCORED = "query int, doc_id long, score long"


def _answer(spark: SparkSession, index: DataFrame, n_docs: int, n_terms: int, terms: list[np.ndarray], k: int, seed_blocks: int) -> DataFrame:
    """(query, doc_id, score, rank) of a group of queries, by their places in ``terms``."""
    queries = _Queries(terms)
    wanted = spark.sparkContext.broadcast(queries.terms)

    def held_by(batches):
        for batch in batches:
            all_terms, held = batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy()
            at = np.minimum(np.searchsorted(wanted.value, all_terms), len(wanted.value) - 1)
            here = wanted.value[at] == all_terms
            n = np.bincount(at[here], weights=held[here], minlength=len(wanted.value)).astype(np.int64)
            some = np.flatnonzero(n)
            yield pa.record_batch([pa.array(wanted.value[some]), pa.array(n[some])], names=["term", "held"])

    held = index.select("terms", "held").mapInArrow(held_by, "term long, held long").groupBy("term").agg(F.sum("held").alias("held"))
    queries.weigh({r.term: r.held for r in held.collect()}, n_docs)  # at most the group's terms
    sent = spark.sparkContext.broadcast(queries)

    def bound(batches):
        """Every query's best blocks of the task."""
        best_bounds, best_blocks = np.zeros((queries_n, 0), np.int64), np.zeros((queries_n, 0), np.int64)
        for batch in pieces_of(batches, 64):
            found = [sent.value.bounds(batch.column(1)[r].values.to_numpy(), batch.column(2)[r].values.to_numpy()) for r in range(len(batch))]
            best_bounds = np.concatenate([best_bounds, np.stack(found, axis=1)], axis=1)
            best_blocks = np.concatenate([best_blocks, np.broadcast_to(batch.column(0).to_numpy(), (queries_n, len(batch)))], axis=1)
            order = np.argsort(-best_bounds, axis=1, kind="stable")[:, :seed_blocks]
            best_bounds, best_blocks = np.take_along_axis(best_bounds, order, 1), np.take_along_axis(best_blocks, order, 1)
        q, b = np.nonzero(best_bounds)
        yield pa.record_batch([pa.array(q.astype(np.int32)), pa.array(best_blocks[q, b]), pa.array(best_bounds[q, b])], names=["query", "block", "bound"])

    queries_n = queries.count
    bounds = index.select("block", "terms", "most").mapInArrow(bound, "query int, block long, bound long")
    order = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
    seeds = bounds.withColumn("r", F.row_number().over(order)).where(F.col("r") <= seed_blocks).groupBy("block").agg(F.collect_list("query").alias("queries"))
    chosen = {r.block: r.queries for r in seeds.collect()}  # at most seed_blocks for each of the group's queries
    first = spark.sparkContext.broadcast(chosen)

    def emit(found: list[tuple[int, list]]):
        rows = [(q, d, s) for q, docs in found for s, d in docs]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["query", "doc_id", "score"])

    def score_seeds(batches):
        for batch in pieces_of(batches, 16):
            blocks = batch.column(batch.schema.get_field_index("block")).to_pylist()
            for row, block in enumerate(blocks):
                own = _Block(batch, row, n_docs, n_terms)
                yield emit([(q, own.best(sent.value, q, k)) for q in first.value[block]])

    seeded = index.where(F.col("block").isin(list(chosen))).drop("held", "most") if chosen else index.limit(0).drop("held", "most")
    seeded = materialize(_first_k(seeded.mapInArrow(score_seeds, _SCORED), k), "seeded")
    known = {r.query: r.score for r in seeded.where(F.col("rank") == k).select("query", "score").collect()}
    least = spark.sparkContext.broadcast(np.array([known.get(q, 1) for q in range(queries.count)], np.int64))

    def score(batches):
        """Blocks of a stretch by their bounds, best first, until the bound falls below the threshold."""
        own, floor = sent.value, least.value.copy()
        heaps: list[list] = [[] for _ in range(own.count)]
        for batch in pieces_of(batches, 64):
            names = batch.schema.get_field_index
            blocks = batch.column(names("block")).to_pylist()
            bounds = np.stack([own.bounds(batch.column(names("terms"))[r].values.to_numpy(), batch.column(names("most"))[r].values.to_numpy()) for r in range(len(batch))])
            ready: dict[int, _Block] = {}
            for q in np.flatnonzero((bounds >= floor).any(axis=0)).tolist():
                for r in np.argsort(-bounds[:, q], kind="stable").tolist():
                    if bounds[r, q] < floor[q]:
                        break
                    if q in first.value.get(blocks[r], ()):
                        continue
                    if r not in ready:
                        ready[r] = _Block(batch, r, n_docs, n_terms)
                    found = [f for f in ready[r].best(own, q, k) if f[0] >= floor[q]]
                    if found:
                        heaps[q] = sorted(heaps[q] + found, key=_place)[:k]
                        if len(heaps[q]) == k:
                            floor[q] = max(floor[q], heaps[q][-1][0])
        yield emit(list(enumerate(heaps)))

    rest = index.drop("held").mapInArrow(score, _SCORED)
    return _first_k(rest.unionByName(seeded.select("query", "doc_id", "score")), k)


def search(docs: DataFrame, items: DataFrame, k: int = 20, seed_blocks: int = SEED_BLOCKS, max_queries: int = GROUP_QUERIES, max_terms: int = GROUP_TERMS,
           block_docs: int = BLOCK_DOCS) -> DataFrame:
    """The ``k`` documents (doc_id, text) of largest score over 0 for each row of ``items`` (item_id, text): item_id, rank, doc_id, score.

    A term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))); it adds weight *
    ((1e9 tf) div (1000 tf + 12 m)), m = 75 + (25 n N) div L, for each time the
    item holds it. Equal scores come in order of doc_id, null ids first. Null,
    empty or wordless texts are found by nothing, and find nothing. Documents
    that share a doc_id are ranked one by one; each row of ``items`` has
    ranks of its own, also where ids repeat. Empty tables give no rows, other columns
    are ignored.
    """
    spark = docs.sparkSession
    index, n_docs, n_terms = build_index(docs, block_docs)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for group in _groups(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")), max_queries, max_terms):
        group = [g for g in group if len(g[1])]
        if group and n_docs:
            ids = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(group)], "query int, item_id long")  # one row per query of the group
            with few_blocks_read(spark):
                found = _answer(spark, index, n_docs, n_terms, [t for _, t in group], k, seed_blocks)
                found = found.join(F.broadcast(ids), "query").select("item_id", "rank", "doc_id", "score")
                out = out.unionByName(materialize(found, "ranked"))
    return out


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents ranked for every benchmark item, 20 at most."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_sql() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""WITH d AS (SELECT doc_id, unnest(regexp_extract_all({lower}, '{TERM}')) AS t FROM documents),
tf AS (SELECT doc_id, t, count(*) AS tf FROM d GROUP BY ALL), n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY ALL),
g AS (SELECT count(*) AS cn, sum(n)::BIGINT AS cl FROM n), df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
q AS (SELECT item_id, unnest(regexp_extract_all({lower}, '{TERM}')) AS t FROM benchmark), qt AS (SELECT item_id, t, count(*) AS times FROM q GROUP BY ALL),
w AS (SELECT item_id, t, times * floor(1000 * ln((2 * cn + 2) / (2 * df + 1)))::BIGINT AS w FROM qt JOIN df USING (t), g),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * cn) // cl))))::BIGINT AS score
      FROM w JOIN tf USING (t) JOIN n USING (doc_id), g GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20"""
