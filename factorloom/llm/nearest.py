"""Approximate nearest neighbours by score-aware anisotropic quantisation.

Unit vectors are quantised in small subspaces of 16 centres (four bits). The
loss weighs the part of the residual parallel to the vector more than the part
across it, since only the former changes large inner products. A coarse
partition sends a query to the nearest of its lists; there the four-bit codes
are scanned by table look-ups. The best give a first k-th score; every vector
whose code error allows as much is then scored on the original, in double
precision, so a visited list loses nothing. Equal vectors are scanned once.

Codebooks and the partition are fitted on a bounded sample (``SAMPLE`` vectors
of least id hash); every vector is indexed. How many lists a query visits is
measured on that sample too: as many as hold ``COVERAGE`` of the true
neighbours. Clustered vectors need few lists; vectors without any cluster need
most of them, and the search then scans codes of nearly all rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.llm.common import bounded_sample, materialize, table

SAMPLE, BOOK_SAMPLE = 20_000, 8_192
CENTRES = 16
SUBSPACE = 2
#: Inner products over which a score matters; sets the weight of parallel error.
SCORE_FROM = 0.2
LIST_ROWS, MAX_LISTS, COVERAGE = 400, 1024, 0.98
#: Rows of a list that one task scans, and queries it scans them for.
CHUNK, QUERY_BLOCK = 20_000, 50_000
#: Codes of a list that are reranked first for each query, to bound the others.
RERANK = 64
#: More than the rounding of an inner product of unit vectors in double precision.
ROUNDING = 1e-9


def parallel_weight(dim: int, score_from: float = SCORE_FROM) -> float:
    """How much more parallel error costs than error across, for unit vectors."""
    return max(1.0, (dim - 1) * score_from**2 / (1 - score_from**2))


class Quantiser:
    """Codebooks of one subspace each, fitted and applied under the anisotropic loss."""

    def __init__(self, books: np.ndarray, splits: list[tuple[int, int]], eta: float):
        self.books, self.splits, self.eta = books, splits, eta

    @classmethod
    def fit(cls, x: np.ndarray, rounds: int = 4, seed: int = 11) -> Quantiser:
        dim = x.shape[1]
        splits = [(a, min(a + SUBSPACE, dim)) for a in range(0, dim, SUBSPACE)]
        rng = np.random.default_rng(seed)
        books = np.zeros((len(splits), CENTRES, SUBSPACE), dtype=np.float32)
        picks = rng.choice(len(x), CENTRES, replace=len(x) < CENTRES)
        for j, (a, b) in enumerate(splits):
            books[j, :, : b - a] = x[picks, a:b]
        self = cls(books, splits, parallel_weight(dim))
        for _ in range(rounds):
            self._update(x, self.encode(x))
        return self

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.books[j, codes[:, j], : b - a] for j, (a, b) in enumerate(self.splits)], axis=1)

    def encode(self, x: np.ndarray, passes: int = 2) -> np.ndarray:
        """Codes by coordinate descent: the nearest centres first, then each in turn given the others."""
        x = x.astype(np.float32)
        codes = np.zeros((len(x), len(self.splits)), dtype=np.uint8)
        for j, (a, b) in enumerate(self.splits):
            gaps = x[:, None, a:b] - self.books[j][None, :, : b - a]
            codes[:, j] = (gaps**2).sum(axis=2).argmin(axis=1)
        parallel = ((x - self.decode(codes)) * x).sum(axis=1)
        for _ in range(passes):
            for j, (a, b) in enumerate(self.splits):
                gaps = x[:, None, a:b] - self.books[j][None, :, : b - a]
                along = (gaps * x[:, None, a:b]).sum(axis=2)
                others = parallel - along[np.arange(len(x)), codes[:, j]]
                cost = (gaps**2).sum(axis=2) + (self.eta - 1) * (others[:, None] + along) ** 2
                codes[:, j] = cost.argmin(axis=1)
                parallel = others + along[np.arange(len(x)), codes[:, j]]
        return codes

    def _update(self, x: np.ndarray, codes: np.ndarray) -> None:
        """Each centre to the minimum of the loss over its vectors, the other subspaces held."""
        parallel = ((x - self.decode(codes)) * x).sum(axis=1)
        for j, (a, b) in enumerate(self.splits):
            part, width = x[:, a:b], b - a
            old = ((part - self.books[j, codes[:, j], :width]) * part).sum(axis=1)
            goal = part + (self.eta - 1) * part * (parallel - old + (part * part).sum(axis=1))[:, None]
            for c in range(CENTRES):
                mine = codes[:, j] == c
                if mine.any():
                    p = part[mine]
                    self.books[j, c, :width] = np.linalg.solve(len(p) * np.eye(width) + (self.eta - 1) * p.T @ p, goal[mine].sum(axis=0))
            parallel += ((part - self.books[j, codes[:, j], :width]) * part).sum(axis=1) - old

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of each query's parts with each centre: query, subspace, centre."""
        parts = [queries[:, a:b] @ self.books[j, :, : b - a].T for j, (a, b) in enumerate(self.splits)]
        return np.stack(parts, axis=1).astype(np.float32)


def pack_codes(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes per byte."""
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros((len(codes), 1), dtype=np.uint8)], axis=1)
    return (codes[:, 0::2] << 4) | codes[:, 1::2]


def unpack_codes(packed: np.ndarray, parts: int) -> np.ndarray:
    return np.stack([packed >> 4, packed & 15], axis=2).reshape(len(packed), -1)[:, :parts]


def scan_codes(tables: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Approximate inner products (query, row) by look-ups, one subspace at a time."""
    out = np.zeros((tables.shape[0], len(packed)), dtype=np.float32)
    for j in range(tables.shape[1]):
        nibble = packed[:, j // 2] & 15 if j % 2 else packed[:, j // 2] >> 4
        out += tables[:, j, :][:, nibble]
    return out


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Unit centres of ``k`` groups of unit vectors."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
    return centres


def probes_for(x: np.ndarray, centres: np.ndarray, k: int, coverage: float, queries: int = 256) -> int:
    """Lists to visit so that ``coverage`` of the ``k`` nearest of sampled queries are in them."""
    asked = x[:queries]
    near = asked @ x.T
    near[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    top = np.argsort(-near, axis=1)[:, : min(k, len(x) - 1)]
    if not top.size:
        return len(centres)
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1), axis=1)
    visits = np.take_along_axis(place, (x @ centres.T).argmax(axis=1)[top], axis=1)
    return int(np.quantile(visits, coverage, method="higher")) + 1


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    peak = np.abs(x).max(axis=1, keepdims=True)
    x = x / peak
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _in_order(products: np.ndarray) -> np.ndarray:
    """Row sums, added from the first component to the last."""
    return np.cumsum(products, axis=1)[:, -1]


def _in_range(x: np.ndarray) -> np.ndarray:
    """Rows scaled by powers of two, which changes no digit of a cosine but keeps squares within the range of doubles."""
    _, exponent = np.frexp(np.abs(x).max(axis=1, keepdims=True))
    return np.ldexp(x, -exponent)


def exact_cosine(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    q, rows = _in_range(query[None, :]), _in_range(rows)
    return _in_order(rows * q) / (np.sqrt(_in_order(q * q)) * np.sqrt(_in_order(rows * rows)))


def usable_vectors(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, embedding) of the vectors that take part.

    Null vectors, zero ones and those with null or non-finite components do
    not, nor do those of another length than most (ties: the shorter).
    """
    v = F.col(f"`{vector}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("embedding"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0))
    lengths = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("embedding") == (lengths[0].d if lengths else -1))


def _best(scores: np.ndarray, n: int) -> np.ndarray:
    """Positions of the ``n`` largest; of equal ones at the end, the first."""
    if len(scores) <= n:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - n)[len(scores) - n]
    over = np.flatnonzero(scores > least)
    return np.concatenate([over, np.flatnonzero(scores == least)[: n - len(over)]])


def _kth(scores: np.ndarray, times: np.ndarray, k: int) -> float:
    """The ``k``-th largest score, each counted as often as ``times`` says; -inf if there are fewer."""
    order = np.argsort(-scores)
    at = np.searchsorted(np.cumsum(times[order]), k)
    return scores[order[at]] if at < len(order) else -np.inf


class _Chunk:
    """Rows of a list: equal vectors are one candidate that holds its ids in order."""

    def __init__(self, ids: np.ndarray, packed: np.ndarray, x: np.ndarray, quantiser: Quantiser):
        as_bytes = np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * 8)))[:, 0]
        _, first, group = np.unique(as_bytes, return_index=True, return_inverse=True)
        order = np.lexsort((ids, group))
        self.ids, self.group, self.times = ids[order], group[order], np.bincount(group)
        self.start = np.cumsum(self.times) - self.times
        self.own_order = np.argsort(self.ids, kind="stable")
        self.own_ids = self.ids[self.own_order]
        self.x, self.packed, self.quantiser = x[first], packed[first], quantiser
        self.unit = _unit(self.x)
        # A code's error is ``along`` times the vector and, across it, a rest of length ``across``.
        codes = quantiser.decode(unpack_codes(self.packed, len(quantiser.splits))).astype(np.float64)
        error = self.unit - codes
        self.along = (error * self.unit).sum(axis=1)
        self.across = np.linalg.norm(error - self.along[:, None] * self.unit, axis=1)
        self.slack = 2e-7 * (len(quantiser.splits) + 1) * (1 + np.linalg.norm(codes, axis=1).max())  # of single precision

    def scan(self, queries: np.ndarray) -> np.ndarray:
        return scan_codes(self.quantiser.tables(queries), self.packed)

    def may_reach(self, approximate: np.ndarray, score: float) -> np.ndarray:
        """Candidates whose inner product with a unit query can be ``score`` or more, by their codes.

        With an inner product s, the codes' is at least s * (1 - along) - across * sqrt(1 - s * s),
        which grows with s from 0 on.
        """
        if score == -np.inf:
            return np.arange(len(approximate))
        score = min(score, 1.0) - ROUNDING
        side = np.sqrt(1 - score * score) if score >= 0 else 1.0
        least = score * (1 - self.along) - self.across * side - self.slack
        return np.flatnonzero((approximate >= least) | (self.along >= 1))

    def best(self, query: np.ndarray, unit: np.ndarray, approximate: np.ndarray, own: int, k: int, rerank: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the ``k`` nearest without ``own``, exactly."""
        a, b = np.searchsorted(self.own_ids, [own, own + 1])
        times = self.times
        if a < b:
            times = times - np.bincount(self.group[self.own_order[a:b]], minlength=len(times))
        at = _best(approximate, rerank + 1)
        at = self.may_reach(approximate, _kth(self.unit[at] @ unit, times[at], k))
        at = at[times[at] > 0]
        scores = self.unit[at] @ unit
        at = at[scores >= _kth(scores, times[at], k) - ROUNDING]
        scores = exact_cosine(query, self.x[at]) if len(at) else np.empty(0)
        members = [self.ids[s : s + n] for s, n in zip(self.start[at], self.times[at], strict=True)]
        members = [m[m != own][:k] for m in members]
        ids = np.concatenate(members) if members else self.ids[:0]
        scores = np.repeat(scores, [len(m) for m in members])
        first = np.lexsort((ids, -scores))[:k]
        return ids[first], scores[first]


def nearest(
    vectors: DataFrame,
    is_query,
    k: int = 5,
    id_col: str = "vec_id",
    vector: str = "embedding",
    sample: int = SAMPLE,
    coverage: float = COVERAGE,
    rerank: int = RERANK,
) -> DataFrame:
    """The ``k`` nearest found of each query: query_id, rank, vec_id, score (cosine).

    ``is_query`` is a condition on ``vec_id``. A query's own id is no candidate.
    Order: score, then the smaller vec_id. Rows that repeat an id are candidates
    each; a repeated query id counts once, with its least vector. A list with
    more than ``CHUNK`` rows is cut by id hash, so a vector with many copies
    spreads; a list's queries are cut into blocks of ``QUERY_BLOCK``. The lists
    that a query visits are searched exactly; only those it does not visit are
    missed, and it visits more than usual where they hold too few candidates.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = usable_vectors(vectors, id_col, vector)
    picked = bounded_sample(rows, "vec_id", sample)
    if picked.empty:
        return empty
    picked = picked.sample(frac=1.0, random_state=3)
    fit_on = _unit(np.stack(picked["embedding"].to_numpy()).astype(np.float64))
    dim, total = fit_on.shape[1], rows.count()
    lists = max(1, min(MAX_LISTS, total // LIST_ROWS, len(fit_on)))
    centres, quantiser = k_means(fit_on, lists), Quantiser.fit(fit_on[:BOOK_SAMPLE])
    probes = probes_for(fit_on, centres, k, coverage)

    def index(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = _unit(_matrix(batch.column(1), dim))
            codes = pack_codes(quantiser.encode(x))
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array((x @ centres.T).argmax(axis=1).astype(np.int32)),
                    pa.array([c.tobytes() for c in codes], pa.binary()),
                    batch.column(1),
                ],
                names=["vec_id", "list", "code", "embedding"],
            )

    indexed = materialize(rows.mapInArrow(index, "vec_id long, list int, code binary, embedding array<double>"), "ann-index")
    sizes = {r.list: r["count"] for r in indexed.groupBy("list").count().collect()}  # a row per list at most
    chunks = [max(1, -(-sizes.get(i, 0) // CHUNK)) for i in range(lists)]
    queries = indexed.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("query"))
    queries = materialize(queries, "ann-queries")
    most = indexed.groupBy("vec_id").count().agg(F.max("count")).head()[0]
    held = np.array([sizes.get(i, 0) for i in range(lists)])

    def route(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = _unit(_matrix(batch.column(1), dim))
            near = np.argsort(-(x @ centres.T), axis=1, kind="stable")
            # its own rows are no candidates: lists are visited until they hold k others in any case
            visits = np.maximum(probes, (np.cumsum(held[near], axis=1) < k + most).sum(axis=1) + 1)
            at = [(i, lst, c) for i, ls in enumerate(near.tolist()) for lst in ls[: visits[i]] for c in range(chunks[lst])]
            i, lst, c = (np.array(z, dtype=np.int64) for z in zip(*at, strict=True))
            yield pa.record_batch(
                [pa.array(lst, pa.int32()), pa.array(c, pa.int32()), batch.column(0).take(pa.array(i)), batch.column(1).take(pa.array(i))],
                names=["list", "chunk", "query_id", "query"],
            )

    def scan(data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(data) and len(asked):
            packed = np.frombuffer(b"".join(data["code"]), dtype=np.uint8).reshape(len(data), -1)
            rows = _Chunk(data["vec_id"].to_numpy(), packed, np.stack(data["embedding"].to_numpy()).astype(np.float64), quantiser)
            q = np.stack(asked["query"].to_numpy()).astype(np.float64)
            unit = _unit(q)
            step = max(1, 2_000_000 // len(data))
            for a in range(0, len(q), step):
                found = rows.scan(unit[a : a + step])
                for i, own in enumerate(asked["query_id"].iloc[a : a + step].tolist()):
                    ids, scores = rows.best(q[a + i], unit[a + i], found[i], own, k, rerank)
                    out.append(pd.DataFrame({"query_id": own, "vec_id": ids, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    asked = materialize(queries.mapInArrow(route, "list int, chunk int, query_id long, query array<double>"), "ann-routes")
    asks = {r.list: r["count"] for r in asked.where("chunk = 0").groupBy("list").count().collect()}  # a row per list at most
    of_list = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("list") + 1)
    blocks = of_list([-(-asks.get(i, 0) // QUERY_BLOCK) for i in range(lists)])
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), blocks).cast("int"))
    chunk = F.pmod(F.xxhash64("vec_id"), of_list(chunks)).cast("int")
    # a list that no query visits is not read again, one that many visit as often as it has blocks of queries
    data = indexed.where(blocks > 0).withColumns({"chunk": chunk, "block": F.explode(F.sequence(F.lit(0), blocks - 1))})
    keys = ["list", "chunk", "block"]
    found = data.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(scan, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every vector whose id 50 divides: query_id, rank, vec_id, score."""
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op4_sql() -> str:
    """All queries against all rows, components added in order."""
    total = lambda x, y: f"list_reduce(list_transform(range(1, len({x}) + 1), lambda i: {x}[i] * {y}[i]), lambda s, t: s + t)"
    return f"""
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, e, sqrt({total("e", "e")}) AS l FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id, q.e AS x, c.e AS y, q.l AS ql, c.l AS cl FROM n q JOIN n c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
d AS (SELECT query_id, vec_id, {total("x", "y")} / (ql * cl) AS score FROM s)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM d
QUALIFY rank <= 5"""
