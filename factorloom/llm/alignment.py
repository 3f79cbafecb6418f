"""Alignment of two tokenizers over the same bytes.

A text's tokens of a byte-level tokenizer (A) and of a piece tokenizer (B) are
the two sides of a bipartite graph: two tokens are linked where their byte
ranges overlap. Union-find over these links gives the connected components,
which are exactly the minimal groups, those between two offsets at which
tokens of both sides end. The members of a component give its links. How many
documents hold an id pair linked is counted over the corpus.

Both tokenizers work on stretches that neither can join with what follows, so
a worker keeps the groups and links of words that it has met; a text is mostly
look-ups. A stretch whose bytes don't come back sends its text to the libraries
as a whole.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.llm.common import materialize, table
from factorloom.llm.tokens import _Bounded, _byte_letters
from factorloom.llm.words import pieces_of

#: Pairs that are looked up inside tasks; those in fewer documents are joined.
FREQUENT_PAIRS = 1 << 20

_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_WORD = re.compile(f" ?[{_LETTER}]+")


def components(a_ends: list[int], b_ends: list[int]) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Links and components of tokens given by the byte offsets at which they end, both sides of the same length.

    Links are (i, j) in order. A component lists its nodes: i for a token of
    side A, len(a_ends) + j for one of side B; components come in text order.
    """
    n, links, i, j = len(a_ends), [], 0, 0
    parent = list(range(n + len(b_ends)))
    while i < n and j < len(b_ends):
        links.append((i, j))
        x, y = i, n + j
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x < y:
            parent[y] = x  # the root is a component's first token of side A
        elif y < x:
            parent[x] = y
        a, b = a_ends[i], b_ends[j]
        i, j = i + (a <= b), j + (b <= a)
    members: dict[int, list[int]] = {}
    for x, above in enumerate(parent):  # parents come before their children
        if above != x:
            above = parent[x] = parent[above]
        members.setdefault(above, []).append(x)
    return links, list(members.values())


class Aligner:
    """``align(text)`` gives (groups, n_a + (n_b << 32), keys of all links) or None for a text without tokens.

    ``groups`` reads ``a1,a2|b1;a3|b2,b3``; ``keys`` are unsigned 64-bit, the A
    id above the B id.
    """

    def __init__(self, byte_path: str, piece_path: str, cache: int = 300_000):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=piece_path)
        self.letters = _byte_letters()
        byte_of = {letter: b for b, letter in enumerate(self.letters)}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for entry, k in self.a.get_vocab().items():
            self.a_bytes[k] = bytes(map(byte_of.get, entry)) if all(c in byte_of for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        whole = [p for k, p in enumerate(pieces) if not self.b.is_byte(k)]
        joined = {p[k : k + 2].replace("▁", " ") for p in whole for k in range(len(p) - 1)}
        # Exact only if no piece goes on over a blank or a line end, and blanks are kept as they are.
        kept = all("".join(map(self.b.id_to_piece, self.b.encode(t))) == "▁" + t.replace(" ", "▁") for t in ("x  y ", "  x"))
        self.by_stretch = kept and not any("▁" in p.lstrip("▁") or "\n" in p for p in whole)
        # The byte-level side ends a token behind letters, before a lone blank and behind a lone line end before a letter. The
        # other side never joins a blank or a line end with what stands before it, nor letters with most characters that follow.
        joins = "".join(sorted({re.escape(y) for x, y in joined if re.match(f"[{_LETTER}]", x) and not re.match(f"[{_LETTER}]", y)}))
        self.cuts = re.compile(rf"(?<=[{_LETTER}])(?=[^{_LETTER}{joins}])|(?<=[^{_SPACE}])(?= [^{_SPACE}])|(?<=[^{_SPACE}]\n)(?=[{_LETTER}])")
        self.stretches = _Bounded(self._stretch, cache)

    def _entry(self, text: str, a: list[int], b: list[int]):
        """The aligned form of ``text``, None if the bytes of a side differ from it."""
        data = text.encode()
        a_bytes, b_bytes = [self.a_bytes[k] for k in a], [self.b_bytes[k] for k in b]
        if not a or b"".join(a_bytes) != data or b"".join(b_bytes) != data:
            return None
        n, links, groups = len(a), [(0, 0)], [[0, 1]]
        if n > 1 or len(b) > 1:
            links, groups = components(list(accumulate(map(len, a_bytes))), list(accumulate(map(len, b_bytes))))
        names = [str(k) for k in a]
        names += [str(k) for k in b]
        text_of = [",".join([names[x] for x in g if x < n]) + "|" + ",".join([names[x] for x in g if x >= n]) for g in groups]
        return ";".join(text_of), n + (len(b) << 32), array("Q", [(a[i] << 32) | b[j] for i, j in links]).tobytes()

    def _ids(self, text: str) -> list[int]:
        if _WORD.fullmatch(text):  # one stretch of letters: no pattern cuts it
            return [t.id for t in self.a.model.tokenize("".join([self.letters[c] for c in text.encode()]))]
        return self.a.encode(text, add_special_tokens=False).ids

    def _stretch(self, text: str):
        """A stretch with whatever blanks it begins with; the line end before it keeps the library from adding one."""
        return self._entry(text, self._ids(text), self.b.encode("\n" + text)[2:])

    def align(self, text: str | None):
        if not text or "▁" in text:
            return None
        if self.by_stretch:
            found = [self.stretches[x] if len(x) < 400 else self._stretch(x) for x in self.cuts.split(" " + text)]
            if None not in found:
                return _merged(found)
        return self._entry(" " + text, self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text))


def _merged(found: list[tuple[str, int, bytes]]) -> tuple[str, int, bytes]:
    if len(found) == 1:
        return found[0]
    groups, sizes, keys = zip(*found, strict=True)
    return ";".join(groups), sum(sizes), b"".join(keys)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(byte_path: str, piece_path: str) -> Aligner:
    """One per worker process and pair of files."""
    key = (byte_path, piece_path)
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(*key)
    return _ALIGNERS[key]


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, pairs array<long>, times array<int>"


def _ragged(parts: list[np.ndarray], kind) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else np.empty(0), kind))


def aligned_documents(docs: DataFrame, byte_tokenizer: str | None = None, piece_tokenizer: str | None = None, with_groups: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): its groups and links, and its distinct id pairs with how often they are linked.

    Columns: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, groups (only
    ``with_groups``, else null), pairs (A id << 32 | B id, ascending), times.
    """
    a, b = default_tokenizers()
    paths = byte_tokenizer or a, piece_tokenizer or b

    def run(batches):
        own = aligner(*paths)
        for batch in pieces_of(batches, 128):
            cols = [[] for _ in range(6)]
            pairs, times = [], []
            for text in batch.column(1):
                found = own.align(text.as_py())
                if found is None:
                    row, keys = (0, 0, 0, 0, "", None), np.empty(0, dtype="<u8")
                else:
                    groups, sizes, data = found
                    keys = np.frombuffer(data, dtype="<u8")
                    digest = hashlib.sha256(groups.encode()).hexdigest()
                    row = (sizes & 0xFFFFFFFF, sizes >> 32, groups.count(";") + 1, len(keys), digest, groups if with_groups else None)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
                keys, n = np.unique(keys, return_counts=True)
                pairs.append(keys.astype(np.int64))
                times.append(n.astype(np.int32))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            out = [batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], _ragged(pairs, pa.int64()), _ragged(times, pa.int32())]
            yield pa.record_batch(out, names=[f.split()[0] for f in _ALIGNED.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _ALIGNED)


def _partial_counts(batches):
    """Pairs with the number of rows that hold them, summed over many rows before they leave the task."""

    def flush(held):
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.record_batch([pa.array(keys), pa.array(n.astype(np.int64))], names=["pair", "docs"])

    held, size = [], 0
    for batch in batches:
        held.append(batch.column(0).flatten().to_numpy())
        size += len(held[-1])
        if size >= 1 << 21:
            yield flush(held)
            held, size = [], 0
    if held:
        yield flush(held)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, docs, best): how many rows hold each id pair, and whether no other pair of its A id is in more of them."""
    counts = aligned.select("pairs").mapInArrow(_partial_counts, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs"))
    most = F.max("docs").over(Window.partitionBy(F.shiftright("pair", 32)))  # at most one row per id of the other side
    return counts.withColumn("best", F.col("docs") == most)


def _frequent_bound(counts: DataFrame, limit: int) -> tuple[int, bool]:
    """The least number of documents from which at most ``limit`` pairs come, and whether these are all pairs.

    The driver sees one row per power of 2 ** (1/8).
    """
    step = F.floor(F.log2("docs") * 8).cast("int")
    found = sorted(((r.k, r.n, r.low) for r in counts.groupBy(step.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("docs").alias("low")).collect()), reverse=True)
    bound, total = 1 << 62, 0
    for _, n, low in found:
        if total + n > limit:
            return bound, False
        bound, total = low, total + n
    return bound, True


def align_tokenizers(
    docs: DataFrame, byte_tokenizer: str | None = None, piece_tokenizer: str | None = None, with_groups: bool = False, frequent: int = FREQUENT_PAIRS
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and groups).

    A takes a blank and the text, B the text, to which it adds the blank; special
    tokens' strings are plain text. Texts that are null or empty, or whose
    joined bytes of a side differ from blank and text, have no tokens: zeros
    and ''. ``n_best`` counts links whose pair is in as many documents as any
    pair of its A id, ties included; ``count_sum`` adds the pairs' documents.
    Rows that share a doc_id, or are repeated, are documents of their own and
    counted so; null ids stay. Other columns are ignored. An empty table gives
    no rows.

    The ``frequent`` pairs in most documents are sent to all tasks (a bound on
    their number, not on the pairs); the others, none of which is in many
    documents, are joined.
    """
    rows = aligned_documents(docs, byte_tokenizer, piece_tokenizer, with_groups).withColumn("__row", F.monotonically_increasing_id())
    rows = materialize(rows, "aligned")
    counts = materialize(pair_counts(rows), "pair-counts")
    bound, every = _frequent_bound(counts, frequent)
    top = counts.where(F.col("docs") >= bound).toPandas().sort_values("pair", ignore_index=True)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((top["pair"].to_numpy(np.int64), top["docs"].to_numpy(np.int64), top["best"].to_numpy(bool)))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *(["groups"] if with_groups else []), "__row"]

    def look_up(batches):
        keys, docs_of, best = sent.value
        for batch in batches:
            lists, times = batch.column(len(names)), batch.column(len(names) + 1)
            pair, n = lists.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            at = np.searchsorted(keys, pair)
            known = at < len(keys)
            known[known] = keys[at[known]] == pair[known]
            at = np.where(known, at, 0)
            count = np.where(known, n * docs_of[at], 0) if len(keys) else np.zeros(len(pair), np.int64)
            good = np.where(known & best[at], n, 0) if len(keys) else count
            ends = np.asarray(lists.offsets) - lists.offsets[0].as_py()
            total = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[ends])
            left = np.concatenate([[0], np.cumsum(~known)])[ends].astype(np.int32)
            rest = [pa.ListArray.from_arrays(pa.array(left), pa.array(v[~known])) for v in (pair, n)]
            yield pa.record_batch([*batch.columns[: len(names)], pa.array(total(good)), pa.array(total(count)), *rest], names=[*names, "n_best", "count_sum", "rest", "rest_times"])

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", n_best long, count_sum long, rest array<long>, rest_times array<long>"
    found = rows.select(*names, "pairs", "times").mapInArrow(look_up, schema)
    if not every:
        found = materialize(found, "aligned-frequent")
        rare = found.select("__row", F.explode(F.arrays_zip("rest", "rest_times")).alias("p")).select("__row", F.col("p.rest").alias("pair"), F.col("p.rest_times").alias("n"))
        rare = rare.join(counts.where(F.col("docs") < bound), "pair").groupBy("__row")
        rare = rare.agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("__best"), F.sum(F.col("n") * F.col("docs")).alias("__sum"))
        more = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).alias(c)
        found = found.join(rare, "__row", "left").select(*names, more("n_best", "__best"), more("count_sum", "__sum"))
    return found.select(*names[:5], "n_best", "count_sum", *names[5:-1])


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents aligned between ``byte_bpe_50k.json`` and ``piece_bpe_32k.model``."""
    return align_tokenizers(table(spark, sf_dir, "documents"))
