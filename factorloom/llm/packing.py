"""Packing of token sequences by swap-based local search.

Pieces are dealt evenly into blocks of bounded size. A block starts from bins
filled in order of arrival. Then documents move, or are exchanged one for one or
two for one, between underfull bins, every step raising the sum of squared
fills: the emptiest bins give away what they can until they are empty, and so on
until the block has no bin too many or no step is left. Only a block that ends above
its least number of bins starts once more, from best fit by falling length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm.common import materialize, table
from factorloom.llm.tokens import END_BYTES, default_tokenizer, encoder

SEQUENCE = 4096
#: Pieces that one task packs together.
BLOCK = 16384

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, capacity: int = SEQUENCE, tokenizer: str | None = None) -> DataFrame:
    """The pieces of each document: doc_id, piece, start, length, ids_crc32.

    Whole texts are encoded, with the end id behind them; null and empty texts
    are that id alone. Only documents longer than ``capacity`` are cut.
    """
    tokenizer = tokenizer or default_tokenizer()
    step = 4 * capacity

    def cut(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode_all(batch.column(1)), strict=True):
                ids += END_BYTES
                for k in range(0, len(ids), step):
                    part = ids[k : k + step]
                    rows.append((doc_id, k // step, k // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(cut, PIECE_SCHEMA)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = defaultdict(list)
    rooms = 0  # bit r: some bin has room r
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fits = rooms >> n
        if n and fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            b, room = len(bins), capacity
            bins.append([])
        bins[b].append(i)
        room -= n
        if room:
            by_room[room].append(b)
            rooms |= 1 << room
    return bins


def arrival_order(lengths: list[int], capacity: int) -> np.ndarray:
    """The bin of each item: the last bin while it takes the next item, then a new one."""
    bins, at, used = np.zeros(len(lengths), dtype=np.int64), 0, 0
    for i, n in enumerate(lengths):
        if used + n > capacity and used:
            at, used = at + 1, 0
        bins[i] = at
        used += n
    return bins


def fullest_first(lengths: list[int], capacity: int) -> np.ndarray:
    """The bin of each item by best fit."""
    bins = np.zeros(len(lengths), dtype=np.int64)
    for b, items in enumerate(best_fit(lengths, capacity)):
        bins[items] = b
    return bins


class _Search:
    """Bins of one block, and the steps between them; bin_of and room are kept up to date."""

    def __init__(self, lengths: list[int], capacity: int, bin_of: np.ndarray):
        self.size, self.bin_of = np.asarray(lengths, dtype=np.int64), bin_of
        fill = np.bincount(bin_of, weights=self.size).astype(np.int64)
        self.room, self.capacity = capacity - fill, capacity
        self.members = [[] for _ in fill]
        for i, b in enumerate(bin_of.tolist()):
            self.members[b].append(i)
        #: A bin is tried again only if a bin with room has changed since.
        self.now, self.tried = 1, np.zeros(len(fill), dtype=np.int64)

    def shift(self, item: int, to: int) -> None:
        old, n = int(self.bin_of[item]), int(self.size[item])
        self.members[old].remove(item)
        self.members[to].append(item)
        self.bin_of[item] = to
        self.room[old] += n
        self.room[to] -= n
        self.now += 1

    def move(self, low: int) -> bool:
        """Give items of ``low`` to the fullest bins that take them; whether any went."""
        went = False
        for x in sorted(self.members[low], key=lambda i: -self.size[i]):
            n = self.size[x]
            takes = (self.room >= n) & (self.room < self.room[low] + n) & (self.room < self.capacity)
            takes[low] = False
            if takes.any():
                self.shift(x, int(np.where(takes, self.room, self.capacity + 1).argmin()))
                went = True
        return went

    def exchange(self, low: int) -> bool:
        """The exchange of one or two items of ``low`` for one of another underfull bin that moves the most tokens out of ``low``."""
        free = self.room[self.bin_of]
        items = np.flatnonzero((free > 0) & (free < self.capacity) & (self.bin_of != low))
        if not len(items):
            return False
        size, free = self.size[items], free[items]
        least = np.maximum(0, free - self.room[low])  # an emptier bin must come out fuller than ``low`` was
        mine = self.members[low]
        best, found = 0, None
        pairs = [(x,) for x in mine] + [(x, y) for k, x in enumerate(mine) for y in mine[k + 1 :]]
        seen = set()
        for out in pairs:
            total = int(self.size[list(out)].sum())
            if (total, len(out)) in seen:
                continue
            seen.add((total, len(out)))
            gain = total - size
            gain = np.where((gain > least) & (gain <= free), gain, 0)
            k = int(gain.argmax())
            if gain[k] > best:
                best, found = int(gain[k]), (out, int(items[k]))
        if found is None:
            return False
        out, back = found
        other = int(self.bin_of[back])
        self.shift(back, low)
        for x in out:
            self.shift(x, other)
        return True

    def step(self, least: int) -> bool:
        """One round over the underfull bins, emptiest first; whether anything changed."""
        changed = False
        for low in np.argsort(-self.room, kind="stable").tolist():
            if not 0 < self.room[low] < self.capacity or self.tried[low] == self.now:
                continue
            while self.members[low] and (self.move(low) or self.exchange(low)):
                changed = True
            self.tried[low] = self.now
            if int((self.room < self.capacity).sum()) <= least:
                return False
        return changed


def pack_block(lengths: list[int], capacity: int = SEQUENCE) -> list[list[int]]:
    """Bins of item numbers, as few as moves and exchanges between underfull bins find.

    Ends at ceil(sum / capacity) bins, or where no step between any two
    underfull bins raises the sum of squared fills; then the search starts once
    more, from best fit, and the better end counts. Ties go to the first item
    and bin, so the same lengths always give the same bins.
    """
    if not lengths:
        return []
    least, ends = -(-sum(lengths) // capacity), []
    for start in (arrival_order, fullest_first):
        search = _Search(lengths, capacity, start(lengths, capacity))
        while int((search.room < capacity).sum()) > least and search.step(least):
            pass
        ends.append([sorted(b) for b in search.members if b])
        if len(ends[-1]) <= least:
            break
    return min(ends, key=len)


def pack_pieces(pieces: DataFrame, capacity: int = SEQUENCE, block: int = BLOCK) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (length at most ``capacity``).

    Rows are dealt by number into ``ceil(rows / block)`` blocks, so repeated
    documents and ids spread evenly; every piece is packed once, offsets in a
    sequence leave no gap. Null ids are packed like others, an empty table gives
    no rows, and columns named ``__n`` or ``__block`` are the caller's to rename.
    """
    numbered = materialize(pieces.withColumn("__n", F.monotonically_increasing_id()), "pieces")
    blocks = max(1, -(-numbered.count() // block))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"
    names = pieces.columns

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__n", ignore_index=True)
        lengths = pdf["length"].tolist()
        sequence, offset = np.zeros(len(pdf), dtype=np.int64), np.zeros(len(pdf), dtype=np.int64)
        first = int(pdf["__block"].iloc[0]) << 32
        for k, items in enumerate(pack_block(lengths, capacity)):
            at = 0
            for i in items:
                sequence[i], offset[i] = first + k, at
                at += lengths[i]
        return pdf[names].assign(sequence_id=sequence, offset=offset)

    dealt = numbered.withColumn("__block", F.pmod(F.xxhash64("__n"), F.lit(blocks)))
    return dealt.groupBy("__block").applyInPandas(pack, schema)


def pack_documents(docs: DataFrame, capacity: int = SEQUENCE, tokenizer: str | None = None, block: int = BLOCK) -> DataFrame:
    """Encode, cut and pack ``docs`` (doc_id, text)."""
    return pack_pieces(token_pieces(docs, capacity, tokenizer), capacity, block)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_documents(table(spark, sf_dir, "documents"))
