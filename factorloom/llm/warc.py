"""WARC archives: writing with revisits, and reading by boundary-chain verification.

Writing: a payload is stored once, with the largest id of the pages that share
it; the others become ``revisit`` records without a body. Spark's text writer
puts a record per row (its line separator is the blank lines that close a
record), so any file system and the output committer work.

Reading: files are split at every occurrence of the magic. Each split names a
*candidate* record and, by its Content-Length, the offset of its successor. A
payload may hold the magic too, so candidates count only if the chain of
successors from the start of the file reaches them: chains are followed inside
each block of ``JUMP_BYTES`` of a file, then pointer jumping (doubling) links the
blocks, whatever splits a file was read in. A body that crosses the bound of two
splits is put together from the parts of just that body.
"""

from __future__ import annotations

import base64
import hashlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.llm.common import materialize, new_path, table

MAGIC = b"WARC/1.1\r\n"
_END = b"\r\n\r\n"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_ID = "<urn:page:"
#: Candidates of so many bytes of a file are followed in one task; pointer jumping goes from there.
JUMP_BYTES = 1 << 20
RECORDS_PER_FILE = 20_000


def base32_of(digest: Column) -> Column:
    """Upper-case base32 of a SHA-1 given as 40 hex digits."""
    letters = []
    for k in range(0, 40, 5):  # five hex digits are four letters
        part = F.conv(F.substring(digest, k + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(_BASE32), F.shiftright(part, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def write_warc(pages: DataFrame, path: str, compression: str = "gzip", records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write a record per row of ``pages`` (page_id, url, html).

    Payload: the html in UTF-8, null as empty. Of rows with equal payloads those
    with the largest page_id are ``response``, others ``revisit`` it; null ids
    are smaller than any. Control characters and blanks are left out of the
    target's header. An empty table gives no records.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("body"))
    rows = rows.withColumn("digest", F.sha1(F.col("body").cast("binary")))
    newest = rows.groupBy(F.col("digest").alias("d")).agg(F.max("page_id").alias("newest"))
    rows = rows.join(newest, F.col("digest") == F.col("d"))
    whole = F.col("page_id").eqNullSafe(F.col("newest"))
    record_id = lambda c: F.concat(F.lit(_ID), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    block = F.when(whole, F.col("body")).otherwise("")
    header = F.concat(
        F.lit(MAGIC.decode()),
        F.lit("WARC-Type: "), F.when(whole, "response").otherwise("revisit"), F.lit("\r\nWARC-Record-ID: "), record_id(F.col("page_id")),
        F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", ""),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), base32_of(F.col("digest")),
        F.when(whole, "").otherwise(F.concat(F.lit("\r\nWARC-Refers-To: "), record_id(F.col("newest")))),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
    )
    out = rows.select(F.concat(header, block).alias("value")).write.option("lineSep", _END.decode())
    out.option("compression", compression).option("maxRecordsPerFile", records_per_file).text(path)


def _fields(head: bytes) -> dict[bytes, bytes]:
    """Header fields by lower-cased name."""
    pairs = (line.partition(b":") for line in head.split(b"\r\n"))
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def _digits(value: bytes | None) -> int | None:
    return int(value) if value and value.isdigit() and len(value) < 19 else None


class _Block:
    """The candidates of one block of a file, fed with what lies between magics, in order."""

    def __init__(self, with_body: bool):
        self.with_body, self.at, self.index = with_body, 0, 0
        self.open: list[dict] = []
        self.recent: deque[tuple[int, bytes]] = deque()

    def feed(self, data: bytes) -> list[dict]:
        done, begin = [], self.at
        row = {"index": self.index, "rel": begin, "span": len(data) + len(MAGIC)}
        self.at += row["span"]
        self.index += 1
        head = data.find(_END)
        fields = _fields(data[:head]) if head >= 0 else {}
        n = _digits(fields.get(b"content-length"))
        if b"warc-type" in fields and n is not None:
            row |= {"fields": fields, "body_at": begin + head + 4, "n": n, "size": len(MAGIC) + head + 4 + n + 4}
            self.open.append(row)
        else:
            done.append(row)
        if self.open:
            self.recent.append((begin, data))
        waiting = []
        for r in self.open:
            stop = r["body_at"] + r["n"]
            if stop + 4 <= begin + len(data):
                body = self._bytes(r["body_at"], stop + 4)
                if body[-4:] == _END:
                    r |= {"body": body[:-4], "complete": True}
                else:
                    del r["size"]
                done.append(r)
            else:
                waiting.append(r)
        self.open = waiting
        low = min((r["rel"] for r in waiting), default=self.at)
        while self.recent and self.recent[0][0] < low:
            self.recent.popleft()
        return done

    def _bytes(self, start: int, stop: int) -> bytes:
        out = []
        for k, (at, data) in enumerate(self.recent):
            part = data if k == len(self.recent) - 1 else data + MAGIC
            if at + len(part) > start and at < stop:
                out.append(part[max(0, start - at) : stop - at])
        return b"".join(out)

    def close(self) -> list[dict]:
        left, self.open = self.open, []
        return left


_SCAN = (
    "file string, block long, index long, rel long, span long, size long, body_at long, n long, complete boolean, type string, id string, uri string, "
    "refers string, stated string, payload_bytes long, payload_digest string"
)
_SCAN_TYPES = [pa.string(), *[pa.int64()] * 7, pa.bool_(), *[pa.string()] * 5, pa.int64(), pa.string()]


def _candidates(lines: DataFrame, with_body: bool) -> DataFrame:
    """A row per candidate, from what lies between magics."""
    names = [f.split()[0] for f in _SCAN.split(", ")] + ["payload"] * with_body
    types = _SCAN_TYPES + [pa.binary()] * with_body

    def as_row(file: str, block: int, r: dict) -> tuple:
        f, body = r.get("fields", {}), r.get("body")
        text = lambda k: f[k].decode("utf-8", "replace") if k in f else None
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode() if body is not None else None
        row = (
            file, block, r["index"], r["rel"], r["span"], r.get("size"), r.get("body_at"), r.get("n"), r.get("complete", False), text(b"warc-type"), text(b"warc-record-id"),
            text(b"warc-target-uri"), text(b"warc-refers-to"), text(b"warc-payload-digest"), None if body is None else len(body), digest,
        )
        return (*row, body) if with_body else row

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, out, held = None, None, [], 0

        def batch():
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for rows in batches:
            for data, file, start in zip(rows.column(0), rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True):
                if key != (file, start):
                    if block is not None:
                        out += [as_row(*key, r) for r in block.close()]
                    key, block = (file, start), _Block(with_body)
                found = [as_row(*key, r) for r in block.feed(data.as_py())]
                out += found
                held += sum(r[4] for r in found) if with_body else 1000 * len(found)
                if held > 8 << 20:
                    yield batch()
                    out, held = [], 0
        if block is not None:
            out += [as_row(*key, r) for r in block.close()]
        yield batch()

    return lines.mapInArrow(scan, _SCAN + ", payload binary" * with_body)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """What lies between magics, with its file and split."""
    reader = spark.read.option("pathGlobFilter", "part-*").option("lineSep", MAGIC.decode())
    return reader.text(path).select(F.col("value").cast("binary"), F.col("_metadata.file_path"), F.col("_metadata.file_block_start"))


def _numbered(lines: DataFrame) -> DataFrame:
    """(file, block, index, data) of the lines, numbered as the candidates are."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, index = None, 0
        for rows in batches:
            numbers = []
            for at in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True):
                key, index = (at, 0) if at != key else (key, index + 1)
                numbers.append(index)
            yield pa.record_batch([rows.column(1), rows.column(2), pa.array(numbers, pa.int64()), rows.column(0)], names=["file", "block", "index", "data"])

    return lines.mapInArrow(number, "file string, block long, index long, data binary")


def _walk(pdf: pd.DataFrame) -> np.ndarray:
    """For the candidates of a block, sorted by offset: the first offset of their chain outside of the block."""
    at = {o: k for k, o in enumerate(pdf["offset"].tolist())}
    succ = pdf["successor"].tolist()
    leaves = np.full(len(pdf), -1, dtype=np.int64)
    for k in range(len(pdf) - 1, -1, -1):
        to = succ[k]
        if to == to and to is not None:  # not NaN
            to = int(to)
            leaves[k] = leaves[at[to]] if to in at else to
    return leaves


def _exits(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("offset", ignore_index=True)
    return pdf[["file", "block", "offset"]].assign(exit=_walk(pdf))


def _mark(pdf: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a block that its entry reaches."""
    pdf = pdf.sort_values("offset", ignore_index=True)
    at = {o: k for k, o in enumerate(pdf["offset"].tolist())}
    succ, keep = pdf["successor"].tolist(), []
    for k in np.flatnonzero(pdf["entry"].to_numpy()).tolist():
        while k is not None and succ[k] == succ[k] and succ[k] is not None:
            keep.append(k)
            k = at.get(int(succ[k]))
    return pdf.loc[sorted(set(keep)), ["file", "split", "index"]]


def _blocks(light: DataFrame) -> DataFrame:
    """(file, block, base, bytes) of the splits: where each begins. A row per split of a file meets its others."""
    sums = light.groupBy("file", "block").agg(F.sum("span").alias("bytes"))
    return sums.withColumn("base", F.sum("bytes").over(Window.partitionBy("file").orderBy("block")) - F.col("bytes"))


def _reachable(light: DataFrame, blocks: DataFrame, jump_bytes: int = JUMP_BYTES) -> DataFrame:
    """(file, split, index) of the candidates that the chain from their file's start reaches.

    One block's candidates, small rows of offsets, meet in one task; the number
    of rounds is the logarithm of a file's blocks.
    """
    offset = F.col("base") + F.col("rel") - len(MAGIC)
    rows = light.join(blocks.select("file", "block", "base"), ["file", "block"]).select("file", F.col("block").alias("split"), "index", offset.alias("offset"), "size")
    rows = rows.where("offset >= 0").withColumn("successor", F.col("offset") + F.col("size")).drop("size")
    rows = materialize(rows.withColumn("block", F.floor(F.col("offset") / jump_bytes)), "warc-offsets")
    entries = rows.where("offset = 0").select("file", "offset")
    exits = materialize(rows.select("file", "block", "offset", "successor").groupBy("file", "block").applyInPandas(_exits, "file string, block long, offset long, exit long"), "warc-exits")
    goals = exits.select("file", F.col("exit").alias("offset")).distinct()
    jumps = exits.join(goals.unionByName(entries).distinct(), ["file", "offset"]).select("file", "offset", F.col("exit").alias("jump"))
    reached, n = materialize(entries, "warc-reached"), -1
    while n != (n := reached.count()):
        jumps = materialize(jumps, "warc-jumps")
        nearer = reached.join(jumps, ["file", "offset"]).select("file", F.col("jump").alias("offset"))
        reached = materialize(reached.unionByName(nearer).distinct(), "warc-reached")
        onward = jumps.select("file", F.col("offset").alias("jump"), F.col("jump").alias("to"))
        jumps = jumps.join(onward, ["file", "jump"], "left").select("file", "offset", F.coalesce("to", "jump").alias("jump"))
    marked = rows.join(reached.withColumn("entry", F.lit(True)), ["file", "offset"], "left").fillna(False, "entry")
    return marked.groupBy("file", "block").applyInPandas(_mark, "file string, split long, index long")


_TORN = "file string, block long, index long, payload_bytes long, payload_digest string"


def _torn(lines: DataFrame, light: DataFrame, blocks: DataFrame, records: DataFrame, with_payload: bool) -> DataFrame:
    """The bodies of reachable records that cross the bound of two splits, from the lines they lie in; no digest if the body has not its end.

    At most one such record crosses a bound, so a split meets two of them at most.
    """
    open_ = records.where("not complete").join(blocks.select("file", "block", "base"), ["file", "block"])
    open_ = open_.select("file", F.col("block").alias("b"), F.col("index").alias("i"), (F.col("base") + F.col("body_at")).alias("from"), F.col("n"))
    open_ = open_.withColumn("to", F.col("from") + F.col("n") + len(_END))
    parts = blocks.join(open_, "file").where((F.col("base") < F.col("to")) & (F.col("base") + F.col("bytes") > F.col("from")) & (F.col("block") >= F.col("b")))
    at = F.col("base") + F.col("rel")
    inside = light.select("file", "block", "index", "rel", "span").join(parts, ["file", "block"]).where((at < F.col("to")) & (at + F.col("span") > F.col("from")))
    inside = materialize(inside.select("file", "block", "index", "b", "i", "n", (at - F.col("from")).alias("at")), "warc-torn")

    def put_together(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        n = int(pdf["n"].iloc[0]) + len(_END)
        body = b"".join(d + MAGIC for d in pdf["data"])[max(0, -int(pdf["at"].iloc[0])) :][:n]
        good = len(body) == n and body.endswith(_END)
        body = body[: -len(_END)] if good else None
        out = pdf[["file", "b", "i"]].head(1).rename(columns={"b": "block", "i": "index"})
        out = out.assign(payload_bytes=len(body) if good else None, payload_digest=base64.b32encode(hashlib.sha1(body).digest()).decode() if good else None)
        out["payload_bytes"] = out["payload_bytes"].astype("Int64")
        return out.assign(payload=[body]) if with_payload else out

    data = _numbered(lines).join(inside, ["file", "block", "index"])
    return data.groupBy("file", "b", "i").applyInPandas(put_together, _TORN + ", payload binary" * with_payload)


def read_warc(spark: SparkSession, path: str, with_payload: bool = True, jump_bytes: int = JUMP_BYTES) -> DataFrame:
    """The records of the archives in ``path``, with their payloads if asked for.

    Columns: file, type, id, uri, refers, stated (the header's digest),
    payload_bytes, payload_digest and payload. A file that does not begin with a
    record has none; one that breaks off, or holds a record whose body has not
    its end, has those before.
    """
    lines, on = _lines(spark, path), ["file", "block", "index"]
    light = materialize(_candidates(lines, False), "warc-candidates")
    blocks = materialize(_blocks(light), "warc-blocks")
    broken = None
    while True:
        known = light if broken is None else light.join(broken.withColumn("bad", F.lit(True)), on, "left").withColumn("size", F.when(F.col("bad").isNull(), F.col("size"))).drop("bad")
        kept = _reachable(known, blocks, jump_bytes).withColumnRenamed("split", "block")
        records = materialize(known.join(kept, on), "warc-kept")
        torn = None
        if records.where("not complete").isEmpty():
            break
        torn = materialize(_torn(lines, light, blocks, records, with_payload), "warc-torn-bodies")
        bad = torn.where("payload_digest is null").select(*on)
        if bad.isEmpty():
            break
        broken = materialize(bad if broken is None else bad.unionByName(broken), "warc-broken")
    names = ["file", "type", "id", "uri", "refers", "stated", "payload_bytes", "payload_digest"] + ["payload"] * with_payload
    rows = _candidates(lines, True).join(records.select(*on), on) if with_payload else records
    out = rows.where("complete").select(*names)
    if torn is not None:
        heads = records.where("not complete").select(*on, "type", "id", "uri", "refers", "stated")
        out = out.unionByName(heads.join(torn, on).select(*names))
    return out


def page_records(records: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes and payload_digest of the full payload, record_type, refers_to."""
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    page = lambda c: F.when(number(c) != "", number(c)).cast("long")
    rows = records.select(
        page(F.col("id")).alias("page_id"), F.col("type").alias("record_type"), page(F.col("refers")).alias("refers_to"),
        F.regexp_extract("stated", r"^sha1:(\w+)$", 1).alias("stated"), "payload_bytes", "payload_digest",
    )
    full = rows.where("record_type = 'response'").groupBy(F.col("payload_digest").alias("d")).agg(F.max("payload_bytes").alias("full_bytes"))
    responses = rows.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    revisits = rows.where("record_type = 'revisit'").join(full, F.col("stated") == F.col("d"))
    revisits = revisits.select("page_id", F.col("full_bytes").alias("payload_bytes"), F.col("d").alias("payload_digest"), "record_type", "refers_to")
    return responses.unionByName(revisits)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write ``pages``, read the archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    path = new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return page_records(read_warc(spark, path, with_payload=False))


def op7_sql() -> str:
    letters = " || ".join(
        f"substr('{_BASE32}', (((('0x' || substr(h, {k + 1}, 5))::INTEGER) >> {s}) & 31) + 1, 1)" for k in range(0, 40, 5) for s in (15, 10, 5, 0)
    )
    return f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, {letters} AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS newest FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = newest THEN NULL ELSE newest END AS refers_to FROM m"""
