"""Token ids in Arrow files of fixed-size-list batches.

``write_token_files`` encodes whole texts and writes Arrow IPC files whose
record batches hold equal-length sequences: ``ids`` (fixed_size_list of
unsigned 16- or 32-bit ids) and ``mask`` (fixed_size_list of booleans, false
over padding). Sequence ``i`` of a file is a slice of one buffer, so a reader
that maps the file reaches any sequence without copying. ``doc_ids`` and
``doc_ends`` (the documents that end in a sequence, and where) make a file
self-describing. ``read_token_files`` reads them back.

Spark's own text writer puts the files in place (one row, one file; the
six closing bytes of the format are its line separator), so task retries and
the output committer hold for any file system Spark can write.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.llm.common import materialize, new_path, shuffle_width, table
from factorloom.llm.tokens import END_BYTES, default_tokenizer, encoder

#: The closing bytes of an Arrow IPC file.
_MAGIC = b"ARROW1"


def _file_bytes(ids: bytes, doc_ids: list, ends: list[int], seq_len: int, kind: str, meta: dict[str, str]) -> bytes:
    """One Arrow file: the ids cut into rows of ``seq_len``, the last one padded."""
    flat = np.frombuffer(ids, dtype="<u4").astype(kind)
    rows = max(1, -(-len(flat) // seq_len))
    values = np.zeros(rows * seq_len, dtype=kind)
    values[: len(flat)] = flat
    real = np.zeros(rows * seq_len, dtype=bool)
    real[: len(flat)] = True
    ends_at = np.asarray(ends, dtype=np.int64)
    at = (ends_at - 1) // seq_len
    bounds = pa.array(np.searchsorted(at, np.arange(rows + 1)), pa.int32())
    batch = pa.record_batch(
        [
            pa.FixedSizeListArray.from_arrays(pa.array(values), seq_len),
            pa.FixedSizeListArray.from_arrays(pa.array(real), seq_len),
            pa.ListArray.from_arrays(bounds, pa.array(doc_ids, pa.int64())),
            pa.ListArray.from_arrays(bounds, pa.array((ends_at - 1) % seq_len + 1, pa.int32())),
        ],
        names=["ids", "mask", "doc_ids", "doc_ends"],
    ).replace_schema_metadata(meta)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str | None = None,
    seq_len: int = 2048,
    file_tokens: int = 1 << 21,
) -> None:
    """Encode ``docs`` (doc_id, text) and write them in ascending doc_id order.

    Every text is encoded whole, with the end id behind it; null or empty texts
    are the end id alone. Documents are dealt by ranges of doc_id; each range
    is sorted and cut into files of about ``file_tokens`` ids at document
    bounds, so the files follow each other in doc_id order. Null ids come
    first, repeated rows stay beside each other. Other columns are ignored.
    An empty table gives no files. Memory: one file's ids and one text.
    """
    tokenizer = tokenizer or default_tokenizer()

    def pack(batches):
        from tokenizers import Tokenizer

        enc = encoder(tokenizer)
        kind = "<u2" if Tokenizer.from_file(tokenizer).get_vocab_size() <= 65536 else "<u4"
        parts, ids, ends, size, seq = [], [], [], 0, 0

        def flush():
            meta = {"file_seq": str(seq), "seq_len": str(seq_len), "n_tokens": str(size)}
            data = _file_bytes(b"".join(parts), ids, ends, seq_len, kind, meta)
            return pa.record_batch([pa.array([data[: -len(_MAGIC)]], pa.binary())], names=["file"])

        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), enc.encode_all(batch.column(1)), strict=True):
                data += END_BYTES
                parts.append(data)
                ids.append(doc_id)
                size += len(data) // 4
                ends.append(size)
                if size >= file_tokens:
                    yield flush()
                    parts, ids, ends, size, seq = [], [], [], 0, seq + 1
        if ids:
            yield flush()

    spark = docs.sparkSession
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranged = ranged.repartitionByRange(shuffle_width(spark), "doc_id").sortWithinPartitions("doc_id")
    files = ranged.mapInArrow(pack, "file binary").select(F.col("file").cast("string"))
    files.write.option("lineSep", _MAGIC.decode()).option("maxRecordsPerFile", 1).text(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files in ``path``: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it. Only one row per file
    meets in one task (for the running total of the files' sizes).
    """

    def parse(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                reader = pa.ipc.open_file(content.as_buffer())
                seq_len = int(reader.schema.metadata[b"seq_len"])
                seq = int(reader.schema.metadata[b"file_seq"])
                total = int(reader.schema.metadata[b"n_tokens"])
                doc_ids, starts, lengths, sums, left, at = [], [], [], [], b"", 0
                for k in range(reader.num_record_batches):
                    rows = reader.get_batch(k)
                    values = rows.column(0).flatten().to_numpy(zero_copy_only=True)
                    ends = rows.column(3)
                    row_of = np.repeat(np.arange(len(rows)), np.diff(ends.offsets.to_numpy()))
                    stops = row_of * seq_len + ends.flatten().to_numpy()
                    begin = 0
                    for doc_id, stop in zip(rows.column(2).flatten().to_pylist(), stops.tolist(), strict=True):
                        data = left + values[begin:stop].astype("<u4").tobytes()
                        left, begin = b"", stop
                        doc_ids.append(doc_id)
                        starts.append(at)
                        lengths.append(len(data) // 4)
                        sums.append(zlib.crc32(data))
                        at += len(data) // 4
                    left += values[begin : begin + total - at].astype("<u4").tobytes()
                n = len(doc_ids)
                yield pa.record_batch(
                    [
                        pa.array([name] * n, pa.string()),
                        pa.array([seq] * n, pa.int32()),
                        pa.array([doc_ids[0]] * n, pa.int64()),
                        pa.array([total] * n, pa.int64()),
                        pa.array(doc_ids, pa.int64()),
                        pa.array(starts, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(sums, pa.int64()),
                    ],
                    names=["file", "file_seq", "first_doc", "file_tokens", "doc_id", "begin", "n_tokens", "ids_crc32"],
                )

    schema = "file string, file_seq int, first_doc long, file_tokens long, doc_id long, begin long, n_tokens long, ids_crc32 long"
    content = spark.read.schema("path string, modificationTime timestamp, length long, content binary")
    files = content.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    docs = materialize(files.mapInArrow(parse, schema), "token-index")
    order = Window.orderBy(F.col("first_doc").asc_nulls_first(), "file_seq")
    base = docs.groupBy("file").agg(
        F.first("first_doc").alias("first_doc"), F.first("file_seq").alias("file_seq"), F.first("file_tokens").alias("file_tokens")
    )
    base = base.select("file", (F.sum("file_tokens").over(order) - F.col("file_tokens")).alias("base"))
    return docs.join(base, "file").select("doc_id", (F.col("base") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document, write the files, read them back: doc_id, start, n_tokens, ids_crc32."""
    path = new_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path)
