"""Token ids in length-delimited binary records, with a separate offset index.

A record file is a run of frames. A frame is

    length of the payload (unsigned 64-bit) | masked CRC-32 of those 8 bytes (unsigned 32-bit)
    payload | masked CRC-32 of the payload (unsigned 32-bit) | line feed

all little-endian; masking rotates the sum right by 15 bits and adds a constant, so that a sum stored inside data that
is summed again does not cancel out. A payload is one flag byte (1: ids are 32 bits wide instead of 16; 2: the document
has no id), the document id (signed 64-bit) and the ids.

Files are written by Spark's own text writer, whose values are the frames without their last byte and whose line
separator is that byte: so the commit protocol covers lost executors, and any store that Spark can write to will do.
Documents are dealt to files by ranges of (id, hash of the text), as many as hold ``file_bytes`` of text each, and sorted
inside each, so files in the order of the numbers in their names hold ascending ids.

Defined cases: a null or empty text holds only the end id; rows that repeat an id are all written, ordered by a hash of
the text, then the text, and may fill several files; null ids come first; an empty table gives an empty index; other
columns are ignored; a text is encoded whole, so one of any length makes one frame, and its file is as large as it needs.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm import _tokens
from riskloom.llm._common import bound_batches, release

HEAD, SUM, MASK = struct.Struct("<QI"), struct.Struct("<I"), 0xA282EAD8
META = struct.Struct("<Bq")
WIDE, NO_ID = 1, 2
RECORDS = "path string, offset long, doc_id long, token_bytes binary"
BATCH_BYTES = 1 << 20


class CorruptRecord(ValueError):
    """A length or checksum that does not hold."""


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """A frame without its closing line feed."""
    size = struct.pack("<Q", len(payload))
    return size + SUM.pack(masked(size)) + payload + SUM.pack(masked(payload))


def frames(data: bytes | memoryview):
    """(offset, payload) of every frame of a file; raises CorruptRecord at the first one that does not hold."""
    at, view = 0, memoryview(data)
    while at < len(data):
        payload = read_frame(view, at)
        yield at, payload
        at += HEAD.size + len(payload) + SUM.size + 1


def read_frame(view: memoryview, at: int) -> bytes:
    if at + HEAD.size > len(view):
        raise CorruptRecord(f"cut short at byte {at}")
    length, check = HEAD.unpack_from(view, at)
    if masked(bytes(view[at : at + 8])) != check:
        raise CorruptRecord(f"length checksum fails at byte {at}")
    begin = at + HEAD.size
    if begin + length + SUM.size + 1 > len(view):
        raise CorruptRecord(f"cut short at byte {at}")
    payload = bytes(view[begin : begin + length])
    if masked(payload) != SUM.unpack_from(view, begin + length)[0] or view[begin + length + SUM.size] != 10:
        raise CorruptRecord(f"payload checksum fails at byte {at}")
    return payload


def encode_payload(doc_id: int | None, tokens: bytes, wide: bool) -> bytes:
    """tokens: little-endian unsigned 32-bit ids."""
    flags = (WIDE if wide else 0) | (NO_ID if doc_id is None else 0)
    return META.pack(flags, doc_id or 0) + (tokens if wide else np.frombuffer(tokens, "<u4").astype("<u2").tobytes())


def decode_payload(payload: bytes) -> tuple[int | None, bytes]:
    """The document id, and its ids as little-endian unsigned 32-bit integers."""
    flags, doc_id = META.unpack_from(payload)
    ids = payload[META.size :]
    return None if flags & NO_ID else doc_id, ids if flags & WIDE else np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def write(docs: DataFrame, path: str, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, file_bytes: int = 32 << 20) -> None:
    """Encodes every text and writes record files in ascending order of ids under path, of about file_bytes of text."""
    bound_batches(docs.sparkSession)
    end = np.asarray([end_id], "<u4").tobytes()

    def encoded(batches):
        enc = _tokens.encoder(tokenizer_path)
        wide = max(enc.size, end_id + 1) > 1 << 16
        for batch in batches:
            held: list[bytes] = []
            size = 0
            for doc, tokens in zip(batch.column(0).to_pylist(), enc.encode(x.as_py() for x in batch.column(1)), strict=True):
                held.append(frame(encode_payload(doc, tokens + end, wide)))
                size += len(held[-1])
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["value"])
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["value"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    rows = rows.repartitionByRange(1 + size // file_bytes, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    # Spark's strings are bytes: the cast neither checks nor changes them.
    rows.mapInArrow(encoded, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\n").option("compression", "none").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("path", "content")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every record, checked: path of its file, offset, doc_id, token_bytes (unsigned 32-bit, little-endian)."""

    def parsed(batches):
        release()
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, held = [], 0
                for at, payload in frames(memoryview(content.as_buffer()).cast("B")):
                    rows.append((name, at, *decode_payload(payload)))
                    held += len(payload)
                    if held >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return _files(spark, path).mapInArrow(parsed, RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["path", "offset", "doc_id", "token_bytes"])


def build_index(spark: SparkSession, path: str, index_path: str) -> DataFrame:
    """Reads the record files, writes the offset index as Parquet beside them and returns it: for each record its file,
    offset, document id, tokens, tokens before it in all files, and the crc32 of its ids."""
    records = read(spark, path).select(
        "path", "offset", "doc_id", (F.length("token_bytes") / 4).cast("long").alias("n_tokens"), F.crc32("token_bytes").alias("ids_crc32")
    )
    records.write.parquet(index_path + "-records")
    records = spark.read.parquet(index_path + "-records")
    in_file = Window.partitionBy("path").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each file of bounded size, so this ordering of all of them is small beside the input. Names pad their
    # numbers to five digits (of a task) and three (of its files), so beyond these their order as text is another one.
    files = records.groupBy("path").agg(F.sum("n_tokens").alias("n")).withColumns({
        "task": F.regexp_extract("path", "part-(\\d+)[^/]*$", 1).try_cast("long"), "piece": F.regexp_extract("path", "-c(\\d+)[^/]*$", 1).try_cast("long")
    })
    before = Window.orderBy("task", "piece", "path").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("path", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    index = records.withColumn("before", F.coalesce(F.sum("n_tokens").over(in_file), F.lit(0))).join(files, "path").select(
        "path", "offset", "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )
    index.write.parquet(index_path)
    return spark.read.parquet(index_path)


def read_shuffled(spark: SparkSession, path: str, index: DataFrame, seed: int, partitions: int) -> DataFrame:
    """Records in an order that the seed fixes: each file is opened once, its records are picked by the index, and the
    order is a sort by a hash of (seed, file, offset)."""
    places = index.groupBy("path").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))  # as many as the file holds

    def picked(batches):
        release()
        for batch in batches:
            for name, content, offsets in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                view = memoryview(content.as_buffer()).cast("B")
                rows, held = [], 0
                for at in offsets:
                    payload = read_frame(view, at)
                    rows.append((name, at, *decode_payload(payload)))
                    held += len(payload)
                    if held >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    rows = _files(spark, path).join(places, "path").select("path", "content", "offsets").mapInArrow(picked, RECORDS)
    key = F.xxhash64(F.lit(seed), "path", "offset")
    return rows.withColumn("order_key", key).repartitionByRange(partitions, "order_key").sortWithinPartitions("order_key")
