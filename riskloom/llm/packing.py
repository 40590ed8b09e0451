"""Packing by power-of-two decomposition.

A document's ids, ended by a separator id, are cut into pieces whose lengths are powers of two: full pieces of
``max_length`` first, then the binary digits of the rest from the largest. Each piece is a sequence of its own, so no
sequence holds tokens of two documents, none is padded, and sequences of one length form a bucket that a trainer reads
in batches of equal shape.

Defined cases: a null or empty text has only the separator id, hence one piece of length 1; repeated rows are packed
once each; a null id is carried through; an empty table gives no pieces; other columns are ignored, so their names
cannot clash. The pass is narrow: it reads each text once and shuffles nothing, whatever a document's length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm import _tokens
from riskloom.llm._common import bound_batches

SCHEMA = "doc_id long, start long, length long, token_bytes binary, doc_tokens long"
#: Bytes of ids handed to Spark at a time.
BATCH_BYTES = 1 << 20


def cut(n: int, max_length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: each length is a power of two of at most max_length (itself one)."""
    out, at = [], 0
    while n - at >= max_length:
        out.append((at, max_length))
        at += max_length
    bit = max_length >> 1
    while at < n:
        if n - at >= bit:
            out.append((at, bit))
            at += bit
        bit >>= 1
    return out


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", max_length: int = 4096, end_id: int = 2, keep: dict[str, Column] | None = None) -> DataFrame:
    """Pieces of all documents, with the columns of keep of their rows: doc_id, start, length, token_bytes (ids, little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset (0: a piece is a whole sequence) and bucket (the binary logarithm of length)."""
    if max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    bound_batches(docs.sparkSession)
    end, keep = np.asarray([end_id], "<u4").tobytes(), keep or {}
    extra = list(keep)

    def pieces(batches):
        enc = _tokens.encoder(tokenizer_path)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), (x.as_py() for x in batch.column(1))
            others = [batch.column(2 + i) for i in range(len(extra))]
            rows, own, held = [], [], 0

            def full():
                made = _batch(rows)
                take = pa.array(own)
                return pa.RecordBatch.from_arrays([*made.columns, *(c.take(take) for c in others)], names=[*made.schema.names, *extra])

            for i, (doc, tokens) in enumerate(zip(ids, enc.encode(texts), strict=True)):
                tokens += end
                n = len(tokens) // 4
                spans = cut(n, max_length)
                rows += [(doc, at, length, tokens[4 * at : 4 * (at + length)], n) for at, length in spans]
                own += [i] * len(spans)
                held += len(tokens)
                if held >= BATCH_BYTES:
                    yield full()
                    rows, own, held = [], [], 0
            if rows:
                yield full()

    taken = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(c.alias(n) for n, c in keep.items()))
    out = taken.mapInArrow(pieces, ", ".join([SCHEMA, *(f"{f.name} {f.dataType.simpleString()}" for f in taken.schema.fields[2:])]))
    # The scan's splits are the same on every attempt, so these ids are too.
    return out.withColumns({
        "sequence_id": F.monotonically_increasing_id(),
        "offset": F.lit(0).cast("long"),
        "bucket": F.log2("length").cast("int"),
    })


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()), strict=True)], names=["doc_id", "start", "length", "token_bytes", "doc_tokens"])


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder for each bucket of equal lengths."""
    packed.write.partitionBy("bucket").parquet(path)
