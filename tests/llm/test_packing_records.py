"""Packing and record files against the whole tokenizer."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskloom.llm import _common, _tokens, packing, records

PATH = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"word{i} the, of; été" for i in range(9000))
ROWS = [(3, "The cat's hat, don't — naïve ÉTÉ!!! 42.5", 1), (1, None, 2), (2, "", 3), (None, "no id", 4), (3, "The cat's hat, don't — naïve ÉTÉ!!! 42.5", 5), (9, LONG, 6), (8, "<|endoftext|> a\tb\x1cc d  é", 7)]


def table(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string, start int").withColumn("length", F.lit("clash")).withColumn("token_bytes", F.lit(1))


TOKENIZER = Tokenizer.from_file(PATH)


def whole(text, end):
    return np.asarray([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, end], "<u4").tobytes()


@given(st.lists(st.text(st.sampled_from("abéß'’ .,!?*$#İΣ́\n\t 中9<|>"), max_size=30), max_size=5))
def test_chunks_give_the_tokenizers_ids(texts):
    enc = _tokens.encoder(PATH)
    assert list(enc.encode(texts)) == [whole(t, 0)[:-4] for t in texts]


def test_generations_are_bounded(monkeypatch):
    monkeypatch.setattr(_tokens, "GENERATION", 5)
    enc = _tokens.ChunkEncoder(PATH)
    texts = [f"alpha beta{i} gamma, Delta! alpha" for i in range(30)]
    assert list(enc.encode(texts)) == [whole(t, 0)[:-4] for t in texts]
    assert len(enc.young) < 20


@given(st.integers(0, 40_000), st.sampled_from([1, 2, 64, 4096]))
def test_cut(n, most):
    pieces = packing.cut(n, most)
    assert sum(k for _, k in pieces) == n
    assert [a for a, _ in pieces] == [0, *np.cumsum([k for _, k in pieces])[:-1].tolist()][: len(pieces)]
    assert all(k & (k - 1) == 0 and k <= most for _, k in pieces)


def test_pack(spark):
    out = packing.pack(table(spark), PATH).collect()
    assert len({r.sequence_id for r in out}) == len(out) and {r.offset for r in out} == {0}
    texts = {(i, t) for i, t, _ in ROWS}
    for doc, text in texts:
        pieces = sorted((r for r in out if r.doc_id == doc), key=lambda r: (r.start, r.sequence_id))
        joined = b"".join(bytes(r.token_bytes) for r in {r.start: r for r in pieces}.values())
        assert joined == whole(text, 2)
        assert {r.doc_tokens for r in pieces} == {len(joined) // 4}
    assert sum(r.doc_id == 3 for r in out) == 2 * len(packing.cut(len(whole(ROWS[0][1], 2)) // 4, 4096))


def test_buckets_and_kept_columns(spark, tmp_path):
    out = packing.pack(table(spark), PATH, keep={"place": F.col("start") + 1})
    packing.write_buckets(out, f"file://{tmp_path}/b")
    back = spark.read.parquet(f"file://{tmp_path}/b").collect()
    assert {r.bucket for r in back} == {int(p.name.split("=")[1]) for p in (tmp_path / "b").glob("bucket=*")}
    assert all(r.length == 1 << r.bucket and len(r.token_bytes) == 4 * r.length for r in back)
    assert sum(r.length for r in back) == sum(len(whole(t, 2)) // 4 for _, t, _ in ROWS)
    assert {(r.doc_id, r.place - 1) for r in back} == {(i, k) for i, _, k in ROWS}


def test_a_tokenizer_that_crosses_blanks_gets_whole_texts(monkeypatch):
    enc = _tokens.ChunkEncoder(PATH)
    assert not enc.whole
    monkeypatch.setattr(_tokens.ChunkEncoder, "_by_chunks", lambda self, text: b"other")
    enc = _tokens.ChunkEncoder(PATH)
    assert enc.whole and list(enc.encode([ROWS[0][1], None])) == [whole(ROWS[0][1], 0)[:-4], b""]


def test_pack_nothing(spark):
    assert packing.pack(table(spark, []), PATH).count() == 0


def test_records_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/r"
    records.write(table(spark), path, PATH)
    got = records.read(spark, path).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, bytes(r.token_bytes)) for r in got) == sorted((i is not None, i or 0, whole(t, 1)) for i, t, _ in ROWS)
    index = records.build_index(spark, path, f"file://{tmp_path}/i").collect()
    at = 0
    for r in sorted(index, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(index, key=lambda r: r.start)]
    assert order == [None, 1, 2, 3, 3, 8, 9]
    assert {r.ids_crc32 for r in index if r.doc_id == 9} == {zlib.crc32(whole(LONG, 1))}
    a = [(r.doc_id, r.offset) for r in records.read_shuffled(spark, path, spark.read.parquet(f"file://{tmp_path}/i"), 5, 2).collect()]
    assert len(a) == len(ROWS)


def test_files_stand_by_their_numbers(spark, tmp_path):
    """Names pad a task's number to five digits and a file's to three only; many small files, equal ids in several."""
    names = ["part-00007-x-c000.txt", "part-99999-x-c998.txt", "part-99999-x-c1000.txt", "part-100000-x-c000.txt", "part-100001-x-c000.txt"]
    (tmp_path / "r").mkdir()
    for i, name in enumerate(names):
        frames = [records.frame(records.encode_payload(i + k, np.arange(i + 2, dtype="<u4").tobytes(), False)) + b"\n" for k in range(2)]
        (tmp_path / "r" / name).write_bytes(b"".join(frames))
    index = sorted(records.build_index(spark, f"file://{tmp_path}/r", f"file://{tmp_path}/i").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in index] == [0, 1, 1, 2, 2, 3, 3, 4, 4, 5]
    assert [r.start for r in index] == [0, 2, 4, 7, 10, 14, 18, 23, 28, 34]


def test_files_of_a_size(spark, tmp_path):
    rows = [(i // 50, f"text {i} " * 20, 1) for i in range(1000)]
    path = f"file://{tmp_path}/r"
    records.write(table(spark, rows), path, PATH, file_bytes=20_000)
    index = sorted(records.build_index(spark, path, f"file://{tmp_path}/i").collect(), key=lambda r: r.start)
    assert len({r.path for r in index}) > 4 and [r.doc_id for r in index] == [i // 50 for i in range(1000)]


def test_records_of_nothing(spark, tmp_path):
    records.write(table(spark, []), f"file://{tmp_path}/r", PATH)
    assert records.build_index(spark, f"file://{tmp_path}/r", f"file://{tmp_path}/i").count() == 0


def test_damage_is_found():
    data = bytearray(b"".join(records.frame(records.encode_payload(i, np.arange(i, dtype="<u4").tobytes(), False)) + b"\n" for i in range(5)))
    assert [records.decode_payload(p)[0] for _, p in records.frames(bytes(data))] == [0, 1, 2, 3, 4]
    for place in (3, 9, 20, len(data) - 3):
        bad = bytearray(data)
        bad[place] ^= 1
        with pytest.raises(records.CorruptRecord):
            list(records.frames(bytes(bad)))
    with pytest.raises(records.CorruptRecord):
        list(records.frames(bytes(data[:-1])))


def test_texts_reach_workers_in_small_batches(spark, tmp_path):
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1000).alias("text"))
    records.write(docs, f"{tmp_path}/r", PATH)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) <= 3 << 20


def test_memories_of_a_worker_are_dropped():
    _common.sole("x", list)
    _common.release()
    assert not _common._sole
