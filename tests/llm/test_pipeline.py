"""The stages on a small corpus with planted cases, and on rows that may break them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rng = np.random.default_rng(11)
    words = {"en": "the cat and dog house with water over there some people walk through green fields every morning".split(), "de": "die katze und der hund haus mit wasser dort über manche leute gehen jeden morgen durch grüne felder".split()}
    rows, passage = [], " ".join(f"Shared{i} sentence number{i} here." for i in range(20))
    for i in range(120):
        lang = "en" if i % 3 else "de"
        vocab = [w + x for w in words[lang] for x in ("", "s", "en", "ly")]
        body = ". ".join(" ".join(rng.choice(vocab, 9)) for _ in range(12)) + "."
        rows.append([i, body, lang, f"s{min(i % 7, 3)}"])
    for i in (30, 60, 90):
        rows[i][1] += " " + passage
    rows.append([200, rows[5][1], "en", "s1"])  # an exact copy
    near = rows[7][1].split()
    for place in (17, 60):
        near[place] = "other"
    # Line breaks elsewhere, so that its sentences differ from the original's and line dedup leaves it.
    rows.append([201, ", ".join(" ".join(near).split(". ")), "en", "s2"])
    rows += [[300, None, "en", "s1"], [301, "", None, None], [302, "123 !!", "en", None], [303, rows[9][1] + " tail", None, None], [None, "the cat and the dog walk over there with water", "en", "s1"]]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long")
    out = {"input": docs}
    for name, stage in cp.STAGES:
        where = f"file://{tmp_path_factory.mktemp(name)}/t"
        stage(spark, docs, "unused").write.parquet(where)
        out[name] = docs = spark.read.parquet(where)
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["language", "lines", "near_duplicates", "mixing", "packing"]
    assert all(stages[n].columns == COLUMNS for n, _ in cp.STAGES[:-1])


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=lambda x: (x is None, x))


def test_language_rejects_only_what_has_none(stages):
    assert set(ids(stages["input"])) - set(ids(stages["language"])) == {300, 301, 302}


def test_lines_delete_later_passages(stages):
    texts = {r.doc_id: r for r in stages["lines"].collect()}
    assert "Shared3" in texts[30].text and "Shared3" not in texts[60].text and "Shared3" not in texts[90].text
    assert 200 not in texts and texts[60].n_chars == len(texts[60].text)
    before = {r.doc_id: r.text for r in stages["language"].collect()}
    clean = set(before) - {60, 90, 200, 303}
    assert all(texts[i].text == before[i] for i in clean)


def test_one_of_each_group_stays(stages):
    gone = set(ids(stages["lines"])) - set(ids(stages["near_duplicates"]))
    assert gone <= {201, 303} and len(ids(stages["near_duplicates"])) == len(set(ids(stages["near_duplicates"])))


def test_mixing_drops_none_and_repeats_the_small(stages):
    kept, mixed = ids(stages["near_duplicates"]), ids(stages["mixing"])
    assert set(mixed) == set(kept) and len(mixed) >= len(kept)


def test_packing_covers_every_use(stages):
    uses = {r.doc_id: r["count"] for r in stages["mixing"].groupBy("doc_id").count().collect()}
    pieces = stages["packing"].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("one"), F.count_distinct("sequence_id").alias("s"), F.count("*").alias("k")).collect()
    assert {r.doc_id: r.n // r.one for r in pieces} == uses and all(r.s == r.k for r in pieces)


def test_the_mixing_order_reaches_the_sequences(spark, tmp_path):
    """Files of uneven size, as a sort leaves them, are read largest first; the places still tell the order."""
    where = tmp_path / "mixed"
    for k, n in enumerate((2, 300, 40)):
        part = spark.range(sum((2, 300, 40)[:k]), sum((2, 300, 40)[: k + 1])).select(F.col("id").alias("doc_id"), F.lit("some words here").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(15).cast("long").alias("n_chars"))
        part.coalesce(1).write.mode("append").parquet(f"file://{where}")
    for k, n in enumerate((2, 300, 40)):  # the names of one sorted write
        for p in where.glob("part-00000-*.parquet"):
            if spark.read.parquet(f"file://{p}").count() == n:
                p.rename(where / f"part-{k:05d}-u-c000.snappy.parquet")
    for p in where.glob(".*.crc"):
        p.unlink()
    rows = cp.pack(spark, spark.read.parquet(f"file://{where}"), "unused").collect()
    rows.sort(key=lambda r: (r.mix_file, r.mix_row, r.start))
    assert list(dict.fromkeys(r.doc_id for r in rows)) == list(range(342))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, "unused")
        assert docs.count() == 0
        docs = spark.createDataFrame([], docs.schema)
