"""Near duplicates of texts, vectors and sounds against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskloom.llm import _common, chroma, minhash, neighbours
from riskloom.llm._common import Scratch, marked
from riskloom.llm import _components, _linking


def lcs(a, b, band):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = max(rows[i][j + 1], rows[i + 1][j], rows[i][j] + 1 if x == y and abs(i - j) <= band else 0)
    return rows[-1][-1]


@given(st.lists(st.integers(0, 6), max_size=24), st.lists(st.integers(0, 6), max_size=24))
def test_alignment(a, b):
    wide = len(a) + len(b) + 1
    assert minhash.matched(np.array(a, np.uint64), np.array(b, np.uint64), 0, wide) == lcs(a, b, wide)
    for t in (0.5, 0.8):
        longer = max(len(a), len(b))
        want = bool(a and b) and lcs(a, b, wide) >= t * longer - 1e-9
        assert minhash.similar(np.array(a, np.uint64), np.array(b, np.uint64), t) == want


def components_of(nodes, links):
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def corpus():
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(400)]
    texts = {}
    passage = " ".join(rng.choice(vocab, 60))
    for k in range(25):
        base = list(rng.choice(vocab, int(rng.integers(60, 250))))
        texts[100 * k + 7] = " ".join(base)
        for c in range(1, int(rng.integers(1, 6))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 5))):
                copy[int(rng.integers(len(copy)))] = f"x{rng.integers(1000)}"
            texts[100 * k + 7 - c] = " ".join(copy)
    for k in range(80):  # many different texts that share a passage
        texts[5000 + k] = " ".join([*rng.choice(vocab, int(rng.integers(40, 160))), passage])
    texts[9000], texts[9001], texts[9002] = "two words", "two words", "Two  WORDS"
    texts[9003], texts[9004], texts[9005], texts[9006] = None, "", " \n ", ""
    texts[9010] = " ".join(rng.choice(vocab, 30_000))
    texts[9011] = texts[9010].replace("w7 ", "y ", 40)
    return texts


def test_groups_equal_brute_force(spark):
    texts = corpus()
    rows = [(i, t, "clash") for i, t in texts.items()] + [(9000, "two words", "again"), (None, "two words", "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string, class string").withColumn("size", F.lit(1))
    out = minhash.groups(df, Scratch(spark, "t")).collect()
    seqs = {i: minhash.shingles(t, 5) for i, t in texts.items()}
    ids = sorted(texts)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if minhash.similar(seqs[a], seqs[b], 0.8)]
    want = components_of(ids, links)
    assert len(out) == len(rows)
    assert {r.doc_id: r.group_id for r in out if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.group_id) for r in out if r.doc_id is not None)
    assert [(r.group_id, r.kept) for r in out if r.doc_id is None] == [(None, True)]
    assert want[9011] == 9010 and want[9004] == 9004 and want[9006] == 9006 and want[9002] == 9000


@pytest.mark.parametrize("candidates", [None, lambda x, side, comps, places: ((i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if side is None or side[i] != side[j])])
def test_links_beside_the_centre(spark, monkeypatch, candidates):
    """One bucket a chain: whichever member is its centre, pairs without it link too, also across blocks."""
    monkeypatch.setattr(_linking, "ITEMS", 4)
    rows = [(key, 10 * key + i, 1) for key in range(6) for i in range(7)]
    buckets = spark.createDataFrame(rows, "key long, id long, size long")
    scratch = Scratch(spark, "t")
    prepare = lambda ids: scratch.write(ids.select("id", F.encode(F.col("id").cast("string"), "utf-8").alias("x")), "x")
    out = _linking.link(buckets, scratch, prepare, lambda a, b, offsets: abs(int(a) - int(b)) == 1, candidates=candidates, large=candidates is not None).collect()
    assert {r.node: r.component for r in out} == {i: i // 10 * 10 for _, i, _ in rows}


def test_overlapping_sides():
    items = [np.array(x, np.uint64) for x in ([1, 2, 3], [1, 2, 4], [1, 2, 3, 9], [7, 8], [1, 2, 3])]
    every = set(_linking.overlapping(items, 0.6))
    assert every == {(0, 1), (0, 2), (0, 4), (1, 4), (2, 4)}
    for k in range(1, 2**5 - 1):
        side = [bool(k >> i & 1) for i in range(5)]
        assert {tuple(sorted(p)) for p in _linking.overlapping(items, 0.6, side)} == {(i, j) for i, j in every if side[i] != side[j]}


def test_variants_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in rng.integers(0, 400, 120)]
    texts = {}
    for i in range(240):
        text = list(base)
        for at in rng.choice(120, 4, replace=False):
            text[at] = f"x{rng.integers(6)}"
        texts[i] = " ".join(text)
    seqs = {i: minhash.shingles(t, 5) for i, t in texts.items()}
    keys = {i: set(minhash.sketch(x, 24, 3).tolist()) for i, x in seqs.items()}
    links = [(a, b) for a in texts for b in texts if a < b and keys[a] & keys[b] and minhash.similar(seqs[a], seqs[b], 0.8)]
    out = minhash.groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), Scratch(spark, "t")).collect()
    assert {r.doc_id: r.group_id for r in out} == components_of(sorted(texts), links)


def test_no_texts(spark):
    assert minhash.groups(spark.createDataFrame([], "doc_id long, text string"), Scratch(spark, "t")).count() == 0


def test_contraction_beyond_one_task(spark, monkeypatch):
    monkeypatch.setattr(_components, "LOCAL", 3)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150), (150, 120)]
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(7)
    got = {r.node: r.component for r in _components.components(edges, Scratch(spark, "t")).collect()}
    assert got == components_of({x for p in pairs for x in p}, pairs)


def test_bit_map_has_no_false_negatives(spark):
    ids = spark.range(0, 3000, 7).select(F.col("id").alias("k"))
    flagged = {r.id for r in marked(spark.range(3000), F.col("id"), ids, "k", "hit").where("hit").collect()}
    assert flagged >= set(range(0, 3000, 7)) and len(flagged) < 600


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 16))
    for k in range(100, 220):
        x[k] = x[k % 40] + rng.normal(size=16) * rng.choice([0, 0.02, 0.1, 0.25])
    x[220:240] = x[0]
    rows = [(int(i), [float(v) for v in r], 1) for i, r in enumerate(x.astype(np.float32))]
    odd = [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] + [1.0] * 15, 0), (1003, [None] + [1.0] * 15, 0), (1004, [float("inf")] + [1.0] * 15, 0), (1005, [1.0], 0), (None, rows[0][1], 0), rows[3]]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>, size int")
    out = neighbours.link(df, Scratch(spark, "t")).collect()
    v = np.array([r[1] for r in rows])
    v /= np.linalg.norm(v, axis=1)[:, None]
    near = v @ v.T >= 0.95
    np.fill_diagonal(near, False)
    comp = components_of(range(300), zip(*np.nonzero(near), strict=True))
    assert len(out) == len(rows) + len(odd)
    for r in out:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, True)
        elif r.vec_id >= 1000:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
        else:
            assert (r.n_links, r.component_id, r.kept) == (near[r.vec_id].sum(), comp[r.vec_id], comp[r.vec_id] == r.vec_id)


def test_tiny_and_huge_vectors(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 8))
    x[30:] = x[:30] + rng.normal(size=(30, 8)) * 0.01
    scale = np.ones(60)
    scale[[3, 33, 7]] = 1e-200, 1e-310, 1e200
    df = spark.createDataFrame([(i, [float(c) for c in v * s]) for i, (v, s) in enumerate(zip(x, scale, strict=True))], "vec_id long, embedding array<double>")
    out = {r.vec_id: r for r in neighbours.link(df, Scratch(spark, "t")).collect()}
    v = x / np.linalg.norm(x, axis=1)[:, None]
    near = v @ v.T >= 0.95
    np.fill_diagonal(near, False)
    assert [out[i].n_links for i in range(60)] == near.sum(axis=1).tolist() and near.sum() >= 60


def test_shards_of_lists(monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD", 10)
    first, many = neighbours._shards({0: 4, 1: 5, 3: 25, 4: 2, 5: 9}, 6)
    assert first.tolist() == [0, 0, 0, 1, 4, 5] and many.tolist() == [1, 1, 0, 3, 1, 1]


def test_no_vectors(spark):
    assert neighbours.link(spark.createDataFrame([], "vec_id long, embedding array<float>"), Scratch(spark, "t")).count() == 0


def melody(rng, notes):
    t = np.arange(256) / chroma.RATE
    return np.concatenate([0.5 * np.sin(2 * np.pi * 110 * 2 ** (s / 12) * t) for s in rng.integers(0, 30, notes)])


def test_sounds(spark):
    rng = np.random.default_rng(9)
    pcm = lambda s: (np.clip(s, -1, 1) * 32000).astype("<i2").tobytes()
    tunes = [melody(rng, 60) for _ in range(6)]
    rows = [(i, pcm(s)) for i, s in enumerate(tunes)]
    rows += [(10, pcm(tunes[0] + rng.normal(size=len(tunes[0])) * 0.02)), (11, pcm(np.concatenate([melody(rng, 8), tunes[1]]))), (12, pcm(0.5 * tunes[2][256 * 10 :]))]
    rows += [(20, None), (21, b""), (22, b"\x00" * 40_000), (23, b"x"), (None, pcm(tunes[0])), (3, pcm(tunes[3]))]
    df = spark.createDataFrame(rows, "rec_id long, audio binary").withColumn("prints", F.lit("clash"))
    out = chroma.groups(chroma.fingerprints(df, id_col="rec_id", media_col="audio"), Scratch(spark, "t")).collect()
    group = {r.rec_id: r.group_id for r in out}
    assert len(out) == len(rows)
    assert (group[10], group[11], group[12]) == (0, 1, 2)
    assert all(group[i] == i for i in (*range(6), 20, 21, 22, 23)) and group[None] is None
    offsets = {r.rec_id: r.frame_offset for r in out}
    assert offsets[10] == 0 and offsets[12] == pytest.approx(20, abs=1) and offsets[11] == pytest.approx(-16, abs=1)
    assert all(r.bit_error is None or r.bit_error < 0.25 for r in out)


def test_integral_image():
    image = np.random.default_rng(1).random((40, 12))
    prints = chroma.fingerprint(image)
    assert len(prints) == 25 and len(set(prints.tolist())) > 10
    assert (chroma.fingerprint(image[3:]) == prints[3:]).all()
    assert len(chroma.fingerprint(image[:10])) == 0


def test_melodies_handle_odd_vectors():
    column = pa.array([[1.0, 2.0], None, [0.0, 0.0], [None, 1.0], [float("nan")], []], pa.list_(pa.float64()))
    assert [m is None for m in chroma.melodies(column)] == [False, True, True, True, True, True]


def test_no_sounds(spark):
    df = spark.createDataFrame([], "rec_id long, audio binary")
    assert chroma.groups(chroma.fingerprints(df, id_col="rec_id", media_col="audio"), Scratch(spark, "t")).count() == 0


def test_votes_in_parts(monkeypatch):
    rng = np.random.default_rng(4)
    a = rng.integers(0, 6, 300).astype(np.uint32)
    b = np.r_[rng.integers(0, 6, 40).astype(np.uint32), a[100:260]]
    whole = chroma.align(a, b)
    monkeypatch.setattr(chroma, "VOTES", 7)
    assert chroma.align(a, b) == whole and whole[0] == 60


def test_recall_of_sounds(spark):
    """Against all pairs at all offsets of a whole table: no pair is grouped without links, at least 0.9 of them are found."""
    rng = np.random.default_rng(21)
    bases = rng.normal(size=(90, 64))
    vectors = [b + rng.normal(size=64) * level for b in bases for level in (0, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3)]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    prints = chroma.fingerprints(table, id_col="vec_id", media_col="embedding", decode=chroma.melodies)
    out = {r.rec_id: r.group_id for r in chroma.groups(prints, Scratch(spark, "t")).collect()}
    heard = [(i, chroma.packed(s, chroma.RATE)) for (i, _), s in zip(rows, chroma.melodies(pa.array([v for _, v in rows], pa.list_(pa.float64()))), strict=True)]
    x = np.stack([np.frombuffer(p, "<u4") for _, p in heard])
    ids, n = [i for i, _ in heard], x.shape[1]
    links = []
    for i in range(len(x) - 1):
        best = np.ones(len(x) - i - 1)
        for o in range(-(n // 2), n // 2 + 1):
            a0, a1 = max(0, o), min(n, n + o)
            if 2 * (a1 - a0) >= n:
                best = np.minimum(best, np.bitwise_count(x[i, a0:a1] ^ x[i + 1 :, a0 - o : a1 - o]).sum(axis=1) / (32 * (a1 - a0)))
        links += [(ids[i], ids[i + 1 + j]) for j in np.flatnonzero(best <= 0.25).tolist()]
    comp = components_of(ids, links)
    assert len(out) == len(rows) and len(links) > 200
    assert all(comp[i] == comp[out[i]] for i in ids)
    found = sum(out[a] == out[b] for a, b in links)
    print(f"recall {found / len(links):.4f} of {len(links)} links, {sum(a != b for a, b in out.items())} grouped")
    assert found >= 0.9 * len(links)


def test_silence_keeps_its_place():
    rng = np.random.default_rng(2)
    tune, pause = melody(rng, 40), np.zeros(2048)
    whole = np.concatenate([tune, pause, melody(rng, 40)])
    a, b = (np.frombuffer(chroma.packed(s, chroma.RATE), "<u4") for s in (whole, whole[len(tune) :]))
    assert chroma.align(a, b, 0.3)[0] == pytest.approx(len(tune) / 128, abs=1)
    assert chroma.packed(pause, chroma.RATE) == b"" and chroma.packed(None, chroma.RATE) == b""
    fast = np.interp(np.arange(0, len(whole), 2048 / 16_000), np.arange(len(whole)), whole)
    _, error, _ = chroma.align(a, np.frombuffer(chroma.packed(fast, 16_000), "<u4"), 0.5)
    assert error < 0.2


def test_nearby_equals_pairwise():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**32, 40, dtype=np.uint32)
    prints, places = [], []
    for _ in range(30):
        a, b = sorted(rng.choice(41, 2, replace=False))
        p = base[a:b].copy()
        p[rng.random(len(p)) < 0.3] = rng.integers(0, 2**32)
        p[rng.random(len(p)) < 0.1] = chroma.SILENT
        prints.append(p)
        places.append(int(rng.integers(0, len(p))))
    comps = list(rng.integers(0, 20, 30))

    def want(i, j):
        bits, frames = chroma.differing(prints[i], prints[j], places[i] - places[j])
        return comps[i] != comps[j] and frames > 0 and frames >= 0.5 * min(len(prints[i]), len(prints[j])) and bits <= 0.25 * 32 * frames

    for area in (4_000_000, 300):
        chroma.AREA = area
        assert set(chroma.nearby(prints, places, None, comps, 0.25, 0.5)) == {(i, j) for i in range(30) for j in range(i + 1, 30) if want(i, j)}
        side = [i % 3 == 0 for i in range(30)]
        assert {tuple(sorted(p)) for p in chroma.nearby(prints, places, side, comps, 0.25, 0.5)} == {(i, j) for i in range(30) for j in range(i + 1, 30) if side[i] != side[j] and want(i, j)}
    chroma.AREA = 4_000_000


def test_words_remembered_by_a_worker_are_few():
    for a in range(0, 80_000, 8_000):
        minhash.shingles(" ".join(f"w{i}" for i in range(a, a + 8_000)), 5)
    assert len(_common.sole("words", minhash.WordHashes)) <= 50_001
