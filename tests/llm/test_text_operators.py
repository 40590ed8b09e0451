"""Language identification, line dedup, mixing and quotation linking."""

import itertools
import math
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskloom.llm import langid, linedup, mixing, quotes
from riskloom.llm._common import Scratch

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def segmentations(text, pieces, logp, unknown):
    """Sum over all segmentations, one by one."""
    if not text:
        return np.ones(logp.shape[1])
    total = np.zeros(logp.shape[1])
    for k in range(1, min(len(text), langid.LONGEST_PIECE) + 1):
        piece = pieces.get(text[:k], -1)
        if piece < 0 and k == 1:
            piece = unknown
        if piece >= 0:
            total += np.exp(logp[piece]) * segmentations(text[k:], pieces, logp, unknown)
    return total


def test_forward_sums_all_segmentations():
    pieces = langid.vocabulary(PIECES)
    n = langid.size(pieces)
    rng = np.random.default_rng(2)
    logp = np.log(rng.dirichlet(np.ones(n + 1), 2).T)
    words = ["the", "thouand", "été", "中ab", "x"]
    got = langid.Lattice(words, pieces).totals(logp)
    want = np.log([segmentations("▁" + w, pieces, logp, n) for w in words])
    assert got == pytest.approx(want)


def test_expected_uses_add_up():
    pieces = langid.vocabulary(PIECES)
    n = langid.size(pieces)
    logp = np.full((n + 1, 1), -math.log(n))
    words, weight = ["hello", "world"], np.array([[2.0], [3.0]])
    uses = langid.Lattice(words, pieces).expected(logp, weight)
    lengths = np.zeros(n + 1)
    for p, i in pieces.items():
        if i >= 0:
            lengths[i] = len(p)
    assert (uses[:, 0] * lengths).sum() == pytest.approx(2 * 6 + 3 * 6)


def test_long_words_do_not_underflow():
    scorer = langid.Scorer(["a", "b"], *langid.fit([("a", "hello there"), ("b", "bonjour ici")], PIECES)[1:], PIECES)
    (lang, score), = scorer.predict(["hello" * 3000])
    assert lang == "a" and 0 <= score <= 1


def test_words_of_any_length(monkeypatch):
    model = langid.fit([("a", "hello there friend of mine"), ("b", "bonjour mon ami")], PIECES)
    words = ["hello", "mine", "xyz", "bonjourbonjour"]
    want = langid.Lattice(words, langid.vocabulary(PIECES)).totals(model[1])
    scorer = langid.Scorer(*model, PIECES)
    assert np.allclose([scorer.alone(w) for w in words], want)
    texts = ["hello there " * 40 + "bonjourami" * 30, "mon ami hello", "friend"]
    one = scorer.predict(texts)
    monkeypatch.setattr(langid, "LONG", 4)
    monkeypatch.setattr(langid, "TOGETHER", 3)
    two = langid.Scorer(*model, PIECES).predict(texts)
    assert [x[0] for x in one] == [x[0] for x in two] and np.allclose([x[1] for x in one], [x[1] for x in two])


def test_one_long_word_among_others_needs_little_memory():
    import tracemalloc

    model = langid.fit([("a", "hello there friend"), ("b", "bonjour mon ami")], PIECES)
    scorer = langid.Scorer(*model, PIECES)
    text = " ".join([*(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(1800)), "hello" * 20_000])
    tracemalloc.start()
    (lang, score), = scorer.predict([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert lang == "a" and peak < 100e6


def test_noise_has_a_low_score():
    rng = np.random.default_rng(3)
    words = {"en": "the cat and dog house with water over there people walking through fields every morning".split(), "de": "die katze und der hund haus mit wasser dort über leute gehen durch felder jeden morgen".split()}
    learned = [(k, " ".join(rng.choice(w, 200))) for k, w in words.items()]
    scorer = langid.Scorer(*langid.fit(learned, PIECES), PIECES)
    noise = [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(3, 9)))) for _ in range(n)) for n in (1, 3, 10, 200)]
    clean = [" ".join(rng.choice(w, n)) for w in words.values() for n in (1, 2, 5, 50, 500)]
    assert all(s > 0.9 for _, s in scorer.predict(clean))
    assert all(s < 0.5 for _, s in scorer.predict(noise[1:]))


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(langid, "MEMORY", 20)
    model = langid.fit([("a", "hello there friend"), ("b", "bonjour mon ami")], PIECES)
    one, two = langid.Scorer(*model, PIECES), langid.Scorer(*model, PIECES)
    texts = [f"hello w{chr(97 + i % 26)}{chr(97 + i // 26)} ami" for i in range(60)]
    assert [two.predict([t])[0] for t in texts] == [one.predict(texts)[i] for i in range(60)]
    assert len(two.row) < 60


def test_language_accuracy_and_odd_rows(spark):
    words = {"en": "the cat and dog house with water over there".split(), "fr": "le chat et chien maison avec eau là bas où".split(), "de": "die katze und der hund haus mit wasser dort über".split()}
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(words[lang], 12)), lang) for i, lang in enumerate(itertools.islice(itertools.cycle(words), 120))]
    odd = [(500, None, "en"), (501, "", None), (502, "12 !! 3", "fr"), (None, "the cat", "en"), (503, "le chat " * 20_000, None), (0, rows[0][1], "en")]
    df = spark.createDataFrame([*rows, *odd], "doc_id long, text string, lang string").withColumn("score", F.lit("clash")).withColumn("lang_pred", F.lit(3))
    found = langid.sample(df, id_col="doc_id", text_col="text", lang_col="lang", may_learn=F.col("doc_id") % 5 != 0, docs_per_language=10, longest=1000)
    assert max(Counter(k for k, _ in found).values()) <= 11 and not any(t == rows[0][1] for _, t in found)
    model = langid.fit(found, PIECES)
    out = langid.predict(df, model, PIECES, keep={"doc_id": F.col("doc_id"), "lang": F.col("lang")}).collect()
    assert len(out) == len(rows) + len(odd)
    assert np.mean([r.lang_pred == r.lang for r in out if r.doc_id is not None and r.doc_id < 200]) > 0.95
    assert {r.doc_id: (r.lang_pred, r.score) for r in out if r.doc_id in (500, 501, 502)} == {i: ("und", 0.0) for i in (500, 501, 502)}
    assert all(0 <= r.score <= 1 for r in out) and {r.lang_pred for r in out if r.doc_id == 503} == {"fr"}


def test_language_without_anything(spark):
    df = spark.createDataFrame([(1, "hello", None)], "doc_id long, text string, lang string")
    args = {"id_col": "doc_id", "text_col": "text", "lang_col": "lang", "may_learn": F.lit(True), "docs_per_language": 5, "longest": 99}
    model = langid.fit(langid.sample(df, **args), PIECES)
    assert [(r.lang_pred, r.score) for r in langid.predict(df, model, PIECES).collect()] == [("und", 0.0)]
    assert langid.predict(df.limit(0), model, PIECES).count() == 0


TEXT = st.text(st.sampled_from("ab .!?\n\t"), max_size=40)


@given(TEXT)
def test_units_match_their_places(text):
    h, words = linedup.units(text)
    places = linedup.split(text)
    assert len(h) == len(words) == len(places)
    assert words.tolist() == [len(text[a:b].split()) for a, b in places]
    assert linedup.delete(text, [])[0] == text
    assert linedup.delete(text, [(0, len(places))])[0] == ""


@given(st.lists(st.integers(0, 5), max_size=20), st.lists(st.integers(0, 5), max_size=20))
def test_patience_aligns_equal_units_in_order(a, b):
    pairs = linedup.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(i < k and j < m for (i, j), (k, m) in zip(pairs[:-1], pairs[1:], strict=True))
    assert linedup.patience(a, a) == [(i, i) for i in range(len(a))]


@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 4)), max_size=15), st.integers(1, 12))
def test_anchors_are_the_shortest_runs(units, least):
    h, w = np.array([u for u, _ in units], np.uint64), np.array([k for _, k in units], np.int64)
    full = [(u, k) for u, k in units if k]
    runs = set()
    for i in range(len(full)):
        for j in range(i, len(full)):
            if sum(k for _, k in full[i : j + 1]) >= least:
                runs.add(tuple(u for u, _ in full[i : j + 1]))
                break
    assert len(linedup.anchors(h, w, least)) == len(runs)
    lead = np.r_[np.uint64(77), h], np.r_[np.int64(1), w]  # the same runs elsewhere have the same hashes
    assert set(linedup.anchors(h, w, least).tolist()) <= set(linedup.anchors(*lead, least).tolist())


def sentences(rng, n, words=7):
    return [" ".join(f"w{x}" for x in rng.integers(0, 5000, words)) + "." for _ in range(n)]


def test_line_dedup(spark):
    rng = np.random.default_rng(4)
    passage = sentences(rng, 8)
    docs = {i: sentences(rng, int(rng.integers(3, 12))) for i in range(40)}
    planted = [i for i in docs if i % 3 == 0]
    for k, i in enumerate(planted):
        at = int(rng.integers(0, len(docs[i]) + 1))
        docs[i][at:at] = passage
    rows = [(i, (" " if i % 2 else "\n").join(s), "keep") for i, s in docs.items()]
    short = "Short line. All rights reserved."
    rows += [(100, rows[1][1], "copy"), (101, None, None), (102, "", "e"), (103, short, "s"), (104, short, "s"), (None, rows[1][1], "null id"), (1, rows[1][1], "again"), (105, " ".join(sentences(rng, 9000)), "long")]
    df = spark.createDataFrame(rows, "doc_id long, text string, first string").withColumn("_overlaps", F.lit("clash")).withColumn("later", F.lit(1))
    out = linedup.dedup(df, Scratch(spark, "t"))
    assert out.columns == ["doc_id", "text", "first", "later", "_removed_words", "_removed_blocks", "_overlaps"]
    got = defaultdict(list)
    for r in out.collect():
        got[r.doc_id].append(r)
    before = defaultdict(list)
    for i, t, _ in rows:
        before[i].append(t)
    for i, found in got.items():
        for r in found:
            if i in planted[1:]:
                assert r._removed_words == 56 and r._overlaps == [planted[0]] and not any(s in r.text for s in passage)
                assert sorted(r.text.replace("\n", " ").split()) == sorted(" ".join(s for s in docs[i] if s not in passage).split())
            elif i == 100:
                assert r.text == "" and r._overlaps == [1]
            else:
                assert r.text in before[i] and r._removed_words == 0 and r._overlaps == []
    assert len(got[1]) == 2 and sum(map(len, got.values())) == len(rows)


@given(st.lists(st.integers(0, 4), max_size=16), st.lists(st.integers(0, 4), max_size=16), st.integers(1, 9))
def test_blocks_hold_every_common_run(a, b, least):
    pair = [(np.array(x, np.uint64) + np.uint64(9), np.array(x, np.int64)) for x in (a, b)]  # unit k has k words
    fa, fb = [x for x in a if x], [j for j, x in enumerate(b) if x]
    stands = {tuple(fa[i:k]) for i in range(len(fa)) for k in range(i + 1, len(fa) + 1) if sum(fa[i:k]) >= least}
    want = {j for i in range(len(fb)) for k in range(i + 1, len(fb) + 1) if tuple(b[j] for j in fb[i:k]) in stands for j in fb[i:k]}
    blocks = linedup.common_blocks(*pair, least)
    assert {j for begin, end in blocks for j in range(begin, end) if b[j]} == want


def test_repeated_and_crossed_passages(spark):
    rng = np.random.default_rng(21)
    p, q = sentences(rng, 4), sentences(rng, 4)
    own = {i: sentences(rng, 3) for i in range(6)}
    rows = {0: [*own[0], *p, *q], 1: [*q, *own[1], *p], 2: [*own[2], *p, *own[3][:1], *p, *q, *p], 3: [*p, *p, *own[4], *q]}
    twice = {10: [*(r := sentences(rng, 4)), *own[5][:1], *r], 11: [*r, *own[5][1:], *r, *r], 12: [*own[3][1:], *r]}
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in (rows | twice).items()], "doc_id long, text string")
    left = {r.doc_id: r.text for r in linedup.dedup(df, Scratch(spark, "t")).collect()}
    for i, first in ((1, 0), (2, 0), (3, 0), (11, 10), (12, 10)):
        assert not any(s in left[i] for s in (*p, *q, *r)), (i, first)
    assert left[0] == " ".join(rows[0]) and left[10] == " ".join(twice[10])
    assert left[1] == " ".join(own[1]) and left[2] == " ".join([*own[2], *own[3][:1]]) and left[12] == " ".join(own[3][1:])


@pytest.mark.parametrize("segment", [2048, 5])
def test_line_dedup_equals_brute_force(spark, monkeypatch, segment):
    """Deleted are the units of every run of at least min_words words, as short as possible from where it begins, that an
    earlier document has as well, and what follows such a run alike in the first document that has it."""
    monkeypatch.setattr(linedup, "SEGMENT", segment)
    rng = np.random.default_rng(33)
    pool = [sentences(rng, int(rng.integers(2, 9)), int(rng.integers(3, 9))) for _ in range(25)]
    docs = {}
    for i in range(90):
        own = sentences(rng, int(rng.integers(1, 6)), 6)
        for k in rng.choice(25, int(rng.integers(0, 4))):
            at, begin = int(rng.integers(0, len(own) + 1)), int(rng.integers(0, 3))
            own[at:at] = pool[k][begin:] * int(rng.integers(1, 3))
        docs[int(7 * i % 90)] = own
    least = 20

    def shortest(own):
        """(run, begin, end) from each unit."""
        for i in range(len(own)):
            words = 0
            for j in range(i, len(own)):
                words += len(own[j].split())
                if words >= least:
                    yield tuple(own[i : j + 1]), i, j + 1
                    break

    held = defaultdict(list)
    for i in sorted(docs):
        for run, *_ in shortest(docs[i]):
            held[run].append(i)
    out = {r.doc_id: r for r in linedup.dedup(spark.createDataFrame([(i, " ".join(x)) for i, x in docs.items()], "doc_id long, text string"), Scratch(spark, "t"), min_words=least).collect()}
    gone = 0
    for i, own in docs.items():
        must, may, firsts = set(), set(), set()
        for run, b, e in shortest(own):
            first = min(held[run])
            if first < i:
                must |= set(range(b, e))
                firsts.add(first)
        for f in firsts:  # a run of an earlier document may go on alike
            a = docs[f]
            stands = {tuple(a[x:y]) for x in range(len(a)) for y in range(x + 1, len(a) + 1)}
            for b in range(len(own)):
                for e in range(b + 1, len(own) + 1):
                    if sum(len(u.split()) for u in own[b:e]) >= least and tuple(own[b:e]) in stands:
                        may |= set(range(b, e))
        left = out[i].text.split(". ") if out[i].text else []
        left = [u if u.endswith(".") else u + "." for u in left]
        rest = [j for j in range(len(own)) if j not in must]
        assert must <= may
        kept = iter(left)
        taken = [j for j in range(len(own)) if j not in may]
        assert len(taken) <= len(left) <= len(rest)
        assert all(any(own[j] == u for u in kept) for j in taken)
        if must == may:
            assert left == [own[j] for j in rest]
        if segment > 1000:
            assert left == [own[j] for j in taken]
        assert out[i]._overlaps == sorted(firsts)
        gone += len(must)
    assert gone > 100


def test_line_dedup_of_nothing(spark):
    assert linedup.dedup(spark.createDataFrame([], "doc_id long, text string"), Scratch(spark, "t")).count() == 0


def test_every_run_stays_somewhere(spark):
    rng = np.random.default_rng(8)
    pool = sentences(rng, 30)
    rows = [(i, "\n".join(pool[j] for j in np.sort(rng.choice(30, 12, replace=False)))) for i in range(60)]
    out = linedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t"), min_words=14).collect()
    left = {s for r in out for s in r.text.split("\n")}
    assert {s for _, t in rows for s in t.split("\n")} <= left


def source_rows():
    rng = np.random.default_rng(6)
    rows = []
    for s, n in (("big", 300), ("mid", 60), ("small", 12), (None, 5)):
        rows += [(len(rows) + k, " ".join(["w"] * int(rng.integers(1, 40))), s) for k in range(n)]
    return [*rows, (9000, None, "mid"), (9001, "", "big"), (9002, "", "empty"), (None, "a b", "mid"), (3, "twin row", "big")]


def tokens_of(rows):
    return {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in {x for *_, x in rows}}


def test_mixing_to_a_repetition_limit(spark):
    rows = source_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("tokens", F.lit("clash")).withColumn("weight", F.lit(0))
    out = mixing.mix(df, Scratch(spark, "t"), max_repetition=3.0, block_tokens=500, bucket_rows=16).collect()
    tokens = tokens_of(rows)
    used = Counter()
    for r in out:
        used[r.source] += r.n_tokens
    live = {s: t for s, t in tokens.items() if t}
    top, low = max(live.values()), min(live.values())
    alpha = max(0.0, 1 - math.log(3.0) / math.log(top / low))
    for s, t in live.items():
        want = max(t, math.floor(t**alpha * top ** (1 - alpha) + 1e-6))
        assert want <= used[s] < want + 40 and want / t <= 3.0 + 1e-6
        weight = {r.weight for r in out if r.source == s}
        assert len(weight) == 1 and weight.pop() == pytest.approx(t**alpha / sum(v**alpha for v in live.values()))
    units = {(i, s) for i, _, s in rows}
    assert {(r.doc_id, r.source) for r in out} == units  # none is dropped
    per = Counter((r.doc_id, r.source) for r in out)
    assert max(per.values()) <= 4 and per[(9001, "big")] == per[(9002, "empty")] == per[(9000, "mid")] == 1
    blocks = Counter()
    for r in out:
        blocks[r.block] += r.n_tokens
    assert all(abs(n - sum(blocks.values()) / len(blocks)) < 4 * 80 for n in blocks.values())


def test_mixing_to_an_entropy_and_budget(spark):
    rows = source_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df, Scratch(spark, "t"), max_repetition=None, target_entropy=1.2, budget=4000).collect()
    live = [t for t in tokens_of(rows).values() if t]
    alpha = out[0].exponent

    def entropy(a):
        w = np.array([t**a for t in live])
        w /= w.sum()
        return -(w * np.log(w)).sum()

    assert entropy(alpha) == pytest.approx(1.2, abs=1e-6)
    used = Counter()
    for r in out:
        used[r.source] += r.n_tokens
    for s, t in tokens_of(rows).items():
        if t:
            want = math.floor(t**alpha / sum(v**alpha for v in live) * 4000)
            assert want <= used[s] < want + 40


def test_mixing_of_many_sources(spark):
    """The exponent is found in passes over the sources; token counts may be given."""
    rng = np.random.default_rng(14)
    tokens = rng.integers(1, 5000, 700)
    sizes = spark.createDataFrame([(f"host{i}", int(t), 1) for i, t in enumerate(tokens)], "source string, tokens long, docs long")
    for entropy in (5.0, 6.4):
        a = mixing.weights(sizes, max_repetition=None, target_entropy=entropy, budget=10_000).first().exponent
        w = tokens.astype(float) ** a
        w /= w.sum()
        assert -(w * np.log(w)).sum() >= entropy - 1e-9 and a in (0.0, 1.0) or -(w * np.log(w)).sum() == pytest.approx(entropy, abs=1e-6)
    for limit, budget in ((2.0, 700 * 2500), (1e9, 10_000)):
        a = mixing.weights(sizes, max_repetition=limit, target_entropy=None, budget=budget).first().exponent
        passes = lambda x: budget * float(tokens.min()) ** (x - 1) / (tokens.astype(float) ** x).sum()  # noqa: E731, B023
        assert passes(a) <= limit * (1 + 1e-9) and (a == 0 or passes(a - 1e-6) > limit)
    docs = spark.createDataFrame([(1, "中文", "a", 50), (2, "x y", "a", None)], "doc_id long, text string, source string, n long")
    assert {r.doc_id: r.n_tokens for r in mixing.mix(docs, Scratch(spark, "t"), tokens=F.col("n")).collect()} == {1: 50, 2: 0}


def test_mixing_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string"), Scratch(spark, "t")).count() == 0
    one = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    assert [(r.doc_id, r.n_tokens) for r in mixing.mix(one, Scratch(spark, "t")).collect()] == [(1, 0)]


CHAT = [
    (1, 0, "user", "Hello there.\n\nHow do I parse mail?"),
    (1, 1, "assistant", "> How do I parse mail?\n\nUse a library that reads mail."),
    (1, 2, "user", "On Monday X wrote:\n>> How do I parse mail?\n>\n> Use a  LIBRARY that reads mail.\nWhich one?"),
    (1, 3, "user", "> Hello there.\nHi."),
    (1, 4, "assistant", "> Which one?\nAny.\n> unknown words"),
    (2, 0, "user", "> Use a library that reads mail.\nFrom elsewhere"),
    (2, 1, "user", None), (2, 2, None, ""), (2, 3, "user", "> only a quote"),
    (None, 1, "user", "Hi."), (3, None, "user", "> Hi."), (1, 0, "user", "Hello there.\n\nHow do I parse mail?"),
    (4, 0, "user", "line\n" * 3000 + "> Hi."),
]


def test_quotation_linking(spark):
    df = spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string").withColumn("hash", F.lit("clash")).withColumn("depth", F.lit("x"))
    out = quotes.build(df, Scratch(spark, "t")).collect()
    assert len(out) == len(CHAT) - 1
    got = {(r.conv_id, r.turn): r for r in out}
    reply = {k: (r.reply_conv, r.reply_turn, r.depth) for k, r in got.items()}
    assert reply[(1, 1)] == (1, 0, 1) and reply[(1, 2)] == (1, 1, 2) and reply[(1, 3)] == (1, 0, 1) and reply[(1, 4)] == (1, 2, 3)
    assert reply[(2, 0)] == (1, 1, 2) and reply[(1, 0)] == (None, None, 0)
    assert reply[(4, 0)] == (None, None, 0) and reply[(3, None)] == (None, None, 0)
    assert got[(1, 2)].text == "Which one?" and got[(1, 4)].text == "Any." and got[(2, 3)].text == "" and got[(2, 1)].text == ""
    assert got[(1, 4)].formatted == "<|assistant|>\nAny." and got[(2, 2)].formatted == "<|unknown|>\n"
    order = [(r.conv_id, r.turn) for r in out if r.thread_conv == 1 and r.thread_turn == 0]
    assert order == [(1, 0), (1, 1), (1, 3), (1, 2), (2, 0), (1, 4)]


def test_short_quotes_link_no_strangers(spark):
    rows = [(1, 0, "user", "Are you there?"), (1, 1, "user", "Yes"), (900, 0, "user", "Shall we?"), (900, 1, "user", "> yes\nGood."), (900, 2, "user", "yes"), (900, 3, "user", "> Yes\nFine.")]
    out = {(r.conv_id, r.turn): (r.reply_conv, r.reply_turn, r.thread_conv) for r in quotes.build(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), Scratch(spark, "t")).collect()}
    assert out[(900, 1)] == (None, None, 900) and out[(900, 3)] == (900, 2, 900)


def test_quotation_sql_gives_the_same(spark):
    import duckdb

    from riskloom.llm.queries import OP2_SQL

    df = spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string")
    out = quotes.build(df, Scratch(spark, "t"))
    con = duckdb.connect()
    con.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    rows = con.sql(OP2_SQL)
    cols = rows.columns
    assert sorted(repr([r[c] for c in cols]) for r in out.collect()) == sorted(repr(list(r)) for r in rows.fetchall())


def test_no_conversations(spark):
    assert quotes.build(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), Scratch(spark, "t")).count() == 0
