"""Language identification by segmentation-marginalised unigrams.

For each language a probability for every piece of a fixed public vocabulary is learned by expectation maximisation; the
likelihood of a word is the sum over all its segmentations into pieces, by the forward algorithm, and the likelihood of
a text is the product over its words. The text's language is the one of largest likelihood; the score is its posterior
under equal priors, against the other languages and against noise: letters drawn evenly from the learned alphabet, with a
sign of that chance for a word's end. So letters without a language have a low score, however many they are. A word is a run of letters, in lower case, with the vocabulary's mark of a word's beginning before
it. A character that is no piece counts as a piece of its own with a small fixed probability.

The model is fitted on a bounded sample: at most ``docs_per_language`` documents of each language, those of smallest
hash among the rows that may be learned from, with texts of at most ``longest`` characters; whole texts of them. Every
row is predicted from its whole text and from nothing else.

Defined cases: a null text or one without letters is ``und`` with score 0; ties go to the first language in
alphabetical order; repeated rows are predicted alike; without any row to learn from, everything is ``und``; other
columns are ignored; the words of a text of any length go through the same sums a bounded number at a time, and a word of
more than ``LONG`` letters goes by itself, letter by letter, with a memory of the longest piece.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm._common import bound_batches, sole

WORD = re.compile(r"[^\W\d_]+")
#: Longest piece looked for, log-probability of a character outside the vocabulary, rounds of fitting.
LONGEST_PIECE, UNKNOWN, ROUNDS = 16, -18.0, 4
#: Words remembered by a worker; letters above which a word is neither remembered nor put into a lattice with others.
MEMORY, LONG = 300_000, 100
#: Cells of a lattice (words by letters), and words of a text, that are summed at a time.
CELLS, TOGETHER = 40_000, 200_000
UNDETERMINED = "und"
SCHEMA = "doc_id long, lang_pred string, score double"

_pieces: dict[str, dict[str, int]] = {}
#: In a vocabulary's table, what only begins a piece.
PREFIX = -1


def vocabulary(path: str) -> dict[str, int]:
    """Pieces of a public sentencepiece vocabulary by number, and their beginnings as PREFIX; a leading mark stands for a
    word's beginning."""
    if path not in _pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
        pieces = [p for p in dict.fromkeys(found) if p == p.lower() and len(p) <= LONGEST_PIECE]
        table = {p[:k]: PREFIX for p in pieces for k in range(1, len(p))}
        table.update((p, i) for i, p in enumerate(pieces))
        _pieces[path] = table
    return _pieces[path]


def size(pieces: dict[str, int]) -> int:
    return 1 + max(pieces.values(), default=-1)


class Lattice:
    """Every segmentation of some words: edges (word, begin, end, piece), sorted by end and word."""

    def __init__(self, words: list[str], pieces: dict[str, int]):
        unknown = size(pieces)
        edges: list[int] = []
        get = pieces.get
        for w, word in enumerate(words):
            text = "▁" + word
            n = len(text)
            for i in range(n):
                piece = get(text[i])
                edges += (i + 1, w, i, unknown if piece is None or piece < 0 else piece)
                if piece is None:
                    continue
                for j in range(i + 2, n + 1):
                    piece = get(text[i:j])
                    if piece is None:
                        break
                    if piece >= 0:
                        edges += (j, w, i, piece)
        self.lengths = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        table = np.asarray(edges, np.int64).reshape(-1, 4)
        # Words are in order already, so a stable sort by end suffices.
        self.end, self.word, self.begin, self.piece = np.ascontiguousarray(table[np.argsort(table[:, 0], kind="stable")].T)
        self.n, self.longest = len(words), int(self.lengths.max(initial=0))

    def forward(self, logp: np.ndarray) -> np.ndarray:
        """logp: pieces × languages. Log-likelihoods of prefixes: (longest + 1) × words × languages."""
        alpha = np.full((self.longest + 1, self.n, logp.shape[1]), -np.inf)
        alpha[0] = 0
        bounds = np.searchsorted(self.end, np.arange(1, self.longest + 2))
        for j in range(1, self.longest + 1):
            part = slice(bounds[j - 1], bounds[j])
            words = self.word[part]
            if len(words):
                first = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
                terms = alpha[self.begin[part], words] + logp[self.piece[part]]
                alpha[j, words[first]] = np.logaddexp.reduceat(terms, first, axis=0)
        return alpha

    def totals(self, logp: np.ndarray) -> np.ndarray:
        """Log-likelihoods of the words: words × languages."""
        return self.forward(logp)[self.lengths, np.arange(self.n)]

    def expected(self, logp: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected uses of the pieces, a word counting weight times: pieces × languages."""
        alpha = self.forward(logp)
        total = alpha[self.lengths, np.arange(self.n)]
        beta = np.full_like(alpha, -np.inf)
        beta[self.lengths, np.arange(self.n)] = 0
        order = np.lexsort((self.word, self.begin))
        begin, word, end, piece = self.begin[order], self.word[order], self.end[order], self.piece[order]
        bounds = np.searchsorted(begin, np.arange(self.longest + 1))
        for i in range(self.longest - 1, -1, -1):
            part = slice(bounds[i], bounds[i + 1])
            words = word[part]
            if len(words):
                first = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
                terms = beta[end[part], words] + logp[piece[part]]
                beta[i, words[first]] = np.logaddexp(beta[i, words[first]], np.logaddexp.reduceat(terms, first, axis=0))
        uses = np.exp(alpha[begin, word] + logp[piece] + beta[end, word] - total[word]) * weight[word]
        return np.stack([np.bincount(piece, uses[:, k], minlength=len(logp)) for k in range(logp.shape[1])], axis=1)


def fit(texts: list[tuple[str, str]], tokenizer_path: str) -> tuple[list[str], np.ndarray, int]:
    """Languages, log-probabilities of the pieces and of an unknown character (pieces + 1 × languages), and the number of
    different letters."""
    counts: dict[str, Counter] = defaultdict(Counter)
    for lang, text in texts:
        counts[lang].update(WORD.findall(text.lower()))
    langs, pieces = sorted(counts), vocabulary(tokenizer_path)
    words = sorted(set().union(*counts.values())) if counts else []
    n_pieces = size(pieces)
    if not words:
        return langs, np.zeros((n_pieces + 1, len(langs))), 0
    letters = len(set().union(*words))
    words = [w for w in words if len(w) <= LONG]
    if not words:
        return langs, np.zeros((n_pieces + 1, len(langs))), letters
    weight = np.asarray([[counts[k][w] for k in langs] for w in words], float).reshape(len(words), len(langs))
    logp = np.full((n_pieces + 1, len(langs)), -np.log(max(1, n_pieces)))
    logp[n_pieces] = UNKNOWN
    parts = [(Lattice(words[a : a + 20_000], pieces), weight[a : a + 20_000]) for a in range(0, len(words), 20_000)]
    for _ in range(ROUNDS):
        uses = sum(lattice.expected(logp, own) for lattice, own in parts)[:n_pieces] + 0.05
        logp = np.vstack([np.log(uses / uses.sum(axis=0)), np.full((1, len(langs)), UNKNOWN)])
    return langs, logp, letters


class Scorer:
    """Scores texts; remembers the likelihoods of a bounded number of words."""

    def __init__(self, langs: list[str], logp: np.ndarray, letters: int, tokenizer_path: str):
        """letters: of the alphabet that noise is drawn from; 0 for no noise."""
        self.langs, self.logp, self.pieces = langs, logp, vocabulary(tokenizer_path)
        self.noise = -np.log(letters + 1) if letters else -np.inf
        self.forget()

    def forget(self) -> None:
        """Starts a new generation; the last one still serves what is asked for again."""
        self.older = (getattr(self, "row", {}), getattr(self, "value", None))
        self.row: dict[str, int] = {}
        self.value = np.empty((4096, len(self.langs) + 1))  # by language, and the letters with the word's end

    def _add(self, words: list[str], values: np.ndarray) -> None:
        at = len(self.row)
        while at + len(words) > len(self.value):
            self.value = np.vstack([self.value, np.empty_like(self.value)])
        self.value[at : at + len(words)] = values
        self.row.update(zip(words, range(at, at + len(words)), strict=True))

    def learn(self, words: set[str]) -> None:
        row, value = self.older
        if again := [w for w in words if w in row]:
            self._add(again, value[[row[w] for w in again]])
            words = words.difference(again)
        ordered = sorted(words, key=len)
        while ordered:  # of like length, so that the arrays stay small
            end = 1
            while end < min(2000, len(ordered)) and (end + 1) * (len(ordered[end]) + 2) <= CELLS:
                end += 1
            own, ordered = ordered[:end], ordered[end:]
            self._add(own, np.column_stack([Lattice(own, self.pieces).totals(self.logp), [len(w) + 1 for w in own]]))

    def total(self, words: list[str]) -> np.ndarray:
        """Of remembered words together: log-likelihoods by language, and letters with the words' ends."""
        return self.value[np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))].sum(axis=0)

    def alone(self, word: str) -> np.ndarray:
        """Log-likelihoods of one word of any length: the forward sums of its last letters only."""
        text, unknown, get = "▁" + word, size(self.pieces), self.pieces.get
        alpha = np.full((LONGEST_PIECE + 1, len(self.langs)), -np.inf)  # a ring, by the place modulo its size
        alpha[0] = 0
        for i in range(len(text)):
            here = alpha[i % len(alpha)].copy()
            alpha[i % len(alpha)] = -np.inf  # the place is used again for a later one
            for j in range(i + 1, min(len(text), i + LONGEST_PIECE) + 1):
                piece = get(text[i:j])
                if j == i + 1 and (piece is None or piece < 0):
                    self._reach(alpha, j, here + self.logp[unknown])
                elif piece is not None and piece >= 0:
                    self._reach(alpha, j, here + self.logp[piece])
                if piece is None:
                    break
        return alpha[len(text) % len(alpha)]

    @staticmethod
    def _reach(alpha: np.ndarray, place: int, value: np.ndarray) -> None:
        at = place % len(alpha)
        alpha[at] = np.logaddexp(alpha[at], value)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out, held = [], []
        for i, text in enumerate(texts):
            held.append(text)
            if sum(map(len, filter(None, held))) > 8 * TOGETHER or i + 1 == len(texts):
                out += self._predict(held)
                held = []
        return out

    def _predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if len(self.row) > MEMORY:
            self.forget()
        sums = np.zeros((len(texts), len(self.langs) + 1))
        any_word = [False] * len(texts)
        for words in self._parts(texts):
            long = [(i, w) for i, own in words for w in own if len(w) > LONG]
            if long:
                words = [(i, [w for w in own if len(w) <= LONG]) for i, own in words]
            new = set().union(*(own for _, own in words)).difference(self.row)
            if new and self.langs:
                self.learn(new)
            for i, own in words:
                if own:
                    any_word[i] = True
                    if self.langs:
                        sums[i] += self.total(own)
            for i, word in long:
                any_word[i] = True
                if self.langs:
                    sums[i] += np.r_[self.alone(word), len(word) + 1]
        out = []
        for row, heard in zip(sums, any_word, strict=True):
            if not heard or not self.langs:
                out.append((UNDETERMINED, 0.0))
                continue
            total, best = row[:-1], int(row[:-1].argmax())
            noise = np.exp(min(700.0, row[-1] * self.noise - total[best]))
            out.append((self.langs[best], float(1 / (np.exp(total - total[best]).sum() + noise))))
        return out

    def _parts(self, texts: list[str | None]):
        """Lists of (text's number, words): all words of the texts, a bounded number at a time."""
        short = [(i, WORD.findall(t.lower())) for i, t in enumerate(texts) if t and len(t) <= 8 * TOGETHER]
        if short:
            yield short
        for i, t in enumerate(texts):
            if t and len(t) > 8 * TOGETHER:
                found = (m[0] for m in WORD.finditer(t.lower()))
                while own := list(islice(found, TOGETHER)):
                    yield [(i, own)]


def sample(docs: DataFrame, *, id_col: str, text_col: str, lang_col: str, may_learn, docs_per_language: int, longest: int) -> list[tuple[str, str]]:
    """(language, text) of the bounded sample; the texts come to the driver."""
    rows = docs.where(may_learn & F.col(lang_col).isNotNull() & (F.length(text_col) <= longest) & F.col(id_col).isNotNull())
    rank = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = rows.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("doc_id")).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= docs_per_language)
    wanted = [r.doc_id for r in ids.select("doc_id").distinct().collect()]  # at most docs_per_language for each language
    if not wanted:
        return []
    # An id that many rows repeat gives one text for each of its languages.
    named = rows.where(F.col(id_col).isin(wanted)).select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    found = named.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect()
    return sorted((r.lang, r.text) for r in found)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, int], tokenizer_path: str, *, text_col: str = "text", keep: dict | None = None, together: int = 256) -> DataFrame:
    """lang_pred and score for every row, beside the columns of keep (name: Column)."""
    bound_batches(docs.sparkSession)
    langs, logp, letters = model
    held = docs.sparkSession.sparkContext.broadcast((langs, logp.astype(np.float32)))  # vocabulary × languages: bounded
    key = (uuid.uuid4().hex, tokenizer_path)

    def scored(batches):
        scorer = sole(key, lambda: Scorer(held.value[0], held.value[1].astype(float), letters, tokenizer_path))
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for a in range(0, batch.num_rows, together):
                found = scorer.predict(texts.slice(a, together).to_pylist())
                own = [batch.column(i).slice(a, together) for i in range(batch.num_columns - 1)]
                pred, score = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([*own, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    rows = docs.select(*[c.alias(n) for n, c in (keep or {}).items()], F.col(text_col).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(scored, f"{schema}{', ' if schema else ''}lang_pred string, score double")
