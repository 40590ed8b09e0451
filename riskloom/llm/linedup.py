"""Line dedup by pairwise alignment.

A text is cut into units: its lines, and in a line its sentences, so a passage that stands inside a line is found too.
Documents overlap if they share a run of units of at least ``min_words`` words. Each place where such a run can begin
gives an anchor, the hash of the shortest run of that many words from there. Every anchor names the first document that
has it (least id); each later document is paired with those first documents, so the number of pairs follows the number
of shared runs and not its square, however many documents share one.

Documents are compared by segments of ``SEGMENT`` units with words, each with some units of the next one, so that a run
lies whole in the segment where it begins: an anchor names the segment of its first document, and only the segments that
share an anchor meet, whatever the length of either document.

A pair is aligned by patience diff: units that occur once in both and in the same order fix the alignment, and between
them the same is done again; what has no such units is aligned by its common beginning and end. A maximal run of
consecutive aligned units of at least ``min_words`` words is a common block. What the alignment leaves, because a passage
is repeated or stands in another order, is matched by its runs directly: each run of at least ``min_words`` words that
stands anywhere in both is a common block as well. Common blocks are deleted from the later document, so no place of an
anchor that an earlier document has too stays, however often either holds it. The first document of a run never loses it
to a later one, so every passage stays somewhere.

Defined cases: a null text stays null and an empty one empty; units without words are neither anchors nor words of a
block, but go with the block they stand in; a passage that one document alone repeats stays; rows that repeat an id are
compared with documents of other ids only, each text by itself, equal ones with equal results; rows of a null id are kept
as they are; an empty table gives no rows; all columns of the input come back, whatever their names. Texts of any length
are taken whole, their hashes in segments.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm._common import Scratch, marked, release

#: What dedup adds; columns of these names in the input are replaced.
FOUND = ("_removed_words", "_removed_blocks", "_overlaps")
#: Units with words in a segment.
SEGMENT = 2048
SENTENCE = re.compile(r"(?<=[.!?])[ \t]+|\n")
B = 0x9E3779B97F4A7C15
B_INVERSE = pow(B, -1, 1 << 64)
C = np.uint64(0xD6E8FEB86659FD93)


def split(text: str) -> list[tuple[int, int]]:
    """(begin, end) of the units, in order; what stands between units separates them."""
    out, at = [], 0
    for m in SENTENCE.finditer(text):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, len(text)))
    return out


def units(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the units, white space normalised, and their numbers of words."""
    parts = text.replace(". ", ".\n").replace("! ", "!\n").replace("? ", "?\n").split("\n") if "\t" not in text and "  " not in text else [text[a:b] for a, b in split(text)]
    words = [p.split() for p in parts]
    h = np.fromiter((xxhash.xxh3_64_intdigest(" ".join(w).encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    return h, np.fromiter(map(len, words), np.int64, len(words))


def runs(h: np.ndarray, words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, begin, end) of the shortest run of at least min_words words from each unit; all units have words."""
    n = len(h)
    total = np.r_[0, np.cumsum(words)]
    end = np.searchsorted(total, total[:-1] + min_words)  # the run is [i, end)
    begin = np.flatnonzero(end <= n)
    if not len(begin):
        return np.zeros(0, np.uint64), begin, begin
    end = end[begin]
    with np.errstate(over="ignore"):
        power = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, B, np.uint64)]) if n > 1 else np.ones(1, np.uint64)
        back = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, B_INVERSE, np.uint64)]) if n > 1 else np.ones(1, np.uint64)
        sums = np.r_[np.uint64(0), np.cumsum(h * power)]
        run = (sums[end] - sums[begin]) * back[begin] + (end - begin).astype(np.uint64) * C
        run = (run ^ (run >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return run ^ (run >> np.uint64(29)), begin, end


def anchors(h: np.ndarray, words: np.ndarray, min_words: int, before: int | None = None) -> np.ndarray:
    """For each unit with words from which a run of at least min_words words begins, the hash of the shortest such run;
    only for the first so many units with words, if before is given."""
    full = words > 0
    run, place, _ = runs(h[full], words[full], min_words)
    return np.unique(run if before is None else run[place < before])


def shared_runs(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], min_words: int) -> list[tuple[int, int]]:
    """Spans of b that hold every unit of every run of at least min_words words that stands anywhere in a; all units have
    words."""
    own, place, _ = runs(*a, min_words)
    found, begin, end = runs(*b, min_words)
    hit = np.isin(found, own)
    found, begin, end = found[hit], begin[hit], end[hit]
    out = list(zip(begin.tolist(), end.tolist(), strict=True))
    # Every longer run consists of shortest ones and, after the last of them, of less than min_words words.
    order = np.argsort(own, kind="stable")
    own, place = own[order], place[order]
    known: dict[bytes, int] = {}
    for k in np.flatnonzero(np.r_[begin[1:] != begin[:-1] + 1, True][: len(begin)]).tolist():
        i, e = int(begin[k]), int(end[k])
        tail = b[0][e : e + min_words]
        content = found[k].tobytes() + tail.tobytes()
        if content not in known:
            at = place[np.searchsorted(own, found[k], "left") : np.searchsorted(own, found[k], "right")] + (e - i)
            more = 0
            while len(at) and more < len(tail):
                at = at[at < len(a[0])]
                at = at[a[0][at] == tail[more]] + 1
                more += bool(len(at))
            known[content] = more
        out.append((i, e + known[content]))
    return merge(out)


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places (i, j) of equal units, ascending in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        fixed = _rising(_once(a, a0, a1), _once(b, b0, b1))
        edges = [(a0 - 1, b0 - 1), *fixed, (a1, b1)]
        if not fixed:
            continue
        out += fixed
        todo += [(i + 1, i2, j + 1, j2) for (i, j), (i2, j2) in zip(edges[:-1], edges[1:], strict=True)]
    return sorted(out)


def _once(x: list[int], begin: int, end: int) -> dict[int, int]:
    """Place of each value that occurs once in the span."""
    place: dict[int, int] = {}
    for i in range(begin, end):
        place[x[i]] = i if x[i] not in place else -1
    return {v: i for v, i in place.items() if i >= 0}


def _rising(a: dict[int, int], b: dict[int, int]) -> list[tuple[int, int]]:
    """The longest run of common unique units that rises in both."""
    pairs = sorted((i, b[v]) for v, i in a.items() if v in b)
    tops: list[int] = []  # index into pairs of the smallest end of a run of each length
    ends: list[int] = []
    before: list[int] = []
    from bisect import bisect_left

    for k, (_, j) in enumerate(pairs):
        at = bisect_left(ends, j)
        before.append(tops[at - 1] if at else -1)
        if at == len(tops):
            tops.append(k)
            ends.append(j)
        else:
            tops[at], ends[at] = k, j
    out, k = [], tops[-1] if tops else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def common_blocks(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], min_words: int) -> list[tuple[int, int]]:
    """Spans of units of b that make common blocks with a. Units without words are passed over on both sides."""
    place_a, place_b = np.flatnonzero(a[1] > 0), np.flatnonzero(b[1] > 0)
    found = blocks_of_words((a[0][place_a], a[1][place_a]), (b[0][place_b], b[1][place_b]), min_words)
    return [(int(place_b[first]), int(place_b[last - 1]) + 1) for first, last in found]


def blocks_of_words(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], min_words: int) -> list[tuple[int, int]]:
    """Spans of b that make common blocks with a; all units have words."""
    pairs = patience(a[0].tolist(), b[0].tolist())
    out, at = [], 0
    words = b[1]
    while at < len(pairs):
        end = at + 1
        while end < len(pairs) and pairs[end][0] == pairs[end - 1][0] + 1 and pairs[end][1] == pairs[end - 1][1] + 1:
            end += 1
        first, last = pairs[at][1], pairs[end - 1][1]
        if int(words[first : last + 1].sum()) >= min_words:
            out.append((first, last + 1))
        at = end
    if sum(e - b for b, e in out) < len(words):
        out += shared_runs(a, b, min_words)
    return merge(out)


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [(b, e) for b, e in out]


def delete(text: str, spans: list[tuple[int, int]]) -> tuple[str, int]:
    """The text without the units of the spans and the separators after them, and the number of words deleted."""
    places = split(text)
    kept, at, gone = [], 0, 0
    for begin, end in merge(spans):
        end = min(end, len(places))
        if begin >= end:
            continue
        start = places[begin][0]
        stop = places[end][0] if end < len(places) else len(text)
        kept.append(text[at:start])
        gone += len(text[start:stop].split())
        at = stop
    kept.append(text[at:])
    out = "".join(kept)
    return (out.rstrip(" \t\n") if at == len(text) and gone else out), gone


def dedup(docs: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20) -> DataFrame:
    """The input's columns, with common blocks deleted from the text, and _removed_words, _removed_blocks, _overlaps (ids
    of the earlier documents)."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")

    beyond = 3 * min_words  # units after a segment: a run, what may follow it, and some more

    def cut(batches):
        """The segments of each text: hashes, words and places of its units with words."""
        release()
        fields = ("doc_id", "t", "part", "h", "w", "u")
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                out: list[tuple] = []
                for own, mark, text in zip(*(batch.column(c).slice(at, 512) for c in range(3)), strict=True):
                    h, w = units(text.as_py())
                    if int(w.sum()) < min_words:
                        continue
                    place = np.flatnonzero(w > 0)
                    for part, begin in enumerate(range(0, len(place), SEGMENT)):
                        u = place[begin : begin + SEGMENT + beyond]
                        out.append((own.as_py(), mark.as_py(), part, h[u].astype("<u8").tobytes(), w[u].astype("<u4").tobytes(), u.astype("<u4").tobytes()))
                if out:
                    types = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=list(fields))

    sequences = scratch.write(rows.mapInArrow(cut, "doc_id long, t long, part int, h binary, w binary, u binary"), "units")

    def of(h, w) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(h.as_py(), "<u8"), np.frombuffer(w.as_py(), "<u4").astype(np.int64)

    def begin(batches):
        """The anchors that begin in each segment."""
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                found = [anchors(*of(h, w), min_words, SEGMENT) for h, w in zip(part.column(2), part.column(3), strict=True)]
                if found:
                    rows_of = pa.array(np.repeat(np.arange(part.num_rows), [len(f) for f in found]))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(rows_of), part.column(1).take(rows_of), pa.array(np.concatenate(found).view(np.int64))], names=["doc_id", "part", "anchor"])

    places = sequences.select("doc_id", "part", "h", "w").mapInArrow(begin, "doc_id long, part int, anchor long")
    shared = places.groupBy("anchor").agg(F.min(F.struct("doc_id", "part")).alias("f"), F.max("doc_id").alias("last")).where("f.doc_id < last")
    shared = shared.select("anchor", F.col("f.doc_id").alias("first"), F.col("f.part").alias("first_part"))
    pairs = places.join(shared, "anchor").where("doc_id > first").select("first", "first_part", F.col("doc_id").alias("later"), F.col("part").alias("later_part")).distinct()
    pairs = scratch.write(pairs, "pairs")

    earlier = scratch.again(sequences).select(F.col("doc_id").alias("first"), F.col("part").alias("first_part"), F.col("h").alias("ha"), F.col("w").alias("wa"))
    later = scratch.again(sequences).select(F.col("doc_id").alias("later"), F.col("part").alias("later_part"), "t", F.col("h").alias("hb"), F.col("w").alias("wb"), F.col("u").alias("ub"))
    later = later.repartition("later", "later_part").dropDuplicates(["later", "later_part", "t"])
    both = pairs.hint("merge").join(earlier, ["first", "first_part"]).hint("merge").join(later, ["later", "later_part"]).select("later", "first", "ha", "wa", "hb", "wb", "t", "ub")

    def align(batches):
        for batch in batches:
            out: list[tuple] = []
            for i in range(batch.num_rows):
                found = blocks_of_words(of(batch.column(2)[i], batch.column(3)[i]), of(batch.column(4)[i], batch.column(5)[i]), min_words)
                if found:
                    place = np.frombuffer(batch.column(7)[i].as_py(), "<u4")
                    key = (batch.column(0)[i].as_py(), batch.column(6)[i].as_py(), batch.column(1)[i].as_py())
                    out += [(*key, int(place[b]), int(place[e - 1]) + 1) for b, e in found]
            for at in range(0, len(out), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out[at : at + 50_000], strict=True)], names=["later", "t", "first", "b", "e"])

    blocks = both.mapInArrow(align, "later long, t long, first long, b long, e long")
    spans = blocks.groupBy("later", "t").agg(F.collect_set(F.struct("b", "e")).alias("_spans"), F.sort_array(F.collect_set("first")).alias("_overlaps"))
    spans = scratch.write(spans, "spans")  # of one document at most as many as it has units, for each first document

    # The input's columns go by other names meanwhile, so that none of them clashes.
    names = {f"c{i}": c for i, c in enumerate(docs.columns)}
    by_name = {c: k for k, c in names.items()}
    own_id, own_text = by_name[id_col], by_name[text_col]
    base = docs.select(*[docs[c].alias(k) for k, c in names.items()])
    others = [k for k in names if k != own_text]
    spans = spans.withColumnRenamed("later", "_later").withColumnRenamed("t", "_t")
    # Documents that surely lose nothing stay where they are; the others meet their spans.
    flagged = marked(base, F.col(own_id), spans, "_later", "_maybe")
    touched = flagged.where("_maybe").hint("merge").join(spans, (F.col(own_id).cast("long") == F.col("_later")) & (F.xxhash64(own_text) == F.col("_t")), "left")
    joined = touched.select(*others, own_text, "_spans", "_overlaps")
    fields = {f.name: f.dataType.simpleString() for f in joined.schema.fields}

    def rewrite(batches):
        release()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n = len(others)
                texts, gone, many = [], [], []
                for text, spans_of in zip(part.column(n), part.column(n + 1), strict=True):
                    places_of = merge([(s["b"], s["e"]) for s in spans_of.as_py() or ()])
                    kept, words = delete(text.as_py(), places_of) if places_of else (text.as_py(), 0)
                    texts.append(kept)
                    gone.append(words)
                    many.append(len(places_of))
                overlaps = pa.array([x or [] for x in part.column(n + 2).to_pylist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(n)), pa.array(texts, pa.string()), pa.array(gone, pa.int64()), pa.array(many, pa.int64()), overlaps],
                    names=[*others, own_text, *FOUND],
                )

    schema = ", ".join([*(f"{k} {fields[k]}" for k in others), f"{own_text} string", "_removed_words long", "_removed_blocks long", "_overlaps array<long>"])
    changed = joined.mapInArrow(rewrite, schema)
    zero = F.lit(0).cast("long")
    same = flagged.where("NOT _maybe").select(*others, own_text, zero.alias("_removed_words"), zero.alias("_removed_blocks"), F.array().cast("array<long>").alias("_overlaps"))
    out = same.unionByName(changed)
    return out.select(*[F.col(k).alias(c) for k, c in names.items() if c not in FOUND], *FOUND)
