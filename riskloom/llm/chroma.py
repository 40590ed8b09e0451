"""Chroma audio fingerprints of a media column.

Samples are cut into overlapping windows; the energy of each window's spectrum is folded into the 12 pitch classes, and
the frames are smoothed and scaled to length 1. Over the resulting image (frames × pitch classes) an integral image
gives the sum of any rectangle from four of its values. Sixteen filters compare two halves (or the middle and the rest)
of a rectangle of 16 frames' width, each result is cut at three levels into 2 bits in Gray code, and the 32 bits of a
frame make one integer. A recording's fingerprint is the sequence of these integers.

Matching. A key is the upper half of four integers ``APART`` frames from one another, the half of the filters that look
at short spans; of every ``WINNOW`` keys in a row the one of least hash is kept, wherever the same stretch begins, so a
shared stretch gives shared keys. Recordings that share a key are candidates, and each shared key votes for the offset
between its two places. The offsets of this histogram are checked, those of most votes first, by the share of bits that
differ over the overlap. A pair links if that bit error is at most ``max_error`` over an overlap of at least
``min_overlap`` of the shorter one's frames. Candidates go through ``_linking``: equal fingerprints are one class first,
and no bucket gives all its pairs. Against brute force over 3000 of the test tables' melodies 0.90 of the links stand in
one group, of those of a bit error up to 0.2 0.999; errors from 0.23 on also occur between unrelated melodies.

No table of this collection has audio, so the query renders each embedding as a melody, one note for each component, the
pitch by its quantised value; near-equal vectors give near-equal melodies. Rendering stands in for a decoder: the
operator takes any function from a batch's media column to samples, and reads 16-bit mono PCM by default.

Defined cases: a null, undecodable, silent or too short recording has an empty fingerprint and links with nothing;
silence within a recording keeps its place, but its integers are no keys and count nowhere that both sides are silent;
recordings of any length are read whole, a long one in slices of frames; rows that repeat an id with one sound are one
recording; a null id is its own group without links; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm._common import Scratch, fingerprint128
from riskloom.llm._linking import link

RATE = 2048
#: Seconds of a window, and from one window to the next, at any sampling rate.
WINDOW, HOP = 1 / 4, 1 / 16
LOWEST, HIGHEST = 100.0, 1000.0
CLASSES, WIDTH, FILTERS = 12, 16, 16
#: Frames between the integers of a key, how many they are, the bits of each that count, and keys of which one is kept.
APART, INTEGERS, BITS, WINNOW = 4, 4, 0xFFFF0000, 2
#: Frames of silence have less energy than this share of full scale.
SILENCE = 1e-6
#: Levels at which a filter's result is cut.
LEVELS = (-0.04, 0.0, 0.04)
#: Integers laid out at a time.
AREA = 4_000_000
#: Votes of shared integers cast at a time.
VOTES = 1_000_000
GRAY = np.array([0, 1, 3, 2], np.uint32)


def folding(rate: int, window: int) -> np.ndarray:
    """Spectrum bins × pitch classes: where each bin's energy goes."""
    hz = np.fft.rfftfreq(window, 1 / rate)
    out = np.zeros((len(hz), CLASSES))
    inside = np.flatnonzero((hz >= LOWEST) & (hz <= HIGHEST))
    out[inside, np.round(CLASSES * np.log2(hz[inside] / 440.0)).astype(int) % CLASSES] = 1
    return out


def chroma(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Frames × pitch classes, each frame of length 1, or 0 where it is silent."""
    window, hop = round(WINDOW * rate), round(HOP * rate)
    n = 1 + (len(samples) - window) // hop
    if n < 1:
        return np.zeros((0, CLASSES))
    taper, fold = np.hanning(window), folding(rate, window)
    frames = np.lib.stride_tricks.sliding_window_view(samples, window)[::hop]
    parts, step = [], max(1, (1 << 21) // window)
    for a in range(0, n, step):  # so that long recordings need no large matrix
        spectrum = np.fft.rfft(frames[a : a + step] * taper, axis=1)
        parts.append((spectrum.real**2 + spectrum.imag**2) @ fold)
    image = np.concatenate(parts) / window**2
    image[image.sum(axis=1) <= SILENCE] = 0
    if len(image) >= 3:  # a short smoothing over time
        image = (np.vstack([image[:1], image[:-1]]) + 2 * image + np.vstack([image[1:], image[-1:]])) / 4
    length = np.sqrt((image**2).sum(axis=1, keepdims=True))
    return image / np.where(length > 0, length, 1)


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first class, height, width) of the sixteen filters: kinds and sizes in turn, so that they cover the image."""
    return [(i % 4, (5 * i) % CLASSES, (3, 4, 6)[i % 3], (4, 8, 12, 16)[(i // 4) % 4]) for i in range(FILTERS)]


def fingerprint(image: np.ndarray) -> np.ndarray:
    """One 32-bit integer for each place of a rectangle of WIDTH frames."""
    n = len(image) - WIDTH + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    # Pitch classes form a circle: the image is repeated, so that rectangles may wrap around.
    wide = np.concatenate([image, image], axis=1)
    total = np.zeros((len(wide) + 1, wide.shape[1] + 1))
    total[1:, 1:] = wide.cumsum(axis=0).cumsum(axis=1)
    place = np.arange(n)

    def area(t0: int, t1: int, c0: int, c1: int) -> np.ndarray:
        a, b = place + t0, place + t1
        return (total[b, c1] - total[a, c1] - total[b, c0] + total[a, c0]) / max(1, (t1 - t0) * (c1 - c0))

    out = np.zeros(n, np.uint32)
    for kind, c, height, width in filters():
        half_t, half_c, third = width // 2, max(1, height // 2), max(1, width // 4)
        if kind == 0:  # later against earlier
            value = area(half_t, width, c, c + height) - area(0, half_t, c, c + height)
        elif kind == 1:  # higher against lower classes
            value = area(0, width, c + half_c, c + height) - area(0, width, c, c + half_c)
        elif kind == 2:  # a chequer of four
            value = area(0, half_t, c, c + half_c) + area(half_t, width, c + half_c, c + height) - area(0, half_t, c + half_c, c + height) - area(half_t, width, c, c + half_c)
        else:  # the middle in time against its sides
            value = area(third, width - third, c, c + height) - (area(0, third, c, c + height) + area(width - third, width, c, c + height)) / 2
        out = (out << np.uint32(2)) | GRAY[np.searchsorted(LEVELS, value, side="right")]
    return out


#: The integer of frames without sound.
SILENT = int(fingerprint(np.zeros((WIDTH, CLASSES)))[0])


def packed(samples: np.ndarray | None, rate: int) -> bytes:
    """A recording's integers, little-endian; none if it has no sound."""
    prints = fingerprint(chroma(samples, rate)) if samples is not None and len(samples) else np.zeros(0, np.uint32)
    return prints.astype("<u4").tobytes() if (prints != SILENT).any() else b""


def pcm(column: pa.Array) -> list[np.ndarray | None]:
    """Samples of 16-bit little-endian mono PCM."""
    return [None if not x.is_valid else np.frombuffer(x.as_py()[: len(x.as_py()) // 2 * 2], "<i2") / 32768.0 for x in column]


def melodies(column: pa.Array) -> list[np.ndarray | None]:
    """A note of 1/8 s for each component of a vector: one of seven steps of a fourth by its value against the root mean
    square, so that a small change of the vector leaves most notes as they are."""
    steps = 7
    t = np.arange(RATE // 8) / RATE
    envelope = np.hanning(len(t) + 2)[1:-1] ** 0.25
    notes = np.stack([0.5 * envelope * np.sin(2 * np.pi * 110.0 * 2 ** (5 * s / 12) * t) + 0.25 * envelope * np.sin(4 * np.pi * 110.0 * 2 ** (5 * s / 12) * t) for s in range(steps)])
    out: list[np.ndarray | None] = []
    for x in column:
        v = np.asarray([np.nan if c is None else c for c in x.as_py()], float) if x.is_valid else np.zeros(0)
        top = np.abs(v).max(initial=0)
        if not len(v) or not np.isfinite(v).all() or top == 0:
            out.append(None)
            continue
        step = np.clip(np.floor(1.2 * v / np.sqrt((v / top) @ (v / top) / len(v)) / top + steps / 2), 0, steps - 1).astype(int)
        out.append(notes[step].ravel())
    return out


def fingerprints(media: DataFrame, *, id_col: str, media_col: str, decode: Callable = pcm, rate: int = RATE) -> DataFrame:
    """(rec_id, prints): the packed integers of every recording as little-endian unsigned 32-bit integers."""

    def heard(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                prints = [packed(s, rate) for s in decode(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints, pa.binary())], names=["rec_id", "prints"])

    rows = media.select(F.col(id_col).cast("long").alias("rec_id"), F.col(media_col).alias("media"))
    return rows.mapInArrow(heard, "rec_id long, prints binary")


def differing(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, int]:
    """Differing bits and frames of the overlap if b begins at that frame of a; frames silent in both are no overlap."""
    begin, stop = max(0, offset), min(len(a), offset + len(b))
    if begin >= stop:
        return 0, 0
    x, y = a[begin:stop], b[begin - offset : stop - offset]
    return int(np.bitwise_count(x ^ y).sum()), stop - begin - int(((x == SILENT) & (y == SILENT)).sum())


def histogram(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Votes of equal integers for each offset; index: offset + len(b) - 1."""
    votes = np.zeros(len(a) + len(b) - 1, np.int64)
    place_a, place_b = np.flatnonzero(a != SILENT), np.flatnonzero(b != SILENT)
    order = place_b[np.argsort(b[place_b], kind="stable")]
    ordered = b[order]
    low, high = np.searchsorted(ordered, a[place_a], "left"), np.searchsorted(ordered, a[place_a], "right")
    many = high - low
    before = np.r_[0, np.cumsum(many)]
    at = 0
    while at < len(place_a):  # a sound that stays the same shares every integer with every place: a bounded number at a time
        end = max(at + 1, int(np.searchsorted(before, before[at] + VOTES, "right")) - 1)
        n = many[at:end]
        if n.sum():
            place = np.repeat(place_a[at:end], n)
            other = order[np.arange(n.sum()) + np.repeat(low[at:end] - (before[at:end] - before[at]), n)]
            votes += np.bincount(place - other + len(b) - 1, minlength=len(votes))
        at = end
    return votes


def align(a: np.ndarray, b: np.ndarray, min_overlap: float = 0.0) -> tuple[int, float, int]:
    """Offset of b in a, share of differing bits and frames of overlap, of the best of the offsets that have at least half
    the most votes (three of them at least) and enough overlap."""
    if not len(a) or not len(b):
        return 0, 1.0, 0
    votes = histogram(a, b)
    offset = np.arange(len(votes)) - len(b) + 1
    overlap = np.minimum(len(a), offset + len(b)) - np.maximum(0, offset)
    votes[overlap < min_overlap * min(len(a), len(b))] = 0
    best = (0, 1.0, 0)
    ranked = np.argsort(-votes, kind="stable")
    for k, top in enumerate(ranked):
        if not votes[top] or (k >= 3 and 2 * votes[top] < votes[ranked[0]]):
            break
        bits, frames = differing(a, b, int(offset[top]))
        if frames and (bits / (32 * frames), -frames) < (best[1], -best[2]):
            best = (int(offset[top]), bits / (32 * frames), frames)
    return best


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, place) of the kept keys; a short fingerprint has its last integer as a key at its end."""
    x = (prints & np.uint32(BITS)).astype(np.uint64)
    span = APART * (INTEGERS - 1)
    if len(x) <= span:
        return (x[-1:] ^ np.uint64(len(x))).view(np.int64), np.full(min(1, len(x)), len(x) - 1)
    n = len(x) - span
    key, heard = np.zeros(n, np.uint64), np.zeros(n, bool)
    for i in range(0, span + 1, APART):
        key = (key ^ x[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
        heard |= prints[i : i + n] != SILENT
    if n >= WINNOW:
        groups_of = np.lib.stride_tricks.sliding_window_view(key, WINNOW)
        chosen = np.unique(np.arange(len(groups_of)) + groups_of.argmin(axis=1))
    else:
        chosen = np.array([int(key.argmin())])
    chosen = chosen[heard[chosen]]
    # A key that goes on from one kept place to the next (a steady sound) counts where it begins.
    fresh = np.r_[True, key[chosen[1:]] != key[chosen[:-1]]][: len(chosen)]
    return key[chosen[fresh]].view(np.int64), chosen[fresh]


def nearby(prints: list[np.ndarray], places: list[int], side: list[bool] | None, comps: list[int], max_error: float, min_overlap: float):
    """Pairs (i, j) of different components whose bit error, with their places on one another, is small enough: each member
    is laid over many others at once."""
    size, at = np.array([len(p) for p in prints]), np.asarray(places)
    comp, asked = np.asarray(comps), None if side is None else np.asarray(side, bool)
    order = np.argsort(size, kind="stable")  # so that what is laid out together is of like length
    begin = 0
    while begin < len(order):
        end = begin + 1
        while end < len(order) and (end + 1 - begin) * (at[order[begin : end + 1]].max() + (size - at)[order[begin : end + 1]].max()) <= AREA:
            end = min(len(order), begin + 2 * (end - begin))
        own = order[begin:end]
        left, right = int(at[own].max()), int((size - at)[own].max())
        image, filled = np.zeros((len(own), left + right), np.uint32), np.zeros((len(own), left + right), np.uint8)
        for k, j in enumerate(own.tolist()):
            image[k, left - at[j] : left - at[j] + size[j]] = prints[j]
            filled[k, left - at[j] : left - at[j] + size[j]] = 1
        quiet = (image == SILENT) & (filled > 0)
        for i in range(len(prints)):
            others = comp[own] != comp[i]
            others &= own > i if asked is None else (asked[own] != asked[i]) & asked[i]
            if not others.any():
                continue
            l, r = min(int(at[i]), left), min(int(size[i] - at[i]), right)
            x = prints[i][at[i] - l : at[i] + r]
            window = slice(left - l, left + r)
            rows = slice(None) if others.all() else np.flatnonzero(others)
            there = filled[rows, window]
            bits = (np.bitwise_count(image[rows, window] ^ x) * there).sum(axis=1, dtype=np.int64)
            frames = there.sum(axis=1, dtype=np.int64)
            if (silent := x == SILENT).any():
                frames = frames - quiet[rows, window][:, silent].sum(axis=1)
            ok = (bits <= max_error * 32 * frames) & (frames > 0) & (frames >= min_overlap * np.minimum(size[i], size[own][rows]))
            for j in own[rows][ok].tolist():
                yield i, j
        begin = end


def groups(prints: DataFrame, scratch: Scratch, *, max_error: float = 0.25, min_overlap: float = 0.5) -> DataFrame:
    """(rec_id, prints) to one row for each: rec_id, n_frames, group_id (the least id of its group), kept, frame_offset and
    bit_error of its alignment with the group's representative (null if it is that one or has no frames in common)."""
    rows = prints.select("rec_id", F.when(F.length("prints") > 0, fingerprint128(F.col("prints"))).alias("copy"), "prints")
    rows = scratch.write(rows.select("rec_id", "copy.h", "copy.g", "prints"), "prints")
    known = rows.where("h IS NOT NULL AND rec_id IS NOT NULL")
    first = known.groupBy("h", "g").agg(F.min("rec_id").alias("least"), F.first("prints").alias("prints"))
    first = scratch.write(first.withColumn("class", F.monotonically_increasing_id()), "classes")
    classes = scratch.again(first).select("class", "least", "h", "g")

    def spread(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                all_prints = [np.frombuffer(p.as_py(), "<u4") for p in part.column(1)]
                own = [keys(p) for p in all_prints]
                many = [len(k) for k, _ in own]
                if sum(many):
                    columns = (np.concatenate([k for k, _ in own]), np.repeat(part.column(0).to_numpy(), many), np.repeat([len(p) for p in all_prints], many), np.concatenate([p for _, p in own]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "id", "size", "place"])

    def same(x: bytes, y: bytes, offsets: list[int]) -> bool:
        a, b = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
        for offset in offsets:
            bits, frames = differing(a, b, offset)
            if frames and frames >= min_overlap * min(len(a), len(b)) and bits <= max_error * 32 * frames:
                return True
        return False

    def candidates(xs: list[bytes], side, comps, places):
        return nearby([np.frombuffer(x, "<u4") for x in xs], places, side, comps, max_error, min_overlap)

    def prepare(ids: DataFrame) -> DataFrame:
        return scratch.write(scratch.again(first).select(F.col("class").alias("id"), F.col("prints").alias("x")).join(ids, "id", "left_semi"), "compared")

    spread_out = first.select("class", "prints").mapInArrow(spread, "key long, id long, size long, place long")
    labels = link(spread_out, scratch, prepare, same, candidates=candidates, large=False)
    named = classes.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    tops = named.groupBy("component").agg(F.min(F.struct("least", "class")).alias("top")).select("component", F.col("top.least").alias("group_id"), F.col("top.class").alias("top"))
    placed = scratch.write(named.join(tops, "component").select("class", "h", "g", "group_id", "top"), "placed")
    tops_of = scratch.again(first).select(F.col("class").alias("top"), F.col("prints").alias("top_prints"))
    # Only members of a group meet its representative.
    others = scratch.again(placed).where("class <> top").select("class", "top")
    own = scratch.again(first).select("class", "prints").join(others, "class").join(tops_of, "top").select("class", "prints", "top_prints")

    def against(batches):
        for batch in batches:
            offsets, errors = [], []
            for p, top in zip(batch.column(1), batch.column(2), strict=True):
                offset, error, frames = align(np.frombuffer(top.as_py(), "<u4"), np.frombuffer(p.as_py(), "<u4"), min_overlap)
                offsets.append(offset if frames else None)
                errors.append(error if frames else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(offsets, pa.int64()), pa.array(errors, pa.float64())], names=["class", "offset", "bit_error"])

    aligned = scratch.write(own.mapInArrow(against, "class long, offset long, bit_error double"), "aligned")
    of_class = placed.join(aligned, "class", "left").select("h", "g", "group_id", F.when(F.col("class") == F.col("top"), 0).otherwise(F.col("offset")).alias("offset"), F.when(F.col("class") == F.col("top"), 0.0).otherwise(F.col("bit_error")).alias("bit_error"))
    out = rows.select("rec_id", "h", "g", (F.length("prints") / 4).cast("long").alias("n_frames")).join(of_class, ["h", "g"], "left")
    group = F.when(F.col("rec_id").isNotNull(), F.coalesce("group_id", "rec_id"))
    return out.select(
        "rec_id", "n_frames", group.alias("group_id"), F.coalesce(F.col("rec_id") == group, F.lit(True)).alias("kept"),
        F.when(F.col("rec_id") != group, F.col("offset")).alias("frame_offset"), F.when(F.col("rec_id") != group, F.round("bit_error", 6)).alias("bit_error"),
    )
