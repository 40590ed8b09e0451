"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A text is a sequence of words (lower case, between white space) and of shingles of ``k`` words; a shorter text is one
shingle. Each shingle carries the number of its earlier occurrences, so repeats count. For each of ``sketches`` hash
functions the ``keep`` least labelled shingles are taken and put back into the order in which they stand in the text;
their hash is a key. So two texts share a key if they share shingles and have them in the same order, which follows
edit similarity rather than set similarity.

Texts that share a key are candidates. A candidate pair links if the alignment of its two shingle sequences, kept to a
band around the diagonal that any pair above the threshold stays in, matches at least ``threshold`` times the longer
one's shingles. Documents reachable by links are a group, the one of least id represents it.

Equal texts (of equal 128-bit hashes) are one class before anything else, and buckets are linked by ``_linking``, so neither groups of copies nor
passages that many documents share lead to all their pairs.

The chance that a pair of similarity s shares none of the keys is (1 - j^keep)^sketches with j = s / (2 - s) if order is
kept: 2e-4 at s = 0.8 with the default parameters, 2e-10 at 0.9. That is for long texts; of few shingles the keys are
drawn without replacement, and the chance is 9e-4 for 14 words and 5e-3 for 9 (four of five shingles matched).

Defined cases: a null text, and one without words, links with nothing but equal texts without words are no copies
either; a document of a null id is its own group and kept; rows that repeat an id with one text are one document; with
different texts each text has its own links and both rows the group's id; an empty table gives no rows; other columns
are ignored; a text of any length is read whole, as one array of 8 bytes a shingle in the worker that holds it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm._common import Scratch, fingerprint128, marked, sole
from riskloom.llm._linking import link, overlapping

#: Words remembered by a worker.
MEMORY = 50_000


class WordHashes(dict):
    """Hash of a word; forgets all when full."""

    def __missing__(self, word: str) -> int:
        if len(self) > MEMORY:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found


ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Hashes of the shingles of k words, in order; of all words if they are fewer; none without words."""
    words = (text or "").lower().split()
    h = np.fromiter(map(sole("words", WordHashes).__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - k + 1) if len(h) else 0
    out = np.zeros(n, np.uint64)
    for i in range(min(k, len(h))):
        out = mix(out * ODD + h[i : i + n])
    return out


def occurrences(x: np.ndarray) -> np.ndarray:
    """How often the same value stands before each place."""
    order = np.argsort(x, kind="stable")
    ordered = x[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    rank = np.arange(len(x)) - np.repeat(starts, np.diff(np.r_[starts, len(x)]))
    out = np.empty(len(x), np.uint64)
    out[order] = rank
    return out


def labelled(x: np.ndarray) -> np.ndarray:
    """Hashes of shingles with the numbers of their earlier occurrences: distinct within a text."""
    return mix(x + occurrences(x) * ODD)


def sketch(x: np.ndarray, sketches: int, keep: int, seed: int = 1) -> np.ndarray:
    """Keys of a shingle sequence: for each hash function, of its least labelled shingles in the order of the text."""
    own = labelled(x)
    salts = mix(np.arange(1, sketches + 1, dtype=np.uint64) * ODD + np.uint64(seed))
    take = min(keep, len(x))
    keys = np.empty(sketches, np.uint64)
    rows = max(1, 2_000_000 // max(1, len(x)))  # so that long texts need no large matrix
    for a in range(0, sketches, rows):
        part = own[None] ^ salts[a : a + rows, None]
        part = (part ^ (part >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        part ^= part >> np.uint64(29)
        at = np.argpartition(part, take - 1, axis=1)[:, :take] if take < len(x) else np.broadcast_to(np.arange(len(x)), part.shape).copy()
        at.sort(axis=1)
        total = salts[a : a + rows].copy()
        for i in range(take):
            total = mix(total * ODD + own[at[:, i]])
        keys[a : a + rows] = total
    return keys


def matched(a: np.ndarray, b: np.ndarray, least: int, band: int) -> int:
    """Length of the longest common subsequence whose matches lie at most band off the diagonal, or a number below
    ``least`` where it cannot reach that. Bit-parallel: a row of the alignment is one integer."""
    lead = 0
    short = min(len(a), len(b))
    if short:
        differ = a[:short] != b[:short]
        lead = int(differ.argmax()) if differ.any() else short
    a, b = a[lead:], b[lead:]
    short = min(len(a), len(b))
    tail = 0
    if short:
        differ = a[::-1][:short] != b[::-1][:short]
        tail = int(differ.argmax()) if differ.any() else short
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    done = lead + tail
    if not len(a) or not len(b):
        return done
    common, ca, cb = np.intersect1d(*(np.unique(v) for v in (a, b)), return_indices=True)
    counts_a, counts_b = (np.unique(v, return_counts=True)[1] for v in (a, b))
    most = int(np.minimum(counts_a[ca], counts_b[cb]).sum())
    if done + most < least:
        return done + most
    masks: dict[int, int] = {}
    wanted = set(common.tolist())
    for j, y in enumerate(b.tolist()):
        if y in wanted:
            masks[y] = masks.get(y, 0) | (1 << j)
    full = (1 << len(b)) - 1
    window = (1 << (2 * band + 1)) - 1
    row = full
    for i, x in enumerate(a.tolist()):
        hits = masks.get(x)
        if hits is None:
            continue
        hits &= window << (i - band) if i >= band else window >> (band - i)
        if hits:
            kept = row & hits
            row = ((row + kept) | (row - kept)) & full
    return done + len(b) - row.bit_count()


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether the aligned shingles are at least that share of the longer sequence's."""
    longer = max(len(a), len(b))
    if not len(a) or not len(b):
        return False
    least = int(np.ceil(threshold * longer - 1e-9))
    if min(len(a), len(b)) < least:
        return False
    return matched(a, b, least, longer - least) >= least


def groups(docs: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.8, sketches: int = 24, keep: int = 3) -> DataFrame:
    """One row for each row of docs: doc_id, group_id (the least doc_id of its group), kept (whether it is that one)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    hashed = rows.select("doc_id", F.when(F.col("text").rlike("\\S"), fingerprint128(F.col("text"))).alias("copy"))
    members = scratch.write(hashed.select("doc_id", "copy.h", "copy.g"), "members")
    first = rows.where(F.col("doc_id").isNotNull() & F.col("text").rlike("\\S")).withColumn("copy", fingerprint128(F.col("text")))
    first = first.select("doc_id", "copy.h", "copy.g", "text")

    def sketched(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                at, sizes, keys = [], [], []
                for i, text in enumerate(batch.column(3).slice(a, 512)):
                    x = shingles(text.as_py(), k)
                    if len(x):
                        at.append(a + i)
                        sizes.append(len(x))
                        keys.append(sketch(x, sketches, keep).view(np.int64))
                if at:
                    lists = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(keys)), sketches).cast(pa.list_(pa.int64()))
                    take = pa.array(at)
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in range(3)), pa.array(sizes, pa.int64()), lists], names=["doc_id", "h", "g", "size", "keys"])

    # A class of equal texts is one row: its number, its least document and the sketch that its copies have alike.
    sketches_of = first.mapInArrow(sketched, "doc_id long, h long, g long, size long, keys array<long>")
    classes = sketches_of.groupBy("h", "g").agg(F.min("doc_id").alias("least"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    classes = scratch.write(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    buckets = classes.select(F.explode(F.array_distinct("keys")).alias("key"), F.col("class").alias("id"), "size")

    def prepare(involved: DataFrame) -> DataFrame:
        """Shingle sequences of the classes that share a key with another; other texts stay where they are."""
        wanted = scratch.again(classes).select(F.col("class").alias("c"), F.col("least").alias("l"), F.col("h").alias("ch"), F.col("g").alias("cg"))
        named = scratch.write(involved.select(F.col("id").alias("c")).join(wanted, "c"), "named")
        near = marked(first, F.col("doc_id"), named, "l", "_maybe").where("_maybe").drop("_maybe")
        texts = near.hint("merge").join(named, (F.col("h") == F.col("ch")) & (F.col("g") == F.col("cg")) & (F.col("doc_id") == F.col("l"))).select(F.col("c").alias("class"), "text").dropDuplicates(["class"])

        def sequences(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t.as_py(), k).tobytes() for t in part.column(1)], pa.binary())], names=["id", "x"])

        return scratch.write(texts.mapInArrow(sequences, "id long, x binary"), "sequences")

    def same(a: bytes, b: bytes, offsets: list[int]) -> bool:
        return similar(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), threshold)

    def candidates(sequences: list[bytes], side: list[bool] | None, comps, places):
        """Pairs with enough shingles in common, repeats counted, whatever their order."""
        return overlapping([labelled(np.frombuffer(x, np.uint64)) for x in sequences], threshold, side)

    labels = link(buckets, scratch, prepare, same, candidates=candidates, ratio=threshold)
    named = scratch.again(classes).select("class", "least", "h", "g").join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = named.groupBy("component").agg(F.min("least").alias("group_id"))
    of_class = scratch.write(named.join(least, "component").select("h", "g", "group_id"), "groups")
    out = members.join(of_class, ["h", "g"], "left").withColumn("group_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("group_id", "doc_id")))
    return out.select("doc_id", "group_id", F.coalesce(F.col("doc_id") == F.col("group_id"), F.lit(True)).alias("kept"))
