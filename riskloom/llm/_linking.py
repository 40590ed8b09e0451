"""Links between the members of candidate buckets, without emitting the pairs of a bucket.

What is wanted are the components of the links, so not every pair of a bucket needs a look. In a first round the members
of every bucket are compared with one centre of it: one row for each member. Those found linked, there or through other
buckets, share a component, and for most buckets nothing else is left.

What is left of a bucket are members of other components than its centre's. They are settled, with one another and with
the other members of the centre's component, inside tasks that hold two bounded blocks of members and return only the
links that join components. Members are dealt to blocks by classes of size first, since sizes below the ratio cannot
link, and no block holds more than ``ITEMS`` items; members of the centre's component have blocks of their own, which meet
those of the others but not each other. Within a task an inverted index over the members' items, or whatever
``candidates`` does, finds the pairs worth an alignment. So every pair that shares a key and could change the components
is considered, in tasks of bounded memory, and nothing is capped.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm._common import Scratch
from riskloom.llm._components import Forest, components

#: Items (shingles, frames) in a block.
ITEMS = 2_000_000
#: Members up to which all pairs of a block are as quick as looking for candidates.
FEW = 4


def overlapping(items: list[np.ndarray], share: float, side: list[bool] | None = None) -> Iterable[tuple[int, int]]:
    """Pairs (i, j) of different places that have at least that share of the longer one's items in common, each once;
    items are sets. With sides, only pairs of different sides."""
    sizes = np.fromiter(map(len, items), np.int64, len(items))
    owner = np.repeat(np.arange(len(items)), sizes)
    _, term = np.unique(np.concatenate(items), return_inverse=True)
    asked = np.ones(len(items), bool)
    held = asked
    if side is not None:  # the smaller side asks, the other one is the index
        asked = np.asarray(side, bool)
        asked = asked if 2 * asked.sum() <= len(items) else ~asked
        held = ~asked
    order = np.argsort(term, kind="stable")
    order = order[held[owner[order]]]
    posted, begin = owner[order], np.searchsorted(term[order], np.arange(term.max(initial=-1) + 2))
    start = np.r_[0, np.cumsum(sizes)]
    for i in np.flatnonzero(asked).tolist():
        n = int(sizes[i])
        own = term[start[i] : start[i + 1]]
        first, many = begin[own], begin[own + 1] - begin[own]
        # The places of all postings of own terms, range after range.
        places = np.arange(many.sum()) + np.repeat(first - np.r_[0, np.cumsum(many)[:-1]], many) if n else np.zeros(0, np.int64)
        common = np.bincount(posted[places], minlength=len(items))
        for j in np.flatnonzero((common >= np.ceil(share * np.maximum(sizes, n) - 1e-9)) & (common > 0)):
            if side is not None or j > i:
                yield i, int(j)


def link(buckets: DataFrame, scratch: Scratch, prepare: Callable[[DataFrame], DataFrame], same: Callable[..., bool], *, candidates: Callable | None = None, ratio: float = 0.0, large: bool = True) -> DataFrame:
    """buckets(key, id, size, and place if the place of a key in its member matters): longs, without repeats; sizes below
    the ratio of one another cannot link. prepare takes the ids (id) that may be compared and returns a written (id, x)
    with what same compares: same(x, y, offsets) gets the differences of the places of shared keys, those that most keys
    give first. candidates(xs, side, comps, places) gives pairs that may be the same, of different sides only if there
    are sides; pairs of one component need not be given (all pairs, if there is no candidates). With large, a pair of
    blocks is worth a call of its own; else blocks come as a sorted stream, which suits many small ones.
    Returns (node, component) of the linked ids."""
    located = "place" in buckets.columns
    if not located:
        buckets = buckets.withColumn("place", F.lit(0).cast("long"))
    whole = scratch.write(_shared(buckets.select("key", "id", "size", "place")), "buckets")
    held = prepare(scratch.write(whole.select("id").distinct(), "involved"))
    order = F.struct(F.xxhash64("id").alias("h"), F.col("id").alias("c"), F.col("size").alias("cs"), F.col("place").alias("cp"))
    centres = whole.groupBy("key").agg(F.min(order).alias("m")).select("key", "m.c", "m.cs", "m.cp")
    star = scratch.write(whole.join(centres, "key").where("id <> c"), "star")
    near = star.where(F.least("size", "cs") >= F.lit(ratio) * F.greatest("size", "cs") - F.lit(1e-9))
    offset = F.when(F.col("id") < F.col("c"), F.col("place") - F.col("cp")).otherwise(F.col("cp") - F.col("place"))
    near = near.select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b"), offset.alias("offset"))
    if located:  # the offset histogram of each pair: as many offsets at most as a member has keys
        votes = near.groupBy("a", "b", "offset").agg((-F.count(F.lit(1))).alias("votes"))
        pairs = votes.groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("votes", "offset"))).getField("offset").alias("offsets"))
    else:
        pairs = near.select("a", "b").distinct().withColumn("offsets", F.array(F.lit(0).cast("long")))
    pairs = scratch.write(pairs, "pairs")

    def compare(batches):
        for batch in batches:
            ok = [same(x.as_py(), y.as_py(), o.as_py()) for x, y, o in zip(batch.column(2), batch.column(3), batch.column(4), strict=True)]
            keep = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"])

    left, right = (scratch.again(held).select(F.col("id").alias(p), F.col("x").alias(f"x{p}")) for p in "ab")
    both = pairs.hint("merge").join(left, "a").hint("merge").join(right, "b").select("a", "b", "xa", "xb", "offsets")
    links = scratch.write(both.mapInArrow(compare, "a long, b long"), "links")
    scratch.drop(pairs, whole)
    labels = components(links, scratch)

    own = scratch.again(labels).select(F.col("node").alias("id"), F.col("component").alias("ci"))
    centre = scratch.again(labels).select(F.col("node").alias("c"), F.col("component").alias("cc"))
    rest = star.join(own, "id", "left").join(centre, "c", "left").withColumn("core", F.coalesce(F.col("ci") == F.col("cc"), F.lit(False)))
    # Buckets with members of other components than the centre's; its own component's members come along.
    open_keys = rest.where("NOT core").select("key").distinct()
    rest = rest.join(open_keys, "key", "left_semi").select("key", "id", "size", "place", F.coalesce("ci", "id").alias("comp"), "core")
    if ratio > 0:
        step = F.floor(F.log(F.col("size").cast("double")) / F.lit(-math.log(ratio)) + F.lit(1e-9)).cast("long")
        rest = rest.withColumn("own", step).withColumn("class", F.explode(F.array("own", F.col("own") + 1)))
    else:
        rest = rest.withColumn("own", F.lit(0).cast("long")).withColumn("class", F.col("own"))
    rest = scratch.write(rest, "rest")
    scratch.drop(star)
    # A class is settled if it has two components, and a member of its own (else its pairs stand in the class below).
    blocks = lambda core: F.ceil(F.sum(F.when(core, F.col("size")).otherwise(0)) / F.lit(float(ITEMS))).cast("int")
    sizes = rest.groupBy("key", "class").agg(
        blocks(~F.col("core")).alias("blocks"), blocks(F.col("core")).alias("cores"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.col("own") == F.col("class")).alias("real")
    )
    sizes = sizes.where("lo < hi AND real AND blocks > 0").select("key", "class", "blocks", "cores")
    # The blocks of the centre's component stand behind the others, and meet those only.
    place = F.when(F.col("core"), F.col("blocks") + F.pmod(F.xxhash64("id"), F.col("cores"))).otherwise(F.pmod(F.xxhash64("id"), F.col("blocks"))).cast("int")
    last = F.when(F.col("core"), F.col("blocks")).otherwise(F.col("blocks") + F.col("cores")) - 1
    dealt = rest.join(sizes, ["key", "class"]).withColumn("block", place).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    dealt = dealt.select("key", "class", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "id", "comp", (F.col("own") == F.col("class")).alias("own"), "place")
    seen = dealt.hint("merge").join(scratch.again(held), "id").select("key", "class", "p", "q", "block", "id", "comp", "own", "place", "x")

    def settle(crossing: bool, rows: list[tuple]) -> list[tuple[int, int]]:
        """Links of one pair of blocks that join components; rows: (block, id, comp, own, place, x)."""
        block, ids, comps, own_class, place, x = zip(*rows, strict=True)
        joined, out = Forest(), []
        side = [b == block[0] for b in block] if crossing else None
        if crossing:
            here, there = ([i for i, s in enumerate(side) if s == t] for t in (True, False))
            every = ((i, j) for i in here for j in there)
        else:
            every = ((i, j) for i in range(len(x)) for j in range(i + 1, len(x)))
        for i, j in candidates(x, side, comps, place) if candidates and len(x) > FEW else every:
            if not (own_class[i] or own_class[j]) or joined.find(comps[i]) == joined.find(comps[j]):
                continue
            if same(x[i], x[j], [place[i] - place[j]]):
                joined.union(comps[i], comps[j])
                out.append((ids[i], ids[j]))
        return out

    def settle_all(batches):
        """Rows come sorted, so the rows of one pair of blocks are held at a time."""
        current, rows = None, []
        for batch in batches:
            found = []
            for key, klass, p, q, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, klass, p, q) != current:
                    if len(rows) > 1:
                        found += settle(current[2] != current[3], rows)
                    current, rows = (key, klass, p, q), []
                rows.append(row)
            yield _pairs(found)
        if len(rows) > 1:
            yield _pairs(settle(current[2] != current[3], rows))

    def settle_group(key, rows):
        fields = ("block", "id", "comp", "own", "place", "x")
        found = settle(key[2].as_py() != key[3].as_py(), list(zip(*(rows.column(n).to_pylist() for n in fields), strict=True))) if rows.num_rows > 1 else []
        return pa.Table.from_batches([_pairs(found)])

    at = ["key", "class", "p", "q"]
    if large:
        settled = seen.groupBy(*at).applyInArrow(settle_group, "a long, b long")
    else:
        settled = seen.repartition(*at).sortWithinPartitions(*at).mapInArrow(settle_all, "a long, b long")
    more = scratch.write(settled, "more")
    scratch.drop(rest, held)
    if more.isEmpty():
        return labels
    return components(links.unionByName(more), scratch)


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])


def _shared(rows: DataFrame) -> DataFrame:
    """Rows of the keys that at least two rows have."""
    many = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    return rows.join(many, "key")
