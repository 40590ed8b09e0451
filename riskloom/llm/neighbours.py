"""Near-duplicate vectors by product quantisation: inverted lists, residual codes, table look-ups and an exact rerank.

Vectors are scaled to length 1. A coarse quantiser (k-means, fitted on a bounded sample) deals them to inverted lists;
in its list a vector is stored as the codes of its residual's subspaces, with the length of what the codes leave out.

Probes. If x stands in the list of centroid c and y in that of c', the segment between them crosses the plane between
both lists, so x and y lie together at most |x - y| <= r from it, and one of them at most r / 2. A vector x therefore
probes every list c' with d(x, c')^2 - d(x, c)^2 <= r |c' - c|: each pair within r is met from one side at least, so the
probes are sufficient, not a guess. A pair met from one side only is counted for both, which that side can tell. In a
list the asymmetric distance of x to a code is read from a table of x's distances to the codewords; since the true distance differs from it by at most the code's error, vectors with
distance - error > r are passed over without loss. The rest are compared exactly, in double precision.

Equal vectors are one class: only classes are compared, and a link between classes counts for all their members. Lists
are gathered into shards of bounded size, a large list being cut into several, and each shard meets its queries in
bounded shares, so no task holds a hot list, and a shard returns sums of links and a spanning forest of the links found
rather than pairs.

Defined cases: vectors that are null, of length zero, of another dimension than the most frequent one, or with null or
non-finite components link with nothing and are their own component; rows that repeat an id with equal vectors are one
vector, with unequal ones the smaller vector counts; components so small or large that their squares leave the range of
doubles count by their direction like any others; a null id is kept without links; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm._common import Scratch
from riskloom.llm._components import Forest, components

#: Vectors of the sample that the quantisers are fitted on; subspaces; codewords of each; rounds of k-means.
SAMPLE, SUBSPACES, CODEWORDS, ROUNDS = 20_000, 8, 64, 8
#: Lists are four times the root of the number of vectors, so work grows as its power 1.5; the sample, grown to four vectors
#: a list, bounds them to this many (from 4 million vectors on, work grows with the square again, divided by that).
LISTS = 8192
#: Members of a shard, and queries that meet it in a task.
SHARD, SHARE = 8192, 16_384


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        count = np.bincount(near, minlength=len(centres))
        for d in range(x.shape[1]):
            total = np.bincount(near, x[:, d], minlength=len(centres))
            centres[:, d] = np.where(count > 0, total / np.maximum(count, 1), centres[:, d])
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared, rows × centres."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None], 0)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(x[a : a + 4096], centres).argmin(1) for a in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


class Quantiser:
    """Coarse centroids and the codebooks of the residuals' subspaces."""

    def __init__(self, sample: np.ndarray, lists: int, subspaces: int = SUBSPACES, codewords: int = CODEWORDS, seed: int = 7):
        self.dim = sample.shape[1]
        self.cuts = np.linspace(0, self.dim, min(subspaces, self.dim) + 1).astype(int)
        self.centres = kmeans(sample, min(lists, len(sample)), ROUNDS, seed)
        rest = sample - self.centres[nearest(sample, self.centres)]
        self.books = [kmeans(rest[:, a:b], min(codewords, len(rest)), ROUNDS, seed + 1 + i) for i, (a, b) in enumerate(self._spans())]

    def _spans(self):
        return zip(self.cuts[:-1], self.cuts[1:], strict=True)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and error of unit vectors."""
        own = nearest(x, self.centres)
        rest = x - self.centres[own]
        codes = np.stack([nearest(rest[:, a:b], book) for (a, b), book in zip(self._spans(), self.books, strict=True)], axis=1)
        left = rest - self.decode(codes)
        return own, codes.astype(np.uint8), np.sqrt((left * left).sum(1))

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([book[codes[:, i]] for i, book in enumerate(self.books)], axis=1)

    def probes(self, x: np.ndarray, radius: float) -> np.ndarray:
        """Rows × lists: whether a unit vector probes a list."""
        d = distances(x, self.centres)
        lists, own = np.unique(d.argmin(1), return_inverse=True)
        gaps = np.sqrt(distances(self.centres[lists], self.centres))
        return d - d.min(1)[:, None] <= radius * gaps[own] + 1e-9

    def approximate(self, x: np.ndarray, own: int, codes: np.ndarray) -> np.ndarray:
        """Distances of queries to the coded members of one list, from tables of distances to the codewords."""
        rest = x - self.centres[own]
        total = np.zeros((len(x), len(codes)))
        for i, ((a, b), book) in enumerate(zip(self._spans(), self.books, strict=True)):
            total += distances(rest[:, a:b], book)[:, codes[:, i]]
        return np.sqrt(total)


def units(column: pa.Array, dim: int) -> np.ndarray:
    return scaled(column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; by the largest component first, since squares may leave the range of doubles."""
    x = x / np.abs(x).max(axis=1, initial=0)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def classes(vectors: DataFrame, *, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(vec_id, v) of usable vectors, one for each id, and their dimension."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where(
        F.col("vec_id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)
    )
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not sizes:
        return rows.limit(0), 0
    dim = sizes[0].dim
    return rows.where(F.size("v") == dim).groupBy("vec_id").agg(F.min("v").alias("v")), dim


def link(vectors: DataFrame, scratch: Scratch, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, sample: int = SAMPLE) -> DataFrame:
    """One row for each row of vectors: vec_id, n_links, component_id, kept."""
    rows, dim = classes(vectors, id_col=id_col, vector_col=vector_col)
    all_ids = vectors.select(F.col(id_col).cast("long").alias("vec_id"))
    if not dim:
        return all_ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    # 0.0 and -0.0 are the same component, and their sum is 0.0.
    kind = dict(rows.dtypes)["v"]
    rows = rows.withColumn("v", F.transform("v", lambda x: F.when(x == 0, F.lit(0)).otherwise(x)).cast(kind))
    member = scratch.write(rows.withColumn("key", F.md5(F.concat_ws(",", F.transform("v", lambda x: x.cast("string"))).cast("binary"))), "vectors")
    groups = scratch.write(member.groupBy("key").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("size")), "classes")
    nodes = member.join(groups, (member.key == groups.key) & (member.vec_id == groups.node)).select("node", "size", "v")
    nodes = scratch.write(nodes, "nodes")

    total = nodes.count()
    lists = int(np.clip(4 * np.sqrt(total), 1, LISTS))
    taken = nodes.orderBy(F.xxhash64("node"), "node").limit(max(sample, 4 * lists)).select("v").collect()  # 4 * LISTS at most
    fitted = scaled(np.asarray([r.v for r in taken], float))
    lists = min(len(fitted), lists)
    held = nodes.sparkSession.sparkContext.broadcast(Quantiser(fitted, lists))  # at most LISTS centroids and the codebooks
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6)

    def index(batches):
        q: Quantiser = held.value
        for batch in batches:
            x = units(batch.column(2), dim)
            own, codes, error = q.encode(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)],
                names=["node", "size", "v", "list", "codes", "error"],
            )

    coded = scratch.write(nodes.mapInArrow(index, f"node long, size long, v {kind}, list int, codes binary, error double"), "lists")
    first, many = _shards({r["list"]: r["n"] for r in coded.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}, lists)  # at most LISTS rows
    shards = int((first + many).max())
    layout = nodes.sparkSession.sparkContext.broadcast((first, many))  # two numbers a list

    def asks(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(row, shard): the shards that hold a list which the row probes, each once."""
        begin, n = layout.value
        row, own = np.nonzero(held.value.probes(units(part.column(2), dim), radius))
        times = n[own]
        shard = np.repeat(begin[own], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        both = np.unique(np.repeat(row, times) * np.int64(shards) + shard)
        return both // shards, both % shards

    def count(batches):
        total_of = np.zeros(shards, np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                total_of += np.bincount(asks(batch.slice(a, 2048))[1], minlength=len(total_of))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total_of)), pa.int32()), pa.array(total_of)], names=["shard", "n"])

    asked_of = {r.shard: r.n for r in nodes.mapInArrow(count, "shard int, n long").groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row for each shard
    share_of = nodes.sparkSession.sparkContext.broadcast(np.asarray([max(1, -(-asked_of.get(k, 0) // SHARE)) for k in range(shards)]))

    def ask(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                row, shard = asks(part)
                node = part.column(0).to_numpy(zero_copy_only=False)[row]
                share = (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % share_of.value[shard]
                for b in range(0, len(row), 8192):
                    at = slice(b, b + 8192)
                    take = pa.array(row[at])
                    yield pa.RecordBatch.from_arrays([pa.array(shard[at], pa.int32()), pa.array(share[at], pa.int32()), *(part.column(k).take(take) for k in range(3))], names=["shard", "share", "node", "size", "v"])

    def store(batches):
        for batch in batches:
            own = batch.column(3).to_numpy()
            node = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)
            pick = (node * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(33)).astype(np.int64)
            begin, n = layout.value
            shard = begin[own] + pick % n[own]
            times = share_of.value[shard]
            row = np.repeat(np.arange(len(own)), times)
            share = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            for b in range(0, len(row), 8192):
                at = slice(b, b + 8192)
                take = pa.array(row[at])
                yield pa.RecordBatch.from_arrays([pa.array(shard[row[at]], pa.int32()), pa.array(share[at], pa.int32()), *(batch.column(k).take(take) for k in range(6))], names=["shard", "share", "node", "size", "v", "list", "codes", "error"])

    def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
        q: Quantiser = held.value
        forest, found, sums = Forest(), [], []
        if left.num_rows and right.num_rows:
            x_id, x_size = left.column("node").to_numpy(), left.column("size").to_numpy()
            order = np.argsort(right.column("list").to_numpy(), kind="stable")
            right = right.take(pa.array(order))
            y_id, y_size, y_list, error = (right.column(k).to_numpy() for k in ("node", "size", "list", "error"))
            y, x_all = units(right.column("v").combine_chunks(), dim), units(left.column("v").combine_chunks(), dim)
            codes = np.frombuffer(b"".join(right.column("codes").to_pylist()), np.uint8).reshape(len(y), -1)
            starts = np.flatnonzero(np.r_[True, y_list[1:] != y_list[:-1]])
            spans = list(zip(y_list[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(y)], strict=True))
            for a in range(0, len(x_id), 1024):
                x, ids, sizes = x_all[a : a + 1024], x_id[a : a + 1024], x_size[a : a + 1024]
                d = distances(x, q.centres)
                x_list = d.argmin(1)
                probing = q.probes(x, radius)
                for own, begin, end in spans:
                    rows = np.flatnonzero(probing[:, own])
                    if not len(rows):
                        continue
                    near = q.approximate(x[rows], own, codes[begin:end]) - error[None, begin:end] <= radius
                    i, j = np.nonzero(near)
                    i, j = rows[i], j + begin
                    exact = np.concatenate([np.einsum("ij,ij->i", x[i[b : b + 65536]], y[j[b : b + 65536]]) for b in range(0, len(i), 65536)] or [np.zeros(0)]) >= threshold
                    i, j = i[exact], j[exact]
                    other = ids[i] != y_id[j]
                    i, j = i[other], j[other]
                    if not len(i):
                        continue
                    found.append(ids[i])
                    sums.append(y_size[j])
                    members, back = np.unique(j, return_inverse=True)
                    mutual = q.probes(y[members], radius)[back, x_list[i]]
                    found.append(y_id[j[~mutual]])
                    sums.append(sizes[i[~mutual]])
                    for p, c in _stars(ids, y_id, i, j):
                        forest.union(p, c)
                if sum(map(len, found)) > 200_000:
                    found, sums = _summed(found, sums)
        found, sums = _summed(found, sums)
        roots = [(n, r) for n in list(forest.parent) if (r := forest.find(n)) != n]
        return pa.table({
            "node": pa.array([*found[0].tolist(), *(n for n, _ in roots)], pa.int64()),
            "links": pa.array([*sums[0].tolist(), *(0 for _ in roots)], pa.int64()),
            "other": pa.array([*(None for _ in found[0]), *(r for _, r in roots)], pa.int64()),
        })

    queries = nodes.mapInArrow(ask, f"shard int, share int, node long, size long, v {kind}").groupBy("shard", "share")
    members = coded.mapInArrow(store, f"shard int, share int, node long, size long, v {kind}, list int, codes binary, error double").groupBy("shard", "share")
    met = queries.cogroup(members).applyInArrow(meet, "node long, links long, other long")
    met = scratch.write(met, "links")
    sums = met.where("other IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    comps = components(met.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")), scratch)
    # The classes' results go back to their members.
    per_class = groups.join(sums, "node", "left").join(comps.withColumnRenamed("component", "least"), "node", "left").select(
        "key", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("least", "node").alias("component_id")
    )
    per_vector = member.join(per_class, "key").select("vec_id", "n_links", "component_id")
    return all_ids.join(per_vector, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"),
    )


def _shards(counts: dict[int, int], lists: int) -> tuple[np.ndarray, np.ndarray]:
    """The first shard of each list and how many it has: small lists share one, a large list has several in a row."""
    first, many = np.zeros(lists, np.int64), np.zeros(lists, np.int64)
    shard, room = -1, 0
    for own, n in sorted(counts.items()):
        if n > SHARD:
            first[own], many[own] = shard + 1, -(-n // SHARD)
            shard, room = shard + int(many[own]), 0
            continue
        if n > room:
            shard, room = shard + 1, SHARD
        first[own], many[own] = shard, 1
        room -= n
    return first, many


def _summed(found: list[np.ndarray], sums: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """One sum for each id."""
    if not found:
        return [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    ids, back = np.unique(np.concatenate(found), return_inverse=True)
    total = np.zeros(len(ids), np.int64)
    np.add.at(total, back, np.concatenate(sums))
    return [ids], [total]


def _stars(ids: np.ndarray, y_id: np.ndarray, i: np.ndarray, j: np.ndarray):
    """Links that join the same nodes as all links (i, j) do, about one for each node: a query is tied to its first
    member, and members that share a query to that one, each member once for each distinct first member."""
    first = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(first, i, y_id[j])
    seen = np.unique(np.stack([first[i], y_id[j]]), axis=1)
    hit = np.unique(i)
    yield from zip(ids[hit].tolist(), first[hit].tolist(), strict=True)
    yield from zip(*seen.tolist(), strict=True)
