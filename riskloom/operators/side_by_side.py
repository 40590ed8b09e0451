"""Text models of all left-out sources, fitted side by side: one pass over the rows serves a step of every model's solver.

The model is that of learning.fit_text_model: words and word pairs, 1 + ln of their counts, inverse document frequencies and unit
length as each model's own training rows give them, balanced labels, logistic regression with an L2 penalty. Texts become terms
once, and terms become numbers of a shared vocabulary once; what differs between the models (their terms, document frequencies,
lengths, weights) is held in arrays of models by terms, which the vocabulary bounds."""

from __future__ import annotations

import pickle
from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators import evaluation as ev
from riskloom.operators import learning as L

#: Models whose terms are numbered at once, and those that are counted and solved at once: they bound the arrays that the driver and each
#: task hold (models × vocabulary).
TOGETHER, SOLVED = 32, 7
#: Sums that the driver gathers in one pass, one from each task.
SUMS = 32
#: Most frequent terms whose counts of each source are looked at first, times the vocabulary; if they may not do, those of all terms are.
FIRST = 4.0
#: Terms and rows of a block, the unit in which rows are read.
BLOCK, BLOCK_ROWS = 1 << 20, 1 << 14
#: Rows that a task looks up at once.
SLICE = 2000
#: 1 + ln of the counts that 16 bits hold.
LOGS = 1.0 + np.log(np.maximum(1, np.arange(1 << 16)))
#: Bytes of an Arrow batch here: by the default 10,000 texts' terms stand in the buffers of the JVM and of each worker at once.
BATCHES, FEWER = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def _counted(batches):
    """source, label and terms of rows to their distinct terms with counts."""
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            lists = batch.column(2)
            codes = pc.dictionary_encode(lists.flatten())
            size = max(1, len(codes.dictionary))
            keys, counts = np.unique(pc.list_parent_indices(lists).to_numpy().astype(np.int64) * size + codes.indices.to_numpy(), return_counts=True)
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(keys // size, minlength=batch.num_rows))]), pa.int32())
            terms = pa.ListArray.from_arrays(ends, codes.dictionary.take(pa.array(keys % size)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), terms, pa.ListArray.from_arrays(ends, pa.array(counts, pa.int32()))], names=["source", "label", "terms", "counts"])


def term_rows(df: DataFrame) -> DataFrame:
    """df(text, source, label) as a table of source, label, terms and their counts."""
    lead = PipelineModel(L.text_features()[:4])
    rows = lead.transform(df.select(F.coalesce("text", F.lit("")).alias("text"), "source", "label")).select("source", F.col("label").cast("int").alias("label"), "_terms")
    return L.written(rows.mapInArrow(_counted, "source string, label int, terms array<string>, counts array<int>"))


def _bound(x: float, n: int) -> float:
    return x * n if x < 1 else x


def first_terms(rows: DataFrame, sizes: dict[str, int], vocabulary: int, min_df: float) -> pa.Table:
    """term, n and df (occurrences and rows in all) of the most frequent terms that any model may take, one more than FIRST tells."""
    cells = rows.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.counts").alias("n"))
    per = cells.groupBy("term").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("df")).where(F.col("df") >= min(_bound(min_df, n) for n in sizes.values()))
    return L.written(per.orderBy(F.desc("n"), "term").limit(int(vocabulary * FIRST) + 1)).toArrow().sort_by([("n", "descending"), ("term", "ascending")])


def _own_counts(rows: DataFrame, sources: list[str], names: pa.Array) -> np.ndarray:
    """Occurrences, and rows, of the terms in each of the sources."""
    sc, shape = rows.sparkSession.sparkContext, (2, len(sources), len(names))
    shared = sc.broadcast((names, pa.array(sources, pa.string())))

    def run(batches):
        names, held = shared.value
        total = np.zeros((2, shape[1] * shape[2]), np.uint32)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                found = pc.index_in(batch.column(1).flatten(), names)
                source = pc.fill_null(pc.index_in(batch.column(0), held), -1).to_numpy()[pc.list_parent_indices(batch.column(1)).to_numpy()]
                keep = pc.is_valid(found).to_numpy(zero_copy_only=False) & (source >= 0)
                cell = source[keep].astype(np.intp) * shape[2] + pc.fill_null(found, 0).to_numpy()[keep]
                np.add.at(total[0], cell, batch.column(2).flatten().to_numpy()[keep].astype(np.uint32))
                np.add.at(total[1], cell, np.uint32(1))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    out = np.zeros(shape, np.int64)
    for r in rows.select("source", "terms", "counts").coalesce(max(1, min(sc.defaultParallelism, SUMS))).mapInArrow(run, "sums binary").collect():  # SUMS at most
        out += np.frombuffer(r.sums, np.uint32).reshape(shape)
    shared.destroy()
    return out


def first_vocabularies(rows: DataFrame, first: pa.Table, sizes: dict[str, int], vocabulary: int, min_df: float, max_df: float) -> tuple[pa.Array, np.ndarray] | None:
    """What vocabularies() gives, from the first terms; none if others might belong to it."""
    whole = first.num_rows <= int(vocabulary * FIRST)
    floor = 0 if whole else first["n"][-1].as_py()  # of the other terms none has more, in all and so under any model
    first = first if whole else first.slice(0, first.num_rows - 1)
    names = first["term"].combine_chunks()
    own = np.concatenate([_own_counts(rows, list(sizes)[at : at + SOLVED], names) for at in range(0, len(sizes), SOLVED)], axis=1)
    n, df = (first[c].to_numpy()[None, :] - own[i] for i, c in enumerate(("n", "df")))
    freq, place = np.zeros(df.shape), np.argsort(np.array(names.to_pylist(), object), kind="stable").argsort()
    for s, rows_of in enumerate(sizes.values()):
        may = np.flatnonzero((df[s] > 0) & (df[s] >= _bound(min_df, rows_of)) & (df[s] <= _bound(max_df, rows_of)))
        if not whole and np.count_nonzero(n[s][may] > floor) < vocabulary:
            return None
        taken = may[np.lexsort((place[may], -n[s][may]))][:vocabulary]
        freq[s, taken] = df[s][taken]
    any_model = np.flatnonzero(freq.any(axis=0))
    return names.take(pa.array(any_model)), freq[:, any_model]


def term_counts(rows: DataFrame) -> DataFrame:
    """A table of the terms: n and df (occurrences and rows in all), own (the same of each source)."""
    cells = rows.select("source", F.explode(F.arrays_zip("terms", "counts")).alias("t")).select("source", F.col("t.terms").alias("term"), F.col("t.counts").alias("n"))
    per = cells.groupBy("term", "source").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("df"))
    return L.written(per.groupBy("term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"), F.collect_list(F.struct("source", "n", "df")).alias("own")))


def vocabularies(terms: DataFrame, sizes: dict[str, int], vocabulary: int, min_df: float, max_df: float) -> tuple[pa.Array, np.ndarray]:
    """The terms that any model takes, and their document frequencies (models by terms, 0 where a model does not take a term). A
    model is named by the source it leaves out, sizes has its rows; it takes the most frequent terms within the limits (below 1:
    shares of its rows), of equals the first."""
    least, most = [_bound(min_df, n) for n in sizes.values()], [_bound(max_df, n) for n in sizes.values()]
    left = lambda s, what: F.col(what) - F.coalesce(F.get(F.filter("own", lambda o: o["source"] == s), F.lit(0)).getField(what), F.lit(0))
    # Terms that every model may take, by the count that each model sees at least: the last of the first ones bounds all models' counts from below.
    of_own = lambda what: F.coalesce(F.array_max(F.filter("own", lambda o: o["source"].isin(list(sizes))).getField(what)), F.lit(0))
    sure = terms.where((F.col("df") - of_own("df") >= max(least)) & (F.col("df") <= min(most))).select((F.col("n") - of_own("n")).alias("n")).orderBy(F.desc("n")).limit(vocabulary)
    found = sure.agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("n")).first()
    near = terms.where((F.col("df") >= min(least)) & (F.col("n") >= (found.n if found.k == vocabulary else 0)))
    each = near.select("term", F.explode(F.array(*[F.struct(F.lit(i).alias("model"), left(s, "n").alias("n"), left(s, "df").alias("df"), F.lit(float(a)).alias("least"), F.lit(float(b)).alias("most")) for i, (s, a, b) in enumerate(zip(sizes, least, most, strict=True))])).alias("m")).select("term", "m.*")
    place = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("n"), "term"))
    taken = each.where("df > 0 AND df >= least AND df <= most").withColumn("place", place).where(F.col("place") <= vocabulary)
    got = taken.select("term", "model", F.col("df").cast("long").alias("df")).toArrow()  # models × vocabulary at most
    names = pc.dictionary_encode(got["term"].combine_chunks()) if got.num_rows else pa.DictionaryArray.from_arrays(pa.array([], pa.int32()), pa.array([], pa.string()))
    freq = np.zeros((len(sizes), len(names.dictionary)))
    freq[got["model"].to_numpy(), names.indices.to_numpy()] = got["df"].to_numpy()
    return names.dictionary, freq


def blocks(rows: DataFrame, held: list[str], names: pa.Array, idf: np.ndarray):
    """rows as an RDD of pickled blocks in the shared folder: of each row its source's number among held (or -1), its label, its
    lengths under every model; of the terms, in the order of their numbers, which rows hold them how often."""
    spark = rows.sparkSession
    squares = idf**2
    shared = spark.sparkContext.broadcast((names, pa.array(held, pa.string()), squares))

    def run(batches):
        names, held, squares = shared.value
        part, size, n = [], 0, 0

        def block():
            source, label, row, term, count = (np.concatenate(x) for x in zip(*part, strict=True))
            order = np.argsort(term, kind="stable")
            row, term, count = row[order], term[order], count[order]
            starts = np.flatnonzero(np.diff(term, prepend=-1))
            cols, lens = term[starts], np.diff(np.append(starts, len(term)))
            value = (1.0 + np.log(count)) ** 2
            norms = np.array([np.sqrt(np.bincount(row, np.repeat(s[cols], lens) * value, minlength=len(label))) for s in squares])
            small = count.astype(np.uint16 if len(count) and count.max() < 1 << 16 else np.uint32)
            made = (source.astype(np.int16), label.astype(np.int8), norms, cols.astype(np.int32), lens.astype(np.int32), row.astype(np.uint16), small)
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made, 5)], pa.binary())], names=["block"])

        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                found = pc.index_in(batch.column(2).flatten(), names)
                keep = pc.is_valid(found).to_numpy(zero_copy_only=False)
                row = pc.list_parent_indices(batch.column(2)).to_numpy()[keep]
                source = pc.fill_null(pc.index_in(batch.column(0), held), -1).to_numpy()
                part.append((source, batch.column(1).to_numpy(), row + n, found.drop_null().to_numpy(), batch.column(3).flatten().to_numpy()[keep]))
                size, n = size + len(row), n + batch.num_rows
                if size >= BLOCK or n + SLICE > BLOCK_ROWS:
                    yield block()
                    part, size, n = [], 0, 0
        if part:
            yield block()

    where = L.scratch_path(spark, "blocks")
    rows.mapInArrow(run, "block binary").rdd.map(lambda r: bytes(r[0])).saveAsPickleFile(where, 1)
    shared.destroy()
    made = spark.sparkContext.pickleFile(where)
    return made.coalesce(max(1, min(made.getNumPartitions(), spark.sparkContext.defaultParallelism, SUMS)))


def _opened(data):
    """A block's arrays: source, label, 1 / length under each model (0 where a row has none of its terms), cols, lens, starts, rows, values."""
    source, label, norms, cols, lens, rows, counts = pickle.loads(data)
    return source, label, np.divide(1.0, norms, out=np.zeros_like(norms), where=norms > 0), cols, lens, np.cumsum(lens) - lens, rows.astype(np.intp), LOGS[counts] if counts.dtype == np.uint16 else 1.0 + np.log(counts)


def _chance(m):
    return 0.5 * (1.0 + np.tanh(0.5 * m))


def passed(data, kernel, *arrays):
    """The sum over all blocks of what kernel(total, block, arrays) adds to a task's total (which begins as None)."""
    shared = data.context.broadcast(arrays)

    def run(part):
        total = None
        for x in part:
            total = kernel(total, _opened(x), *shared.value)
        if total is not None:
            yield total

    found = data.mapPartitions(run).collect()  # SUMS at most
    shared.destroy()
    return tuple(sum(x[1:], x[0]) for x in zip(*found, strict=True))


def _moments(total, block, weight, models, width):
    """For each of the models sums over its rows of weight × value / length, the same with both squared."""
    source, label, short, cols, _, starts, rows, values = block
    one, two = total or (np.zeros((len(models), width)), np.zeros((len(models), width)))
    for k, s in enumerate(models) if len(cols) else ():
        w = np.where(source == s, 0.0, weight[s][label])
        one[k, cols] += np.add.reduceat((w * short[s])[rows] * values, starts)
        two[k, cols] += np.add.reduceat((w * short[s] ** 2)[rows] * values**2, starts)
    return one, two


def _margins(s, block, v, b):
    _, label, short, cols, lens, _, rows, values = block
    return np.bincount(rows, np.repeat(v[cols], lens) * values, minlength=len(label)) * short[s] + b


def _steps(total, block, weight, models, v, b):
    """For each of the models loss, slope of the intercept and slopes of the terms at weights v (idf included) and intercept b."""
    source, label, short, cols, _, starts, rows, values = block
    loss, slope, slopes = total or (np.zeros(len(models)), np.zeros(len(models)), np.zeros(v.shape))
    for k, s in enumerate(models):
        m = _margins(s, block, v[k], b[k])
        w = np.where(source == s, 0.0, weight[s][label])
        loss[k] += w @ np.logaddexp(0.0, np.where(label == 1, -m, m))
        r = w * (_chance(m) - label)
        slope[k] += r.sum()
        if len(cols):
            slopes[k, cols] += np.add.reduceat((r * short[s])[rows] * values, starts)
    return loss, slope, slopes


def lbfgs(x: np.ndarray, iterations: int, tolerance: float, memory: int = 10):
    """Minimises as a generator: gives points, is sent (value, gradient) of each, returns the best one found."""
    value, slope = yield x
    pairs, recent, first = deque(maxlen=memory), deque([value], maxlen=memory), abs(value)
    for _ in range(iterations):
        d, kept = -slope, []
        for s, y, r in reversed(pairs):
            a = r * (s @ d)
            kept.append(a)
            d = d - a * y
        if pairs:
            s, y, r = pairs[-1]
            d = d / (r * (y @ y))
        for (s, y, r), a in zip(pairs, reversed(kept), strict=True):
            d = d + (a - r * (y @ d)) * s
        down = slope @ d
        if not down < 0:
            break
        step, low, high = 1.0 if pairs else min(1.0, 1.0 / np.sqrt(slope @ slope)), 0.0, np.inf
        for _ in range(25):
            new, its = yield x + step * d
            if not new <= value + 1e-4 * step * down:
                high = step
            elif its @ d < 0.9 * down:
                low = step
            else:
                break
            step = (low + high) / 2 if high < np.inf else 2 * step
        if not new <= value:
            break
        s, y = step * d, its - slope
        if s @ y > 0:
            pairs.append((s.astype(np.float32), y.astype(np.float32), 1.0 / (s @ y)))  # they only give directions
        x, value, slope = x + s, new, its
        if max(recent) - value <= tolerance * first or np.sqrt(slope @ slope) <= max(tolerance * abs(value), 1e-8):
            break
        recent.append(value)
    return x


def fit(data, idf: np.ndarray, counts: np.ndarray, c: float, models: list[int], iterations: int = 50, tolerance: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Weights (times idf) and intercepts of the models. counts: rows of each label (0, 1) that each model trains on. Like Spark's
    solver it works on centred terms of unit variance and penalises weights as they are."""
    total, width = counts.sum(axis=1, keepdims=True), idf.shape[1]
    weight = 1.0 / (2.0 * counts)  # labels weigh the same in all; the weights of all rows sum up to 1
    one, two = passed(data, _moments, weight, models, width)
    own, mean, scale = {}, {}, {}
    for k, s in enumerate(models):
        mean[s], squares = one[k] * idf[s], two[k] * idf[s] ** 2
        varied = squares - mean[s] ** 2
        own[s] = np.flatnonzero((idf[s] > 0) & (varied > 1e-12 * squares))  # below, all rows have the same value
        mean[s] = mean[s][own[s]]
        scale[s] = np.sqrt((1.0 - counts[s] @ weight[s] ** 2) / varied[own[s]])
    del one, two
    penalty = 1.0 / (c * total[:, 0])

    def opened(s, x):
        w = x[:-1] * scale[s]
        v = np.zeros(width)
        v[own[s]] = w * idf[s][own[s]]
        return w, v, x[-1] - w @ mean[s]

    runs, last = {s: lbfgs(np.zeros(len(own[s]) + 1), iterations, tolerance) for s in models}, {}
    at = {s: next(run) for s, run in runs.items()}
    while at:
        now = sorted(at)
        tried = {s: opened(s, at[s]) for s in now}
        loss, slope, slopes = passed(data, _steps, weight, now, np.array([tried[s][1] for s in now]), np.array([tried[s][2] for s in now]))
        for k, s in enumerate(now):
            w, mine = tried[s][0], own[s]
            by = (slopes[k][mine] * idf[s][mine] - mean[s] * slope[k] + penalty[s] * w) * scale[s]
            try:
                at[s] = runs[s].send((loss[k] + 0.5 * penalty[s] * (w @ w), np.append(by, slope[k])))
            except StopIteration as end:
                last[s] = opened(s, end.value)[1:]
                del at[s], runs[s]
    return np.array([last[s][0] for s in models]), np.array([last[s][1] for s in models])


def held_scores(data, held: list[str], models: list[int], v: np.ndarray, b: np.ndarray):
    """(source, score, label) of the rows that each of the models left out."""
    shared = data.context.broadcast((v, b))

    def run(x):
        v, b = shared.value
        block = _opened(x)
        for s in models:
            mine = np.flatnonzero(block[0] == s)
            if len(mine):
                yield from zip([held[s]] * len(mine), _chance(_margins(s, block, v[s], b[s])[mine]).tolist(), block[1][mine].tolist(), strict=True)

    return data.flatMap(run)


def leave_one_source_out(df: DataFrame, sources: list[str] | None = None, *, vocabulary: int = 40_000, min_df: float = 3.0, max_df: float = 0.95, c: float = 4.0) -> DataFrame:
    """learning.leave_one_source_out under the text model of learning.fit_text_model, without a fit for each source."""
    spark = df.sparkSession
    before = spark.conf.get(BATCHES, None)
    spark.conf.set(BATCHES, str(FEWER))
    try:
        return _leave_one_source_out(df, sources, vocabulary, min_df, max_df, c)
    finally:
        spark.conf.unset(BATCHES) if before is None else spark.conf.set(BATCHES, before)


def _leave_one_source_out(df: DataFrame, sources: list[str] | None, vocabulary: int, min_df: float, max_df: float, c: float) -> DataFrame:
    spark = df.sparkSession
    rows = term_rows(df)  # those without a label count for nothing
    seen = {(r.source, r.label): r.n for r in rows.groupBy("source", "label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two for each source
    every = sorted({s for s, _ in seen if s is not None}) if sources is None else list(sources)
    counts = {s: [sum(n for (x, y), n in seen.items() if x != s and y == label) for label in (0, 1)] for s in every}
    fitted = [s for s in every if min(counts[s]) > 0]
    rows = rows.where("label IS NOT NULL")
    size = {s: sum(counts[s]) for s in fitted}
    first, terms, out = first_terms(rows, size, vocabulary, min_df) if fitted else None, None, []
    for at in range(0, len(fitted), TOGETHER):
        held = fitted[at : at + TOGETHER]
        limits = ({s: size[s] for s in held}, vocabulary, min_df, max_df)
        made = first_vocabularies(rows, first, *limits)
        if made is None:
            terms = terms or term_counts(rows)
            made = vocabularies(terms, *limits)
        names, freq = made
        n = np.array([counts[s] for s in held], float)
        idf = np.where(freq > 0, np.log((n.sum(axis=1, keepdims=True) + 1) / (freq + 1)), 0.0)
        data = blocks(rows, held, names, idf)
        solved = [fit(data, idf, n, c, list(range(k, min(k + SOLVED, len(held))))) for k in range(0, len(held), SOLVED)]
        v, b = (np.concatenate(x) for x in zip(*solved, strict=True))
        found = L.written(spark.createDataFrame(held_scores(data, held, list(range(len(held))), v, b), "source string, score double, label int").withColumn("score", F.round("score", 3)))
        out += ev.rank_metrics(found, ev.threshold_table(found, by=["source"]), by=["source"]).select("average_precision", "roc_auc", "brier", "source").collect()  # a row for each source
    have = {r.source: tuple(r) for r in out}
    return spark.createDataFrame([have.get(s, (None, None, None, s)) for s in every], "average_precision double, roc_auc double, brier double, source string")
