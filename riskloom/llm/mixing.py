"""Mixing sources to target weights: temperature mixing, with DataFrame functions only.

Weights are w ~ t^a for the sources' token counts t. The exponent a in [0, 1] is found by bisection: the smallest that
keeps every source within ``max_repetition`` passes over its documents, or, with ``target_entropy``, the largest whose
weights reach that entropy (in nats). The budget is either a number of tokens or "cover": the smallest budget at which
every source is used whole at least once, so that mixing only repeats documents and drops none.

Realisation. A source's budget is the floor of its weight times the whole. Its documents stand in an order given by a
hash (a permutation that a seed fixes), passes follow one another, and a document is used in a pass if the tokens before
it are less than the budget. The output is a row of blocks of about ``block_tokens`` tokens: a source's stream is dealt
evenly over all blocks, so each block holds the sources in their weights, and in a block the order is a new permutation.

Prefix sums over a source are taken in two levels, inside hash buckets of about ``bucket_rows`` documents and over
buckets, so a source that holds a third of all rows is not one task's work.

Defined cases: a null source is a source of its own; rows with equal id and source move together as one unit; a null or
empty text has no tokens, stands in the first pass only, and a source without tokens has weight 0 and is used once under
"cover" and not at all under a budget; ties of the hash go by id; an empty table gives no rows; other columns are
ignored; a text of any length is a document like others, and stands whole in one block however large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm._common import Scratch

STEPS = 40


def count_tokens(text) -> F.Column:
    """Runs of characters other than blanks and line ends."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\r\\n]+")), F.lit(0)).cast("long")


def order_hash(doc_id, salt: str) -> F.Column:
    """60 bits that any SQL engine with md5 gives alike."""
    key = F.concat(F.lit(f"{salt}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


#: Exponents tried in a pass over the sources, and passes: 2^-42 is left of the range in the end.
GRID, PASSES = 64, 7


def _narrowed(held: DataFrame, bounds: DataFrame, fits) -> DataFrame:
    """bounds(lo, hi) of the exponent with a grid tried between them: sums over the sources for each of its points."""
    grid = bounds.select("lo", "hi", F.explode(F.transform(F.sequence(F.lit(0), F.lit(GRID)), lambda k: F.col("lo") + (F.col("hi") - F.col("lo")) * k / F.lit(float(GRID)))).alias("a"))
    each = held.crossJoin(F.broadcast(grid))  # a source meets GRID + 1 exponents
    sums = each.groupBy("lo", "hi", "a").agg(F.sum(F.exp(F.col("a") * F.col("x"))).alias("z"), F.sum(F.exp(F.col("a") * F.col("x")) * F.col("x")).alias("zx"), F.min("x").alias("low"))
    tried = sums.withColumn("ok", fits(F.col("a"), F.col("z"), F.col("zx"), F.col("low")))
    return tried.groupBy("lo", "hi").agg(F.max(F.when(~F.col("ok"), F.col("a"))).alias("below"), F.min(F.when(F.col("ok"), F.col("a"))).alias("above")).select(
        F.coalesce("below", "lo").alias("lo"), F.coalesce("above", "hi").alias("hi"), F.col("below").isNull().alias("none_below")
    )


def _exponent(sources: DataFrame, max_repetition: float | None, target_entropy: float | None, budget: int | None) -> DataFrame:
    """(exponent, top): one row, none without tokens. Cover needs the ends of the sources' sizes only; otherwise sums over
    all sources are taken, in passes that each narrow the range by a grid, so sources are never gathered."""
    held = sources.where("tokens > 0").select(F.log(F.col("tokens").cast("double")).alias("x"))
    ends = held.agg(F.min("x").alias("low"), F.max("x").alias("top")).where("top IS NOT NULL")
    if target_entropy is None and budget is None:
        def fits(a):  # passes over a source are (top / t)^(1-a): most over the smallest source
            return F.exp((F.lit(1.0) - a) * (F.col("top") - F.col("low"))) <= F.lit(float(max_repetition))

        def halve(acc, _):
            mid = (acc["lo"] + acc["hi"]) / F.lit(2.0)
            ok = fits(mid)
            return F.struct(F.when(ok, acc["lo"]).otherwise(mid).alias("lo"), F.when(ok, mid).otherwise(acc["hi"]).alias("hi"))

        found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), halve)
        return ends.select("top", F.when(fits(F.lit(0.0)), F.lit(0.0)).otherwise(found["hi"]).alias("exponent"))

    def ok(a, z, zx, low):
        if target_entropy is not None:  # larger exponents lower the entropy
            return F.log(z) - a * zx / z < F.lit(float(target_entropy))
        return F.lit(float(budget)) * F.exp((a - F.lit(1.0)) * low) / z <= F.lit(float(max_repetition))

    bounds = ends.select(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    for step in range(PASSES):
        bounds = _narrowed(held, bounds.select("lo", "hi"), ok)
        if not step:
            zero = bounds.select(F.col("none_below").alias("zero"))  # the exponent 0 fits already
    best = bounds.select(F.col("lo" if target_entropy is not None else "hi").alias("best"))
    rows = ends.crossJoin(F.broadcast(best)).crossJoin(F.broadcast(zero))  # one row each
    return rows.select("top", F.when(F.col("zero"), F.lit(0.0)).otherwise(F.col("best")).alias("exponent"))


def weights(sources: DataFrame, *, max_repetition: float | None, target_entropy: float | None, budget: int | None) -> DataFrame:
    """sources(source, tokens, docs), a written table, with exponent, weight and budget added; one row for each source."""
    if (max_repetition is None) == (target_entropy is None):
        raise ValueError("give either max_repetition or target_entropy")
    found = _exponent(sources, max_repetition, target_entropy, budget)
    log_t = F.log(F.col("tokens").cast("double"))
    whole = sources.where("tokens > 0").crossJoin(F.broadcast(found)).groupBy("top", "exponent").agg(F.sum(F.exp(F.col("exponent") * log_t)).alias("whole"))
    rows = sources.join(F.broadcast(whole), F.lit(True), "left")  # one row of three numbers
    used = F.col("tokens") > 0
    share = F.when(used, F.exp(F.col("exponent") * log_t) / F.col("whole")).otherwise(0.0)
    if budget is None:  # the largest source is passed over exactly once
        own = F.when(used, F.floor(F.exp(F.col("exponent") * log_t + (F.lit(1.0) - F.col("exponent")) * F.col("top")) + F.lit(1e-6))).otherwise(0)
        own = F.greatest(own, F.col("tokens"))
    else:
        own = F.floor(share * F.lit(float(budget)))
    return rows.select("source", "tokens", "docs", "exponent", share.alias("weight"), own.cast("long").alias("budget"))


def mix(docs: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", max_repetition: float | None = 1.5, target_entropy: float | None = None, budget: int | None = None, block_tokens: int = 1 << 20, bucket_rows: int = 4096, salt: str = "mix", tokens: Column | None = None) -> DataFrame:
    """One row for each use of a document: doc_id, source, n_tokens, epoch, block, position (order within the block),
    weight and exponent. tokens: a document's count of tokens, by default its runs between blanks; give that of the
    tokenizer where texts have no blanks between words."""
    count = count_tokens(F.col(text_col)) if tokens is None else F.coalesce(tokens, F.lit(0)).cast("long")
    units = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), count.alias("n_tokens"))
    units = scratch.write(units.groupBy("doc_id", "source").agg(F.sum("n_tokens").alias("n_tokens")), "units")
    sizes = scratch.write(units.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "sizes")
    sources = scratch.write(weights(sizes, max_repetition=max_repetition, target_entropy=target_entropy, budget=budget), "sources")
    total = F.broadcast(sources.agg(F.sum("budget").alias("all_tokens")))  # one number
    per_source = sources.crossJoin(total).select(F.col("source").alias("s"), "tokens", "docs", "budget", "weight", "exponent", "all_tokens")

    # The hash, 60 bits, falls into ceil(docs / bucket_rows) equal ranges.
    unit = F.col("key").cast("double") / F.lit(float(1 << 60))
    buckets = F.ceil(F.col("docs") / F.lit(float(bucket_rows)))
    rows = units.withColumn("key", order_hash(F.col("doc_id"), salt)).join(per_source, F.col("source").eqNullSafe(F.col("s")))
    rows = rows.withColumn("bucket", F.least(F.floor(unit * buckets), buckets - 1).cast("long"))
    sums = rows.groupBy(F.col("s").alias("bs"), F.col("bucket").alias("bb")).agg(F.sum("n_tokens").alias("n"))
    over = Window.partitionBy("bs").orderBy("bb").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("bs", "bb", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("base"))
    inside = Window.partitionBy("s", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    placed = placed.join(bases, F.col("s").eqNullSafe(F.col("bs")) & (F.col("bucket") == F.col("bb"))).withColumn("before", F.col("before") + F.col("base"))

    # Passes in which the tokens before this document are still less than the budget.
    passes = F.when(F.col("tokens") > 0, F.floor((F.col("budget") - F.col("before") + F.col("tokens") - 1) / F.col("tokens"))).otherwise(F.lit(1 if budget is None else 0))
    passes = F.when(F.col("n_tokens") == 0, F.least(passes, F.lit(1))).otherwise(passes)
    if budget is None:
        passes = F.greatest(passes, F.lit(1))
    placed = placed.withColumn("passes", passes.cast("int")).where("passes > 0")
    used = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("all_tokens") / F.lit(float(block_tokens))))
    at = (F.col("epoch") * F.col("tokens") + F.col("before")).cast("double") / F.greatest(F.col("budget"), F.lit(1))
    return used.select(
        "doc_id", "source", "n_tokens", F.col("epoch").cast("int").alias("epoch"),
        F.least(F.floor(at * blocks), blocks - 1).cast("long").alias("block"),
        order_hash(F.concat_ws(":", F.col("epoch"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), f"{salt}-block").alias("position"),
        "weight", "exponent",
    )
