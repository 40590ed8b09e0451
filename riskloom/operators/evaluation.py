"""Cohort reports: exact counts, rates with intervals, every grouping, comparison and gates."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import stats as S


def counts() -> list[Column]:
    """Outcome counts of rows with label (phishing, legitimate) and decision (alerted, not_alerted, undetermined)."""
    out = [F.count(F.lit(1)).alias("n")]
    for label in ("phishing", "legitimate"):
        out.append(F.count_if(F.col("label") == label).alias(f"{label}_count"))
        out += [F.count_if((F.col("label") == label) & (F.col("decision") == d)).alias(f"{label}_{d}") for d in ("alerted", "not_alerted", "undetermined")]
    return out


def rates(report: DataFrame) -> DataFrame:
    """Recall and false-alert rate with their 95 % intervals; an undetermined message was not detected."""
    out = {}
    for name, hits, total in (("recall", "phishing_alerted", "phishing_count"), ("false_alert", "legitimate_alerted", "legitimate_count")):
        out[f"{name}_rate"] = S.rate(F.col(hits), F.col(total))
        out[f"{name}_low"] = S.wilson_low(F.col(hits), F.col(total))
        out[f"{name}_high"] = S.wilson_high(F.col(hits), F.col(total))
    return report.withColumns(out)


def summary(outcomes: DataFrame) -> DataFrame:
    return rates(outcomes.agg(*counts()))


def by_all_subsets(outcomes: DataFrame, dims: list[str]) -> DataFrame:
    """One report row for each group of each subset of the dimensions, in one pass; grouping_set names the subset."""
    cube = outcomes.cube(*dims).agg(*counts(), *[F.grouping(d).alias(f"_{d}") for d in dims])
    name = F.concat_ws("+", *[F.when(F.col(f"_{d}") == 0, F.lit(d)) for d in dims])
    return rates(cube.withColumn("grouping_set", name).drop(*[f"_{d}" for d in dims]))


def unreconciled(cube: DataFrame, dims: list[str], measures: list[str]) -> DataFrame:
    """Coarser groups whose measures are not the sums of the finest cells; none in a sound report."""
    full = "+".join(dims)
    cells = cube.where(F.col("grouping_set") == full)
    sums = []
    for k in range(len(dims)):
        for subset in combinations(dims, k):
            own = cells.groupBy(*subset).agg(*[F.sum(m).cast("long").alias(m) for m in measures])
            own = own.withColumns({d: F.lit(None).cast("string") for d in dims if d not in subset})
            sums.append(own.select(F.lit("+".join(subset)).alias("grouping_set"), *dims, *measures))
    expected = reduce(DataFrame.unionByName, sums)
    stated = cube.where(F.col("grouping_set") != full).select("grouping_set", *dims, *measures)
    return stated.exceptAll(expected).withColumn("side", F.lit("stated")).unionByName(expected.exceptAll(stated).withColumn("side", F.lit("summed")))


def compare(base: DataFrame, other: DataFrame, keys: list[str], measure: str, tolerance: float = 0.0) -> DataFrame:
    """Both reports side by side: base_value, other_value, delta, status (only_base, only_other, regressed, improved, same)."""
    a = base.select(*keys, F.col(measure).alias("base_value"), F.lit(True).alias("_a"))
    b = other.select(*keys, F.col(measure).alias("other_value"), F.lit(True).alias("_b"))
    both = a.join(b, keys, "full_outer")
    delta = F.round(F.col("other_value") - F.col("base_value"), 4)
    status = F.when(F.col("_b").isNull(), "only_base").when(F.col("_a").isNull(), "only_other").when(delta < -tolerance, "regressed").when(delta > tolerance, "improved").otherwise("same")
    return both.select(*keys, "base_value", "other_value", delta.alias("delta"), status.alias("status"))


def threshold_table(scores: DataFrame, by: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """scores(score, label 0/1) to one row for each distinct score: confusion counts if that score and more is positive; of
    each group, if by names columns (without nulls).

    Scores are summed before the ordering, so its single task sees distinct scores only; round them beforehand where
    they are continuous."""
    per = scores.groupBy(*by, "score").agg(F.sum("label").cast("long").alias("p"), F.sum(1 - F.col("label")).cast("long").alias("n"))
    down = Window.partitionBy(*by).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    total = per.groupBy(*by).agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    summed = per.select(*by, "score", F.sum("p").over(down).alias("tp"), F.sum("n").over(down).alias("fp"))
    return (summed.join(total, list(by)) if by else summed.crossJoin(F.broadcast(total))).select(
        *by, F.col("score").alias("threshold"), "tp", "fp", (F.col("all_p") - F.col("tp")).alias("fn"), (F.col("all_n") - F.col("fp")).alias("tn")
    )


def best_f2(table: DataFrame) -> DataFrame:
    """The threshold of largest F2, the lowest of equals."""
    f2 = F.when(F.col("tp") > 0, 5 * F.col("tp") / (5 * F.col("tp") + 4 * F.col("fn") + F.col("fp"))).otherwise(F.lit(0.0))
    return table.withColumn("f2", F.round(f2, 6)).orderBy(F.desc("f2"), "threshold").limit(1)


def best_under_fpr(table: DataFrame, cap: float) -> DataFrame:
    """The threshold of largest recall within a false-positive cap; ties by lower rate, then lower threshold."""
    fpr = F.col("fp") / F.greatest(F.col("fp") + F.col("tn"), F.lit(1))
    recall = F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    return table.withColumns({"recall": F.round(recall, 6), "fpr": F.round(fpr, 6)}).where(fpr <= cap).orderBy(F.desc("recall"), "fpr", "threshold").limit(1)


def rank_metrics(scores: DataFrame, table: DataFrame, by: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """Average precision, area under the ROC curve (ties halved) and Brier score, of each group if by names columns; the first
    two are null where the rows have one label only."""
    step = Window.partitionBy(*by).orderBy(F.desc("threshold"))
    prior = lambda c: F.coalesce(F.lag(c).over(step), F.lit(0))
    both = table.where("tp + fn > 0 AND fp + tn > 0")
    areas = both.select(*by, "tp", "fp", "fn", "tn", prior("tp").alias("tp0"), prior("fp").alias("fp0")).select(
        *by, ((F.col("tp") - F.col("tp0")) / (F.col("tp") + F.col("fn")) * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"),
        ((F.col("fp") - F.col("fp0")) * (F.col("tp") + F.col("tp0")) / 2 / (F.col("tp") + F.col("fn")) / (F.col("fp") + F.col("tn"))).alias("auc"),
    ).groupBy(*by).agg(F.round(F.sum("ap"), 6).alias("average_precision"), F.round(F.sum("auc"), 6).alias("roc_auc"))
    brier = scores.groupBy(*by).agg(F.round(F.avg((F.col("score") - F.col("label")) ** 2), 6).alias("brier"))
    return brier.join(areas, list(by), "left") if by else areas.crossJoin(brier)


def agreement(rows: DataFrame, readings: list[Column], confidence: Column, positive: Column, floors: tuple[float, ...]) -> DataFrame:
    """For each floor of confidence: rows, those kept (all readings equal and the confidence reached), coverage, and precision
    and recall of what is kept and read as positive (null without rows to rate)."""
    same = readings[0] == readings[1]
    for a, b in zip(readings[1:-1], readings[2:], strict=True):
        same = same & (a == b)
    # One pass: the counts of every floor are taken side by side.
    each = rows.select(same.alias("_same"), readings[0].alias("_read"), confidence.alias("_c"), positive.alias("_p")).withColumn("floor", F.explode(F.array(*map(F.lit, floors))))
    kept = F.col("_same") & (F.col("_c") >= F.col("floor"))
    counts = each.groupBy("floor").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(kept).alias("kept"), F.count_if(kept & F.col("_read")).alias("_read_kept"),
        F.count_if(kept & F.col("_read") & F.col("_p")).alias("_right"), F.count_if("_p").alias("_positives"),
    )
    c = F.col
    return counts.select("floor", "n", "kept", S.rate(c("kept"), c("n")).alias("coverage"), S.rate(c("_right"), c("_read_kept")).alias("precision"), S.rate(c("_right"), c("_positives")).alias("recall"))
