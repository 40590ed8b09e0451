"""Families of equal canonical text: dedup, conflicts, precedence, campaigns and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import records as X
from riskloom.functions import text as T


def with_family(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.withColumn("family", T.family_id(F.coalesce(text_col, F.lit(""))))


def dedup(df: DataFrame, *, label_col: str, order: list[Column], family_col: str = "family") -> DataFrame:
    """Adds family_rows, conflict (its labels differ) and kept (first of a family without conflict).

    One shuffle by family serves both. A family with more rows than a task should sort costs time there, not memory:
    the window streams over sorted rows."""
    whole = Window.partitionBy(family_col)
    first = F.row_number().over(whole.orderBy(*order))
    conflict = F.min(label_col).over(whole) != F.max(label_col).over(whole)
    return df.withColumns({"family_rows": F.count(F.lit(1)).over(whole), "conflict": F.coalesce(conflict, F.lit(False)), "place": first}).withColumn(
        "kept", ~F.col("conflict") & (F.col("place") == 1)
    )


def dedup_rows(df: DataFrame, *, label_col: str, order_col: str, family_col: str = "family") -> DataFrame:
    """The kept rows only. Statistics of a family are combined before the shuffle, so a hot family is cheap."""
    stats = df.groupBy(family_col).agg(F.min(label_col).alias("_lo"), F.max(label_col).alias("_hi"), F.min(order_col).alias("_first"))
    stats = stats.where(F.coalesce(F.col("_lo") == F.col("_hi"), F.lit(True))).select(F.col(family_col).alias("_family"), "_first")
    return df.join(stats, (F.col(family_col) == F.col("_family")) & (F.col(order_col) == F.col("_first"))).drop("_family", "_first")


def dedup_keys(df: DataFrame, *, label_col: str, order: list[str], family_col: str = "family") -> DataFrame:
    """The kept rows of a table without long columns, in one aggregation: a family's first row in a total order, unless its
    labels differ. Nothing is computed twice and nothing joined."""
    others = [c for c in df.columns if c != family_col]
    first = df.groupBy(family_col).agg(F.min(label_col).alias("_lo"), F.max(label_col).alias("_hi"), F.min(F.struct(*order, *[c for c in others if c not in order])).alias("_m"))
    kept = first.where(F.coalesce(F.col("_lo") == F.col("_hi"), F.lit(True)))
    return kept.select(*[F.col(family_col) if c == family_col else F.col(f"_m.{c}") for c in df.columns])


def removal_counts(marked: DataFrame) -> DataFrame:
    """kept, duplicates and conflicts of dedup's result."""
    return marked.agg(
        F.count_if("kept").alias("kept_rows"),
        F.count_if(~F.col("conflict") & ~F.col("kept")).alias("duplicate_rows"),
        F.count_if("conflict").alias("conflict_rows"),
    )


def exclude_reserved(df: DataFrame, reserved: DataFrame, family_col: str = "family") -> DataFrame:
    return df.join(reserved.select(family_col).distinct(), family_col, "left_anti")


def hash_split(df: DataFrame, key: Column, *, salt: str, fraction: float, name: str = "held_out") -> DataFrame:
    """Rows whose digest's first byte is less than 256 times the fraction are held out; needs no other row."""
    return df.withColumn(name, T.salted_share(key, salt) < F.lit(256 * fraction))


def seeded_cap(df: DataFrame, *, group_col: str, key: Column, salt: str, n: int) -> DataFrame:
    """At most n rows of each group, those of smallest salted digest."""
    digest = F.sha2(F.concat(F.lit(salt + ":"), key.cast("string")).cast("binary"), 256)
    return df.withColumn("place", F.row_number().over(Window.partitionBy(group_col).orderBy(digest, key))).where(F.col("place") <= n)


def time_partitions(df: DataFrame, *, ts_col: str, validation_from: str, holdout_from: str, family_col: str) -> DataFrame:
    """role by date (undated rows train); a family stays in its latest partition only."""
    ts = F.col(ts_col)
    rank = F.when(ts >= F.lit(holdout_from).cast("date"), 2).when(ts >= F.lit(validation_from).cast("date"), 1).otherwise(0)
    ranked = df.withColumn("_rank", rank)
    latest = ranked.groupBy(family_col).agg(F.max("_rank").alias("_latest"))
    role = F.element_at(F.array(F.lit("train"), F.lit("validation"), F.lit("holdout")), F.col("_rank") + 1)
    return ranked.join(latest, family_col).where(F.col("_rank") == F.col("_latest")).withColumn("role", role).drop("_rank", "_latest")


def split_with_ledger(df: DataFrame, ledger: DataFrame | None, *, family_col: str, order: list[str], ts_col: str, fresh_from: str, key: bytes, share: float, first: int = 3) -> DataFrame:
    """Rows with role, known (the family stands in the ledger) and reason. A family keeps the role that the ledger(family,
    role) gives it; a new one is held out if a keyed digest draws it and none of its rows is older than fresh_from. Of a
    held-out family only its first few rows are kept."""
    drawn = F.conv(F.substring(X.hmac_sha256(key, F.col(family_col).cast("string")), 1, 2), 16, 10).cast("int") < F.lit(256 * share)
    oldest = df.groupBy(family_col).agg(F.min(ts_col).alias("_first"))
    roles = oldest.select(F.col(family_col).alias("_f"), F.when(drawn & (F.col("_first") >= F.lit(fresh_from).cast("date")), "holdout").otherwise("development").alias("_role"))
    if ledger is None:
        roles = roles.withColumn("_old", F.lit(None).cast("string"))
    else:
        roles = roles.join(ledger.select(F.col(family_col).alias("_f"), F.col("role").alias("_old")), "_f", "left")
    rows = df.join(roles, F.col(family_col) == F.col("_f")).withColumns({"role": F.coalesce("_old", "_role"), "known": F.col("_old").isNotNull()})
    place = F.row_number().over(Window.partitionBy(family_col).orderBy(*order))
    return rows.withColumn("reason", F.when((F.col("role") == "holdout") & (place > first), "beyond_first_three").otherwise("kept")).drop("_f", "_role", "_old")


def ledger(split: DataFrame, family_col: str) -> DataFrame:
    """family and role of every family of a split, to be kept for the next run."""
    return split.groupBy(family_col).agg(F.max("role").alias("role"))
