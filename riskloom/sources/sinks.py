"""Sinks: splits by role, aggregate reports, snapshots that prove themselves, synthetic corpora from templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_split(df: DataFrame, path: str, role_col: str = "role") -> None:
    """One folder for each role."""
    df.write.partitionBy(role_col).parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """An aggregate report as JSON lines, its columns in alphabetical order, in one file: reports have few rows."""
    report.select(*sorted(report.columns)).coalesce(1).write.json(path)


def digest(df: DataFrame) -> DataFrame:
    """rows and an order-independent sum of the rows' hashes: equal for equal tables, one row, no gathering."""
    value = F.xxhash64(*sorted(df.columns))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(value.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias("digest"))


def snapshot(df: DataFrame, path: str) -> None:
    """Writes a table and beside it what proves it."""
    df.write.parquet(f"{path}/table")
    digest(df.sparkSession.read.parquet(f"{path}/table")).write.json(f"{path}/proof")


def restore(spark: SparkSession, path: str) -> DataFrame:
    """The table of a snapshot; raises ValueError if it is not what was written."""
    table = spark.read.parquet(f"{path}/table")
    want, found = spark.read.schema("rows long, digest string").json(f"{path}/proof").first(), digest(table).first()
    if (want.rows, want.digest) != (found.rows, found.digest):
        raise ValueError(f"the snapshot at {path} was changed")
    return table


def from_templates(templates: DataFrame, variants: int, fills: dict[str, list[str]], salt: str = "variant") -> DataFrame:
    """templates(template, label) times variants, each {name} filled by a hash of template, variant and name: the same on
    every run. Adds variant, text and group_id (the template's, so that its variants stay together in splits)."""
    rows = templates.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))))
    text = F.col("template")
    for name, options in fills.items():
        pick = F.pmod(F.xxhash64(F.lit(salt), "template", "variant", F.lit(name)), F.lit(len(options)))
        text = F.replace(text, F.lit("{" + name + "}"), F.element_at(F.array(*map(F.lit, options)), (pick + 1).cast("int")))
    return rows.withColumns({"text": text, "group_id": F.concat(F.lit("template:"), F.substring(F.sha2(F.col("template").cast("binary"), 256), 1, 20))})
