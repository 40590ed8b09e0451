"""From corpus to report: families, dedup, rules, verdicts, counts with intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import stats as S
from riskloom.operators import families as fam
from riskloom.operators import rules as R
from riskloom.sources.tables import table


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each label and level: messages, the label's messages, and the share with its 95 % interval."""
    labels = table(spark, sf_dir, "labels").where("toxic IS NOT NULL").select("doc_id", F.when(F.col("toxic") == 1, "phishing").otherwise("legitimate").alias("label"))
    docs = fam.with_family(table(spark, sf_dir, "documents").select("doc_id", "text")).join(labels, "doc_id")
    kept = fam.dedup_rows(docs, label_col="label", order_col="doc_id")
    style = kept.select("doc_id", "label", R.style_cues(F.col("text"))["style_points"].alias("points"))
    words = R.keyword_evidence(kept, R.KEYWORDS, id_col="doc_id", text_col="text").groupBy("doc_id").agg(F.sum("points").alias("word_points"))
    scored = style.join(words, "doc_id", "left").withColumn("points", F.col("points") + F.coalesce("word_points", F.lit(0)))
    per = scored.groupBy("label", R.content_verdict(F.col("points"), F.lit("safe")).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    totals = per.groupBy("label").agg(F.sum("n").alias("label_n"))
    n, whole = F.col("n"), F.col("label_n")
    return per.join(totals, "label").select("label", "level", "n", "label_n", S.rate(n, whole).alias("share"), S.wilson_low(n, whole).alias("share_low"), S.wilson_high(n, whole).alias("share_high"))
