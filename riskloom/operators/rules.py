"""Rules over text as evidence, and the fusion of evidence into graded verdicts.

Evidence is long: one row (id, code, points, floor) for each finding. Levels are ordered by rank, never by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import text as T
from riskloom.functions import words as W
from riskloom.operators.vocabulary import KEYWORDS

#: Levels from least to most severe, the score that stands for a floor, and the bounds of points.
LEVELS = ("safe", "low", "medium", "high", "critical")
FLOOR_SCORES = {"safe": 0.0, "low": 0.1, "medium": 0.3, "high": 0.55, "critical": 0.8}
FULL_SCALE = 16

def keyword_table(spark, keywords: dict | None = None) -> DataFrame:
    """(category, level, keyword) rows; a dimension whose size does not follow the data."""
    rows = [(c, level, k) for c, (level, words) in (keywords or KEYWORDS).items() for k in words]
    return spark.createDataFrame(rows, "category string, level string, keyword string")


def keyword_evidence(df: DataFrame, keywords: dict[str, tuple[str, tuple[str, ...]]], *, id_col: str, text_col: str, cap: int = 5) -> DataFrame:
    """One row for each category that matches: id, category, level, matched (keywords), points (at most cap).

    A text is made plain once, its words meet the keywords' first words by hash, and only keywords that begin with a word of the
    text are searched for in it; no join is made."""
    rows = W.once(df.select(F.col(id_col), F.col(text_col).alias("_text")), "_plain", W.plain(F.col("_text")))
    rows = W.once(rows, "_firsts", W.first_words(F.col("_plain"), tuple(w for _, words in keywords.values() for w in words)))
    found = [F.struct(F.lit(c).alias("category"), F.lit(level).alias("level"), W.held_after(F.col("_plain"), F.col("_firsts"), words).alias("matched")) for c, (level, words) in keywords.items()]
    rows = rows.select(id_col, F.explode(F.array(*found)).alias("e")).where(F.size("e.matched") > 0)
    return rows.select(id_col, "e.category", "e.level", F.array_sort("e.matched").alias("matched"), F.least(F.size("e.matched"), F.lit(cap)).cast("long").alias("points"))


def style_cues(text: Column) -> dict[str, Column]:
    """Presentation cues: exclamation marks, share of capitals, question marks, and their points."""
    marks, share = T.count_char(text, "!"), T.capitals_share(text)
    return {
        "exclamations": marks.cast("long"),
        "capitals_share": F.round(share, 4),
        "questions": T.count_char(text, "?").cast("long"),
        "style_points": (F.when(marks >= 3, 1).otherwise(0) + F.when((share > 0.4) & (F.length(text) > 60), 1).otherwise(0)).cast("long"),
    }


def rank(level: Column) -> Column:
    out = F.lit(-1)
    for i, name in enumerate(LEVELS):
        out = F.when(level == name, i).otherwise(out)
    return out


def level_of(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LEVELS]), (number + 1).cast("int"))


def content_verdict(points: Column, floor: Column) -> Column:
    """Level from points and floor alone."""
    return (
        F.when(points > 15, "critical")
        .when(floor.isin("high", "critical"), F.when(floor == "critical", "critical").otherwise("high"))
        .when((floor == "medium") & (points <= 8), "medium")
        .when(points == 0, "safe").when(points <= 3, "low").when(points <= 8, "medium").otherwise("high")
    )


def floor_score(floor: Column) -> Column:
    out = F.lit(0.0)
    for name, value in FLOOR_SCORES.items():
        out = F.when(floor == name, F.lit(value)).otherwise(out)
    return out


def fused_verdict(points: Column, presentation: Column, floor: Column, model: Column, threshold: float, original: Column) -> dict[str, Column]:
    """Rules and a model's probability (null: no model) as one level, its score, and whether the model stands alone.

    Presentation points count only while the model does not read the message as legitimate. A model without independent
    support, on an original message, is a note; on pasted text it is a medium warning."""
    signal = F.coalesce(model >= threshold, F.lit(False))
    counted_points = F.when(model.isNotNull() & ~signal, F.greatest(points - presentation, F.lit(0))).otherwise(points)
    rule = F.greatest(F.least(counted_points / FULL_SCALE, F.lit(1.0)), floor_score(floor))
    support = (counted_points >= 9) | floor.isin("high", "critical")
    alone = signal & (rule < 0.1)
    note = alone & original
    counted_model = F.when(signal & ~note, F.coalesce(model, F.lit(0.0))).otherwise(F.least(F.coalesce(model, F.lit(0.0)), F.lit(0.29)))
    score = F.greatest(rule, F.when(model.isNotNull(), counted_model).otherwise(F.lit(0.0)))
    level = (
        F.when((floor == "critical") | (rule >= 0.8) | (F.coalesce(model >= 0.8, F.lit(False)) & support), "critical")
        .when((floor == "high") | (rule >= 0.55) | (signal & ~alone), "high")
        .when(alone, F.when(original, "low").otherwise("medium"))
        .when(score >= 0.3, "medium").when(score >= 0.1, "low").otherwise("safe")
    )
    return {"score": F.round(score, 4), "level": level, "model_alone": alone}


def decision(level: Column) -> Column:
    return F.when(level == "unknown", "undetermined").when(level.isin("medium", "high", "critical"), "alerted").otherwise("not_alerted")


def abstain(level: Column, complete: Column, tokens: Column, chars: Column) -> Column:
    """Unknown in place of a calm verdict on what was not read whole, or is too short (5 tokens, 40 characters)."""
    return F.when(level.isin("safe", "low") & (~complete | (tokens < 5) | (chars < 40)), "unknown").otherwise(level)


def merge_evidence(evidence: DataFrame, id_col: str) -> DataFrame:
    """Points and floor of each message from its evidence rows: sums of points, the highest floor."""
    return evidence.groupBy(id_col).agg(F.sum("points").cast("long").alias("points"), F.max(rank(F.col("floor"))).alias("_floor")).select(
        id_col, "points", F.when(F.col("_floor") > 0, level_of(F.col("_floor"))).otherwise("safe").alias("floor")
    )
