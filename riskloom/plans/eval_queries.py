"""Queries of cohort evaluation, rules and fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import stats as S
from riskloom.functions import text as T
from riskloom.functions import words as W
from riskloom.operators import evaluation as ev
from riskloom.operators import rules as R
from riskloom.operators import vocabulary as VOCABULARY
from riskloom.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


CAPS_SQL = r"CASE WHEN length(regexp_replace(text, '[^\p{L}]', '', 'g')) > 0 THEN CAST(length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS DOUBLE) / length(regexp_replace(text, '[^\p{L}]', '', 'g')) ELSE CAST(0 AS DOUBLE) END"
MARKS_SQL = "(length(text) - length(replace(text, '!', '')))"
#: A rule's decision: many exclamation marks or capitals alert; texts of under 40 characters are undetermined.
OUTCOMES_SQL = f"""outcomes AS (SELECT d.doc_id, lang, source, CASE toxic WHEN 1 THEN 'phishing' ELSE 'legitimate' END AS label,
  CASE WHEN length(text) < 40 THEN 'undetermined' WHEN {MARKS_SQL} >= 3 OR {CAPS_SQL} > 0.4 THEN 'alerted' ELSE 'not_alerted' END AS decision
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE toxic IS NOT NULL)"""
COUNTS_SQL = """count(*) AS n, count(*) FILTER (WHERE label = 'phishing') AS phishing_count, count(*) FILTER (WHERE label = 'phishing' AND decision = 'alerted') AS phishing_alerted,
  count(*) FILTER (WHERE label = 'phishing' AND decision = 'not_alerted') AS phishing_not_alerted, count(*) FILTER (WHERE label = 'phishing' AND decision = 'undetermined') AS phishing_undetermined,
  count(*) FILTER (WHERE label = 'legitimate') AS legitimate_count, count(*) FILTER (WHERE label = 'legitimate' AND decision = 'alerted') AS legitimate_alerted,
  count(*) FILTER (WHERE label = 'legitimate' AND decision = 'not_alerted') AS legitimate_not_alerted, count(*) FILTER (WHERE label = 'legitimate' AND decision = 'undetermined') AS legitimate_undetermined"""


def wilson_sql(k: str, n: str, sign: str) -> str:
    z = "CAST(1.959963984540054 AS DOUBLE)"
    centre = f"(({k}) / CAST({n} AS DOUBLE) + {z} * {z} / (2 * CAST({n} AS DOUBLE))) / (1 + {z} * {z} / {n})"
    margin = f"{z} * sqrt(({k}) / CAST({n} AS DOUBLE) * (1 - ({k}) / CAST({n} AS DOUBLE)) / {n} + {z} * {z} / (4 * CAST({n} AS DOUBLE) * {n})) / (1 + {z} * {z} / {n})"
    if sign == "-":
        return f"CASE WHEN {n} > 0 THEN round(CASE WHEN {k} = 0 THEN CAST(0 AS DOUBLE) ELSE greatest(CAST(0 AS DOUBLE), {centre} - {margin}) END, 4) END"
    return f"CASE WHEN {n} > 0 THEN round(CASE WHEN {k} = {n} THEN CAST(1 AS DOUBLE) ELSE least(CAST(1 AS DOUBLE), {centre} + {margin}) END, 4) END"


def rates_sql(source: str) -> str:
    parts = []
    for name, k, n in (("recall", "phishing_alerted", "phishing_count"), ("false_alert", "legitimate_alerted", "legitimate_count")):
        parts += [f"CASE WHEN {n} > 0 THEN round(CAST({k} AS DOUBLE) / {n}, 4) END AS {name}_rate", f"{wilson_sql(k, n, '-')} AS {name}_low", f"{wilson_sql(k, n, '+')} AS {name}_high"]
    return f"SELECT *, {', '.join(parts)} FROM {source}"


def outcomes(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").where("toxic IS NOT NULL").select("doc_id", F.when(F.col("toxic") == 1, "phishing").otherwise("legitimate").alias("label"))
    text = F.col("text")
    decision = F.when(F.length(text) < 40, "undetermined").when((T.count_char(text, "!") >= 3) | (T.capitals_share(text) > 0.4), "alerted").otherwise("not_alerted")
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", decision.alias("decision"))
    return rows.join(labels, "doc_id")


@query(f"WITH {OUTCOMES_SQL}, s AS (SELECT {COUNTS_SQL} FROM outcomes) {rates_sql('s')}")
def label_decision_summary(spark, sf_dir):
    return ev.summary(outcomes(spark, sf_dir))


@query(f"WITH {OUTCOMES_SQL}, s AS (SELECT lang, source, concat_ws('+', CASE WHEN grouping(lang) = 0 THEN 'lang' END, CASE WHEN grouping(source) = 0 THEN 'source' END) AS grouping_set, {COUNTS_SQL} FROM outcomes GROUP BY CUBE (lang, source)) {rates_sql('s')}")
def grouped_cube_summary(spark, sf_dir):
    return ev.by_all_subsets(outcomes(spark, sf_dir), ["lang", "source"])


@query(f"""WITH {OUTCOMES_SQL}, c AS (SELECT lang, source, grouping(lang) AS gl, grouping(source) AS gs, count(*) AS n FROM outcomes GROUP BY CUBE (lang, source)),
cells AS (SELECT * FROM c WHERE gl = 0 AND gs = 0),
bad AS (SELECT 1 FROM c JOIN (SELECT lang, sum(n) AS s FROM cells GROUP BY 1) x ON c.lang = x.lang AND gl = 0 AND gs = 1 WHERE n <> s
  UNION ALL SELECT 1 FROM c JOIN (SELECT source, sum(n) AS s FROM cells GROUP BY 1) x ON c.source = x.source AND gl = 1 AND gs = 0 WHERE n <> s
  UNION ALL SELECT 1 FROM c, (SELECT sum(n) AS s FROM cells) WHERE gl = 1 AND gs = 1 AND n <> s)
SELECT (SELECT count(*) FROM bad) AS unreconciled, (SELECT count(*) FROM c) AS report_rows""")
def marginals_reconcile(spark, sf_dir):
    cube = ev.by_all_subsets(outcomes(spark, sf_dir), ["lang", "source"])
    bad = ev.unreconciled(cube, ["lang", "source"], ["n", "phishing_alerted", "legitimate_alerted"])
    return bad.agg(F.count(F.lit(1)).alias("unreconciled")).crossJoin(cube.agg(F.count(F.lit(1)).alias("report_rows")))


@query(f"""WITH {OUTCOMES_SQL},
a AS (SELECT lang, source, round(avg(CASE WHEN decision = 'alerted' THEN 1.0 ELSE 0.0 END), 4) AS v FROM outcomes GROUP BY 1, 2),
b AS (SELECT o.lang, o.source, round(avg(CASE WHEN {CAPS_SQL} > 0.4 THEN 1.0 ELSE 0.0 END), 4) AS v FROM outcomes o JOIN documents d USING (doc_id) WHERE o.lang <> 'es' GROUP BY 1, 2)
SELECT coalesce(a.lang, b.lang) AS lang, coalesce(a.source, b.source) AS source, a.v AS base_value, b.v AS other_value, round(b.v - a.v, 4) AS delta,
  CASE WHEN b.lang IS NULL THEN 'only_base' WHEN a.lang IS NULL THEN 'only_other' WHEN round(b.v - a.v, 4) < 0 THEN 'regressed' WHEN round(b.v - a.v, 4) > 0 THEN 'improved' ELSE 'same' END AS status
FROM a FULL JOIN b ON a.lang = b.lang AND a.source = b.source""")
def report_compare(spark, sf_dir):
    rows = outcomes(spark, sf_dir)
    base = rows.groupBy("lang", "source").agg(F.round(F.avg(F.when(F.col("decision") == "alerted", 1.0).otherwise(0.0)), 4).alias("value"))
    texts = table(spark, sf_dir, "documents").select("doc_id", T.capitals_share(F.col("text")).alias("caps"))
    other = rows.where("lang <> 'es'").join(texts, "doc_id").groupBy("lang", "source").agg(F.round(F.avg(F.when(F.col("caps") > 0.4, 1.0).otherwise(0.0)), 4).alias("value"))
    return ev.compare(base, other, ["lang", "source"], "value")


@query(f"""WITH {OUTCOMES_SQL}, cells AS (SELECT * FROM (SELECT DISTINCT lang FROM outcomes), (SELECT DISTINCT label FROM outcomes))
SELECT c.lang, c.label, count(o.doc_id) AS n, count(o.doc_id) >= 50 AS covered FROM cells c LEFT JOIN outcomes o ON o.lang = c.lang AND o.label = c.label GROUP BY 1, 2""")
def release_coverage_gate(spark, sf_dir):
    """Every cell of language and label with whether it has the 50 rows that a release needs; empty cells count as 0."""
    per = outcomes(spark, sf_dir).groupBy("lang", "label").agg(F.count(F.lit(1)).alias("n"))
    cells = per.select("lang").distinct().crossJoin(per.select("label").distinct())
    n = F.coalesce("n", F.lit(0).cast("long"))
    return cells.join(per, ["lang", "label"], "left").select("lang", "label", n.alias("n"), (n >= 50).alias("covered"))


#: The query's keywords: the rules' own, and words that the synthetic texts do hold.
WORDS = {**VOCABULARY.KEYWORDS, "common": ("low", ("the", "and", "of", "les", "der", "und", "los")), "licence": ("medium", ("licensed under", "all rights reserved", "released under"))}


def keywords_sql(source: str) -> str:
    rows = ", ".join(f"{{'category': '{c}', 'level': '{level}', 'matched': list_sort({W.held_sql('plain', words)})}}" for c, (level, words) in WORDS.items())
    return f"""WITH p AS (SELECT doc_id, {W.plain_sql('text')} AS plain FROM {source}), e AS (SELECT doc_id, unnest([{rows}]) AS e FROM p)
SELECT doc_id, e.category AS category, e.level AS level, e.matched AS matched, CAST(least(len(e.matched), 5) AS BIGINT) AS points FROM e WHERE len(e.matched) > 0"""


@query(keywords_sql("documents"))
def keyword_categories(spark, sf_dir):
    return R.keyword_evidence(table(spark, sf_dir, "documents"), WORDS, id_col="doc_id", text_col="text")


@query(f"""SELECT doc_id, CAST({MARKS_SQL} AS BIGINT) AS exclamations, round({CAPS_SQL}, 4) AS capitals_share, CAST(length(text) - length(replace(text, '?', '')) AS BIGINT) AS questions,
CAST((CASE WHEN {MARKS_SQL} >= 3 THEN 1 ELSE 0 END) + (CASE WHEN {CAPS_SQL} > 0.4 AND length(text) > 60 THEN 1 ELSE 0 END) AS BIGINT) AS style_points FROM documents""")
def caps_exclaim_style(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(k) for k, c in R.style_cues(F.col("text")).items()])


@query("""SELECT p_partkey, translate(replace(replace(replace(replace(lower(p_name), 'vv', 'w'), 'rn', 'm'), 'nn', 'm'), 'cl', 'd'), '0134568@', 'oleasgba') AS folded,
translate(replace(replace(replace(replace(lower(p_name), 'vv', 'w'), 'rn', 'm'), 'nn', 'm'), 'cl', 'd'), '0134568@', 'oleasgba') <> lower(p_name) AS changed FROM part""")
def leet_fold(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.leet_fold(F.col("p_name")).alias("folded")).join(
        table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("low")), "p_partkey"
    ).select("p_partkey", "folded", (F.col("folded") != F.col("low")).alias("changed"))


@query(r"""SELECT doc_id, list_slice(list_filter(regexp_extract_all(text, '[$€£¥] ?\d[\d.,]*'), lambda a: length(regexp_replace(regexp_replace(a, '[.,]\d{1,2}$', ''), '\D', '', 'g')) >= 5 AND length(a) <= 80), 1, 4) AS amounts FROM documents""")
def large_amounts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.large_amounts(F.col("text")).alias("amounts"))


@query(r"""WITH a AS (SELECT doc_id, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '<address>', 'g') AS t FROM documents),
m AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '(?:\d[ -]?){13,19}', '<card>', 'g'), '\+?\d[\d ()-]{7,}\d', '<phone>', 'g'), '\d{4,8}', '<code>', 'g') AS t FROM a)
SELECT doc_id, sha256(t) AS digest, t LIKE '%<address>%' AS has_address, t LIKE '%<phone>%' AS has_phone FROM m""")
def pii_mask(spark, sf_dir):
    out = table(spark, sf_dir, "documents").select("doc_id", T.mask_private(F.col("text")).alias("t"))
    return out.select("doc_id", F.sha2(F.col("t").cast("binary"), 256).alias("digest"), F.col("t").contains("<address>").alias("has_address"), F.col("t").contains("<phone>").alias("has_phone"))


def fused_sql() -> str:
    floor = "CASE floor WHEN 'low' THEN CAST(0.1 AS DOUBLE) WHEN 'medium' THEN CAST(0.3 AS DOUBLE) WHEN 'high' THEN CAST(0.55 AS DOUBLE) WHEN 'critical' THEN CAST(0.8 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"
    return f"""WITH floors AS (SELECT unnest(['safe', 'medium', 'high', 'critical']) AS floor), models AS (SELECT unnest([NULL, CAST(0.1 AS DOUBLE), CAST(0.5 AS DOUBLE), CAST(0.9 AS DOUBLE)]) AS model),
docs AS (SELECT doc_id, CAST(least({MARKS_SQL}, 20) AS BIGINT) AS points, CAST(least({MARKS_SQL}, 2) AS BIGINT) AS presentation, doc_id % 2 = 0 AS original FROM documents),
a AS (SELECT *, coalesce(model >= 0.3736, false) AS signal FROM docs, floors, models),
b AS (SELECT *, CASE WHEN model IS NOT NULL AND NOT signal THEN greatest(points - presentation, 0) ELSE points END AS cp FROM a),
c AS (SELECT *, greatest(least(cp / CAST(16 AS DOUBLE), CAST(1 AS DOUBLE)), {floor}) AS rule, cp >= 9 OR floor IN ('high', 'critical') AS support FROM b),
d AS (SELECT *, signal AND rule < 0.1 AS alone FROM c),
e AS (SELECT *, greatest(rule, CASE WHEN model IS NULL THEN CAST(0 AS DOUBLE) WHEN signal AND NOT (alone AND original) THEN model ELSE least(model, CAST(0.29 AS DOUBLE)) END) AS score FROM d)
SELECT floor, model, points, original, round(score, 4) AS score, CASE WHEN floor = 'critical' OR rule >= 0.8 OR (coalesce(model >= 0.8, false) AND support) THEN 'critical'
  WHEN floor = 'high' OR rule >= 0.55 OR (signal AND NOT alone) THEN 'high' WHEN alone THEN CASE WHEN original THEN 'low' ELSE 'medium' END
  WHEN score >= 0.3 THEN 'medium' WHEN score >= 0.1 THEN 'low' ELSE 'safe' END AS level, alone AS model_alone, count(*) AS n FROM e GROUP BY ALL"""


@query(fused_sql())
def fusion_verdict(spark, sf_dir):
    marks = T.count_char(F.col("text"), "!")
    rows = table(spark, sf_dir, "documents").select(F.least(marks, F.lit(20)).cast("long").alias("points"), F.least(marks, F.lit(2)).cast("long").alias("presentation"), (F.col("doc_id") % 2 == 0).alias("original"))
    rows = rows.groupBy("points", "presentation", "original").agg(F.count(F.lit(1)).alias("n"))
    grid = rows.withColumn("floor", F.explode(F.array(*map(F.lit, ("safe", "medium", "high", "critical"))))).withColumn("model", F.explode(F.array(F.lit(None).cast("double"), F.lit(0.1), F.lit(0.5), F.lit(0.9))))
    out = grid.withColumns(R.fused_verdict(F.col("points"), F.col("presentation"), F.col("floor"), F.col("model"), 0.3736, F.col("original")))
    return out.groupBy("floor", "model", "points", "original", "score", "level", "model_alone").agg(F.sum("n").cast("long").alias("n"))


@query(f"""WITH r AS (SELECT doc_id, text, CASE WHEN {MARKS_SQL} > 15 THEN 'critical' WHEN {MARKS_SQL} = 0 THEN 'safe' WHEN {MARKS_SQL} <= 3 THEN 'low' WHEN {MARKS_SQL} <= 8 THEN 'medium' ELSE 'high' END AS level FROM documents)
SELECT doc_id, level, CASE WHEN level IN ('safe', 'low') AND (length(text) > 20000 OR len(str_split(trim(text), ' ')) < 5 OR length(text) < 40) THEN 'unknown' ELSE level END AS verdict FROM r""")
def abstention_verdict(spark, sf_dir):
    text = F.col("text")
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", R.content_verdict(T.count_char(text, "!"), F.lit("safe")).alias("level"))
    return rows.select("doc_id", "level", R.abstain(F.col("level"), F.length(text) <= 20000, F.size(F.split(F.trim(text), " ")), F.length(text)).alias("verdict"))


SCORES_SQL = f"scores AS (SELECT round({CAPS_SQL}, 2) AS score, toxic AS label FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL)"
TABLE_SQL = """per AS (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM scores GROUP BY 1),
t AS (SELECT score AS threshold, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS fp, CAST((SELECT sum(p) FROM per) - sum(p) OVER w AS BIGINT) AS fn, CAST((SELECT sum(n) FROM per) - sum(n) OVER w AS BIGINT) AS tn FROM per WINDOW w AS (ORDER BY score DESC))"""


def scores(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").where("toxic IS NOT NULL").select("doc_id", F.col("toxic").alias("label"))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(T.capitals_share(F.col("text")), 2).alias("score")).join(labels, "doc_id").select("score", "label")


@query(f"WITH {SCORES_SQL}, {TABLE_SQL} SELECT *, round(CASE WHEN tp > 0 THEN 5.0 * tp / (5 * tp + 4 * fn + fp) ELSE 0 END, 6) AS f2 FROM t ORDER BY f2 DESC, threshold LIMIT 1")
def threshold_f2(spark, sf_dir):
    return ev.best_f2(ev.threshold_table(scores(spark, sf_dir)))


@query(f"WITH {SCORES_SQL}, {TABLE_SQL} SELECT *, round(CAST(tp AS DOUBLE) / greatest(tp + fn, 1), 6) AS recall, round(CAST(fp AS DOUBLE) / greatest(fp + tn, 1), 6) AS fpr FROM t WHERE CAST(fp AS DOUBLE) / greatest(fp + tn, 1) <= 0.2 ORDER BY recall DESC, fpr, threshold LIMIT 1")
def threshold_at_fpr(spark, sf_dir):
    return ev.best_under_fpr(ev.threshold_table(scores(spark, sf_dir)), 0.2)


@query(f"""WITH {SCORES_SQL}, {TABLE_SQL}, l AS (SELECT *, coalesce(lag(tp) OVER (ORDER BY threshold DESC), 0) AS tp0, coalesce(lag(fp) OVER (ORDER BY threshold DESC), 0) AS fp0 FROM t)
SELECT round(sum(CAST(tp - tp0 AS DOUBLE) / (tp + fn) * tp / (tp + fp)), 6) AS average_precision, round(sum(CAST(fp - fp0 AS DOUBLE) * (tp + tp0) / 2 / (tp + fn) / (fp + tn)), 6) AS roc_auc,
(SELECT round(avg((score - label) * (score - label)), 6) FROM scores) AS brier FROM l""")
def rank_metrics(spark, sf_dir):
    rows = scores(spark, sf_dir)
    return ev.rank_metrics(rows, ev.threshold_table(rows))
