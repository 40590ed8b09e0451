"""Queries of text identity, dedup, splits and overlap, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.functions import records as X
from riskloom.functions import text as T
from riskloom.operators import families as fam
from riskloom.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def family_sql(t: str) -> str:
    masked = rf"regexp_replace(lower(trim({t})), '\b[\w.+-]+@[\w.-]+\.[a-z]{{2,}}\b', ' <email> ', 'g')"
    masked = rf"regexp_replace({masked}, '\b(?:https?://|www\.)\S+', ' <url> ', 'g')"
    # A word border that knows letters beyond ASCII; applied twice, for neighbours share their border.
    masked = rf"regexp_replace({masked}, '(^|[^\pL\pN_])[0-9]+($|[^\pL\pN_])', '\1 <number> \2', 'g')"
    masked = rf"regexp_replace({masked}, '(^|[^\pL\pN_])[0-9]+($|[^\pL\pN_])', '\1 <number> \2', 'g')"
    return rf"trim(regexp_replace({masked}, '\s+', ' ', 'g'))"


def family_id_sql(t: str) -> str:
    return f"'content:' || substr(sha256({family_sql(t)}), 1, 20)"


def template_sql(t: str) -> str:
    masked = rf"regexp_replace(lower({t}), 'https?://[^\s<>]+', '<url>', 'g')"
    masked = rf"regexp_replace({masked}, '\b[\w.+-]+@[\w.-]+\.[a-z]{{2,}}\b', '<email>', 'g')"
    masked = rf"trim(regexp_replace(regexp_replace({masked}, '\d+', '<number>', 'g'), '\s+', ' ', 'g'))"
    return f"CASE WHEN length({masked}) >= 80 AND len(str_split({masked}, ' ')) >= 12 THEN sha256({masked}) END"


FAMILIES = f"fams AS (SELECT d.*, {family_id_sql('coalesce(text, chr(32))')} AS family, l.toxic AS label FROM documents d LEFT JOIN labels l USING (doc_id))"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def labelled_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return fam.with_family(docs(spark, sf_dir)).join(labels, "doc_id", "left")


@query(f"SELECT doc_id, {family_id_sql('text')} AS family FROM documents")
def text_family_id(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.family_id(F.col("text")).alias("family"))


@query(f"SELECT doc_id, {template_sql('text')} AS template FROM documents")
def template_fingerprint(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.template_fingerprint(F.col("text")).alias("template"))


def model_text_sql(text: str) -> str:
    """The same steps where patterns cannot look ahead: what follows a link is taken and put back."""
    steps = (
        (r"(?m)^[ \t]*(?:>[ \t]?)+", ""), (r"(?i)\b[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}\b", " zzemail "), (r"(?i)\b(?:https?://|www\.)\S+?([.,;:!?)\]]*(?:\s|$))", r" zzurl \1"),
        (r"(?i)\b\d{1,2}(?::\d{2}(?::\d{2})?(?:\s*[ap]\.?m\b\.?)?|\s*[ap]\.?m\b\.?)", " zztime "), (r"\b(?:19|20)\d{2}\b", " zzyear "), (r"\b\d+(?:[.,]\d+)*\b", " zznum "), (r"\s+", " "),
    )
    for pattern, token in steps:
        text = f"regexp_replace({text}, '{pattern}', '{token}', 'g')"
    return f"trim({text})"


@query(f"SELECT doc_id, sha256({model_text_sql('text')}) AS digest FROM documents")
def model_text_normalise(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.sha2(T.model_text(F.col("text")).cast("binary"), 256).alias("digest"))


@query(f"""WITH {FAMILIES},
labelled AS (SELECT * FROM fams WHERE label IS NOT NULL),
marked AS (SELECT *, min(label) OVER w <> max(label) OVER w AS conflict, row_number() OVER (PARTITION BY family ORDER BY doc_id) AS place FROM labelled WINDOW w AS (PARTITION BY family))
SELECT count(*) FILTER (WHERE NOT conflict AND place = 1) AS kept_rows, count(*) FILTER (WHERE NOT conflict AND place > 1) AS duplicate_rows, count(*) FILTER (WHERE conflict) AS conflict_rows FROM marked""")
def dedup_families(spark, sf_dir):
    rows = labelled_families(spark, sf_dir).where("label IS NOT NULL").select("doc_id", "family", "label")
    return fam.removal_counts(fam.dedup(rows, label_col="label", order=[F.col("doc_id")]))


@query(f"""WITH {FAMILIES},
stats AS (SELECT family, min(label) AS lo, max(label) AS hi, min(lpad(substr(source, 4), 4, '0') || ':' || lpad(CAST(doc_id AS VARCHAR), 12, '0')) AS first_key FROM fams GROUP BY 1)
SELECT doc_id, source, f.family, label FROM fams f JOIN stats s ON f.family = s.family
WHERE (lo = hi OR lo IS NULL) AND lpad(substr(source, 4), 4, '0') || ':' || lpad(CAST(doc_id AS VARCHAR), 12, '0') = first_key""")
def dedup_across_sources(spark, sf_dir):
    key = F.concat(F.lpad(F.substring("source", 4, 10), 4, "0"), F.lit(":"), F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    rows = labelled_families(spark, sf_dir).select("doc_id", "source", "family", "label").withColumn("place", key)
    return fam.dedup_keys(rows, label_col="label", order=["place"]).select("doc_id", "source", "family", "label")


@query(f"""SELECT doc_id, {family_id_sql('text')} AS family FROM documents
WHERE {family_id_sql('text')} NOT IN (SELECT {family_id_sql('text')} FROM benchmark WHERE text IS NOT NULL)""")
def reserved_family_antijoin(spark, sf_dir):
    rows = fam.with_family(docs(spark, sf_dir).select("doc_id", "text"))
    return fam.exclude_reserved(rows, fam.with_family(table(spark, sf_dir, "benchmark"))).select("doc_id", "family")


@query(f"""WITH {FAMILIES},
b AS (SELECT DISTINCT sha256(text) AS digest FROM benchmark), bt AS (SELECT DISTINCT {template_sql('text')} AS template FROM benchmark),
d AS (SELECT doc_id, text, {template_sql('text')} AS template, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS place FROM documents)
SELECT CASE WHEN place > 1 THEN 'duplicate' WHEN sha256(text) IN (SELECT digest FROM b) THEN 'exact' WHEN template IN (SELECT template FROM bt WHERE template IS NOT NULL) THEN 'template' ELSE 'kept' END AS reason, count(*) AS n
FROM d GROUP BY 1""")
def overlap_precedence(spark, sf_dir):
    mark = lambda d: d.select("*", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), T.template_fingerprint(F.col("text")).alias("template"))
    ours = mark(docs(spark, sf_dir).select("doc_id", "text")).drop("text")
    ours = ours.withColumn("place", F.row_number().over(Window.partitionBy("digest").orderBy("doc_id")))
    theirs = mark(table(spark, sf_dir, "benchmark"))
    exact = theirs.select("digest").distinct().withColumn("exact", F.lit(True))
    template = theirs.where("template IS NOT NULL").select("template").distinct().withColumn("same", F.lit(True))
    both = ours.join(exact, "digest", "left").join(template, "template", "left")
    reason = F.when(F.col("place") > 1, "duplicate").when(F.col("exact"), "exact").when(F.col("same"), "template").otherwise("kept")
    return both.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, CAST(('0x' || substr(sha256('split:' || doc_id), 1, 2)) AS INTEGER) < 51.2 AS held_out FROM documents")
def hash_split(spark, sf_dir):
    return fam.hash_split(docs(spark, sf_dir).select("doc_id"), F.col("doc_id").cast("string"), salt="split", fraction=0.2)


@query("""WITH r AS (SELECT o_custkey AS family, o_orderkey, CASE WHEN o_orderdate >= DATE '1997-01-01' THEN 2 WHEN o_orderdate >= DATE '1996-01-01' THEN 1 ELSE 0 END AS k FROM orders),
m AS (SELECT *, max(k) OVER (PARTITION BY family) AS top FROM r)
SELECT family, o_orderkey, CASE k WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'holdout' END AS role FROM m WHERE k = top""")
def time_partition_split(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("family"), "o_orderkey", "o_orderdate")
    return fam.time_partitions(rows, ts_col="o_orderdate", validation_from="1996-01-01", holdout_from="1997-01-01", family_col="family").select("family", "o_orderkey", "role")


LEDGER_KEY = b"the key of the split"


@query(f"""WITH o AS (SELECT o_custkey AS family, o_orderkey, o_orderdate AS d, CAST('0x' || substr({X.hmac_sha256_sql(LEDGER_KEY, 'CAST(o_custkey AS VARCHAR)')}, 1, 2) AS INTEGER) < 76.8 AS drawn FROM orders),
old AS (SELECT family, max(CASE WHEN drawn THEN 1 ELSE 0 END) AS held, min(d) AS oldest FROM o WHERE d < DATE '1996-01-01' GROUP BY 1), led AS (SELECT family, CASE WHEN held = 1 AND oldest >= DATE '1994-01-01' THEN 'holdout' ELSE 'development' END AS role FROM old),
fresh AS (SELECT family, CASE WHEN max(CASE WHEN drawn THEN 1 ELSE 0 END) = 1 AND min(d) >= DATE '1994-01-01' THEN 'holdout' ELSE 'development' END AS role FROM o GROUP BY 1),
r AS (SELECT o.family, o_orderkey, coalesce(led.role, fresh.role) AS role, led.role IS NOT NULL AS known, row_number() OVER (PARTITION BY o.family ORDER BY d, o_orderkey) AS place FROM o JOIN fresh USING (family) LEFT JOIN led USING (family))
SELECT family, o_orderkey, role, known, CASE WHEN role = 'holdout' AND place > 3 THEN 'beyond_first_three' ELSE 'kept' END AS reason FROM r""")
def family_split_ledger(spark, sf_dir):
    """Two runs: the first writes a ledger of the families before 1996, the second keeps to it whatever came since."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("family"), "o_orderkey", F.col("o_orderdate").alias("at"))
    args = {"family_col": "family", "order": ["at", "o_orderkey"], "ts_col": "at", "fresh_from": "1994-01-01", "key": LEDGER_KEY, "share": 0.3}
    first = fam.split_with_ledger(rows.where("at < DATE '1996-01-01'"), None, **args)
    return fam.split_with_ledger(rows, fam.ledger(first, "family"), **args).select("family", "o_orderkey", "role", "known", "reason")


@query("SELECT doc_id, source, round(CAST((SELECT count(*) FROM documents) AS DOUBLE) / ((SELECT count(DISTINCT source) FROM documents) * count(*) OVER (PARTITION BY source)), 6) AS weight FROM documents")
def source_balanced_weights(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", "source")
    per = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    total = per.agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("sources"))
    weights = per.crossJoin(F.broadcast(total)).select("source", F.round(F.col("all") / (F.col("sources") * F.col("n")), 6).alias("weight"))
    return rows.join(weights, "source").select("doc_id", "source", "weight")


@query("""SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY sha256('cap:' || doc_id), doc_id) <= 5""")
def seeded_cap_per_group(spark, sf_dir):
    return fam.seeded_cap(docs(spark, sf_dir).select("doc_id", "source"), group_col="source", key=F.col("doc_id"), salt="cap", n=5).select("doc_id", "source")


@query("SELECT doc_id, lang, 1 + (row_number() OVER (PARTITION BY lang ORDER BY sha256('batch:' || doc_id), doc_id) - 1) % 2 AS batch FROM documents")
def batch_alternation(spark, sf_dir):
    order = F.sha2(F.concat(F.lit("batch:"), F.col("doc_id").cast("string")).cast("binary"), 256)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id"))
    return docs(spark, sf_dir).select("doc_id", "lang", (1 + (place - 1) % 2).cast("long").alias("batch"))


@query("""WITH d AS (SELECT sha256(coalesce(text, '')) AS d FROM documents),
leaf AS (SELECT substr(d, 1, 4) AS p, sha256(string_agg(d, '' ORDER BY d)) AS h, count(*) AS n FROM d GROUP BY 1),
mid AS (SELECT substr(p, 1, 2) AS p, sha256(string_agg(h, '' ORDER BY leaf.p)) AS h, CAST(sum(n) AS BIGINT) AS n FROM leaf GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(h, '' ORDER BY p)) AS fingerprint FROM mid""")
def cohort_fingerprint(spark, sf_dir):
    """Digest of the rows' digests, the same for any order of the rows: a tree whose leaves hold the sorted digests of one
    four-digit prefix, so no task gathers more than a 65536th of them."""
    digests = docs(spark, sf_dir).select(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("d"))
    digest = lambda c: F.sha2(F.array_join(c, "").cast("binary"), 256)
    leaf = digests.groupBy(F.substring("d", 1, 4).alias("p")).agg(digest(F.sort_array(F.collect_list("d"))).alias("h"), F.count(F.lit(1)).alias("n"))
    for digits in (2, 0):
        joined = F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x["h"])
        leaf = leaf.groupBy(F.substring("p", 1, digits).alias("q")).agg(digest(joined).alias("h"), F.sum("n").alias("n")).withColumnRenamed("q", "p")
    return leaf.select("n", F.col("h").alias("fingerprint"))


@query(f"""WITH a AS (SELECT {family_id_sql('text')} AS family, min(doc_id) AS doc_id, count(*) AS n_docs FROM documents GROUP BY 1),
b AS (SELECT {family_id_sql('text')} AS family, min(item_id) AS item_id, count(*) AS n_items FROM benchmark GROUP BY 1)
SELECT coalesce(a.family, b.family) AS family, CASE WHEN b.family IS NULL THEN 'documents_only' WHEN a.family IS NULL THEN 'benchmark_only' ELSE 'both' END AS side, doc_id, item_id FROM a FULL JOIN b ON a.family = b.family""")
def paired_modes(spark, sf_dir):
    a = fam.with_family(docs(spark, sf_dir).select("doc_id", "text")).groupBy("family").agg(F.min("doc_id").alias("doc_id"))
    b = fam.with_family(table(spark, sf_dir, "benchmark")).groupBy("family").agg(F.min("item_id").alias("item_id"))
    side = F.when(F.col("item_id").isNull(), "documents_only").when(F.col("doc_id").isNull(), "benchmark_only").otherwise("both")
    return a.join(b, "family", "full_outer").select("family", side.alias("side"), "doc_id", "item_id")
