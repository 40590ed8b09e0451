"""Further queries of counts, pivots, ranks, folds and campaigns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.functions import text as T
from riskloom.operators import evaluation as ev
from riskloom.operators import folds
from riskloom.plans.eval_queries import CAPS_SQL, MARKS_SQL, OUTCOMES_SQL, outcomes
from riskloom.plans.text_queries import template_sql
from riskloom.plans.state_queries import ORDERED_SQL
from riskloom.plans.folders import shared_folder
from riskloom.sources.tables import events, table, union_corpora
from riskloom.streaming import history as hs
from riskloom.streaming import limits

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {OUTCOMES_SQL} SELECT label, count(*) FILTER (WHERE decision = 'alerted') AS alerted, count(*) FILTER (WHERE decision = 'not_alerted') AS not_alerted, count(*) FILTER (WHERE decision = 'undetermined') AS undetermined FROM outcomes GROUP BY 1")
def cohort_level_pivot(spark, sf_dir):
    rows = outcomes(spark, sf_dir).groupBy("label").pivot("decision", ["alerted", "not_alerted", "undetermined"]).agg(F.count(F.lit(1)))
    return rows.na.fill(0)


@query(f"WITH {OUTCOMES_SQL} SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' ELSE 'source' END AS dimension, coalesce(lang, source) AS value, count(*) AS n, count(*) FILTER (WHERE decision = 'alerted') AS alerted FROM outcomes GROUP BY GROUPING SETS ((lang), (source))")
def one_dimensional_groupings(spark, sf_dir):
    outcomes(spark, sf_dir).createOrReplaceTempView("riskloom_outcomes")
    return spark.sql("""SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' ELSE 'source' END AS dimension, coalesce(lang, source) AS value, count(*) AS n, count_if(decision = 'alerted') AS alerted
        FROM riskloom_outcomes GROUP BY GROUPING SETS ((lang), (source))""")


@query(f"""WITH d AS (SELECT {template_sql('text')} AS template, source FROM documents) SELECT template, count(*) AS messages, count(DISTINCT source) AS senders, count(DISTINCT source) >= 3 AS hub FROM d WHERE template IS NOT NULL GROUP BY 1""")
def template_hubs(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(T.template_fingerprint(F.col("text")).alias("template"), "source").where("template IS NOT NULL")
    return rows.groupBy("template").agg(F.count(F.lit(1)).alias("messages"), F.count_distinct("source").alias("senders")).withColumn("hub", F.col("senders") >= 3)


@query("SELECT c_nationkey, count(DISTINCT o_custkey) AS addresses, count(*) AS messages, count(DISTINCT o_custkey) >= 20 AND 2 * count(DISTINCT o_custkey) >= count(*) AS diffuse FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def diffuse_domains(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    out = rows.groupBy("c_nationkey").agg(F.count_distinct("o_custkey").alias("addresses"), F.count(F.lit(1)).alias("messages"))
    return out.withColumn("diffuse", (F.col("addresses") >= 20) & (2 * F.col("addresses") >= F.col("messages")))


@query(r"SELECT lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), ':\d*$', '')) AS host, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, host LIMIT 10")
def top_domains(spark, sf_dir):
    from riskloom.functions import network as N

    return table(spark, sf_dir, "pages").groupBy(N.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "host").limit(10)


@query("""WITH m AS (SELECT l_returnflag AS model, 'quantity' AS metric, round(avg(l_quantity), 6) AS v FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, 'price', round(avg(l_extendedprice), 6) FROM lineitem GROUP BY 1
UNION ALL SELECT l_returnflag, 'discount', round(avg(l_discount), 6) FROM lineitem GROUP BY 1), r AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY v DESC) AS r, count(*) OVER (PARTITION BY metric, v) AS ties FROM m)
SELECT model, round(avg((2 * r + ties - 1) / CAST(2 AS DOUBLE)), 6) AS average_rank, count(*) FILTER (WHERE r = 1) AS best_on FROM r GROUP BY 1""")
def average_ranks(spark, sf_dir):
    per = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("model")).agg(*[F.round(F.avg(F.col(c).cast("double")), 6).alias(n) for n, c in (("quantity", "l_quantity"), ("price", "l_extendedprice"), ("discount", "l_discount"))])
    rows = per.unpivot("model", ["quantity", "price", "discount"], "metric", "v")
    by = Window.partitionBy("metric")
    rows = rows.withColumns({"r": F.rank().over(by.orderBy(F.desc("v"))), "ties": F.count(F.lit(1)).over(Window.partitionBy("metric", "v"))})
    return rows.groupBy("model").agg(F.round(F.avg((2 * F.col("r") + F.col("ties") - 1) / 2.0), 6).alias("average_rank"), F.count_if(F.col("r") == 1).alias("best_on"))


@query("""SELECT c.custkey AS custkey, c.n AS orders, list_transform(list_sort(c.o), lambda x: x.k) AS order_keys FROM (SELECT o_custkey AS custkey, count(*) AS n, list({'d': o_orderdate, 'k': o_orderkey}) AS o FROM orders GROUP BY 1) c""")
def case_with_events(spark, sf_dir):
    """Each case with its events in order; a case's events are bounded by the store's limit of 200 kept events."""
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.count(F.lit(1)).alias("orders"), F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey"))).alias("o"))
    return rows.select("custkey", "orders", F.transform("o", lambda x: x["o_orderkey"]).alias("order_keys"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS closed_on FROM orders WHERE o_orderstatus = 'F' AND o_orderdate < DATE '1993-01-01'")
def retention_candidates(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").where((F.col("o_orderstatus") == "F") & (F.col("o_orderdate") < F.lit("1993-01-01").cast("date")))
    return rows.select("o_orderkey", F.to_date("o_orderdate").alias("closed_on"))


@query("""WITH f AS (SELECT user_id, arg_min(event_type, event_id) AS digest FROM events GROUP BY 1)
SELECT e.user_id, f.digest, count(*) FILTER (WHERE event_type = digest) - 1 AS repeats, count(*) FILTER (WHERE event_type <> digest) AS conflicts FROM events e JOIN f USING (user_id) GROUP BY ALL""")
def idempotent_create(spark, sf_dir):
    return folds.idempotent_create(events(spark, sf_dir).select("user_id", "event_type", "event_id"), "user_id", "event_type", "event_id")


def timed(spark, sf_dir):
    return events(spark, sf_dir).select("user_id", "event_id", "event_type", F.col("ts").cast("long").alias("t"))


@query(f"""WITH RECURSIVE {ORDERED_SQL}, f AS (SELECT user_id, event_id, i, t, t + 3600 AS stop, CAST(1 AS BIGINT) AS n FROM o WHERE i = 1 UNION ALL
SELECT o.user_id, o.event_id, o.i, o.t, CASE WHEN o.t >= f.stop THEN o.t + 3600 ELSE f.stop END, CASE WHEN o.t >= f.stop THEN 1 ELSE f.n + 1 END FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1)
SELECT user_id, event_id, n AS window_count, n <= 2 AS allowed, CASE WHEN n <= 2 THEN 0 ELSE stop - t END AS retry_after FROM f""")
def rate_limit_first_hit(spark, sf_dir):
    return folds.first_hit_window(timed(spark, sf_dir), "user_id", "t", 3600, 2).select("user_id", "event_id", "window_count", "allowed", "retry_after")


@query(f"""WITH RECURSIVE {ORDERED_SQL}, f AS (SELECT user_id, i, t AS began, t AS last, CAST(1 AS BIGINT) AS n FROM o WHERE i = 1 UNION ALL
SELECT user_id, i, CASE WHEN fresh THEN t ELSE began END, t, n + CASE WHEN fresh THEN 1 ELSE 0 END FROM (SELECT o.user_id, o.i, o.t, f.began, f.n, o.t - f.last >= 1800 OR o.t - f.began >= 28800 AS fresh FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1))
SELECT user_id, max(n) AS sessions, count(*) AS events FROM f GROUP BY 1""")
def sessions_absolute(spark, sf_dir):
    return folds.capped_sessions(timed(spark, sf_dir), "user_id", "t", 1800, 8 * 3600).groupBy("user_id").agg(F.max("session").alias("sessions"), F.count(F.lit(1)).alias("events"))


@query(f"""WITH RECURSIVE {ORDERED_SQL}, q AS (SELECT user_id, event_id, t, i, CASE WHEN event_id % 7 = 0 THEN 'release' WHEN event_id % 3 = 0 THEN 'finish' ELSE 'reserve' END AS op, user_id || '-' || (event_id // 400) AS r FROM o),
f AS (SELECT user_id, event_id, op, i, t // 86400 AS day, CAST(CASE WHEN op = 'reserve' THEN 1 ELSE 0 END AS BIGINT) AS used, CASE WHEN op = 'reserve' THEN [{{'r': r, 'at': t, 'st': 'reserved'}}] ELSE [] END AS seen, CASE WHEN op = 'reserve' THEN 'granted' ELSE 'unknown' END AS result FROM q WHERE i = 1
  UNION ALL SELECT user_id, event_id, op, i, day, CASE result WHEN 'granted' THEN used + 1 WHEN 'released' THEN used - 1 ELSE used END,
    CASE WHEN result = 'granted' THEN list_append(seen, {{'r': r, 'at': t, 'st': 'reserved'}}) WHEN result IN ('finished', 'released') THEN list_append(list_filter(seen, lambda x: x.r <> r), {{'r': r, 'at': t, 'st': op}}) ELSE seen END, result
  FROM (SELECT *, CASE WHEN op = 'reserve' THEN CASE WHEN st IS NOT NULL THEN 'repeated' WHEN used >= 2 THEN 'refused' ELSE 'granted' END WHEN st = 'reserved' THEN CASE op WHEN 'finish' THEN 'finished' ELSE 'released' END ELSE 'unknown' END AS result
    FROM (SELECT *, list_filter(seen, lambda x: x.r = r)[1].st AS st FROM (SELECT q.user_id, q.event_id, q.op, q.i, q.t, q.r, q.t // 86400 AS day, CASE WHEN q.t // 86400 <> f.day THEN 0 ELSE f.used END AS used, list_filter(f.seen, lambda x: x.at > q.t - 86400) AS seen FROM f JOIN q ON q.user_id = f.user_id AND q.i = f.i + 1))))
SELECT user_id, event_id, op, result, 2 - used AS remaining FROM f""")
def quota_receipts(spark, sf_dir):
    """Events as requests: every third finishes, every seventh releases, the others reserve; ids repeat in pairs."""
    return folds.quota_receipts(requests_of(timed(spark, sf_dir)), "user_id", "t", "op", "request", 2).select("user_id", "event_id", "op", "result", "remaining")


def requests_of(rows):
    op = F.when(F.col("event_id") % 7 == 0, "release").when(F.col("event_id") % 3 == 0, "finish").otherwise("reserve")
    return rows.withColumns({"op": op, "request": F.concat_ws("-", "user_id", F.floor(F.col("event_id") / 400))})


def timed_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return hs.event_stream(spark, f"{sf_dir}/events.parquet*", schema).select("user_id", "event_id", "event_type", "ts", F.col("ts").cast("long").alias("t"))


@query(SQL["rate_limit_first_hit"])
def rate_limit_stream(spark, sf_dir):
    """The window counter as a stream whose state lives a day: equal to the fold."""
    rows = limits.fold_stream(timed_stream(spark, sf_dir), "user_id", ["t", "event_id"], *folds.first_hit("t", 3600, 2), 86_400)
    return limits.run_append(rows, spark, shared_folder(spark)).select("user_id", "event_id", "window_count", "allowed", "retry_after")


@query(SQL["sessions_absolute"])
def sessions_stream(spark, sf_dir):
    rows = limits.fold_stream(timed_stream(spark, sf_dir), "user_id", ["t", "event_id"], *folds.sessions("t", 1800, 8 * 3600), 86_400)
    return limits.run_append(rows, spark, shared_folder(spark)).groupBy("user_id").agg(F.max("session").alias("sessions"), F.count(F.lit(1)).alias("events"))


@query(SQL["quota_receipts"])
def quota_stream(spark, sf_dir):
    rows = requests_of(timed_stream(spark, sf_dir))
    out = limits.fold_stream(rows, "user_id", ["t", "event_id"], *folds.quota("t", "op", "request", 2), 2 * 86_400)
    return limits.run_append(out, spark, shared_folder(spark)).select("user_id", "event_id", "op", "result", "remaining")


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, event_id % 3 AS expected, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
f AS (SELECT user_id, event_id, i, expected = 0 AS applied, CASE WHEN expected = 0 THEN 1 ELSE 0 END AS version FROM o WHERE i = 1
  UNION ALL SELECT o.user_id, o.event_id, o.i, o.expected = f.version, f.version + CASE WHEN o.expected = f.version THEN 1 ELSE 0 END FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1)
SELECT user_id, event_id, applied, CAST(version AS BIGINT) AS version FROM f""")
def optimistic_updates(spark, sf_dir):
    rows = timed(spark, sf_dir).select("user_id", "event_id", (F.col("event_id") % 3).alias("expected"))
    return folds.versioned_updates(rows, "user_id", "expected").select("user_id", "event_id", "applied", "version")


@query(f"""WITH r AS (SELECT doc_id, {MARKS_SQL} AS m, {CAPS_SQL} AS c, length(text) AS n FROM documents)
SELECT CASE WHEN n < 40 THEN 'unknown' WHEN m >= 3 AND c > 0.4 THEN 'alert' WHEN m >= 3 OR c > 0.4 THEN 'review' ELSE 'pass' END AS plan, count(*) AS n FROM r GROUP BY 1""")
def review_plan_counts(spark, sf_dir):
    text = F.col("text")
    m, c = T.count_char(text, "!") >= 3, T.capitals_share(text) > 0.4
    plan = F.when(F.length(text) < 40, "unknown").when(m & c, "alert").when(m | c, "review").otherwise("pass")
    return table(spark, sf_dir, "documents").select(plan.alias("plan")).groupBy("plan").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT source_rank, source, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM (SELECT 0 AS source_rank, 'documents' AS source, text FROM documents
UNION ALL SELECT 1, 'benchmark', text FROM benchmark UNION ALL SELECT 2, 'conversations', text FROM conversations) GROUP BY 1, 2""")
def union_corpora_counts(spark, sf_dir):
    corpora = [table(spark, sf_dir, n).select(F.lit(n).alias("source"), "text") for n in ("documents", "benchmark", "conversations")]
    return union_corpora(corpora).groupBy("source_rank", "source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))


@query(f"WITH {OUTCOMES_SQL}, c AS (SELECT lang, source, count(*) AS n FROM outcomes GROUP BY CUBE (lang, source)) SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS rows_in_groups FROM c")
def cube_of_unions(spark, sf_dir):
    return ev.by_all_subsets(outcomes(spark, sf_dir), ["lang", "source"]).agg(F.count(F.lit(1)).alias("groups"), F.sum("n").cast("long").alias("rows_in_groups"))
