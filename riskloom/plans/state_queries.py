"""Queries of keyed state, streams, matching, addresses and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import network as N
from riskloom.functions import text as T
from riskloom.operators import matching as M
from riskloom.operators import sender
from riskloom.operators import state as st
from riskloom.plans.folders import shared_folder
from riskloom.sources.tables import events, table
from riskloom.streaming import history as hs

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


HISTORY_SQL = "SELECT user_id, epoch_us(min(ts)) AS first_seen, epoch_us(max(ts)) AS last_seen, least(count(*), 1000000) AS seen_count FROM events GROUP BY 1"


def micros(df):
    return df.withColumns({c: F.unix_micros(c) for c in ("first_seen", "last_seen")})


@query(HISTORY_SQL)
def sender_history_batch(spark, sf_dir):
    return micros(st.history(events(spark, sf_dir), "user_id"))


@query(HISTORY_SQL)
def sender_history_stream(spark, sf_dir):
    """The same as a stream over the events' file, in update mode; equal to the batch result."""
    schema = table(spark, sf_dir, "events").schema
    stream = hs.history_stream(hs.event_stream(spark, f"{sf_dir}/events.parquet*", schema), "user_id")
    return micros(hs.run_to_table(stream, spark, shared_folder(spark), "user_id"))


@query("SELECT event_id, user_id, count(*) OVER w AS hits, count(*) OVER w <= 3 AS allowed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW)".replace("epoch(ts)::BIGINT", "CAST(floor(epoch(ts)) AS BIGINT)"))
def rate_limit_sliding(spark, sf_dir):
    return st.sliding_hits(events(spark, sf_dir), "user_id", 3600, 3).select("event_id", "user_id", "hits", "allowed")


ORDERED_SQL = "o AS (SELECT user_id, event_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS t, row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT), event_id) AS i FROM events)"


@query(f"""WITH RECURSIVE {ORDERED_SQL}, f AS (SELECT user_id, event_id, i, [t] AS kept, true AS allowed FROM o WHERE i = 1 UNION ALL
SELECT user_id, event_id, i, CASE WHEN len(k) < 3 THEN list_append(k, t) ELSE k END, len(k) < 3 FROM (SELECT o.*, list_filter(f.kept, lambda x: x > o.t - 3600) AS k FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1))
SELECT user_id, event_id, allowed FROM f""")
def rate_limit_exact(spark, sf_dir):
    return st.exact_limit(events(spark, sf_dir), "user_id", 3600, 3)


@query("SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS requests, least(count(*), 2) AS used, count(*) - least(count(*), 2) AS refused, 2 - least(count(*), 2) AS remaining FROM events GROUP BY 1, 2")
def fixed_window_quota(spark, sf_dir):
    return st.daily_quota(events(spark, sf_dir), "user_id", 2)


@query("""WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch(ts) - epoch(lag(ts) OVER w) >= 1800 THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM g)
SELECT user_id, session, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS events FROM s GROUP BY 1, 2""")
def idle_sessions(spark, sf_dir):
    out = st.idle_sessions(events(spark, sf_dir), "user_id", 1800)
    return out.select("user_id", "session", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "events")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25 OFFSET 50")
def case_list_page(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey", "o_orderstatus", F.to_date("o_orderdate").alias("o_orderdate"))
    return st.page(rows, [F.desc("o_orderdate"), F.desc("o_orderkey")], 25, 50)


@query("""SELECT user_id, arg_max(event_type, {'t': ts, 'i': event_id}) FILTER (WHERE event_type <> 'click') AS last_other, arg_max(value, {'t': ts, 'i': event_id}) FILTER (WHERE value > 50) AS last_large FROM events GROUP BY 1""")
def case_latest_fields(spark, sf_dir):
    fields = {"last_other": F.when(F.col("event_type") != "click", F.col("event_type")), "last_large": F.when(F.col("value") > 50, F.col("value"))}
    return st.latest_fields(events(spark, sf_dir), "user_id", ["ts", "event_id"], fields)


@query("""SELECT count(*) AS cases, count(*) FILTER (WHERE o_orderstatus = 'O') AS open_cases, count(*) FILTER (WHERE o_orderstatus = 'F') AS closed_cases,
count(*) FILTER (WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS without_events FROM orders""")
def feedback_overview(spark, sf_dir):
    touched = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")).distinct().withColumn("t", F.lit(True))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(touched, F.col("o_orderkey") == F.col("k"), "left")
    return rows.agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(F.col("o_orderstatus") == "O").alias("open_cases"), F.count_if(F.col("o_orderstatus") == "F").alias("closed_cases"),
        F.count_if(F.col("t").isNull()).alias("without_events"),
    )


@query("SELECT conv_id, count(*) AS n FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations r WHERE r.conv_id = c.conv_id AND r.role = 'assistant') GROUP BY 1")
def one_way_conversations(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "role")
    answered = rows.where("role = 'assistant'").select("conv_id").distinct()
    return rows.join(answered, "conv_id", "left_anti").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))


URL_SQL = r"""SELECT page_id, lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':\d*$', '')) AS host,
regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query, regexp_extract(url, '#(.*)$', 1) AS fragment FROM pages"""


@query(URL_SQL)
def url_parts(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", N.host(url).alias("host"), N.path(url).alias("path"), N.query(url).alias("query"), N.fragment(url).alias("fragment"))


REGISTRY = (("example.com", "brand"), ("blog.tionble.example.com", "hosting"), ("example.net", "provider"), ("tionsh.example.net", "brand"))


@query(f"""WITH h AS ({URL_SQL}), r AS (SELECT * FROM (VALUES {', '.join(map(str, REGISTRY))}) t(domain, kind))
SELECT page_id, host, domain AS matched, kind FROM h LEFT JOIN r ON host = domain OR ends_with(host, '.' || domain) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(domain) DESC NULLS LAST) = 1""")
def domain_suffix_match(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", N.host(F.col("url")).alias("host"))
    return M.suffix_match(rows, "host", spark.createDataFrame(list(REGISTRY), "domain string, kind string"), "domain", "page_id")


@query("""WITH r AS (SELECT i AS range_id, i * 300000 AS s, i * 300000 + 120000 AS e FROM range(0, 40) t(i)), p AS (SELECT o_orderkey, (o_orderkey * 7919 + o_custkey * 104729) % 12000000 AS v FROM orders)
SELECT o_orderkey, v AS value, range_id FROM p JOIN r ON v BETWEEN s AND e""")
def ip_range_join(spark, sf_dir):
    i = F.col("id")
    ranges = spark.range(40).select(i.alias("range_id"), (i * 300000).alias("start"), (i * 300000 + 120000).alias("end"))
    points = table(spark, sf_dir, "orders").select("o_orderkey", ((F.col("o_orderkey") * 7919 + F.col("o_custkey") * 104729) % 12000000).cast("long").alias("value"))
    return M.range_join(points, F.col("value"), ranges).select("o_orderkey", "value", "range_id")


ADDRESSES_SQL = r"addresses AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS address FROM documents)"


def addresses(spark, sf_dir):
    found = F.regexp_extract_all(F.col("text"), F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("address"))


@query(f"""WITH {ADDRESSES_SQL} SELECT doc_id, address, lower(str_split(address, '@')[1]) AS local, lower(str_split(address, '@')[-1]) AS domain,
CASE WHEN lower(str_split(address, '@')[-1]) IN ('gmail.com', 'googlemail.com') THEN replace(str_split(lower(str_split(address, '@')[1]), '+')[1], '.', '') ELSE str_split(lower(str_split(address, '@')[1]), '+')[1] END || '@' || lower(str_split(address, '@')[-1]) AS canonical FROM addresses""")
def address_parse(spark, sf_dir):
    a = F.col("address")
    return addresses(spark, sf_dir).select("doc_id", "address", N.local_part(a).alias("local"), N.domain_part(a).alias("domain"), N.canonical_address(a).alias("canonical"))


@query("""WITH c AS (SELECT c_custkey, c_name, unnest(str_split(c_name, '')) AS ch FROM customer), n AS (SELECT c_custkey, ch, count(*) AS k FROM c GROUP BY ALL),
t AS (SELECT c_custkey, sum(k) AS tot FROM n GROUP BY 1) SELECT c_custkey, round(-sum(CAST(k AS DOUBLE) / tot * log2(CAST(k AS DOUBLE) / tot)), 6) AS entropy FROM n JOIN t USING (c_custkey) GROUP BY 1""")
def entropy_usernames(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(T.entropy(F.col("c_name")), 6).alias("entropy"))


#: Addresses of every kind beside those of the documents, dealt to the customers by number.
ADDRESSES = (
    "jane.doe@gmail.com", "x9k2j4qz8w@secure-login.tk", "a@1.2.3.4", "info@paypa1.com", "help@paypal.com", "no at", "12345678@qq.com", "a.b+c@googlemail.com", "verify@bank-account.xyz", "two@at@x.com", "noreply@mail.shop.example.org", "ab12345@outlook.com",
    "updates@news.example.edu", "very.long.local.part.of.an.address@a-rather-long-domain-name.example", "o'neil@example.com", "xkcdqwrtz@example.net", "billing@micr0soft.ru", "a@bit.ly", "aaaaaaaaa1@example.org", "q7w8e9r0@yahoo.com",
)


@query(f"""WITH every AS (SELECT c_custkey AS id, ([{', '.join("'" + x.replace("'", "''") + "'" for x in ADDRESSES)}])[CAST(c_custkey % {len(ADDRESSES)} AS INTEGER) + 1] AS address FROM customer UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}')) FROM documents),
{sender.features_sql('every')} SELECT id, address, {', '.join(sender.NAMES)}, CASE WHEN score >= 80 THEN 'critical' WHEN score >= 60 THEN 'high' WHEN score >= 30 THEN 'medium' ELSE 'low' END AS band FROM scored""")
def sender_score(spark, sf_dir):
    dealt = F.element_at(F.array(*map(F.lit, ADDRESSES)), (F.col("c_custkey") % len(ADDRESSES) + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), dealt.alias("address"))
    return sender.features(rows.unionByName(addresses(spark, sf_dir).withColumnRenamed("doc_id", "id")))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT min(l_suppkey) OVER (PARTITION BY l_orderkey) AS a, l_suppkey AS b FROM lineitem), x AS (SELECT * FROM e WHERE a <> b), u AS (SELECT a, b FROM x UNION SELECT b, a FROM x),
reach AS (SELECT a AS node, a AS least FROM u UNION SELECT u.b, reach.least FROM reach JOIN u ON u.a = reach.node AND reach.least < u.b)
SELECT node, min(least) AS component FROM reach GROUP BY 1""")
def campaign_components(spark, sf_dir):
    """Suppliers joined by the orders that they share, over every row."""
    shared_folder(spark)
    return M.components(spark, M.shared_key_edges(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), "l_orderkey", "l_suppkey"))


@query("""WITH f AS (SELECT lang || ':' || source AS component, count(*) AS n FROM documents GROUP BY 1)
SELECT least(n, 10) AS size, count(*) AS components, CAST(sum(n) AS BIGINT) AS members FROM f GROUP BY 1""")
def component_shape(spark, sf_dir):
    return M.shape(table(spark, sf_dir, "documents").select(F.concat_ws(":", "lang", "source").alias("component")))


@query("""SELECT round(corr(l_quantity, l_extendedprice), 6) AS quantity_price, round(corr(l_quantity, l_discount), 6) AS quantity_discount, round(corr(l_extendedprice, l_discount), 6) AS price_discount FROM lineitem""")
def pearson_target(spark, sf_dir):
    c = lambda a, b: F.round(F.corr(F.col(a).cast("double"), F.col(b).cast("double")), 6)
    return table(spark, sf_dir, "lineitem").agg(c("l_quantity", "l_extendedprice").alias("quantity_price"), c("l_quantity", "l_discount").alias("quantity_discount"), c("l_extendedprice", "l_discount").alias("price_discount"))


@query("""WITH s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS d, avg(l_discount) AS m2, stddev_pop(l_discount) AS d2 FROM lineitem)
SELECT l_orderkey, l_linenumber, round((l_quantity - m) / d, 4) AS quantity, round((l_discount - m2) / d2, 4) AS discount FROM lineitem, s""")
def standardise_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("q"), F.col("l_discount").cast("double").alias("d"))
    stats = rows.agg(F.avg("q").alias("mq"), F.stddev_pop("q").alias("sq"), F.avg("d").alias("md"), F.stddev_pop("d").alias("sd"))
    scaled = rows.crossJoin(F.broadcast(stats))  # one row
    return scaled.select("l_orderkey", "l_linenumber", F.round((F.col("q") - F.col("mq")) / F.col("sq"), 4).alias("quantity"), F.round((F.col("d") - F.col("md")) / F.col("sd"), 4).alias("discount"))
