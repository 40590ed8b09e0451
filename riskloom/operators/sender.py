"""Sender features of an address: thirty tri-state values (-1 suspicious, 0 borderline, 1 clean), their indicators by
level, and the risk score with its band. The names are those of the tabular benchmark; the meaning is their own.

Registries come as parameters. Everything is a Column, so a table of addresses is one pass without a shuffle."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import network as N
from riskloom.functions import text as T

# Top-level domains and shorteners.
SPAM_TLDS = ("xyz", "top", "click", "loan", "win", "gq", "tk", "ml", "cf", "ga", "pw", "cc")
COMMON_TLDS = ("com", "org", "net", "edu", "gov", "mil", "io", "co", "cn")
ABUSED_CCTLDS = ("ru", "cn", "tk", "ml", "ga", "cf", "gq", "pw", "xyz")
SHORTENERS = ("bit.ly", "tinyurl.com", "goo.gl", "ow.ly", "t.co", "short.io")
# Role mailboxes whose name says nothing of intent.
ROUTINE = ("subscriptions", "subscriber", "updates", "alerts", "admin", "mailer", "webmaster", "postmaster")


@dataclass(frozen=True)
class Registries:
    """Known domains and words. The defaults are short; users pass their own."""

    providers: tuple[str, ...] = ("gmail.com", "yahoo.com", "outlook.com", "hotmail.com", "icloud.com", "aol.com", "protonmail.com", "live.com", "qq.com", "163.com", "foxmail.com")
    high_traffic: tuple[str, ...] = ("gmail.com", "yahoo.com", "outlook.com", "hotmail.com", "icloud.com", "protonmail.com", "live.com", "qq.com", "163.com")
    relays: tuple[str, ...] = ()
    disposable: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ("verify", "secure", "security", "bank", "account", "update", "confirm", "login", "signin", "password", "service", "admin", "alert", "billing", "refund", "payment", "wallet", "no-reply")
    brands: tuple[str, ...] = ("paypal", "google", "microsoft", "amazon", "apple", "netflix", "facebook", "chase", "coinbase", "fedex")
    names: tuple[str, ...] = ("john", "jane", "anna", "maria", "david", "smith", "miller", "doe", "lee", "wang")
    words: tuple[str, ...] = ("info", "sales", "team", "office", "contact", "news", "mail", "help", "shop", "web")


def _tri(bad: Column, borderline: Column | None = None) -> Column:
    out = F.when(bad, F.lit(-1))
    if borderline is not None:
        out = out.when(borderline, F.lit(0))
    return out.otherwise(F.lit(1)).cast("int")


def _words(words: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def _registered(domain: Column, entries: tuple[str, ...]) -> Column:
    """Equal to an entry or below one."""
    dotted = F.concat(F.lit("."), domain)
    return F.exists(_words(entries), lambda e: F.endswith(dotted, F.concat(F.lit("."), e)))


def randomness(local: Column, registries: Registries) -> Column:
    """How many of six signs of a random name a local part shows."""
    alpha = F.regexp_replace(local, r"[^\p{L}]", "")
    n_alpha, n = F.length(alpha), F.length(local)
    parts = F.filter(F.split(local, "[._-]"), lambda w: w.rlike(r"^\p{L}{3,}$"))
    distinct = F.size(F.array_distinct(F.filter(F.split(local, ""), lambda c: c != "")))
    known = _words((*registries.names, *registries.words))
    signs = [
        T.entropy(local) > 3.0,
        F.length(F.regexp_replace(alpha, "[^aeiou]", "")) <= 0.30 * F.greatest(n_alpha, F.lit(1)),
        (F.length(F.regexp_replace(local, r"\D", "")) >= 2) & local.rlike(r"[a-z]\d[a-z]|\d[a-z]\d"),
        distinct >= 0.75 * F.greatest(n, F.lit(1)),
        ~F.exists(_words(registries.words), lambda w: F.contains(alpha, w)),
        (F.size(parts) >= 2) & ~F.arrays_overlap(parts, known),
    ]
    return reduce(lambda a, b: a + b, [s.cast("int") for s in signs])


def features(df: DataFrame, address_col: str = "address", registries: Registries | None = None) -> DataFrame:
    """df with the thirty features, counts of indicators by level, score and band."""
    r = registries or Registries()
    raw = F.lower(F.trim(F.col(address_col)))
    # Materialised step by step: later expressions read earlier columns.
    rows = df.withColumns({"_domain": N.domain_part(raw), "_plain": F.when(F.contains(raw, F.lit("@")), N.local_part(raw)).otherwise(raw), "_ats": T.count_char(raw, "@")})
    rows = rows.withColumns({
        "_local": F.when(F.col("_domain").isin(*N.DOT_ALIAS_DOMAINS), F.replace(F.substring_index("_plain", "+", 1), F.lit("."), F.lit(""))).otherwise(F.substring_index("_plain", "+", 1)),
        "_labels": F.split("_domain", r"\."), "_ip": F.col("_domain").rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"),
    })
    labels, ip, domain, local = F.col("_labels"), F.col("_ip"), F.col("_domain"), F.col("_local")
    deep = F.size(labels) >= 2
    rows = rows.withColumns({
        "_base": F.when(deep & ~ip, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(domain),
        "_label": F.when(deep & ~ip, F.element_at(labels, -2)).otherwise(domain), "_tld": F.when(deep & ~ip, F.element_at(labels, -1)).otherwise(F.lit("")),
        "_subs": F.when(ip, 0).otherwise(F.greatest(F.size(labels) - 2, F.lit(0))), "_scoring": F.when(F.col("_ats") == 1, F.concat(local, F.lit("@"), domain)).otherwise(raw),
        "_relay": _registered(domain, r.relays), "_provider": _registered(domain, r.providers), "_traffic": _registered(domain, r.high_traffic), "_throwaway": _registered(domain, r.disposable),
    })
    base, label, tld, scoring = F.col("_base"), F.col("_label"), F.col("_tld"), F.col("_scoring")
    relay, provider = F.col("_relay"), F.col("_provider")
    known = provider | F.col("_throwaway") | relay | tld.isin("edu", "gov")
    folded = T.leet_fold(label)
    official = lambda b: base.isin(f"{b}.com", f"{b}.net", f"{b}.org")
    named = reduce(lambda a, b: a | b, [F.contains(label, F.lit(b)) & ~official(b) for b in r.brands], F.lit(False))
    imitated = reduce(lambda a, b: a | b, [(folded != label) & F.contains(folded, F.lit(b)) & ~official(b) for b in r.brands], F.lit(False))
    any_folded = (folded != label) & F.exists(_words(r.brands), lambda b: F.contains(folded, b))
    mixed = label.rlike(r"[a-z]\d|\d[a-z]") & ~relay
    length = F.length(scoring)
    rows = rows.withColumns({
        "having_ip_address": _tri(ip), "url_length": _tri(length > 50, length > 30), "shortining_service": _tri(base.isin(*SHORTENERS)), "having_at_symbol": _tri(F.col("_ats") > 1),
        "double_slash_redirecting": _tri(F.contains(domain, F.lit("//"))), "prefix_suffix": _tri(F.contains(base, F.lit("-"))),
        "having_sub_domain": _tri(~relay & (F.col("_subs") > 1), ~relay & (F.col("_subs") == 1)), "https_token": _tri(F.contains(scoring, F.lit("http"))), "sslfinal_state": _tri(~known),
        "domain_registration_length": _tri(~(tld.isin(*COMMON_TLDS) | relay)), "age_of_domain": _tri(F.length(label) > 20, F.length(label) > 12), "dnsrecord": _tri(label.rlike(r"\d") & ~relay),
        "web_traffic": _tri(~(F.col("_traffic") | relay)), "page_rank": _tri(~relay & F.exists(_words(r.keywords), lambda k: F.contains(F.replace(domain, F.lit("."), F.lit("")), k))),
        "google_index": _tri(~local.isin(*ROUTINE) & F.exists(_words(r.keywords), lambda k: F.contains(local, k))), "statistical_report": _tri(tld.isin(*SPAM_TLDS)),
        "_random": local.rlike(r"^[a-z0-9._-]{8,25}$") & ~(base.isin("qq.com", "foxmail.com") & local.rlike(r"^\d{5,11}$"))
        & ~((F.size(F.split(local, "[._-]")) == 2) & (F.size(F.filter(F.split(local, "[._-]"), lambda w: F.array_contains(_words(r.names), w))) == 2))
        & (randomness(local, r) >= F.when(provider | F.col("_traffic"), 4).otherwise(2)),
        "request_url": _tri(~local.rlike(r"^[a-z0-9.!#$%&'*+/=?^_`{|}~-]*$")), "url_of_anchor": _tri(F.length(local) > 30, F.length(local) > 15), "links_in_tags": _tri(~relay & (named | imitated)),
        "sfh": _tri(F.lit(False), local.rlike("noreply|no-reply|donotreply")), "abnormal_url": _tri(mixed | (~relay & any_folded)), "_imitated": ~relay & imitated & ~named, "_swapped": ~relay & any_folded & ~mixed,
        "redirect": _tri(F.lit(False)), "on_mouseover": _tri(tld.isin(*ABUSED_CCTLDS)), "popupwindow": _tri(F.regexp_count(label, F.lit("[a-z]+")) > 3),
        "links_pointing_to_page": _tri(~raw.rlike(r"^[a-z0-9.!#$%&'*+/=?^_`{|}~-]+@(?:[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?\.)+[\p{L}\p{N}-]{2,}$")),
    })
    first = ["having_ip_address", "url_length", "shortining_service", "having_at_symbol", "double_slash_redirecting", "prefix_suffix", "having_sub_domain", "https_token", "sslfinal_state", "domain_registration_length", "age_of_domain", "dnsrecord", "web_traffic", "page_rank", "google_index", "statistical_report", "request_url", "url_of_anchor", "links_in_tags", "sfh", "abnormal_url", "redirect", "on_mouseover", "popupwindow"]
    # The cumulative feature counts what stands before it; the random-name rule sets its four features afterwards.
    so_far = reduce(lambda a, b: a + b, [(F.col(c) == -1).cast("int") for c in first])
    n = F.greatest(F.length(local), F.lit(1))
    most = F.array_max(F.transform(F.array_distinct(F.split(local, "")), lambda c: F.size(F.filter(F.split(local, ""), lambda d: d == c))))
    random = F.col("_random")
    rows = rows.withColumns({
        "iframe": _tri(so_far > 8, so_far > 4), "favicon": _tri(random & (F.length(F.regexp_replace(local, r"\D", "")) > 0.4 * n)), "port": _tri(random & (T.entropy(local) > 3.0)),
        "submitting_to_email": _tri(random & (most > 0.5 * n) & (n > 3)), "rightclick": _tri(random & local.rlike(r"^[a-z]{2,5}\d{4,12}$")),
    })
    bad = lambda c: F.col(c) == -1
    high = [bad("having_ip_address"), bad("shortining_service"), bad("having_at_symbol"), bad("double_slash_redirecting"), bad("page_rank"), bad("google_index"), bad("statistical_report"), F.col("_imitated"), F.col("_swapped"), bad("links_pointing_to_page")]
    medium = [bad("url_length"), bad("having_sub_domain"), bad("https_token"), bad("sslfinal_state"), bad("domain_registration_length") & (tld != ""), bad("request_url"), bad("on_mouseover"), random]
    low = [bad("prefix_suffix"), bad("age_of_domain"), bad("dnsrecord"), bad("url_of_anchor")]
    total = lambda cs: reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(False)).cast("int") for c in cs])
    rows = rows.withColumns({"n_high": total(high), "n_medium": total(medium), "n_low": total(low)})
    score = F.least(F.lit(100), 28 * F.col("n_high") + 10 * F.col("n_medium") + 3 * F.col("n_low"))
    rows = rows.withColumn("score", F.when(F.col("_imitated"), F.greatest(score, F.lit(60))).otherwise(score).cast("int"))
    band = F.when(F.col("score") >= 80, "critical").when(F.col("score") >= 60, "high").when(F.col("score") >= 30, "medium").otherwise("low")
    rows = rows.withColumns({"random_username": random, "band": band})
    return rows.drop(*[c for c in rows.columns if c.startswith("_") and c not in df.columns])


def contribution(band: Column, score: Column) -> Column:
    """Points that a sender adds to its message."""
    return F.when(band == "critical", 6).when(band == "high", 5).when(band == "medium", 3).when(score > 0, 1).otherwise(0)


def features_sql(source: str, address: str = "address", registries: Registries | None = None) -> str:
    """DuckDB: the rows of a table with the same features; written side by side, feature by feature."""
    r = registries or Registries()
    words = lambda ws: "CAST([" + ", ".join(f"'{w}'" for w in ws) + "] AS VARCHAR[])"
    below = lambda ws: f"len(list_filter({words(ws)}, lambda e: ends_with('.' || dom, '.' || e))) > 0"
    tri = lambda bad, mid="false": f"CASE WHEN {bad} THEN -1 WHEN {mid} THEN 0 ELSE 1 END"
    holds = lambda text, ws: f"len(list_filter({words(ws)}, lambda k: contains({text}, k))) > 0"
    official = lambda b: f"base IN ('{b}.com', '{b}.net', '{b}.org')"
    fold = "lab"
    for group, letter in T.FOLD_GROUPS:
        fold = f"replace({fold}, '{group}', '{letter}')"
    fold = f"translate({fold}, '{T.FOLD_FROM}', '{T.FOLD_TO}')"
    undotted = "replace(dom, '.', '')"
    syntax = "^[a-z0-9.!#$%&''*+/=?^_`{|}~-]+@(?:[\\p{L}\\p{N}](?:[\\p{L}\\p{N}-]*[\\p{L}\\p{N}])?\\.)+[\\p{L}\\p{N}-]{2,}$"
    any_of = lambda f: "(" + " OR ".join(f(b) for b in r.brands) + ")"
    entropy = "coalesce((SELECT -sum(k / n * log2(k / n)) FROM (SELECT CAST(count(*) AS DOUBLE) AS k, CAST(length(loc) AS DOUBLE) AS n FROM (SELECT unnest(str_split(loc, '')) AS ch) WHERE ch <> '' GROUP BY ch)), 0)"
    alpha = "regexp_replace(loc, '[^\\p{L}]', '', 'g')"
    parts = "list_filter(str_split_regex(loc, '[._-]'), lambda w: regexp_matches(w, '^\\p{L}{3,}$'))"
    signs = [
        "ent > 3.0", f"length(regexp_replace({alpha}, '[^aeiou]', '', 'g')) <= 0.30 * greatest(length({alpha}), 1)", "(length(regexp_replace(loc, '[^0-9]', '', 'g')) >= 2 AND regexp_matches(loc, '[a-z][0-9][a-z]|[0-9][a-z][0-9]'))",
        "len(list_distinct(list_filter(str_split(loc, ''), lambda c: c <> ''))) >= 0.75 * greatest(length(loc), 1)", f"NOT ({holds(alpha, r.words)})", f"(len({parts}) >= 2 AND NOT list_has_any({parts}, {words((*r.names, *r.words))}))",
    ]
    count = " + ".join(f"CASE WHEN {x} THEN 1 ELSE 0 END" for x in signs)
    named = f"(SELECT count(*) FROM (SELECT unnest(str_split_regex(loc, '[._-]')) AS w) WHERE w IN ({', '.join(repr(n) for n in r.names)})) = 2 AND len(str_split_regex(loc, '[._-]')) = 2"
    cols = {
        "having_ip_address": tri("ip"), "url_length": tri("length(scoring) > 50", "length(scoring) > 30"), "shortining_service": tri(f"base IN {SHORTENERS}"), "having_at_symbol": tri("ats > 1"), "double_slash_redirecting": tri("contains(dom, '//')"),
        "prefix_suffix": tri("contains(base, '-')"), "having_sub_domain": tri("NOT relay AND subs > 1", "NOT relay AND subs = 1"), "https_token": tri("contains(scoring, 'http')"), "sslfinal_state": tri("NOT (provider OR throwaway OR relay OR tld IN ('edu', 'gov'))"),
        "domain_registration_length": tri(f"NOT (tld IN {COMMON_TLDS} OR relay)"), "age_of_domain": tri("length(lab) > 20", "length(lab) > 12"), "dnsrecord": tri("regexp_matches(lab, '[0-9]') AND NOT relay"), "web_traffic": tri("NOT (traffic OR relay)"),
        "page_rank": tri(f"NOT relay AND {holds(undotted, r.keywords)}"), "google_index": tri(f"loc NOT IN {ROUTINE} AND {holds('loc', r.keywords)}"), "statistical_report": tri(f"tld IN {SPAM_TLDS}"),
        "request_url": tri("NOT regexp_matches(loc, '^[a-z0-9.!#$%&''*+/=?^_`{|}~-]*$')"), "url_of_anchor": tri("length(loc) > 30", "length(loc) > 15"), "links_in_tags": tri("NOT relay AND (named OR imitated)"), "sfh": tri("false", "regexp_matches(loc, 'noreply|no-reply|donotreply')"),
        "abnormal_url": tri("(regexp_matches(lab, '[a-z][0-9]|[0-9][a-z]') AND NOT relay) OR (NOT relay AND any_folded)"), "redirect": "1", "on_mouseover": tri(f"tld IN {ABUSED_CCTLDS}"), "popupwindow": tri("len(regexp_extract_all(lab, '[a-z]+')) > 3"),
    }
    so_far = " + ".join(f"CASE WHEN {c} = -1 THEN 1 ELSE 0 END" for c in cols)
    bad = lambda c: f"coalesce({c} = -1, false)"
    high = [*map(bad, ("having_ip_address", "shortining_service", "having_at_symbol", "double_slash_redirecting", "page_rank", "google_index", "statistical_report")), "(NOT relay AND imitated AND NOT named)", "(NOT relay AND any_folded AND NOT (regexp_matches(lab, '[a-z][0-9]|[0-9][a-z]') AND NOT relay))", bad("links_pointing_to_page")]
    medium = [*map(bad, ("url_length", "having_sub_domain", "https_token", "sslfinal_state")), f"({bad('domain_registration_length')} AND tld <> '')", bad("request_url"), bad("on_mouseover"), "random_username"]
    low = [*map(bad, ("prefix_suffix", "age_of_domain", "dnsrecord", "url_of_anchor"))]
    total = lambda cs: " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in cs)
    digits = "length(regexp_replace(loc, '[^0-9]', '', 'g'))"
    most = "coalesce(list_max(list_transform(list_distinct(str_split(loc, '')), lambda c: len(list_filter(str_split(loc, ''), lambda d: d = c)))), 0)"
    return f"""a0 AS (SELECT *, lower(trim({address})) AS raw FROM {source}),
a1 AS (SELECT *, lower(str_split(raw, '@')[-1]) AS dom, CASE WHEN contains(raw, '@') THEN lower(str_split(raw, '@')[1]) ELSE raw END AS pl, length(raw) - length(replace(raw, '@', '')) AS ats FROM a0),
a2 AS (SELECT *, CASE WHEN dom IN {N.DOT_ALIAS_DOMAINS} THEN replace(str_split(pl, '+')[1], '.', '') ELSE str_split(pl, '+')[1] END AS loc, str_split(dom, '.') AS labs, regexp_matches(dom, '^[0-9]{{1,3}}(?:\\.[0-9]{{1,3}}){{3}}$') AS ip FROM a1),
a3 AS (SELECT *, CASE WHEN len(labs) >= 2 AND NOT ip THEN labs[-2] || '.' || labs[-1] ELSE dom END AS base, CASE WHEN len(labs) >= 2 AND NOT ip THEN labs[-2] ELSE dom END AS lab, CASE WHEN len(labs) >= 2 AND NOT ip THEN labs[-1] ELSE '' END AS tld,
  CASE WHEN ip THEN 0 ELSE greatest(len(labs) - 2, 0) END AS subs, CASE WHEN ats = 1 THEN loc || '@' || dom ELSE raw END AS scoring, {below(r.relays)} AS relay, {below(r.providers)} AS provider, {below(r.high_traffic)} AS traffic, {below(r.disposable)} AS throwaway, {entropy} AS ent FROM a2),
a4 AS (SELECT *, {any_of(lambda b: f"(contains(lab, '{b}') AND NOT {official(b)})")} AS named, {any_of(lambda b: f"({fold} <> lab AND contains({fold}, '{b}') AND NOT {official(b)})")} AS imitated, ({fold} <> lab AND {any_of(lambda b: f"contains({fold}, '{b}')")}) AS any_folded FROM a3),
a5 AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in cols.items())}, {tri(f"NOT regexp_matches(raw, '{syntax}')")} AS links_pointing_to_page,
  regexp_matches(loc, '^[a-z0-9._-]{{8,25}}$') AND NOT (base IN ('qq.com', 'foxmail.com') AND regexp_matches(loc, '^[0-9]{{5,11}}$')) AND NOT ({named}) AND ({count}) >= CASE WHEN provider OR traffic THEN 4 ELSE 2 END AS random_username FROM a4),
a6 AS (SELECT *, {tri(f'({so_far}) > 8', f'({so_far}) > 4')} AS iframe, {tri(f'random_username AND {digits} > 0.4 * greatest(length(loc), 1)')} AS favicon, {tri('random_username AND ent > 3.0')} AS port,
  {tri(f'random_username AND {most} > 0.5 * greatest(length(loc), 1) AND length(loc) > 3')} AS submitting_to_email, {tri("random_username AND regexp_matches(loc, '^[a-z]{2,5}[0-9]{4,12}$')")} AS rightclick FROM a5),
a7 AS (SELECT *, {total(high)} AS n_high, {total(medium)} AS n_medium, {total(low)} AS n_low FROM a6),
scored AS (SELECT *, CASE WHEN NOT relay AND imitated AND NOT named THEN greatest(least(100, 28 * n_high + 10 * n_medium + 3 * n_low), 60) ELSE least(100, 28 * n_high + 10 * n_medium + 3 * n_low) END AS score FROM a7)"""


#: The features and what follows from them, in the order of the operator's columns.
NAMES = (
    "having_ip_address", "url_length", "shortining_service", "having_at_symbol", "double_slash_redirecting", "prefix_suffix", "having_sub_domain", "https_token", "sslfinal_state", "domain_registration_length", "age_of_domain", "dnsrecord",
    "web_traffic", "page_rank", "google_index", "statistical_report", "request_url", "url_of_anchor", "links_in_tags", "sfh", "abnormal_url", "redirect", "on_mouseover", "popupwindow", "links_pointing_to_page", "iframe", "favicon", "port",
    "submitting_to_email", "rightclick", "n_high", "n_medium", "n_low", "score", "random_username",
)
