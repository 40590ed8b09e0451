"""What a message's envelope says: who writes as whom, by which way, with what attached; and the merging of verdicts of a
message's views, nested messages and pictures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import network as N
from riskloom.functions import words as W
from riskloom.operators import rules as R

#: Points and floor of each finding.
FINDINGS = {
    "self_addressed": (1, "safe"), "brand_identity": (4, "high"), "recipient_in_name": (3, "medium"), "routing_mismatch": (2, "safe"),
    "auth_failure": (6, "high"), "auth_partial": (2, "safe"), "dangerous_attachment": (4, "high"), "archive_attachment": (2, "medium"),
}
#: Endings of files that run, and of files that hide others.
DANGEROUS = ("exe", "scr", "js", "vbs", "bat", "cmd", "lnk", "hta", "iso", "img", "jar", "ps1", "msi", "docm", "xlsm", "html", "htm", "svg")
ARCHIVES = ("zip", "rar", "7z", "gz", "tar", "cab")
#: Networks that are no hop of the open net, as beginnings of dotted addresses.
PRIVATE = ("10.", "127.", "192.168.", "169.254.", "0.", *(f"172.{i}." for i in range(16, 32)), *(f"100.{i}." for i in range(64, 128)))


def address_of(header: Column) -> Column:
    """The address in a From-like header, in lower case."""
    return F.lower(F.regexp_extract(header, "([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+)[^@]*$", 1))


def display_name(header: Column) -> Column:
    """What stands before the address in angle brackets, without quotes."""
    return F.trim(F.regexp_replace(F.regexp_extract(header, "^(.*)<[^<>]*>[^<>]*$", 1), '"', ""))


def ending(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, "\\.([A-Za-z0-9]+)$", 1))


def findings(sender: Column, reply_to: Column, return_path: Column, recipients: Column, auth: Column, files: Column, brands: dict[str, tuple[str, ...]]) -> Column:
    """Codes of a message's envelope, once for each brand or file where they may repeat. auth: map of methods to results;
    files: array of file names; brands: name to its own domains."""
    own, name = N.domain_part(address_of(sender)), W.plain(display_name(sender))
    replies, returns = (N.domain_part(address_of(F.coalesce(h, F.lit("")))) for h in (reply_to, return_path))
    elsewhere = lambda d: (d != "") & (own != "") & ~N.aligned(d, own)
    result = lambda m: F.coalesce(F.try_element_at(auth, F.lit(m)), F.lit("none"))
    failed = lambda m: result(m).isin("fail", "softfail", "permerror")
    decisive = (result("dmarc") == "fail") | (failed("spf") & failed("dkim"))
    label = lambda r: F.element_at(F.split(N.domain_part(address_of(r)), "\\."), 1)
    once = {
        "self_addressed": F.exists(recipients, lambda r: (address_of(r) == address_of(sender)) & (address_of(r) != "")),
        "recipient_in_name": F.exists(recipients, lambda r: (F.length(label(r)) >= 4) & F.contains(name, F.concat(F.lit(" "), label(r), F.lit(" "))) & ~N.aligned(N.domain_part(address_of(r)), own)),
        "routing_mismatch": elsewhere(replies) | elsewhere(returns),
        "auth_failure": decisive,
        "auth_partial": ~decisive & (failed("spf") | failed("dkim")),
    }
    codes = [F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in once.items()]), lambda x: x.isNotNull())]
    outside = lambda domains: (own != "") & ~reduce(lambda a, b: a | b, [F.endswith(F.concat(F.lit("."), own), F.lit("." + d)) for d in domains])
    codes.append(F.filter(F.array(*[F.when(F.contains(name, F.lit(W.needle(b))) & outside(d), F.lit("brand_identity")) for b, d in brands.items()]), lambda x: x.isNotNull()))
    codes.append(F.transform(F.filter(files, lambda f: ending(f).isin(*DANGEROUS)), lambda f: F.lit("dangerous_attachment")))
    codes.append(F.transform(F.filter(files, lambda f: ending(f).isin(*ARCHIVES)), lambda f: F.lit("archive_attachment")))
    return F.concat(*codes)


def points(codes: Column) -> Column:
    table = F.create_map(*[x for k, (p, _) in FINDINGS.items() for x in (F.lit(k), F.lit(p).cast("long"))])
    return F.aggregate(codes, F.lit(0).cast("long"), lambda acc, c: acc + table[c])


def floor(codes: Column) -> Column:
    has = lambda level: F.exists(codes, lambda c: c.isin(*[k for k, (_, f) in FINDINGS.items() if f == level]))
    return F.when(has("high"), "high").when(has("medium"), "medium").otherwise("safe")


def first_hop(received: Column) -> Column:
    """The first public IPv4 address of a Received chain, topmost header first; null if there is none."""
    found = F.flatten(F.transform(F.slice(received, 1, 30), lambda r: F.regexp_extract_all(r, F.lit("\\[([0-9]{1,3}(?:\\.[0-9]{1,3}){3})\\]"), F.lit(1))))
    public = F.filter(found, lambda a: ~reduce(lambda x, y: x | y, [F.startswith(a, F.lit(p)) for p in PRIVATE]))
    return F.get(public, F.lit(0))


def registrable(df: DataFrame, host_col: str, id_col: str, suffixes: DataFrame) -> DataFrame:
    """id, host, suffix and registrable domain (the longest public suffix and one label more; null for a suffix itself).
    suffixes(suffix) meets the hosts' own suffixes in an equi join."""
    labels = F.split(host_col, "\\.")
    spread = df.select(id_col, host_col, F.posexplode(N.suffixes(F.col(host_col))).alias("place", "suffix"))
    hit = spread.join(suffixes.select("suffix"), "suffix").groupBy(id_col).agg(F.min("place").alias("place"))  # the first is the longest
    rows = df.select(id_col, host_col).join(hit, id_col, "left")
    at = F.coalesce("place", F.size(labels) - 1)  # an unlisted last label is a suffix
    join = lambda begin: F.array_join(F.slice(labels, begin + 1, F.size(labels)), ".")
    return rows.select(id_col, host_col, join(at).alias("suffix"), F.when(at >= 1, join(at - 1)).alias("registrable"))


def semantic_indicators(domain: Column, keywords: tuple[str, ...]) -> Column:
    """Keywords that a domain's labels hold, the longest first; one that a longer one holds is left out."""
    low = F.lower(domain)
    found = F.filter(F.array(*map(F.lit, sorted(keywords, key=lambda k: (-len(k), k)))), lambda k: F.contains(low, k))
    return F.filter(found, lambda k: ~F.exists(found, lambda o: (o != k) & F.contains(o, k)))


def sender_contribution(score: Column) -> dict[str, Column]:
    """Points and floor that a sender's score gives to its message."""
    level = F.when(score >= 80, 6).when(score >= 60, 5).when(score >= 30, 3).when(score > 0, 1).otherwise(0)
    return {"points": level.cast("long"), "floor": F.when(score >= 80, "high").when(score >= 60, "medium").otherwise("safe")}


def capped_verified(level: Column, verified: Column, hard: Column) -> Column:
    """A verified sender's message is at most low, unless a finding says more than its wording."""
    return F.when(verified & ~hard & level.isin("medium", "high", "critical"), "low").otherwise(level)


def model_only(model: Column, threshold: float, original: Column, option: str) -> Column:
    """Level of a message on which the model alone speaks: "A" notes it, "B" warns of pasted texts, "C" always warns."""
    if option not in ("A", "B", "C"):
        raise ValueError("option is A, B or C")
    warned = {"A": F.lit("low"), "B": F.when(original, "low").otherwise("medium"), "C": F.lit("medium")}[option]
    return F.when(F.coalesce(model >= threshold, F.lit(False)), warned).otherwise("safe")


def views_agree(views: DataFrame, id_col: str, *, score: str = "score", threshold: float = 0.5, level: Column) -> DataFrame:
    """id, views, agree (all views give one decision), the riskiest view's number (the first of equal ones) and its level."""
    decided = views.withColumn("_alert", F.col(score) >= threshold).withColumn("_level", level)
    return decided.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("views"), (F.min("_alert") == F.max("_alert")).alias("agree"),
        F.max(F.struct(F.col(score).alias("s"), (-F.col("view")).alias("v"), F.col("_level").alias("l"))).alias("_m"),
    ).select(id_col, "views", "agree", (-F.col("_m.v")).alias("riskiest"), F.col("_m.l").alias("level"))


def merge_children(nodes: DataFrame, root_col: str) -> DataFrame:
    """One row a root of its nodes(root, score, level, codes): the highest score and level, and all codes once. A child can
    raise its root, never lower it."""
    rank = R.rank(F.col("level"))
    codes = nodes.select(F.col(root_col).alias("_r"), F.explode("codes").alias("c")).groupBy("_r").agg(F.array_sort(F.collect_set("c")).alias("codes"))  # a rule set's codes at most
    top = nodes.groupBy(root_col).agg(F.max("score").alias("score"), F.max(rank).alias("_rank"), F.count(F.lit(1)).alias("nodes"))
    return top.join(codes, F.col(root_col) == F.col("_r"), "left").select(
        root_col, "nodes", "score", R.level_of(F.greatest("_rank", F.lit(0))).alias("level"), F.coalesce("codes", F.array().cast("array<string>")).alias("codes")
    )


def merge_visual(level: Column, score: Column, seen_level: Column, seen_score: Column) -> dict[str, Column]:
    """A picture's evidence with a message's: it can raise the verdict and never erase it; unknown gives way to any level."""
    up = R.rank(F.coalesce(seen_level, F.lit("safe"))) > R.rank(level)
    return {"level": F.when((level == "unknown") & seen_level.isin("safe", "low"), "unknown").when(up, seen_level).otherwise(level), "score": F.greatest(score, F.coalesce(seen_score, F.lit(0.0)))}
