"""Rules over links: one row (id, label, destination) for each link gives evidence, each finding once for a message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import network as N
from riskloom.functions import text as T

#: Points and floor of each finding; a "medium" floor does not lower a higher one.
FINDINGS = {
    "obfuscated_scheme": (3, "high"), "malformed_target": (2, "medium"), "unsafe_scheme": (5, "high"), "url_userinfo": (5, "high"), "ip_host": (3, "high"),
    "ipfs_gateway": (4, "high"), "display_mismatch": (3, "high"), "idn_confusable": (5, "high"), "brand_lookalike": (5, "high"), "dev_hosting": (4, "medium"),
    "brand_on_free_host": (4, "safe"), "credential_collection_host": (4, "high"), "sensitive_host": (2, "safe"),
}
#: Words of hosts that speak of accounts, and hosting under which anyone may publish.
SENSITIVE = ("account", "auth", "bank", "billing", "login", "pay", "payment", "recover", "reset", "secure", "security", "signin", "unlock", "verification", "verify", "wallet")
DEV_HOSTING = ("vercel.app", "netlify.app", "pages.dev", "workers.dev", "herokuapp.com", "web.app", "firebaseapp.com", "github.io")
FREE_HOSTING = (*DEV_HOSTING, "blogspot.com", "wordpress.com", "weebly.com", "wixsite.com")
SHOWN_HOST = r"(?i)^\s*(?:https?://)?((?:[a-z0-9-]+\.)+[a-z]{2,})(?:[/:?#\s]|$)"


def _any_word(tokens: Column, words: tuple[str, ...]) -> Column:
    return F.arrays_overlap(tokens, F.array(*map(F.lit, words)))


def _below(host: Column, suffixes: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, suffixes)), lambda s: F.endswith(host, F.concat(F.lit("."), s)))


def _imitates(labels: Column, name: str) -> Column:
    """A label that is not the name but reads as it."""
    return F.exists(labels, lambda x: (x != name) & (T.leet_fold(x) == name))


def findings(links: DataFrame, brands: dict[str, tuple[str, ...]], *, label_col: str = "label", target_col: str = "destination", known: tuple[str, ...] = ()) -> DataFrame:
    """links with found: the codes that a link gives. brands: name to its own domains."""
    target = F.trim(F.col(target_col))
    scheme = F.lower(F.regexp_extract(target, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    web = F.regexp_replace(target, r"(?i)^hxxp(s?)://", "http$1://")
    is_web = scheme.isin("http", "https", "hxxp", "hxxps")
    host = F.regexp_replace(N.host(web), r"\.$", "")
    sound = host.rlike(r"^(?:[\p{L}\p{N}_-]+\.)*[\p{L}\p{N}_-]+$") | host.rlike(r"^\[[0-9a-f:.]+\]$")
    shown = F.lower(F.regexp_extract(label_col, SHOWN_HOST, 1))
    folded = T.leet_fold(host)
    tokens = F.regexp_extract_all(folded, F.lit("[a-z0-9]+"), F.lit(0))
    labels = F.split(host, r"\.")
    collects = _any_word(tokens, ("credential", "password", "passcode", "otp")) & _any_word(tokens, ("capture", "harvest", "steal"))
    is_known = _below(F.concat(F.lit("."), host), known) if known else F.lit(False)
    on_free = _below(host, FREE_HOSTING)
    confusable, lookalike, free_brand = F.lit(False), F.lit(False), F.lit(False)
    for name, own in brands.items():
        official = _below(F.concat(F.lit("."), host), own)
        confusable = confusable | (~official & F.contains(F.element_at(F.split(folded, r"\."), 1), F.lit(name)) & (F.startswith(host, F.lit("xn--")) | (folded != host)) & host.rlike(r"[^\x00-\x7f]|^xn--"))
        lookalike = lookalike | (~official & _imitates(labels, name))
        free_brand = free_brand | (on_free & F.contains(F.element_at(labels, 1), F.lit(name)))
    rules = {
        "obfuscated_scheme": scheme.isin("hxxp", "hxxps"),
        "malformed_target": is_web & ~sound,
        "unsafe_scheme": scheme.isin("data", "file", "javascript"),
        "url_userinfo": is_web & web.rlike(r"^[A-Za-z]+://[^/?#]*@"),
        "ip_host": is_web & (N.ipv4_number(host).isNotNull() | host.rlike(r"^\[|^(?:0x[0-9a-f]+|\d{8,10})$")),
        "ipfs_gateway": is_web & (host.rlike(r"(?:^|\.)ipfs\.") | N.path(web).rlike(r"^/ip[fn]s/[A-Za-z0-9]{20,}")),
        "display_mismatch": is_web & (shown != "") & (host != "") & ~N.aligned(shown, host),
        "idn_confusable": is_web & confusable,
        "brand_lookalike": is_web & lookalike,
        "dev_hosting": is_web & _below(host, DEV_HOSTING),
        "brand_on_free_host": is_web & free_brand,
        "credential_collection_host": is_web & ~is_known & collects,
        "sensitive_host": is_web & ~is_known & ~collects & _any_word(tokens, SENSITIVE),
    }
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull())
    return links.withColumns({"host": host, "found": found})


def evidence(found: DataFrame, id_col: str) -> DataFrame:
    """One row for each message and code: id, code, points, floor."""
    codes = found.select(id_col, F.explode("found").alias("code")).distinct()
    table = F.create_map(*[x for k, (p, f) in FINDINGS.items() for x in (F.lit(k), F.struct(F.lit(p).alias("points"), F.lit(f).alias("floor")))])
    value = table[F.col("code")]
    return codes.select(id_col, "code", value["points"].cast("long").alias("points"), value["floor"].alias("floor"))


def in_text(text: Column) -> Column:
    """Links of plain text and Markdown as array<struct<label,destination>>: a bare link is its own label."""
    markdown = F.regexp_extract_all(text, F.lit(r"\[[^\]\n]{1,300}\]\([^)\s]+\)"), F.lit(0))
    bare = F.regexp_extract_all(F.regexp_replace(text, r"\[[^\]\n]{1,300}\]\([^)\s]+\)", " "), F.lit(r"(?i)\b(?:https?|hxxps?)://[^\s<>\"']+"), F.lit(0))
    named = F.transform(markdown, lambda m: F.struct(F.regexp_extract(m, r"^\[([^\]]*)\]", 1).alias("label"), F.regexp_extract(m, r"\]\(([^)]*)\)$", 1).alias("destination")))
    plain = F.transform(bare, lambda b: F.struct(F.regexp_replace(b, r"[.,;:!?)\]]+$", "").alias("label"), F.regexp_replace(b, r"[.,;:!?)\]]+$", "").alias("destination")))
    return F.array_distinct(F.concat(named, plain))
