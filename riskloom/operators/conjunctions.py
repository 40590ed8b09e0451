"""Rules that ask for several concepts at once, and for links or numbers: text-message findings and mail lures.

A rule is a row of data: concepts that must all be in the text, concepts that must not, and what kind of link the message
needs. Concepts are names into a table of words, so users bring their own; each is looked up once a text."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import network as N
from riskloom.functions import words as W
from riskloom.operators import links as K
from riskloom.operators.vocabulary import CONCEPTS, Concept


@dataclass(frozen=True)
class Rule:
    code: str
    needs: tuple[str, ...] = ()
    never: tuple[str, ...] = ()
    #: "any", "off" (outside the claimed or sender's domains), "short" (a shortener), "action" (an action's label, off).
    link: str | None = None
    points: int = 4
    floor: str = "medium"


#: Numbers that cost the caller: fixed prefixes of the numbering plans.
PREMIUM = (r" (?:call|dial|ring)(?: \S+){0,6} (?:1 ?900|0 ?9[01]\d|09\d{2}|9[78]\d)\d*[\d ]{4,} ",)
SMS = (
    Rule("sms.reopen_to_activate", ("reopen",)), Rule("sms.reopen_to_activate", ("copy_link",)), Rule("sms.reopen_to_activate", ("reopen_han",)),
    Rule("sms.prize_callback", ("prize", "call_number")), Rule("sms.split_words", ("broken_lure", "=split")), Rule("sms.external_contact_lure", ("easy_money", "messenger")),
    Rule("sms.job_offer", ("job", "pay"), link="short"), Rule("sms.job_offer", ("job", "pay", "messenger")), Rule("sms.job_offer", ("job", "pay", "contact")),
    Rule("sms.premium_callback", ("=premium",)), Rule("sms.account_lure", ("account_lure_han",), ("warning",), "any"),
    Rule("sms.gambling_promo", ("gambling",), link="any"), Rule("sms.gambling_promo", ("gambling", "messenger")), Rule("sms.prize_link", ("prize",), ("warning",), "off"),
    Rule("sms.flight_compensation", ("flight", "refund")), Rule("sms.stock_group", ("stock", "group")), Rule("sms.album_link", ("album",), link="any"),
    Rule("sms.account_threat", ("account", "block", "fix"), ("warning",), "off"), Rule("sms.account_threat", ("account", "block", "call_number"), ("warning",)),
    Rule("sms.utility_cutoff", ("utility", "call_number")), Rule("sms.refund_lure", ("government", "refund"), ("warning",), "off"), Rule("sms.family_new_number", ("family", "new_phone")),
    Rule("sms.parcel_problem", ("parcel", "parcel_problem"), ("warning",), "off"), Rule("sms.delivery_lure", ("parcel", "parcel_act"), ("warning",), "off"),
    Rule("sms.authority_threat", ("authority", "authority_lure"), ("warning",), "off"), Rule("sms.loan_offer", ("loan", "approved"), ("warning",), "off"),
    Rule("sms.fine_lure", ("fine",), ("warning",), "off"), Rule("sms.fine_lure", ("fine_han",), ("warning",), "off"),
)
LURES = (
    Rule("lure.mailbox", ("mailbox",), ("warning",), "action", floor="high"), Rule("lure.file_share", ("file_service", "file_notice"), (), "action", points=3),
    Rule("lure.delivery", ("parcel", "parcel_problem", "parcel_act"), ("warning",), "action", points=3), Rule("lure.fine", ("fine",), ("warning",), "off", points=3),
    Rule("lure.account_hold", ("account", "block", "fix"), ("warning",), "off", floor="high"), Rule("lure.subsidy", ("subsidy",), ("warning",), floor="high"),
    Rule("lure.callback", ("dispute", "call_number"), ("warning",), floor="high"), Rule("lure.user_content", (), (), "publish", points=3),
)
#: Words of a link's label that ask for an act, and those that speak of an account.
ACTIONS = ("verify", "confirm", "update", "open", "view", "click", "log in", "login", "sign in", "download", "review", "pay", "schedule", "continue", "restore", "upgrade", "unlock", "access")
SHORTENERS = ("bit.ly", "tinyurl.com", "goo.gl", "ow.ly", "t.co", "is.gd", "t.cn", "dwz.cn", "rb.gy", "cutt.ly")
#: Places under which anyone may publish a page.
PUBLISH = ("docs.google.com", "forms.gle", "sites.google.com", "notion.site", "weebly.com", "wixsite.com", "blogspot.com", "jotform.com", "typeform.com", "github.io", "web.app")
#: Marks between Han characters that break their words up.
BREAK = "[一-鿿][.|~*_·•-]+[一-鿿]"


def special(name: str, text: Column, plain: Column) -> Column:
    """Concepts that are no words: numbers that cost, and Han words broken up at four places or more."""
    if name == "=premium":
        return plain.rlike(PREMIUM[0])
    # Matches cannot share a character, so the breaks at other places are counted in the text without its first character of each match.
    return F.regexp_count(F.regexp_replace(text, "([一-鿿])", "$1$1"), F.lit(BREAK)) >= 4


def special_sql(name: str, text: str, plain: str) -> str:
    if name == "=premium":
        return f"regexp_matches({plain}, '{PREMIUM[0]}')"
    return f"len(regexp_extract_all(regexp_replace(coalesce({text}, ''), '([一-鿿])', '\\1\\1', 'g'), '{BREAK}')) >= 4"


def evaluate(df: DataFrame, rules: tuple[Rule, ...], *, text_col: str, links: Column | None = None, own_domains: Column | None = None, concepts: dict[str, Concept] | None = None) -> DataFrame:
    """df with found: array of struct(code, points, floor), each code once. links: array<struct<label,destination>>, by
    default those of the text; own_domains: domains that a link may point to (none)."""
    concepts = concepts or CONCEPTS
    text = F.coalesce(F.col(text_col), F.lit(""))
    used = sorted({p for r in rules for p in (*r.needs, *r.never)})
    rows = W.once(df.withColumn("_own", own_domains if own_domains is not None else F.array().cast("array<string>")), "_text", W.plain(text))
    rows = W.once(rows, "_links", links if links is not None else K.in_text(text))
    rows = rows.withColumns({f"_p_{p}": special(p, text, F.col("_text")) if p.startswith("=") else F.col("_text").rlike(concepts[p].pattern()) for p in used})
    host = lambda l: N.host(l["destination"])
    off = lambda l: (host(l) != "") & ~F.exists("_own", lambda d: F.endswith(F.concat(F.lit("."), host(l)), F.concat(F.lit("."), d)))
    acts = lambda l: W.plain(l["label"]).rlike(f" {W.either(ACTIONS)} ")
    kinds = {
        "any": F.size("_links") > 0, "off": F.exists("_links", off), "short": F.exists("_links", lambda l: host(l).isin(*SHORTENERS)), "action": F.exists("_links", lambda l: off(l) & acts(l)),
        "publish": F.exists("_links", lambda l: acts(l) & F.exists(F.array(*map(F.lit, PUBLISH)), lambda s: F.endswith(F.concat(F.lit("."), host(l)), F.concat(F.lit("."), s)))),
    }
    rows = rows.withColumns({f"_l_{k}": c for k, c in kinds.items() if any(r.link == k for r in rules)})
    found = []
    for r in rules:
        tests = [F.col(f"_p_{p}") for p in r.needs] + [~F.col(f"_p_{p}") for p in r.never] + ([F.col(f"_l_{r.link}")] if r.link else [])
        value = F.struct(F.lit(r.code).alias("code"), F.lit(r.points).alias("points"), F.lit(r.floor).alias("floor"))
        found.append(F.when(reduce(lambda a, b: a & b, tests), value))
    out = F.array_distinct(F.filter(F.array(*found), lambda x: x.isNotNull()))
    return rows.withColumn("found", out).drop(*[c for c in rows.columns if c.startswith("_") and c not in df.columns])


def codes_sql(rules: tuple[Rule, ...], *, text: str, hosts: str, labels: str, concepts: dict[str, Concept] | None = None) -> str:
    """DuckDB: the codes of the rules for a text with lists of its links' hosts and labels (of equal length), without own
    domains. Columns named plain and links(struct host, label) are expected beside it."""
    concepts = concepts or CONCEPTS
    acts = f"regexp_matches({W.plain_sql('l.label')}, ' {W.either(ACTIONS)} ')"
    publish = " OR ".join(f"ends_with('.' || l.host, '.{s}')" for s in PUBLISH)
    link = {
        "any": "len(links) > 0", "off": "len(list_filter(links, lambda l: l.host <> '')) > 0", "short": "len(list_filter(links, lambda l: l.host IN (" + ", ".join(f"'{s}'" for s in SHORTENERS) + "))) > 0",
        "action": f"len(list_filter(links, lambda l: l.host <> '' AND {acts})) > 0", "publish": f"len(list_filter(links, lambda l: {acts} AND ({publish}))) > 0",
    }

    def test(p: str) -> str:
        return special_sql(p, text, "plain") if p.startswith("=") else f"regexp_matches(plain, '{concepts[p].pattern()}')"

    cases: dict[str, list[str]] = {}
    for r in rules:
        cases.setdefault(r.code, []).append(" AND ".join(["true", *map(test, r.needs), *(f"NOT {test(p)}" for p in r.never), *([link[r.link]] if r.link else [])]))
    return "list_filter([" + ", ".join(f"CASE WHEN ({') OR ('.join(c)}) THEN '{code}' END" for code, c in cases.items()) + "], lambda x: x IS NOT NULL)"


def sender_kind(sender: Column) -> Column:
    """cn_mobile, cn_port_106, short_code, nanp_toll_free, nanp_long_code, alphanumeric, email, other or none.

    Toll-free numbers come first: with their country code they would read as Chinese mobiles."""
    digits = F.regexp_replace(sender, r"[\s()+.-]", "")
    national = F.regexp_replace(digits, r"^(?:0086|86)(?=1[3-9]\d{9}$|106\d{5,})", "")
    ten = F.regexp_replace(digits, r"^1(?=\d{10}$)", "")
    return (
        F.when(sender.isNull() | (F.trim(sender) == ""), "none").when(F.contains(sender, F.lit("@")), "email").when(sender.rlike("[A-Za-z]"), "alphanumeric")
        .when(ten.rlike(r"^8(?:00|33|44|55|66|77|88)\d{7}$"), "nanp_toll_free").when(national.rlike(r"^1[3-9]\d{9}$") & ~F.trim(sender).startswith("+1"), "cn_mobile").when(national.rlike(r"^106\d{5,}$"), "cn_port_106")
        .when(digits.rlike(r"^\d{3,6}$"), "short_code")
        .when(ten.rlike(r"^[2-9]\d{9}$"), "nanp_long_code").otherwise("other")
    )


def finding(code: str, points: int, floor: str) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(points).alias("points"), F.lit(floor).alias("floor"))


def sender_mismatch(kind: Column, region: Column) -> Column:
    """struct(code, points, floor) if an organisation of the region (cn, intl) does not text from that kind; else null."""
    expected = ((region == "cn") & kind.isin("short_code", "cn_port_106")) | ((region == "intl") & kind.isin("short_code", "nanp_toll_free"))
    silent = region.isNull() | kind.isin("none", "alphanumeric") | expected
    return F.when(silent, None).when((region == "intl") & (kind == "nanp_long_code"), finding("sms.sender_mismatch_weak", 2, "safe")).otherwise(finding("sms.sender_mismatch", 4, "medium"))


def claimed_brand(plain: Column, brands: dict[str, tuple[str, tuple[str, ...]]]) -> Column:
    """The first brand (name: region and own domains) that a plain text names, of those of most letters, as a struct of
    name, region and domains; null if it names none."""
    out = F.lit(None)
    for name in sorted(brands, key=lambda n: (len(n), n)):
        region, domains = brands[name]
        value = F.struct(F.lit(name).alias("name"), F.lit(region).alias("region"), F.array(*map(F.lit, domains)).alias("domains"))
        out = F.when(F.contains(plain, F.lit(W.needle(name))), value).otherwise(out)
    return out


def link_off_brand(brand: Column, links: Column) -> Column:
    """2 points without a floor if a message that names a brand has a link to none of its domains."""
    def off(l):
        host = N.host(l["destination"])
        return (host != "") & ~F.exists(brand["domains"], lambda d: F.endswith(F.concat(F.lit("."), host), F.concat(F.lit("."), d)))

    return F.when(brand.isNotNull() & F.exists(links, off), finding("sms.link_off_brand", 2, "safe"))


def prefilled(destination: Column, recipient: Column) -> Column:
    """Whether a link carries its recipient's address: as it is, with its marks escaped, or in base64 of either alphabet,
    outside of its host. Links of subscriptions do so rightly."""
    address = F.lower(F.trim(recipient))
    beyond = F.regexp_extract(destination, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(.*)$", 1)
    encoded = F.regexp_replace(F.base64(address.cast("binary")), r"[\r\n=]", "")
    decoded = F.lower(F.replace(F.replace(beyond, F.lit("%40"), F.lit("@")), F.lit("%2B"), F.lit("+")))
    subscription = F.lower(beyond).rlike("unsubscribe|subscription|preferences|optout|opt-out")
    carries = F.contains(decoded, address) | F.contains(beyond, encoded) | F.contains(beyond, F.translate(encoded, "+/", "-_"))
    return F.coalesce((F.length(address) >= 6) & F.contains(address, F.lit("@")) & carries & ~subscription, F.lit(False))


def verdict(found: Column) -> Column:
    """unknown without a finding; else the level of the findings' points and floors."""
    from riskloom.operators.rules import content_verdict

    points = F.aggregate(found, F.lit(0), lambda acc, x: acc + x["points"])
    floor = F.when(F.exists(found, lambda x: x["floor"] == "high"), "high").when(F.exists(found, lambda x: x["floor"] == "medium"), "medium").otherwise("safe")
    return F.when(F.size(found) == 0, "unknown").otherwise(content_verdict(points, floor))
