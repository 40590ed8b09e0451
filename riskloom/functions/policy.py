"""Mail policy records as Columns, once the DNS texts are a column: SPF, DMARC, age bands and the overall status."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The shapes of SPF terms and DMARC fields.
SPF_TERM = r"(?i)^(?:[+?~-]?(?:all|(?:include|exists):\S+|(?:a|mx)(?::\S+|/[0-9]+(?://[0-9]+)?|//[0-9]+)?|ptr(?::\S+)?|ip[46]:\S+)|[a-z][a-z0-9._-]*=\S+)$"
DMARC_FIELD = r"^\s*([a-zA-Z][a-zA-Z0-9_]*)\s*=\s*(.*?)\s*$"


def spf(records: Column) -> Column:
    """strict, softfail, neutral, open or unknown by the first "all" of the one SPF record; missing; error."""
    own = F.filter(records, lambda r: r.rlike(r"(?i)^v=spf1(?:\s|$)"))
    terms = F.filter(F.slice(F.split(F.trim(F.get(own, 0)), r"\s+"), 2, 10_000), lambda t: t != "")
    first = F.lower(F.get(F.filter(terms, lambda t: t.rlike(r"(?i)^[+?~-]?all$")), 0))
    return (
        F.when(F.size(own) == 0, "missing").when(F.size(own) > 1, "error").when(F.exists(terms, lambda t: ~t.rlike(SPF_TERM)), "error")
        .when(first == "-all", "strict").when(first == "~all", "softfail").when(first == "?all", "neutral").when(first.isin("+all", "all"), "open").otherwise("unknown")
    )


def dmarc(records: Column) -> Column:
    """struct(status, policy, pct) of the one DMARC record; status is ok, missing or error."""
    own = F.filter(records, lambda r: r.rlike(r"^v\s*=\s*DMARC1\s*(?:;|$)"))
    fields = F.split(F.regexp_replace(F.rtrim(F.get(own, 0)), ";$", ""), ";")
    names = F.transform(fields, lambda f: F.regexp_extract(f, DMARC_FIELD, 1))
    value = lambda name: F.get(F.filter(F.transform(fields, lambda f: F.when(F.regexp_extract(f, DMARC_FIELD, 1) == name, F.regexp_extract(f, DMARC_FIELD, 2))), lambda v: v.isNotNull()), 0)
    policy, pct = value("p"), F.coalesce(value("pct"), F.lit("100"))
    sound = (
        ~F.exists(fields, lambda f: ~f.rlike(DMARC_FIELD)) & (F.size(F.array_distinct(names)) == F.size(names))
        & F.coalesce(policy.isin("reject", "quarantine", "none"), F.lit(False)) & pct.rlike("^[0-9]{1,3}$")
    )
    number = F.when(pct.rlike("^[0-9]{1,3}$"), pct).cast("int")
    status = F.when(F.size(own) == 0, "missing").when((F.size(own) == 1) & sound & (number <= 100), "ok").otherwise("error")
    return F.struct(status.alias("status"), F.when(status == "ok", policy).alias("policy"), F.when(status == "ok", number).alias("pct"))


def age_band(created: Column, today: Column) -> Column:
    days = F.datediff(today, created)
    return F.when(created.isNull(), "no_date").when(days < 30, "very_new").when(days < 180, "new").when(days < 365, "under_year").otherwise("established")


def domain_status(format_valid: Column, null_mx: Column, mx_found: Column, checks_complete: Column, likely_invalid: Column) -> Column:
    return (
        F.when(~format_valid, "invalid_format").when(null_mx, "no_mail_service").when(mx_found & checks_complete, "valid").when(mx_found, "partial")
        .when(likely_invalid, "invalid").otherwise("unavailable")
    )


def mailbox_status(smtp_enabled: Column, smtp_result: Column) -> Column:
    return F.when(~smtp_enabled, "unavailable").when(smtp_result == "exists", "accepted").when(smtp_result == "does_not_exist", "rejected").otherwise("inconclusive")
