"""Addresses, hosts, links and IP numbers as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Services whose local parts ignore dots, and whose aliases follow a plus sign.
DOT_ALIAS_DOMAINS = ("gmail.com", "googlemail.com")


def host(url: Column) -> Column:
    """Lower-case host of an http(s) link, without user information and port."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", ""))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, r"#(.*)$", 1)


def suffixes(domain: Column) -> Column:
    """The domain and every parent of it, longest first."""
    labels = F.split(domain, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def local_part(address: Column) -> Column:
    return F.lower(F.substring_index(address, "@", 1))


def domain_part(address: Column) -> Column:
    return F.lower(F.substring_index(address, "@", -1))


def canonical_address(address: Column) -> Column:
    """Without what follows a plus sign, and without dots where the service ignores them."""
    local = F.substring_index(local_part(address), "+", 1)
    domain = domain_part(address)
    return F.concat(F.when(domain.isin(*DOT_ALIAS_DOMAINS), F.replace(local, F.lit("."), F.lit(""))).otherwise(local), F.lit("@"), domain)


def ipv4_number(a: Column) -> Column:
    """Value of a dotted quad, null if it is none."""
    part = F.split(a, r"\.")
    ok = a.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$")
    number = sum((F.get(part, i).cast("long") * F.lit(256 ** (3 - i)) for i in range(4)), F.lit(0).cast("long"))
    return F.when(ok, number)


def aligned(a: Column, b: Column) -> Column:
    """Equal domains, or one below the other."""
    return (a == b) | F.endswith(a, F.concat(F.lit("."), b)) | F.endswith(b, F.concat(F.lit("."), a))
