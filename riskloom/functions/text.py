"""Text functions as Columns: canonical forms, fingerprints, style cues and masks.

Patterns carry (?U) where a word character may be any letter; blanks and digits then follow Unicode as well.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The tokens that stand for masked spans.
EMAIL_TOKEN, URL_TOKEN, TIME_TOKEN, YEAR_TOKEN, NUMBER_TOKEN = "zzemail", "zzurl", "zztime", "zzyear", "zznum"
ADDRESS = r"(?U)\b[\w.+-]+@[\w.-]+\.[a-z]{2,}\b"


def squeeze(text: Column) -> Column:
    """One blank for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def family_text(text: Column) -> Column:
    """Lower case with addresses, links and whole numbers masked."""
    masked = F.regexp_replace(F.lower(F.trim(text)), ADDRESS, " <email> ")
    masked = F.regexp_replace(masked, r"(?U)\b(?:https?://|www\.)\S+", " <url> ")
    return squeeze(F.regexp_replace(masked, r"(?U)\b\d+\b", " <number> "))


def family_id(text: Column) -> Column:
    return F.concat(F.lit("content:"), F.substring(F.sha2(family_text(text).cast("binary"), 256), 1, 20))


def template_fingerprint(text: Column) -> Column:
    """Digest of a masked text of at least 80 characters and 12 words, else null."""
    masked = F.regexp_replace(F.lower(text), r"https?://[^\s<>]+", "<url>")
    masked = F.regexp_replace(masked, ADDRESS, "<email>")
    masked = squeeze(F.regexp_replace(masked, r"(?U)\d+", "<number>"))
    return F.when((F.length(masked) >= 80) & (F.size(F.split(masked, " ")) >= 12), F.sha2(masked.cast("binary"), 256))


def model_text(text: Column) -> Column:
    """Surface details that tell corpora apart replaced by tokens; applying it again changes nothing."""
    out = F.regexp_replace(text, r"(?m)^[ \t]*(?:>[ \t]?)+", "")
    out = F.regexp_replace(out, r"(?iU)\b[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}\b", f" {EMAIL_TOKEN} ")
    out = F.regexp_replace(out, r"(?iU)\b(?:https?://|www\.)\S+?(?=[.,;:!?)\]]*(?:\s|$))", f" {URL_TOKEN} ")
    out = F.regexp_replace(out, r"(?iU)\b\d{1,2}(?::\d{2}(?::\d{2})?(?:\s*[ap]\.?m\b\.?)?|\s*[ap]\.?m\b\.?)", f" {TIME_TOKEN} ")
    out = F.regexp_replace(out, r"(?U)\b(?:19|20)\d{2}\b", f" {YEAR_TOKEN} ")
    return squeeze(F.regexp_replace(out, r"(?U)\b\d+(?:[.,]\d+)*\b", f" {NUMBER_TOKEN} "))


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]", ""))


def capitals_share(text: Column) -> Column:
    """Upper-case letters among all letters; 0 without letters."""
    n = letters(text)
    return F.when(n > 0, F.length(F.regexp_replace(text, r"[^\p{Lu}]", "")) / n).otherwise(F.lit(0.0))


def count_char(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 for an empty text."""
    chars = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    n = F.size(chars).cast("double")
    # Sorted characters are walked once: at the end of a run of equal ones its share is known.
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("place"), F.lit(0).alias("begin"))

    def step(acc, c):
        place = acc["place"] + 1
        last = F.coalesce(F.get(chars, place) != c, F.lit(True))
        share = (place - acc["begin"]) / n
        return F.struct(F.when(last, acc["sum"] - share * F.log2(share)).otherwise(acc["sum"]).alias("sum"), place.alias("place"), F.when(last, place).otherwise(acc["begin"]).alias("begin"))

    return F.aggregate(chars, start, step, lambda acc: acc["sum"])


#: Look-alike groups folded first, then single characters.
FOLD_GROUPS = (("vv", "w"), ("rn", "m"), ("nn", "m"), ("cl", "d"))
FOLD_FROM, FOLD_TO = "0134568@", "oleasgba"


def leet_fold(text: Column) -> Column:
    """Look-alike character groups and digits as the letters they imitate; the order matters."""
    out = F.lower(text)
    for group, letter in FOLD_GROUPS:
        out = F.replace(out, F.lit(group), F.lit(letter))
    return F.translate(out, FOLD_FROM, FOLD_TO)


def mask_private(text: Column) -> Column:
    """Addresses, card tails and long digit runs masked."""
    out = F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<address>")
    out = F.regexp_replace(out, r"(?:\d[ -]?){13,19}", "<card>")
    out = F.regexp_replace(out, r"\+?\d[\d ()-]{7,}\d", "<phone>")
    return F.regexp_replace(out, r"\d{4,8}", "<code>")


def large_amounts(text: Column) -> Column:
    """Amounts beside a currency sign with at least five digits before the decimals: the first four, judged as text."""
    found = F.regexp_extract_all(text, F.lit(r"[$€£¥] ?\d[\d.,]*"), F.lit(0))
    whole = lambda a: F.regexp_replace(F.regexp_replace(a, r"[.,]\d{1,2}$", ""), r"\D", "")
    return F.slice(F.filter(found, lambda a: (F.length(whole(a)) >= 5) & (F.length(a) <= 80)), 1, 4)


def salted_share(key: Column, salt: str) -> Column:
    """First byte of a digest of salt and key, 0 to 255: the basis of a split that needs no memory."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(salt + ":"), key).cast("binary"), 256), 1, 2), 16, 10).cast("int")
