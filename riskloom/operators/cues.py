"""Cues of a message's wording beside the keyword categories: requests under pressure, numbers to call, salutations, calls
to action, phrases of a region, advertising, commands to a reading machine, disguised words.

Every cue is a column over the plain text or the text itself, so a whole set is one projection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import words as W
from riskloom.operators.requests import DENIALS
from riskloom.operators.vocabulary import CONCEPTS

#: What asks for credentials, and the words within which pressure or a dispute counts for it.
ASKS_CREDENTIAL = ("verify your account", "verify your identity", "confirm your account", "confirm your identity", "confirm your password", "update your account", "update your details", "validate your account", "reactivate your account", "unlock your account", "enter your password")
REACH = 40
#: Letters of other scripts that pass for Latin ones, in one order with what they pass for.
CONFUSABLE, LATIN = "аеорсухіѕјԁһкмтвнαενορτυ", "aeopcyxisjdhkmtbhaevoptu"
OTHER_SCRIPT = "[Ͱ-ϿЀ-ӿ]"
#: Letters of scripts that the models have no words of.
UNCOVERED = "[Ͱ-ϿЀ-ӿ֐-׿؀-ۿ฀-๿぀-ヿ一-鿿가-힯]"
INJECTION = CONCEPTS["injection"].pattern()


def _within(first: str, second: str) -> str:
    """Either order, at most REACH words apart; both patterns begin and end with a blank."""
    gap = f"(?: \\S+){{0,{REACH}}}"
    return f"{first[:-1]}{gap}{second}|{second[:-1]}{gap}{first}"


def _phrase(words: tuple[str, ...]) -> str:
    return f" {W.either(tuple(w for w in words if not W.is_han(w)))} "


PRESSED = _within(_phrase(ASKS_CREDENTIAL), _phrase(CONCEPTS["pressure"].words))
DENIED_ASK = f" {W.either(DENIALS)}(?: \\S+){{0,4}}{_phrase(ASKS_CREDENTIAL)}"
CALLBACK = _within(CONCEPTS["call_number"].patterns()[0], _phrase(CONCEPTS["dispute"].words))
#: Points and floor of each cue.
POINTS = {"pressed_credential": (4, "high"), "callback": (4, "high"), "subsidy": (4, "high"), "salutation": (2, "safe"), "calls_to_action": (1, "safe"), "regional": (0, "safe"), "mixed_script": (3, "medium"), "letter_swap": (3, "safe")}


def letter_swaps(text: Column) -> Column:
    """Words with a capital I for a small l, or the other way round: "PaypaI", "APPlE"."""
    return F.filter(F.split(text, "[^A-Za-z]+"), lambda w: w.rlike("^[A-Z]?[a-z]+I[a-z]*$") | w.rlike("^[A-Z]{2,}l[A-Z]*$"))


def letter_swaps_sql(text: str) -> str:
    return f"list_filter(str_split_regex({text}, '[^A-Za-z]+'), lambda w: regexp_matches(w, '^[A-Z]?[a-z]+I[a-z]*$') OR regexp_matches(w, '^[A-Z]{{2,}}l[A-Z]*$'))"


def mixed_script(text: Column) -> Column:
    """Words that mix Latin letters with look-alikes of other scripts, as the Latin words that they pass for."""
    words = F.filter(F.split(F.lower(text), "[^\\p{L}]+"), lambda w: w.rlike("[a-z]") & w.rlike(OTHER_SCRIPT))
    return F.transform(words, lambda w: F.translate(w, CONFUSABLE, LATIN))


def mixed_script_sql(text: str) -> str:
    return f"list_transform(list_filter(str_split_regex(lower({text}), '[^\\p{{L}}]+'), lambda w: regexp_matches(w, '[a-z]') AND regexp_matches(w, '{OTHER_SCRIPT}')), lambda w: translate(w, '{CONFUSABLE}', '{LATIN}'))"


def uncovered(text: Column, letters: int = 12) -> Column:
    """Runs of at least so many letters, blanks between words aside, of scripts without a model."""
    return F.filter(F.regexp_extract_all(text, F.lit(f"{UNCOVERED}+(?: {UNCOVERED}+)*"), F.lit(0)), lambda r: F.length(F.replace(r, F.lit(" "), F.lit(""))) >= letters)


def uncovered_sql(text: str, letters: int = 12) -> str:
    return f"list_filter(regexp_extract_all({text}, '{UNCOVERED}+(?: {UNCOVERED}+)*'), lambda r: length(replace(r, ' ', '')) >= {letters})"


def han_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(W.HAN)).cast("long")


def cues(df: DataFrame, *, id_cols: list[str], text_col: str) -> DataFrame:
    """id columns, the cues, and points and floor that they give together."""
    plain = F.col("_plain")
    rows = W.once(df.select(*id_cols, F.coalesce(F.col(text_col), F.lit("")).alias("_text")), "_plain", W.plain(F.col("_text")))
    count = lambda c: F.size(W.held(plain, CONCEPTS[c].words)).cast("long")
    values = {
        "pressed_credential": plain.rlike(PRESSED) & ~plain.rlike(DENIED_ASK),
        "callback": plain.rlike(CALLBACK),
        "subsidy": plain.rlike(CONCEPTS["subsidy"].pattern()),
        "salutation": plain.rlike(CONCEPTS["salutation"].pattern()),
        "calls_to_action": count("call_to_action"),
        "regional": W.held(plain, CONCEPTS["regional"].words),
        "advertising": count("advertising"),
        "injection": plain.rlike(INJECTION),
        "mixed_script": mixed_script(F.col("_text")),
        "letter_swap": letter_swaps(F.col("_text")),
    }
    rows = rows.select(*id_cols, *[v.alias(k) for k, v in values.items()])
    shown = {"calls_to_action": F.col("calls_to_action") >= 2, "regional": F.size("regional") > 0, "mixed_script": F.size("mixed_script") > 0, "letter_swap": F.size("letter_swap") > 0}
    on = {k: shown.get(k, F.col(k)) for k in POINTS}
    points = reduce(lambda a, b: a + b, [F.when(on[k], p).otherwise(0) for k, (p, _) in POINTS.items()])
    any_of = lambda level: reduce(lambda a, b: a | b, [on[k] for k, (_, f) in POINTS.items() if f == level])
    return rows.withColumns({"points": points.cast("long"), "floor": F.when(any_of("high"), "high").when(any_of("medium"), "medium").otherwise("safe")})


def cues_sql(source: str, id_cols: list[str]) -> str:
    ids = ", ".join(id_cols)
    words = lambda c: W.held_sql("plain", CONCEPTS[c].words)
    on = {"calls_to_action": "calls_to_action >= 2", "regional": "len(regional) > 0", "mixed_script": "len(mixed_script) > 0", "letter_swap": "len(letter_swap) > 0"}
    points = " + ".join(f"CASE WHEN {on.get(k, k)} THEN {p} ELSE 0 END" for k, (p, _) in POINTS.items())
    any_of = lambda level: " OR ".join(on.get(k, k) for k, (_, f) in POINTS.items() if f == level)
    return f"""p AS (SELECT {ids}, coalesce(text, '') AS text, {W.plain_sql('text')} AS plain FROM {source}),
c AS (SELECT {ids}, regexp_matches(plain, '{PRESSED}') AND NOT regexp_matches(plain, '{DENIED_ASK}') AS pressed_credential, regexp_matches(plain, '{CALLBACK}') AS callback, regexp_matches(plain, '{CONCEPTS['subsidy'].pattern()}') AS subsidy,
  regexp_matches(plain, '{CONCEPTS['salutation'].pattern()}') AS salutation, len({words('call_to_action')}) AS calls_to_action, {words('regional')} AS regional, len({words('advertising')}) AS advertising, regexp_matches(plain, '{INJECTION}') AS injection,
  {mixed_script_sql('text')} AS mixed_script, {letter_swaps_sql('text')} AS letter_swap FROM p)
SELECT *, CAST({points} AS BIGINT) AS points, CASE WHEN {any_of('high')} THEN 'high' WHEN {any_of('medium')} THEN 'medium' ELSE 'safe' END AS floor FROM c"""


def subject_template(subject: Column) -> Column:
    """A subject without marks of replies, with digits and addresses masked: what a campaign's subjects share."""
    out = F.regexp_replace(F.lower(F.trim(subject)), "^(?:(?:re|fwd?|aw|wg|回复|转发)(?:\\[\\d+\\])? ?[:：] *)+", "")
    out = F.regexp_replace(out, "[a-z0-9._%+-]+@[a-z0-9.-]+", "<address>")
    return F.trim(F.regexp_replace(F.regexp_replace(out, "[0-9]+", "#"), "[ \\t]+", " "))


def subject_template_sql(subject: str) -> str:
    out = f"regexp_replace(lower(trim({subject})), '^(?:(?:re|fwd?|aw|wg|回复|转发)(?:\\[\\d+\\])? ?[:：] *)+', '')"
    out = f"regexp_replace({out}, '[a-z0-9._%+-]+@[a-z0-9.-]+', '<address>', 'g')"
    return f"trim(regexp_replace(regexp_replace({out}, '[0-9]+', '#', 'g'), '[ \\t]+', ' ', 'g'))"


def redact(text: Column) -> Column:
    """What may leave the house: links, addresses and runs of digits by their kind only."""
    out = F.regexp_replace(text, "(?:https?|hxxps?)://[^ \\t\\r\\n<>\"]+", "[link]")
    out = F.regexp_replace(out, "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}", "[address]")
    return F.regexp_replace(out, "\\+?[0-9](?:[0-9 ().-]{2,}[0-9])+", "[number]")


def redact_sql(text: str) -> str:
    out = f"regexp_replace({text}, '(?:https?|hxxps?)://[^ \\t\\r\\n<>\"]+', '[link]', 'g')"
    out = f"regexp_replace({out}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}', '[address]', 'g')"
    return f"regexp_replace({out}, '\\+?[0-9](?:[0-9 ().-]{{2,}}[0-9])+', '[number]', 'g')"


def render(template: Column, params: dict[str, Column], longest: int = 60) -> Column:
    """A message template with {name} replaced by parameters, each cut at so many characters; unknown names stay."""
    out = template
    for name, value in params.items():
        out = F.replace(out, F.lit(f"{{{name}}}"), F.substring(F.coalesce(value.cast("string"), F.lit("")), 1, longest))
    return out


def adjacent_sentences(df: DataFrame, *, id_cols: list[str], text_col: str, first: str, second: str) -> DataFrame:
    """Pairs of sentences side by side of which the one matches the first pattern and the other the second, in either order:
    id columns, place of the earlier sentence and both. Sentences of a text are an array, no window is needed."""
    rows = W.once(df.select(*id_cols, F.col(text_col).alias("_text")), "_s", F.filter(F.transform(F.split(F.coalesce("_text", F.lit("")), "[.!?\\n]+"), lambda s: F.trim(s)), lambda s: s != ""))
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("_s") - 2, F.lit(0))), lambda i: F.struct(i.cast("long").alias("place"), F.get("_s", i).alias("one"), F.get("_s", i + 1).alias("two")))
    fits = lambda p: p["two"].isNotNull() & ((p["one"].rlike(first) & p["two"].rlike(second)) | (p["one"].rlike(second) & p["two"].rlike(first)))
    return rows.select(*id_cols, F.explode(F.filter(pairs, fits)).alias("p")).select(*id_cols, "p.place", "p.one", "p.two")


#: Behaviours of the intent rules: what is asked for and what it is asked with. A sentence that denies, quotes or reports
#: the behaviour does not count; neighbours complete one another.
INTENTS = {
    "credential_handover": ((*ASKS_CREDENTIAL, "send your password", "reply with your password", "share your code", "send me the code", "give me your password", "send the verification code"), ("account", "access", "login", "code", "password", "mailbox")),
    "payment_redirection": (("new bank details", "updated bank details", "new bank account", "changed our bank", "change of bank account", "pay to the new account", "update the payment details", "different account"), ("invoice", "payment", "pay", "transfer", "remittance", "supplier", "wire")),
}
REPORTED = (*DENIALS, "example of", "beware", "scam", "phishing", "reported", "training", "awareness", "he wrote", "she wrote", "they wrote")


def intents(text: Column, intents_of: dict | None = None) -> Column:
    """Behaviours that a text shows: a sentence with an asking phrase that nothing denies or reports, and an object in it or
    in a neighbour. Lines that quote an earlier message are left out first."""
    own = F.regexp_replace(F.coalesce(text, F.lit("")), "(?m)^[ \\t]*>.*$", "")
    sentences = F.transform(F.split(own, "[.!?\\n]+"), W.plain)

    def shown(name: str, asks: tuple[str, ...], objects: tuple[str, ...]) -> Column:
        asking, about, told = (f" {W.either(w)} " for w in (asks, objects, REPORTED))
        has = lambda i, p: F.coalesce(F.get(sentences, i).rlike(p), F.lit(False))
        good = lambda i: has(i, asking) & ~has(i, told) & (has(i, about) | has(i - 1, about) | has(i + 1, about))
        return F.when(F.exists(F.sequence(F.lit(0), F.size(sentences) - 1), good), F.lit(name))

    return F.filter(F.array(*[shown(n, a, o) for n, (a, o) in (intents_of or INTENTS).items()]), lambda x: x.isNotNull())


def intents_sql(text: str) -> tuple[str, str]:
    """DuckDB: the sentences of a text, and the behaviours of sentences named ss."""
    own = f"regexp_replace(coalesce({text}, ''), '(?m)^[ \\t]*>.*$', '', 'g')"
    sentences = f"list_transform(str_split_regex({own}, '[.!?\\n]+'), lambda s: {W.plain_sql('s')})"
    cases = []
    for name, (asks, objects) in INTENTS.items():
        asking, about, told = (f" {W.either(w)} " for w in (asks, objects, REPORTED))
        has = lambda i, p: f"coalesce(regexp_matches(ss[{i}], '{p}'), false)"
        cases.append(f"CASE WHEN len(list_filter(range(1, len(ss) + 1), lambda i: {has('i', asking)} AND NOT {has('i', told)} AND ({has('i', about)} OR (i > 1 AND {has('i - 1', about)}) OR {has('i + 1', about)}))) > 0 THEN '{name}' END")
    return sentences, "list_filter([" + ", ".join(cases) + "], lambda x: x IS NOT NULL)"


def without_brand(matched: Column, brand: Column) -> Column:
    """Keywords without the name of the organisation that a message claims to come from."""
    return F.filter(matched, lambda k: F.coalesce(k != brand, F.lit(True)))
