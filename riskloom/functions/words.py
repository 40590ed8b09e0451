"""Texts as words: one plain copy of a text, in which words and phrases are substrings between blanks.

The plain copy is in lower case, without apostrophes ("won't" is "wont" and so never the word "won"), with one blank for
every run of other characters, and with a blank at both ends; blanks between Han characters are taken out, so marks that
split their words do not hide them. Patterns over it need no look-around, so any engine can run them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = "[一-鿿]"
#: Where a clause ends, in lower-case text.
CLAUSE_END = "[.!?;\\n。！？；]+|[,，] *(?:please|then|and|but) | but "


def plain(text: Column) -> Column:
    low = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "['’‘`´​-‍⁠﻿]", "")
    spaced = F.concat(F.lit(" "), F.trim(F.regexp_replace(low, "[^\\p{L}\\p{M}\\p{N}]+", " ")), F.lit(" "))
    for _ in range(2):  # matches do not overlap, so every other blank is left the first time
        spaced = F.regexp_replace(spaced, f"({HAN}) ({HAN})", "$1$2")
    return spaced


def plain_sql(text: str) -> str:
    low = f"regexp_replace(lower(coalesce({text}, '')), '[''’‘`´​-‍⁠﻿]', '', 'g')"
    spaced = f"(' ' || trim(regexp_replace({low}, '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', ' ', 'g')) || ' ')"
    for _ in range(2):
        spaced = f"regexp_replace({spaced}, '({HAN}) ({HAN})', '\\1\\2', 'g')"
    return spaced


def clauses(text: Column) -> Column:
    """Plain copies of a text's clauses."""
    return F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), CLAUSE_END), plain)


def clauses_sql(text: str) -> str:
    return f"list_transform(str_split_regex(lower(coalesce({text}, '')), '{CLAUSE_END}'), lambda c: {plain_sql('c')})"


def is_han(word: str) -> bool:
    return any("一" <= c <= "鿿" for c in word)


def needle(word: str) -> str:
    """What stands for a word or phrase in a plain text: Han words may stand anywhere, others between blanks."""
    return word if is_han(word) else f" {word} "


def either(words: tuple[str, ...]) -> str:
    """A pattern for any of the words, those of more letters first."""
    return "(?:" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + ")"


def near(first: tuple[str, ...], gap: int, then: tuple[str, ...], *, han: bool = False) -> str:
    """A pattern for a word of the first list and, at most gap words (Han: characters) later, one of the second."""
    return f"{either(first)}\\S{{0,{gap}}}{either(then)}" if han else f" {either(first)}(?: \\S+){{0,{gap}}} {either(then)} "


def spread(pattern: str) -> str:
    """The pattern for a text whose blanks were doubled, so that matches side by side share none."""
    return pattern[0] + pattern[1:-1].replace(" ", "  ") + pattern[-1]


def loose(pattern: str) -> str:
    """The pattern for any number of blanks between words."""
    return pattern.replace(" ", " +")


def held(text: Column, words: tuple[str, ...]) -> Column:
    """The words and phrases that a plain text holds, as an array in the order of the list. Each is one search for a
    substring, much cheaper than a pattern."""
    return F.filter(F.array(*[F.when(F.contains(text, F.lit(needle(w))), F.lit(w)) for w in words]), lambda x: x.isNotNull())


def first_words(text: Column, words: tuple[str, ...]) -> Column:
    """The first words of the Latin words and phrases that a plain text holds: one pass over its words by hash."""
    firsts = sorted({w.split(" ")[0] for w in words if not is_han(w)})
    return F.array_intersect(F.split(text, " "), F.array(*map(F.lit, firsts)))


def held_after(text: Column, firsts: Column, words: tuple[str, ...]) -> Column:
    """The same as held, for many words: only words and phrases whose first word the text holds are searched for, and Han words
    only in texts that have such characters. firsts as first_words gives it."""
    latin, han = (tuple((i, w) for i, w in enumerate(words) if is_han(w) == k) for k in (False, True))
    entry = lambda i, w: F.struct(F.lit(i).alias("place"), F.lit(w.split(" ")[0]).alias("first"), F.lit(needle(w)).alias("needle"), F.lit(w).alias("word"))
    found = F.array().cast("array<struct<place:int,first:string,needle:string,word:string>>")
    if latin:
        found = F.concat(found, F.filter(F.array(*[entry(*x) for x in latin]), lambda e: F.array_contains(firsts, e["first"]) & F.contains(text, e["needle"])))
    if han:
        found = F.concat(found, F.when(text.rlike(HAN), F.filter(F.array(*[entry(*x) for x in han]), lambda e: F.contains(text, e["needle"]))).otherwise(F.filter(F.array(entry(*han[0])), lambda e: F.lit(False))))
    return F.transform(F.array_sort(found), lambda e: e["word"])


def held_sql(text: str, words: tuple[str, ...]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN contains({text}, '{needle(w)}') THEN '{w}' END" for w in words) + "], lambda x: x IS NOT NULL)"


def once(df, name: str, value: Column):
    """df with a column that is computed once a row, however often it is used: a generator keeps the optimiser from
    writing its expression into every use."""
    return df.withColumn(name, F.explode(F.array(value)))
