"""Column functions on words and byte spans."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space by Unicode, spelled out so that Java and RE2 agree.
SPACE = r"\s\p{Z}\x{85}\x{0B}"
#: Pieces that tile any text: a run of word characters, a run of white space, or any other single character.
PIECE = rf"[\p{{L}}\p{{N}}\p{{Mn}}']+|[{SPACE}]+|[^{SPACE}\p{{L}}\p{{N}}\p{{Mn}}']"


def ascii_fold(x: Column) -> Column:
    """Lower-cases A-Z and nothing else; the comparison of rule literals (PRD-2)."""
    return F.translate(x, string.ascii_uppercase, string.ascii_lowercase)


def strip_marks(x: Column) -> Column:
    """Removes combining marks, the lookup key of vocalised scripts (TOK-5, FN-3)."""
    return F.regexp_replace(x, r"\p{Mn}", "")


def is_word(x: Column) -> Column:
    """Whether all characters are alphabetic, and there is one (FN-7)."""
    return x.rlike(r"\A\p{L}+\z")


def is_digits(x: Column) -> Column:
    """Decimal digits of any script only (FN-3)."""
    return x.rlike(r"\A\p{Nd}+\z")


def starts_upper(x: Column) -> Column:
    return x.rlike(r"\A\p{Lu}")


def capitalize_first(x: Column) -> Column:
    """Upper-cases the first character and keeps the rest (PRJ-8)."""
    return F.concat(F.upper(F.substring(x, 1, 1)), x.substr(F.lit(2), F.char_length(x)))


def recase(source: Column, candidate: Column) -> Column:
    """The candidate with the source's initial capital (PRJ-8)."""
    return F.when(starts_upper(source), capitalize_first(candidate)).otherwise(candidate)


def apply_case(x: Column, case: str) -> Column:
    """keep, upper, lower or start_upper (PRJ-3, PRJ-12)."""
    return {"keep": x, "upper": F.upper(x), "lower": F.lower(x), "start_upper": capitalize_first(x)}[case]


def distinct_nonempty(xs: Column) -> Column:
    """Order-preserving unique strings without the empty and missing ones (PRJ-5)."""
    return F.array_distinct(F.filter(xs, lambda x: x.isNotNull() & (x != "")))


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    """text[start:end] by UTF-8 byte offsets (PRJ-2)."""
    raw = F.encode(text, "UTF-8")
    return F.decode(F.substring(raw, (start + 1).cast("int"), (end - start).cast("int")), "UTF-8")


def chars_before(text: Column, offset: Column) -> Column:
    """The characters of text before a byte offset, as a string."""
    return byte_slice(text, F.lit(0), offset)


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a byte offset (SNK-2)."""
    before = chars_before(text, offset)
    return F.char_length(before) - F.char_length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def column_of(text: Column, offset: Column) -> Column:
    """1-based column, in characters, of a byte offset (SNK-2)."""
    return F.char_length(F.substring_index(chars_before(text, offset), "\n", -1)) + 1


def utf16_offset(text: Column, offset: Column) -> Column:
    """The UTF-16 offset of a byte offset on a character border (PRJ-15): astral characters count twice."""
    before = chars_before(text, offset)
    return F.char_length(before) + F.char_length(F.regexp_replace(before, r"[\x{0}-\x{FFFF}]", ""))


def edits1(word: Column, alphabet: str) -> Column:
    """All strings at edit distance 1 (deletes, adjacent transposes, replaces by another letter, inserts), distinct,
    in byte order; the word itself may occur by transposing equal letters (FN-1, SET-6)."""
    n = F.char_length(word)
    letters = F.array(*map(F.lit, alphabet))

    def head(i: Column) -> Column:
        return F.substring(word, F.lit(1), i)

    def tail(i: Column) -> Column:
        return F.substring(word, i + 1, n)

    places = F.sequence(F.lit(0), n)
    inner = F.sequence(F.lit(0), n - 1)
    deletes = F.transform(inner, lambda i: F.concat(head(i), tail(i + 1)))
    swaps = F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.concat(head(i), F.substring(word, i + 2, F.lit(1)), F.substring(word, i + 1, F.lit(1)), tail(i + 2)))).otherwise(F.array().cast("array<string>"))
    replaces = F.flatten(F.transform(inner, lambda i: F.transform(F.filter(letters, lambda c: c != F.substring(word, i + 1, F.lit(1))), lambda c: F.concat(head(i), c, tail(i + 1)))))
    inserts = F.flatten(F.transform(places, lambda i: F.transform(letters, lambda c: F.concat(head(i), c, tail(i)))))
    return F.array_sort(F.array_distinct(F.concat(deletes, swaps, replaces, inserts)))
