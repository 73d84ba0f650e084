"""Text expressions as native columns: nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions import fixed as X

def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(c: Column | str) -> Column:
    """How many runs of visible characters."""
    return F.regexp_count(col(c), F.lit(r"\S+")).cast("bigint")


def ratio(part: Column, whole: Column) -> Column:
    return F.round(part / F.greatest(whole, F.lit(1)), 6)


def without(c: Column | str, pattern: str) -> Column:
    """How many characters are left of c when all runs of a pattern are taken away."""
    return F.length(F.regexp_replace(col(c), pattern, ""))


def visible(c: Column | str) -> Column:
    return without(c, r"\s+")


def letters(c: Column | str) -> Column:
    return F.length(col(c)) - without(c, r"\p{L}+")


def latin_letters(c: Column | str) -> Column:
    return F.length(col(c)) - without(c, r"[A-Za-z\x{00AA}\x{00B5}\x{00BA}\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{024F}]+")


def digits(c: Column | str) -> Column:
    return F.length(col(c)) - F.length(F.translate(col(c), "0123456789", ""))


def stop_words(c: Column | str) -> Column:
    return count_of(c, X.STOP_WORDS)


def count_of(c: Column | str, words: list[str]) -> Column:
    """How many of the runs of a-z are among some words."""
    return F.size(F.filter(F.regexp_extract_all(F.lower(col(c)), F.lit("[a-z]+"), F.lit(0)), lambda x: x.isin(words)))


def blank(c: Column) -> Column:
    return c.rlike(r"^[ \t\n\r]*$")


def lines(c: Column | str) -> Column:
    """The lines with something on them, trimmed."""
    trimmed = F.transform(F.split(col(c), "\n"), lambda x: F.trim(x))
    return F.filter(trimmed, lambda x: x != "")


def is_table_line(c: Column) -> Column:
    pipes = F.length(c) - F.length(F.replace(c, F.lit("|"), F.lit("")))
    tabs = F.length(c) - F.length(F.replace(c, F.lit("\t"), F.lit("")))
    return (pipes >= 3) | (tabs >= 2) | (c.rlike(X.TABLE_RULE) & (c.contains("|") | c.contains("-")))


def is_code_line(c: Column) -> Column:
    size = F.length(c)
    braces = size - F.length(F.translate(c, "{}", ""))
    symbols = size - F.length(F.translate(c, X.CODE_SYMBOLS, ""))
    return c.rlike(X.CODE_LINE) | c.rlike(X.CODE_TOKEN) | (braces >= 2) | ((size > 24) & (symbols / size > 0.15))


def is_boilerplate_line(c: Column) -> Column:
    """Furniture of a page, navigation or adverts."""
    return c.rlike(X.BOILERPLATE) | c.rlike(X.NAVIGATION) | c.rlike(X.ADVERTS)


def decimal_digits(c: Column | str) -> Column:
    return F.length(col(c)) - without(c, r"\p{Nd}+")


def any_of(c: Column, stems: list[str]) -> Column:
    out = F.contains(c, F.lit(stems[0]))
    for s in stems[1:]:
        out = out | F.contains(c, F.lit(s))
    return out


def tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(col(c)), F.lit("[a-z0-9]+"), F.lit(0))


def content_digest(c: Column | str) -> Column:
    """Equal for texts of the same tokens."""
    return F.md5(F.array_join(tokens(c), " "))


def fold_punctuation(c: Column | str) -> Column:
    folded = F.translate(col(c), "‘’“”–—− ​‌‍﻿", "''\"\"--- ")
    return F.replace(folded, F.lit("…"), F.lit("..."))


def strip_markup(c: Column | str) -> Column:
    """Images and link targets, citation numbers, control characters and web addresses removed; blanks collapsed."""
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(col(c), X.IMAGE, " "), X.LINK, "$1"), X.CITATION, "")
    c = F.regexp_replace(fold_punctuation(c), X.CONTROL, "")
    c = F.regexp_replace(c, X.URL, "")
    return F.regexp_replace(c, r"[ \t]+", " ")


SPECIAL = r"<\|(?:bos|eos|pad|unk)\|>"


def reverse_text(c: Column | str) -> Column:
    """Code points in reverse order, with the special tokens kept whole."""
    c = col(c)
    marked = F.regexp_replace(c, f"({SPECIAL})", "\u0001$1\u0001")
    pieces = F.transform(F.split(marked, "\u0001"), lambda p: F.when(p.rlike(f"^{SPECIAL}$"), p).otherwise(F.reverse(p)))
    return F.when(F.contains(c, F.lit("<|")), F.array_join(F.reverse(pieces), "")).otherwise(F.reverse(c))


def normal_key(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.trim(col(c))), r"[ \t\n\r]+", " ")


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def hash_fraction(*parts: Column) -> Column:
    """A number from 0 to 1 that depends on the parts only: the first 13 hexadecimal digits of their MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def source_name(c: Column | str) -> Column:
    c = F.lower(F.regexp_replace(col(c), r"^[ \t\n\r]+|[ \t\n\r]+$", ""))
    out = F.when(c.isin(X.SOURCES), c)
    for alias, name in X.SOURCE_NAMES.items():
        out = out.when(c == alias, name)
    return out.otherwise("unknown")
