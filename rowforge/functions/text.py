"""Text functions with Unicode's notions of space, letter and number, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import regexes

SPACE = r"\p{IsWhite_Space}"
WORD = r"[\p{IsAlphabetic}\p{N}]"
#: What reads as a number (a fixed grammar).
NUMBER = r"(?i)^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf|infinity)\z"


def upper(c: Column) -> Column:
    return F.upper(c)


def lower(c: Column) -> Column:
    return F.lower(c)


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+\\z", "")


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, f"{SPACE}+", " ")


def title_case(c: Column) -> Column:
    """Words are runs of letters and numbers; each character is mapped by itself.

    Only a capital sigma's small letter depends on what is around it, so without one a word's rest is mapped at once.
    """
    runs = F.regexp_extract_all(c, F.lit(f"{WORD}+|[^\\p{{IsAlphabetic}}\\p{{N}}]+"), F.lit(0))
    each = lambda t: F.array_join(F.transform(F.split(t, ""), F.lower), "")

    def cased(rest):
        return F.array_join(F.transform(runs, lambda t: F.concat(F.upper(F.substr(t, F.lit(1), F.lit(1))), rest(F.substr(t, F.lit(2))))), "")

    return F.when(c.contains("\u03a3"), cased(each)).otherwise(cased(F.lower))


def number(c: Column) -> Column:
    """The number that a text is, white space aside; null if it is none (NaN is none)."""
    t = trim(c)
    return F.when(t.rlike(NUMBER), t).try_cast("double")


def replace(find: str, by: str, ignore_case: bool = False, regex: bool = False):
    """A function that replaces all matches within a text."""
    if regex:
        pattern, names, groups = regexes.replacing(find, ignore_case)
        to = regexes.replacement(by, names, groups)
    elif ignore_case or not find:
        pattern = regexes.replacing(find, ignore_case, literal=True)[0] if find else ""
        to = by.replace("\\", "\\\\").replace("$", "\\$")
    else:
        return lambda c: F.replace(c, F.lit(find), F.lit(by))
    return lambda c: F.regexp_replace(c, F.lit(pattern), F.lit(to))


def wrap(c: Column, width: int) -> Column:
    """Chunks of ``width`` code points; an empty text is one empty chunk."""
    return F.when(c == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(c, F.lit(f"(?s).{{1,{width}}}"), F.lit(0)))


def split_literal(c: Column, separator: str) -> Column:
    return F.split(c, regexes.quote(separator), -1)
