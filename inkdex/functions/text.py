"""Splitting text into character units, on the JVM side."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _ranges() -> list[tuple[int, int]]:
    """Letters and numbers of at most two bytes in UTF-8, as ranges of code points."""
    found: list[tuple[int, int]] = []
    for c in range(0x800):
        if unicodedata.category(chr(c))[0] in "LN":
            if found and found[-1][1] == c - 1:
                found[-1] = (found[-1][0], c)
            else:
                found.append((c, c))
    return found


#: Inside of a character class of what joins into words; spelled out so that every regex engine agrees.
JOINING = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" if a < b else f"\\x{{{a:X}}}" for a, b in _ranges())
#: A unit: a run of joining characters, or any other single character.
UNIT = f"[{JOINING}]+|[\\s\\S]"
#: The same for Java's engine, which tests a category and a range faster than a list of ranges.
JAVA_UNIT = r"[\p{L}\p{N}&&[\x{0}-\x{7FF}]]+|[\s\S]"


def ascii_lower(text: Column) -> Column:
    """Lower case for A to Z only; all other letters stay as they are."""
    return F.translate(text, UPPER, LOWER)


def split_words(text: Column) -> Column:
    """The units of a text as they stand: array<string>, null for null, one element "" never occurs, [] for an empty text."""
    return F.regexp_extract_all(text, F.lit(JAVA_UNIT), F.lit(0))


def units(text: Column) -> Column:
    """The units of a text in ASCII lower case."""
    return split_words(ascii_lower(text))


def several(units: Column) -> Column:
    """The units of a text that has more than one, else none: fine mode without a dictionary. ``units`` is worked out once."""
    return F.flatten(F.filter(F.array(units), lambda u: F.size(u) > 1))


def asked_units(text: Column) -> Column:
    """Units in fine mode without a dictionary: a text of a single unit has none; null counts as empty."""
    return several(units(F.coalesce(text, F.lit(""))))


def token_text(words: Column) -> Column:
    """The text of a token that consists of these units."""
    return F.array_join(words, "")
