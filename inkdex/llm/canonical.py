"""One form for all texts that look the same in print.

Most characters are stable: they are canonical by themselves and never interact with a neighbour (the quick-check
property of normalization). One linear scan isolates the unstable segments, each with the starter before it as
boundary context; only those are normalized, and the results are spliced into the unchanged rest.
"""

from __future__ import annotations

import re
import string
import sys
import unicodedata
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkdex.operators.index import current_rows
from inkdex.runtime import materialize

# Letters of other scripts or codes with the shape of the Latin letters below them, the clear cases.
LOOKALIKES = {
    # Cyrillic
    **dict(zip("АВЕЅІӀЈКМНОРСТУХԌԚԜҮ", "ABESIIJKMHOPCTYXGQWY")),
    **dict(zip("аеѕіјорсухһԁԛԝӏ", "aesijopcyxhdqwl")),
    # Greek
    **dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳ", "ABEZHIKMNOPTYXCj")),
    **dict(zip("ονϲ", "ovc")),
    # Armenian, phonetic Latin
    **dict(zip("օɑɡᴄᴏꜱᴠᴡᴢ", "oagcosvwz")),
}
#: Scripts whose letters are looked up in the published table of confusable characters besides.
SCRIPTS = ("ARMENIAN", "CHEROKEE", "COPTIC", "CYRILLIC", "GREEK", "LISU")
#: Code points with no mark in print besides those of the general category Cf.
SILENT = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x1810), 0x3164, *range(0xFE00, 0xFE10), 0xFFA0, *range(0xE0100, 0xE01F0)]
#: Control characters that lay out lines and columns, hence visible.
LAYOUT = "\t\n\v\f\r\x85"
#: Kinds of compatibility decomposition that keep the shape of a letter or digit but for its width or code.
SAME_SHAPE = ("<wide>", "<narrow>", "<compat>")

#: Letters whose compatibility decomposition looks different: long s, symbol variants of Greek letters, lone Hangul jamo.
OTHER_SHAPE = frozenset([0x017F, 0x03D0, 0x03D1, 0x03D2, 0x03D5, 0x03D6, 0x03F0, 0x03F1, 0x03F5, *range(0x3131, 0x318F)])


def _letter(c: str) -> bool:
    return unicodedata.category(c)[0] in "LN"


def _silent(c: str) -> bool:
    return unicodedata.category(c) == "Cf" or ord(c) in _SILENT or (unicodedata.category(c) == "Cc" and c not in LAYOUT)


_SILENT = frozenset(SILENT)


class Look(NamedTuple):
    """What texts look like: ``pairs``, each letter followed by the Latin one of its shape, and ``inside``, the unstable
    characters as the inside of a character class. Worked out once by the driver and sent with the tasks."""

    pairs: str
    inside: str


def published_lookalikes(spark: SparkSession) -> dict[str, str]:
    """Letters with the shape of an ASCII letter by the confusables table of the Unicode consortium, as the ICU library
    beside Spark carries it, in addition to ``LOOKALIKES``.

    Of the scripts in ``SCRIPTS``, letters that don't decompose and whose skeleton is that of a letter of their own case
    (letters without case count as capitals); i and j only for letters whose dot goes away under an accent, so that a
    dotless one stays different. Of a script's letters for one shape the first counts, so that no two of them become equal.
    """
    icu = getattr(spark._jvm.com.ibm.icu.text, "SpoofChecker")
    letters = [c for c in map(chr, range(0x80, 0x20000)) if unicodedata.category(c) in ("Lu", "Ll", "Lo") and not unicodedata.decomposition(c) and unicodedata.name(c, "").partition(" ")[0] in SCRIPTS]
    skeletons = lambda chars: icu.Builder().build().getSkeleton("\n".join(chars)).split("\n")
    latin: dict[tuple[str, bool], str] = {(k, t.isupper()): t for t, k in zip(string.ascii_letters, skeletons(string.ascii_letters))}
    dotted = spark._jvm.com.ibm.icu.text.UnicodeSet("[:Soft_Dotted:]")
    script = lambda c: unicodedata.name(c).partition(" ")[0]
    taken = {(script(c), t) for c, t in LOOKALIKES.items()}
    out = {}
    for c, k in zip(letters, skeletons(letters)):
        t = latin.get((k, unicodedata.category(c) != "Ll"))
        if t and c not in LOOKALIKES and (script(c), t) not in taken and (t not in "ij" or dotted.contains(ord(c))):
            taken.add((script(c), t))
            out[c] = t
    return out


@lru_cache(4)
def _letters(pairs: str) -> dict[str, str]:
    return dict(zip(pairs[::2], pairs[1::2]))


@lru_cache(1 << 16)
def _fold(c: str, pairs: str) -> str:
    """What a character looks like, in decomposed form."""
    if unicodedata.category(c) == "Zs":
        return " "
    if _silent(c):
        return ""
    letters = _letters(pairs)
    kind, *parts = unicodedata.decomposition(c).split() or [""]
    if kind in SAME_SHAPE and ord(c) not in OTHER_SHAPE:
        plain = "".join(chr(int(x, 16)) for x in parts)
        if all(_letter(x) or unicodedata.combining(x) for x in plain) and (_letter(c) or len(plain) == 1):
            return "".join(letters.get(x, x) for x in unicodedata.normalize("NFD", plain))
    return "".join(letters.get(x, x) for x in unicodedata.normalize("NFD", c))


def _normal(segment: str, pairs: str) -> str:
    folded = unicodedata.normalize("NFD", "".join([_fold(c, pairs) for c in segment]))
    return unicodedata.normalize("NFC", folded)


def _stable(c: str, pairs: str) -> bool:
    """Canonical by itself whatever stands next to it: the quick check says yes and nothing folds it."""
    return _normal(c, pairs) == c and not unicodedata.combining(c) and unicodedata.is_normalized("NFC", c) and c not in _seconds()


@lru_cache(1)
def _seconds() -> frozenset[str]:
    """Characters that may compose with the one before them though their combining class is 0 (quick check: maybe)."""
    found = {chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]}
    for c in map(chr, range(0xA0, 0x20000)):
        d = unicodedata.decomposition(c).split()
        if len(d) == 2 and d[0][0] != "<" and not unicodedata.combining(chr(int(d[1], 16))):
            found.add(chr(int(d[1], 16)))
    return frozenset(found)


@lru_cache(4)
def look_of(letters: tuple[tuple[str, str], ...]) -> Look:
    """The look by a table of letters: their pairs and the ranges of unstable characters."""
    pairs = "".join(c + t for c, t in letters)
    spans, begin = [], None
    for c in range(sys.maxunicode + 2):
        bad = c <= sys.maxunicode and not 0xD800 <= c < 0xE000 and (c < 0xA0 or unicodedata.category(chr(c)) not in ("Cn", "Co") or c in _SILENT) and not (0x4E00 <= c < 0xA000) and not (0xAC00 <= c < 0xD7A4) and not _stable(chr(c), pairs)
        if bad and begin is None:
            begin = c
        elif not bad and begin is not None:
            spans.append((begin, c - 1))
            begin = None
    return Look(pairs, "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans))


def look(spark: SparkSession) -> Look:
    """The look by ``LOOKALIKES`` and the published table."""
    return look_of(tuple((LOOKALIKES | published_lookalikes(spark)).items()))


@lru_cache(4)
def _unstable(inside: str) -> re.Pattern:
    """A maximal segment of unstable characters with the starter before it, as its boundary context."""
    return re.compile(f"(?:[^{inside}])?[{inside}]+")


def canonical_text(text: str, of: Look) -> str:
    """The canonical form of one text: two texts look the same in print when their forms are equal."""
    return _unstable(of.inside).sub(lambda m: _normal(m[0], of.pairs), text)


def canonical(text: Column, of: Look) -> Column:
    """``canonical_text`` of a column; null stays null. Plain ASCII never leaves the JVM."""

    @F.pandas_udf("string")
    def run(texts):
        pattern, pairs = _unstable(of.inside), of.pairs
        normal = lambda m: _normal(m[0], pairs)
        return texts.map(lambda t: t if t is None else pattern.sub(normal, t))

    odd = text.rlike("[^\\t-\\r -~]")
    return F.coalesce(run(F.when(odd, text)), text)


def canonical_rows(rows: DataFrame, key: str, text: str, version: str) -> DataFrame:
    """(key, canonical) of the current row of every key, that of the greatest ``version`` (null is the lowest)."""
    return current_rows(rows.select(key, text, version), key, version).select(key, canonical(F.col(text), look(rows.sparkSession)).alias("canonical"))


def lookalike_pairs(rows: DataFrame, group: str, key: str, text: str, version: str | None = None) -> DataFrame:
    """Pairs (group, id_a, id_b), id_a < id_b, of a group's records whose texts look the same but differ in characters.

    Of a key's rows in a group the one of greatest ``version`` counts (null is the lowest; among equals any, as they
    are repeats). Null keys, groups and texts are in no pair; an empty text is a text and looks like one of silent
    characters only. Texts are compared whole. An empty table gives no pairs.

    Rows are reduced to two fingerprints before anything is shuffled, also those that are not current: that costs their
    share of the work, but the texts themselves never move. Classes of one look with a single spelling,
    nearly all of them, end in a map-side aggregate. Of the others every two spellings are paired first, and records
    are joined to these pairs: records with the same characters, however many, never meet each other.
    """
    seen = rows.select(F.col(group).alias("g"), F.col(key).alias("k"), (F.col(version) if version else F.lit(0)).alias("v"), F.col(text).alias("t")).where("g is not null and k is not null")
    marks = seen.select("g", "k", "v", F.unhex(F.md5(canonical(F.col("t"), look(rows.sparkSession)))).alias("look"), F.unhex(F.md5("t")).alias("spelling"))
    marks = marks.withColumn("_n", F.row_number().over(Window.partitionBy("g", "k").orderBy(F.col("v").desc_nulls_last()))).where("_n = 1 and look is not null")
    marks = materialize(marks.select("g", "k", "look", "spelling"), "looks")
    mixed = marks.groupBy("g", "look").agg(F.min("spelling").alias("lo"), F.max("spelling").alias("hi")).where("lo <> hi").select("g", "look")
    own = materialize(marks.join(mixed, ["g", "look"], "left_semi"), "mixed")
    kinds = own.select("g", "look", "spelling").distinct()
    two = kinds.withColumnRenamed("spelling", "s1").join(kinds.withColumnRenamed("spelling", "s2"), ["g", "look"]).where("s1 < s2")
    left = own.select("g", "look", F.col("spelling").alias("s1"), F.col("k").alias("k1"))
    right = own.select("g", "look", F.col("spelling").alias("s2"), F.col("k").alias("k2"))
    found = two.join(left, ["g", "look", "s1"]).join(right, ["g", "look", "s2"])
    return found.select(F.col("g").alias(group), F.least("k1", "k2").alias("id_a"), F.greatest("k1", "k2").alias("id_b"))
