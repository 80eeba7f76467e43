"""Dictionary segmentation: the cheapest path through a text's units, and what follows from it.

A dictionary entry costs log2(all frequencies) - log2(its frequency), a unit without one costs 32. Distances are
float32 and of paths of equal cost the one whose last entry starts first wins, so that results are reproducible.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cached_property
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkdex.functions.text import LOWER, UNIT, UPPER, ascii_lower, units
from inkdex.runtime import materialize

#: The least frequency of an entry; distance and part of speech of a unit without entry.
MIN_FREQUENCY, UNKNOWN_DISTANCE, UNKNOWN_POS = 2, 32.0, "x"
#: Entries that are sent to every task at most; larger dictionaries are joined instead.
BROADCAST_ENTRIES = 1_000_000
SEGMENT = "struct<text:string,start:int,end:int,pos:string>"

_UNITS = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", UNIT)).findall
_LOWER = str.maketrans(UPPER, LOWER)


def unit_list(text: str | None) -> list[str]:
    """The units of a text in ASCII lower case, as ``functions.text.units`` gives them."""
    return _UNITS(text.translate(_LOWER)) if text else []


def load_entries(rows: DataFrame, text: str, freq: str, pos: str, *order: str) -> DataFrame:
    """The entries of a dictionary: (text, words, freq, pos, distance float).

    Rows with a null or empty text or a frequency below 2 (null included) are left out; of entries with the same units
    the first by ``order`` counts; a null pos is ''. The distance uses the frequencies of all entries kept.
    """
    kept = rows.select(ascii_lower(F.col(text)).alias("text"), F.col(freq).cast("int").alias("freq"), F.coalesce(F.col(pos), F.lit("")).alias("pos"), F.struct(*order).alias("_o")).where((F.col("text") != "") & (F.col("freq") >= MIN_FREQUENCY))
    first = kept.withColumn("_n", F.row_number().over(Window.partitionBy("text").orderBy("_o"))).where("_n = 1")
    total = first.agg(F.sum("freq").alias("total"))
    distance = F.log2("total").cast("float") - F.log2("freq").cast("float")
    return first.crossJoin(F.broadcast(total)).select("text", units(F.col("text")).alias("words"), "freq", "pos", distance.alias("distance"))


def dictionary_totals(entries: DataFrame) -> DataFrame:
    """(num_tokens, total_frequency, max_token_length) of a dictionary; zeros for an empty one."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return entries.agg(F.count(F.lit(1)).alias("num_tokens"), zero(F.sum("freq")).cast("bigint").alias("total_frequency"), zero(F.max(F.size("words"))).alias("max_token_length"))


@dataclass
class Lexicon:
    """A dictionary in memory: distance and part of speech by text. Units are recoverable from a text, so texts are keys."""

    entries: dict[str, tuple[float, str]] = field(default_factory=dict)

    @classmethod
    def collect(cls, entries: DataFrame, most: int = BROADCAST_ENTRIES) -> Lexicon:
        """From the result of ``load_entries``; too large a one is refused (use ``segment_by_join``)."""
        rows = entries.select("text", "distance", "pos").limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} entries: use segment_by_join")
        return cls({r.text: (r.distance, r.pos) for r in rows})

    @cached_property
    def longest(self) -> int:
        return max((len(unit_list(t)) for t in self.entries), default=0)

    @cached_property
    def _starts(self) -> set[str]:
        """First two units of the entries that have several: where none begins, no longer entry need be tried."""
        return {"".join(u[:2]) for u in map(unit_list, self.entries) if len(u) > 1}

    def matches(self, words: list[str]) -> list[list[tuple[int, float, str]]]:
        """At each unit the (length in units, distance, pos) of the entries that start there, shortest first."""
        out: list[list[tuple[int, float, str]]] = []
        for i, w in enumerate(words):
            here = []
            if (e := self.entries.get(w)) is not None:
                here.append((1, *e))
            if i + 1 < len(words) and w + words[i + 1] in self._starts:
                text = w
                for n in range(2, min(self.longest, len(words) - i) + 1):
                    text += words[i + n - 1]
                    if (e := self.entries.get(text)) is not None:
                        here.append((n, *e))
            out.append(here)
        return out

    def cut(self, text: str | None, fine: bool = True) -> list[tuple[str, int, int, str]]:
        """The segments (text, start byte, end byte, pos) of a text; in fine mode a single unit has none."""
        words = unit_list(text)
        return cheapest(words, self.matches(words), fine)

    def tokens(self, text: str) -> list[str]:
        """The texts of a text's fine-mode segments."""
        return [t for t, *_ in self.cut(text)]

    def column(self, text: Column, spark: SparkSession) -> Column:
        """The same of a column."""
        return cut_column(text, self, spark)

    def parts(self, text: str) -> list[str]:
        """The finer entries inside an entry, depth first, then itself; parts of one unit don't count."""
        out = []
        for t, *_ in self.cut(text):
            if len(unit_list(t)) > 1:
                out += self.parts(t)
        return [*out, text]


def cheapest(words: list[str], found: list[list[tuple[int, float, str]]], fine: bool) -> list[tuple[str, int, int, str]]:
    """The cheapest segmentation of units, given the entries that start at each.

    Worked out from the end of each segment: among all segments that end at a unit, in the order of their starts, the
    first of least cost counts. Fixed values of the semantics: a cost of exactly 0 counts as not set yet, so what comes
    next replaces it; fine mode forbids an entry that spans the whole text.
    """
    n = len(words)
    if n == 0 or (fine and n == 1):
        return []
    if all(not h or (len(h) == 1 and h[0][0] == 1 and 0 < h[0][1] <= UNKNOWN_DISTANCE) for h in found):
        # no entry spans units: every unit is a segment, an entry where there is one, as it costs no more than none
        ends = list(accumulate(len(w.encode()) for w in words))
        return list(zip(words, [0, *ends], ends, [h[0][2] if h else UNKNOWN_POS for h in found]))
    ending: list[list[tuple[int, float, str]]] = [[] for _ in range(n)]
    for i, here in enumerate(found):
        for size, distance, pos in here:
            if not (fine and size == n):
                ending[i + size - 1].append((i, distance, pos))
        if not here or here[0][0] > 1 or len(words[i].encode()) > 1:
            ending[i].append((i, UNKNOWN_DISTANCE, UNKNOWN_POS))
    cost, came = [np.float32(0)] * (n + 1), [(0, "")] * (n + 1)
    for end in range(n):
        best = np.float32(0)
        for start, distance, pos in ending[end]:
            total = cost[start] + np.float32(distance)
            if best == 0 or total < best:
                best, came[end + 1] = total, (start, pos)
        cost[end + 1] = best
    cuts, at = [], n
    while at:
        start, pos = came[at]
        cuts.append((start, at, pos))
        at = start
    out, byte = [], 0
    for start, end, pos in reversed(cuts):
        text = "".join(words[start:end])
        out.append((text, byte, byte + len(text.encode()), pos))
        byte = out[-1][2]
    return out


def _as_rows(segments: list[list[tuple[str, int, int, str]]]) -> pa.Array:
    texts, starts, ends, pos = zip(*(s for x in segments for s in x)) if any(segments) else ([], [], [], [])
    rows = pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(pos, pa.string())], ["text", "start", "end", "pos"])
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, segments))], pa.int32()), rows)


def segment(df: DataFrame, key: str, text: str, lexicon: Lexicon, fine: bool = True) -> DataFrame:
    """(key, segments array<struct<text, start, end, pos>>) of every row; [] for null and empty texts.

    The lexicon goes to every task once; its size was bounded when it was collected.
    """
    side = df.sparkSession.sparkContext.broadcast(lexicon)
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        lex = side.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _as_rows([lex.cut(t, fine) for t in b.column(1).to_pylist()])], ["k", "segments"])

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, segments array<{SEGMENT}>").withColumnRenamed("k", key)


def cut_column(text: Column, lexicon: Lexicon, spark: SparkSession) -> Column:
    """The texts of the fine-mode segments of a column, array<string>, where no key is at hand to join by; null stays null."""
    side = spark.sparkContext.broadcast(lexicon)

    @F.pandas_udf("array<string>")
    def run(texts):
        lex = side.value
        return texts.map(lambda t: None if t is None else [s for s, *_ in lex.cut(t)])

    return run(text)


def _hits(base: DataFrame, entries: DataFrame) -> DataFrame:
    """``base`` (k unique, t) with the entries that occur in each text: hits array<struct<i, n, text, distance, pos>>, null where none does."""
    longest = entries.agg(F.max(F.size("words"))).first()[0] or 0
    words = base.withColumn("w", units(F.col("t")))
    # a row holds its own run of units only: each place is cut to the longest entry before it is told apart
    at = words.where(F.size("w") > 0).select("k", F.posexplode(F.transform("w", lambda _, i: F.slice("w", i + 1, F.lit(max(longest, 1))))).alias("i", "r"))
    grams = at.select("k", "i", F.posexplode(F.transform("r", lambda _, j: F.array_join(F.slice("r", F.lit(1), j + 1), ""))).alias("j", "text")).select("k", "i", (F.col("j") + 1).alias("n"), "text")
    hits = grams.join(entries.select("text", "distance", "pos"), "text").groupBy("k").agg(F.collect_list(F.struct("i", "n", "text", "distance", "pos")).alias("hits"))
    return base.join(hits, "k", "left").select("k", "t", "hits")


def segment_by_join(df: DataFrame, key: str, text: str, entries: DataFrame, fine: bool = True) -> DataFrame:
    """The same as ``segment`` for dictionaries of any size: runs of units meet the entries in a join.

    ``key`` must be unique. What comes back to one row is bounded by its own length times the longest entry.
    """
    kind = df.schema[key].dataType.simpleString()
    base = df.select(F.col(key).alias("k"), F.col(text).alias("t"))

    def run(batches):
        for b in batches:
            out = []
            for t, hits in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                units_ = unit_list(t)
                found: list[list] = [[] for _ in units_]
                for h in sorted(hits or [], key=lambda h: (h["i"], h["n"])):
                    found[h["i"]].append((h["n"], h["distance"], h["pos"]))
                out.append(cheapest(units_, found, fine))
            yield pa.RecordBatch.from_arrays([b.column(0), _as_rows(out)], ["k", "segments"])

    return _hits(base, entries).mapInArrow(run, f"k {kind}, segments array<{SEGMENT}>").withColumnRenamed("k", key)


def small_lexicon(entries: DataFrame, most: int = BROADCAST_ENTRIES) -> Lexicon | None:
    """The dictionary in memory if it has at most ``most`` entries (they are counted first), else None."""
    return Lexicon.collect(entries, most) if entries.limit(most + 1).count() <= most else None


def segment_by(df: DataFrame, key: str, text: str, entries: DataFrame, fine: bool = True, most: int = BROADCAST_ENTRIES) -> DataFrame:
    """``segment`` where the dictionary has at most ``most`` entries (they are counted first), else ``segment_by_join``."""
    lexicon = small_lexicon(entries, most)
    return segment_by_join(df, key, text, entries, fine) if lexicon is None else segment(df, key, text, lexicon, fine)


def segments_to_string(segments: Column) -> Column:
    """Each segment as 'text/pos ', in a row."""
    return F.array_join(F.transform(segments, lambda s: F.concat(s["text"], F.lit("/"), s["pos"], F.lit(" "))), "")


def expand(df: DataFrame, segments: str, lexicon: Lexicon, output: str = "tokens") -> DataFrame:
    """Adds the segments' texts with the finer entries inside each before it: array<string>."""
    side = df.sparkSession.sparkContext.broadcast(lexicon)

    @F.pandas_udf("array<string>")
    def run(texts):
        lex, known = side.value, {}
        parts = lambda t: known.get(t) or known.setdefault(t, lex.parts(t) if t in lex.entries else [t])
        return texts.map(lambda x: None if x is None else [p for t in x for p in parts(t)])

    return df.withColumn(output, run(F.transform(F.col(segments), lambda s: s["text"])))


def expand_by_join(df: DataFrame, key: str, segments: str, entries: DataFrame, output: str = "tokens") -> DataFrame:
    """The same as ``expand`` for dictionaries of any size: each distinct segment meets the entries inside it in a join.

    ``key`` must be unique and not null.
    """
    df = materialize(df, "segments")
    at = df.select(F.col(key).alias("_k"), F.posexplode(F.transform(F.col(segments), lambda s: s["text"])).alias("_i", "_t"))

    def run(batches):
        for b in batches:
            out = []
            for t, hits in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                lex = Lexicon({h["text"]: (h["distance"], h["pos"]) for h in hits or []})
                out.append(lex.parts(t) if t in lex.entries else [t])
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(out, pa.list_(pa.string()))], ["_t", "_p"])

    texts = at.select(F.col("_t").alias("k"), F.col("_t").alias("t")).distinct()
    parts = _hits(texts, entries).mapInArrow(run, "_t string, _p array<string>")
    whole = at.join(parts, "_t").groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("_i", "_p"))).alias("_p"))
    none = F.when(F.col(segments).isNotNull(), F.array().cast("array<string>"))
    rows = df.join(whole, df[key] == whole["_k"], "left")
    return rows.withColumn(output, F.coalesce(F.flatten(F.transform("_p", lambda x: x["_p"])), none)).drop("_k", "_p")


def prefix_lookup(words: Column, entries: DataFrame, df: DataFrame) -> DataFrame:
    """``df`` joined to every entry whose units begin the row's units: adds (entry, n_words)."""
    longest = entries.agg(F.max(F.size("words"))).first()[0] or 0
    heads = df.withColumn("n_words", F.explode(F.sequence(F.lit(1), F.least(F.lit(max(longest, 1)), F.size(words))))).withColumn("entry", F.array_join(F.slice(words, 1, F.col("n_words")), ""))
    return heads.join(entries.select(F.col("text").alias("entry")), "entry", "left_semi")
