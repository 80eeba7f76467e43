"""Near-duplicate texts by min-max hashing: banded candidates, sketch filter, exact verification.

Under each permutation both the least and the greatest value of a text's shingles are kept, so half as many hash
evaluations give the same number of signature values, each of which agrees between two texts with probability equal to
their Jaccard similarity. Bands of ``rows`` values are hashed into bucket keys; texts that share a bucket are
candidates. Bit sketches that travel with the keys turn most false candidates away inside the join; what remains is
verified on the texts' whole shingle sets.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkdex.llm.words import blocks, mix
from inkdex.runtime import materialize

#: Characters that are signed together: as many as stay in a core's cache while all permutations run over them.
BLOCK = 1 << 17
#: Bits of the sketches, in words of 64.
SKETCH = 256
WORDS = [f"s{i}" for i in range(SKETCH // 64)]


@dataclass(frozen=True)
class MinMax:
    """Parameters of the method; the defaults miss a pair at the threshold of 0.6 with probability 0.04 %.

    ``slack``: sketches of 256 bits may differ in as many bits
    as are expected at the threshold plus so many standard deviations (4: one in 30,000 such pairs is lost).
    """

    threshold: float = 0.6
    size: int = 5
    bands: int = 96
    rows: int = 5
    slack: float = 4.0

    @property
    def permutations(self) -> int:
        return (self.bands * self.rows + 1) // 2

    @property
    def most_bits(self) -> int:
        p = (1 - self.threshold) / 2
        return int(SKETCH * p + self.slack * (SKETCH * p * (1 - p)) ** 0.5)


def visible(text: Column) -> Column:
    """Runs of blank, tab, CR and LF as one blank, no outer blanks, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, "[ \t\r\n]+", " ")))


def shingles(text: str, size: int) -> set[str]:
    """The distinct substrings of ``size`` code points."""
    return {text[i : i + size] for i in range(len(text) - size + 1)}


def similarity(a: set, b: set) -> float:
    """Jaccard similarity; 0 if both are empty."""
    both = len(a & b)
    return both / (len(a) + len(b) - both) if both else 0.0


def _hashes(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles of texts no shorter than ``size``, and where each text's begin."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(points) - size + 1
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + points[k : k + n])
    ends = np.cumsum(lengths)
    inside = np.ones(len(points), bool)
    for k in range(1, size):
        inside[ends - k] = False
    return h[inside[:n]], np.concatenate(([0], np.cumsum(lengths - size + 1)[:-1]))


def _distinct(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many distinct hashes each text has, but for rare collisions: one sort of words of text number and hash."""
    bits = max(len(starts).bit_length(), 1)
    owner = np.repeat(np.arange(len(starts), dtype=np.uint64), np.diff(np.append(starts, len(h))))
    both = np.sort((owner << np.uint64(64 - bits)) | (h >> np.uint64(bits)))
    new = np.concatenate(([True], both[1:] != both[:-1]))
    return np.bincount((both[new] >> np.uint64(64 - bits)).astype(np.int64), minlength=len(starts))


def signature(texts: list[str], p: MinMax) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts no shorter than the shingle size: distinct shingles, the sketch words and the bucket keys of all bands."""
    h, starts = _hashes(texts, p.size)
    short = (h >> np.uint64(32)).astype(np.uint32)
    rng = np.random.default_rng(20_11)
    xor, odd = rng.integers(0, 1 << 32, p.permutations, dtype=np.uint32), rng.integers(0, 1 << 31, p.permutations, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    values = np.empty((2 * p.permutations, len(texts)), np.uint32)  # of each permutation the least and the greatest
    work = np.empty_like(short)
    for k in range(p.permutations):
        np.multiply(np.bitwise_xor(short, xor[k], out=work), odd[k], out=work)
        values[2 * k], values[2 * k + 1] = np.minimum.reduceat(work, starts), np.maximum.reduceat(work, starts)
    keys = np.empty((len(texts), p.bands), np.int64)
    for b in range(p.bands):
        key = np.full(len(texts), b + 1, np.uint64)
        for v in values[b * p.rows : (b + 1) * p.rows]:
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + v)
        keys[:, b] = key.view(np.int64)
    sketch = np.zeros((len(texts), len(WORDS)), np.uint64)
    for k in range(SKETCH):  # one bit of each of as many values
        bit = (values[k % len(values)] * np.uint32(0x85EBCA6B)) >> np.uint32(31)
        sketch[:, k // 64] |= bit.astype(np.uint64) << np.uint64(k % 64)
    return _distinct(h, starts), sketch.view(np.int64), keys


def similar_pairs(texts: DataFrame, key: str, text: str, p: MinMax) -> DataFrame:
    """Pairs (a, b), a < b, of keys whose texts have a similarity of ``p.threshold`` or more.

    Keys are unique, texts are compared as they stand. Texts shorter than a shingle are in no pair. Candidates share a
    bucket of any band; every bucket is joined whole, by a sort-merge join that splits and spills, never collected.
    """

    def sign(batches):
        for b in batches:
            rows = [(k, t) for k, t in enumerate(b.column(1).to_pylist()) if t is not None and len(t) >= p.size]
            for lo, hi in blocks([t for _, t in rows], BLOCK):
                n, sketch, keys = signature([t for _, t in rows[lo:hi]], p)
                ids = b.column(0).take(pa.array([k for k, _ in rows[lo:hi]]))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, p.bands, dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int32)), *map(pa.array, sketch.T), lists], ["k", "n", *WORDS, "bands"])

    kind = texts.schema[key].dataType.simpleString()
    base = texts.select(F.col(key).alias("k"), F.col(text).alias("x"))
    signed = base.mapInArrow(sign, f"k {kind}, n int, {', '.join(f'{w} bigint' for w in WORDS)}, bands array<bigint>")
    rows = signed.select("k", "n", *WORDS, F.explode("bands").alias("bucket"))
    a, b = rows.alias("a").hint("merge"), rows.alias("b")
    close = (F.col("a.k") < F.col("b.k")) & (F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * F.lit(0.99 * p.threshold))
    close &= sum((F.bit_count(F.col(f"a.{w}").bitwiseXOR(F.col(f"b.{w}"))) for w in WORDS), F.lit(0)) <= p.most_bits
    pairs = a.join(b, (F.col("a.bucket") == F.col("b.bucket")) & close).select(F.col("a.k").alias("a"), F.col("b.k").alias("b")).distinct()

    def verify(batches):
        seen: dict[str, set] = {}
        for b in batches:
            left, right = b.column(2).to_pylist(), b.column(3).to_pylist()
            keep = []
            for k, (x, y) in enumerate(zip(left, right)):
                if len(seen) > 5_000:
                    seen.clear()
                for t in (x, y):
                    if t not in seen:
                        seen[t] = shingles(t, p.size)
                if similarity(seen[x], seen[y]) >= p.threshold:
                    keep.append(k)
            if keep:
                yield b.select(["a", "b"]).take(pa.array(keep))

    with_texts = pairs.join(base.select(F.col("k").alias("a"), F.col("x").alias("xa")), "a").join(base.select(F.col("k").alias("b"), F.col("x").alias("xb")), "b")
    return with_texts.select("a", "b", "xa", "xb").mapInArrow(verify, f"a {kind}, b {kind}")


@dataclass
class NearDuplicates:
    """Result of ``near_duplicates``: ``members`` (key, rep) of all records in question, ``links`` (a, b) of representatives."""

    members: DataFrame
    links: DataFrame

    def pairs(self) -> DataFrame:
        """All pairs of records (doc_a < doc_b), copies of one text included."""
        m = self.members
        copies = m.alias("x").join(m.alias("y"), (F.col("x.rep") == F.col("y.rep")) & (F.col("x.k") < F.col("y.k"))).select(F.col("x.k").alias("p"), F.col("y.k").alias("q"))
        other = self.links.join(m.select(F.col("k").alias("p"), F.col("rep").alias("a")), "a").join(m.select(F.col("k").alias("q"), F.col("rep").alias("b")), "b").select("p", "q")
        both = copies.unionByName(other)
        return both.select(F.least("p", "q").alias("doc_a"), F.greatest("p", "q").alias("doc_b"))

    def groups(self) -> DataFrame:
        """One row per record: (k, rep, n_links of its text, group_id = least key that links lead to).

        Each round, the least label two steps from a text's neighbours goes to the text and to the text that its old
        label names (as in FastSV), so that whole trees are hooked; measured rounds grow with the logarithm of a chain
        in whatever order its keys come. Labels only fall, so the rounds end; every round is written to the shared folder.
        """
        edges = materialize(self.links.unionByName(self.links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
        label = materialize(edges.select(F.col("a").alias("v")).distinct().select("v", F.col("v").alias("l")), "labels")
        changed = 1
        while changed:
            two = label.join(label.select(F.col("v").alias("l"), F.col("l").alias("g")), "l").select("v", "l", "g")
            near = edges.join(two.select(F.col("v").alias("b"), "g"), "b").groupBy("a").agg(F.min("g").alias("m"))
            own, hook = F.struct("v", F.least("g", "m").alias("l"), F.col("l").alias("old")), F.struct(F.col("l").alias("v"), F.col("m").alias("l"), F.lit(None).alias("old"))
            told = two.join(near, two.v == near.a).select(F.inline(F.array(own, hook)))
            label = materialize(told.groupBy("v").agg(F.min("l").alias("l"), F.max("old").alias("old")), "labels")
            changed = label.where("l < old").limit(1).count()
            label = label.select("v", "l")
        degree = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n_links"))
        rows = self.members.join(label, F.col("rep") == F.col("v"), "left").join(degree, F.col("rep") == F.col("a"), "left")
        return rows.select("k", "rep", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("l", "rep").alias("group_id"))


def near_duplicates(df: DataFrame, key: str, text: str, revision: str | None = None, *, params: MinMax = MinMax(), least_chars: int = 40) -> NearDuplicates:
    """Records whose texts are alike, from the current row (greatest ``revision``) of each key.

    Texts are compared as ``visible`` makes them; null ones and those then shorter than ``least_chars`` characters are
    in no result. Of copies of one text the least key represents all: only representatives are compared, and
    ``members`` says who they stand for. Rows that repeat a key count once; a null revision is the lowest; null keys
    are left out; texts are taken whole. An empty table gives empty results.
    """
    rows = df.select(F.col(key).alias("k"), (F.col(revision) if revision else F.lit(0)).alias("r"), visible(F.col(text)).alias("x")).where(F.col("k").isNotNull())
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("k").orderBy(F.col("r").desc_nulls_last()))).where("_n = 1")
    now = materialize(rows.where(F.char_length("x") >= least_chars).select("k", F.unhex(F.md5("x")).alias("fp"), "x"), "contents")
    classes = now.groupBy("fp").agg(F.min("k").alias("rep"), F.count(F.lit(1)).alias("c")).where("c > 1")
    members = now.select("k", "fp").join(classes, "fp", "left").select("k", F.coalesce("rep", "k").alias("rep"))
    copies = now.select("k", "fp").join(classes, "fp").where("k <> rep").select("k")
    links = similar_pairs(now.join(copies, "k", "left_anti"), "k", "x", params)
    return NearDuplicates(members, materialize(links, "links"))
