"""Held-out passages inside long documents: size-partitioned MinHash containment, verified exactly.

A passage is ``run`` consecutive words of an item, whatever the item's own length, as any part of it that long counts. MinHash estimates containment only where the two sets are of like
size, so documents and items are partitioned into windows of one size class, that of the passage: ``run`` words, or
run - shingle + 1 word shingles. A document that holds the passage has a window with the same shingle set, where
containment and Jaccard similarity are 1, and there one minimum already agrees with certainty: so nothing is
missed. Neighbouring windows mostly share their minimum, so a text has far fewer signatures than words. Whatever
agrees in a signature is a candidate, verified by the words of the passage themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkdex.llm.words import blocks, hashed_words, mix, runs, words_of
from inkdex.runtime import materialize

RUN, SHINGLE = 12, 5
#: Item text that is broadcast at most, in characters; beyond it signatures and candidates are joined by shuffle.
BROADCAST_CHARS = 16 << 20
#: Bits, as a power of two, of the filter that documents' signatures pass before such a join (8 MB).
FILTER = 26
#: Characters that a task splits into words at once.
BLOCK = 1 << 20


def signatures(texts: list[str | None], run: int = RUN, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (text index, window minimum) of all windows of ``run`` words, as two arrays."""
    parts = [(lo, _signatures(texts[lo:hi], run, shingle)) for lo, hi in blocks(texts, BLOCK)]
    return np.concatenate([o + lo for lo, (o, _) in parts] or [np.zeros(0, np.int64)]), np.concatenate([s for _, (_, s) in parts] or [np.zeros(0, np.int64)])


def _signatures(texts: list[str | None], run: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    hashes, owner = hashed_words(texts)
    shingles, _ = runs(hashes, owner, shingle)
    shingles = mix(shingles ^ np.uint64(0x5851F42D4C957F2D))
    n = len(hashes) - run + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = shingles[:n].copy()
    for k in range(1, run - shingle + 1):
        np.minimum(least, shingles[k : k + n], out=least)
    whole = owner[:n] == owner[run - 1 :]
    owner, least = owner[:n][whole], least[whole].view(np.int64)
    new = np.ones(len(owner), bool)  # a minimum stays for several windows
    new[1:] = (owner[1:] != owner[:-1]) | (least[1:] != least[:-1])
    return owner[new], least[new]


def passages(text: str | None, run: int = RUN) -> set[tuple[str, ...]]:
    """Every run of ``run`` words of a text."""
    w = words_of(text)
    return {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}


def _verified(doc: str, wanted: dict[int, set[tuple[str, ...]]], run: int) -> list[int]:
    w = words_of(doc)
    left, out = dict(wanted), []
    for i in range(len(w) - run + 1):
        p = tuple(w[i : i + run])
        for k in [k for k, s in left.items() if p in s]:
            out.append(k)
            del left[k]
        if not left:
            break
    return out


def leaks(docs: DataFrame, items: DataFrame, doc_key: str, item_key: str, text: str = "text", *, run: int = RUN, shingle: int = SHINGLE, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """The (doc_key, item_key) where a document holds ``run`` consecutive words of an item.

    Words are runs of letters and digits, each Han character a word of its own; case and everything between words are
    ignored. Null, empty and shorter texts are in no pair; keys must not be null; a key's repeats give one pair. Whole
    texts are read, whatever their length.

    Items of up to ``broadcast_chars`` characters in all (counted first) go to every task, and one pass over the
    documents without any shuffle does it all. Larger sets of items meet the documents in joins on the signature, which
    only those signatures of documents enter that pass a filter of the items' (8 MB, however many there are).
    """
    if shingle > run:
        raise ValueError("a shingle is no longer than a run")
    d = docs.select(F.col(doc_key).alias("d"), F.col(text).alias("t")).where(F.col("t").isNotNull() & F.col("d").isNotNull())
    i = items.select(F.col(item_key).alias("i"), F.col(text).alias("t")).where(F.col("t").isNotNull() & F.col("i").isNotNull())
    chars = i.agg(F.sum(F.char_length("t") + 64).alias("n")).first().n or 0
    dk, ik = d.schema["d"].dataType.simpleString(), i.schema["i"].dataType.simpleString()
    found = _by_broadcast(d, i, ik, dk, run, shingle) if chars <= broadcast_chars else _by_join(d, i, ik, dk, run, shingle)
    return found.select(F.col("d").alias(doc_key), F.col("i").alias(item_key))


def _by_broadcast(d: DataFrame, i: DataFrame, ik: str, dk: str, run: int, shingle: int) -> DataFrame:
    rows = i.collect()  # bounded by broadcast_chars
    owner, sig = signatures([r.t for r in rows], run, shingle)
    order = np.argsort(sig, kind="stable")
    side = d.sparkSession.sparkContext.broadcast((sig[order], owner[order], [r.i for r in rows], [r.t for r in rows]))

    def find(batches):
        sigs, owners, keys, texts = side.value
        parts: dict[int, set] = {}
        for b in batches:
            docs = b.column(1).to_pylist()
            who, least = signatures(docs, run, shingle)
            lo, hi = np.searchsorted(sigs, least), np.searchsorted(sigs, least, "right")
            candidates: dict[int, set[int]] = {}
            for k in np.flatnonzero(hi > lo):
                candidates.setdefault(int(who[k]), set()).update(owners[lo[k] : hi[k]].tolist())
            at, out = [], []
            for k, items in candidates.items():
                for x in items:
                    if x not in parts:
                        parts[x] = passages(texts[x], run)
                for x in dict.fromkeys(keys[x] for x in _verified(docs[k], {x: parts[x] for x in items}, run)):
                    at.append(k)
                    out.append(x)
            if at:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(out, b.schema.field(0).type if ik == dk else None)], ["d", "i"])

    found = d.mapInArrow(find, f"d {dk}, i {ik}")
    return found.distinct()  # pairs only; repeats of a document's row give one


def _by_join(d: DataFrame, i: DataFrame, ik: str, dk: str, run: int, shingle: int) -> DataFrame:
    def signed(batches):
        for b in batches:
            who, least = signatures(b.column(1).to_pylist(), run, shingle)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(who)), pa.array(least)], ["k", "s"])

    def verify(batches):
        for b in batches:
            docs, texts = b.column(2).to_pylist(), b.column(3).to_pylist()
            keep = [k for k, (x, y) in enumerate(zip(docs, texts)) if _verified(x, {0: passages(y, run)}, run)]
            if keep:
                yield b.select(["d", "i"]).take(pa.array(keep))

    right = materialize(i.mapInArrow(signed, f"k {ik}, s bigint").distinct(), "item-signatures")
    slots = F.shiftrightunsigned("s", 64 - FILTER)
    rows = right.groupBy(F.shiftright(slots, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(s, {64 - FILTER}) & 63 as int))")).alias("m")).toArrow()  # one row a word at most
    words = np.zeros(1 << (FILTER - 6), np.uint64)
    words[rows["w"].to_numpy()] = rows["m"].to_numpy().view(np.uint64)
    side = d.sparkSession.sparkContext.broadcast(words)

    def asked(batches):  # only signatures that an item may have are shuffled
        held = side.value
        for b in signed(batches):
            slot = b.column(1).to_numpy().view(np.uint64) >> np.uint64(64 - FILTER)
            yield b.filter(pa.array((held[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1))

    left = d.mapInArrow(asked, f"k {dk}, s bigint").distinct()
    pairs = left.withColumnRenamed("k", "d").join(right.withColumnRenamed("k", "i"), "s").select("d", "i").distinct()
    rows = pairs.join(d, "d").withColumnRenamed("t", "dt").join(i, "i").select("d", "i", "dt", F.col("t").alias("it"))
    return rows.mapInArrow(verify, f"d {dk}, i {ik}").distinct()
