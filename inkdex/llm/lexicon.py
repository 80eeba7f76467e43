"""Byte-level BPE encoding of a whole corpus with a memory-mapped transducer of frequent words.

The public tokenizer splits a text into pieces by its pattern and merges each piece on its own, so the ids of a text
are the ids of its pieces in order. A lexicon holds the pieces that are frequent in the corpus with their ids, as a
minimal acyclic automaton whose shared suffixes keep it small; every other piece is merged exactly.
"""

from __future__ import annotations

import base64
import importlib.util
import uuid
from collections import Counter
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkdex.llm.words import blocks
from inkdex.runtime import ship_file, spread_scan

#: Fixed value of the public tokenizer: the pattern that splits a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces in the lexicon at most; more only costs memory and time to compile, never changes an id.
LEXICON_WORDS = 1 << 16
#: Longer pieces don't enter the lexicon (they are merged exactly).
WORD_BYTES = 48
#: Distinct pieces that a task counts before it hands on what it has.
FLUSH = 200_000
#: Characters that a task splits into pieces at once.
BLOCK = 1 << 20


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Path of a public vocabulary of ranks; any path to such a file may be used instead."""
    if "/" in name:
        return name
    spec = importlib.util.find_spec("public_tokenizers")
    return str(Path(spec.origin).parent / name if spec else Path("/opt/tokenizers") / name)


@lru_cache(2)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


@lru_cache(1)
def _split():
    import regex

    return regex.compile(PIECES).findall


class Transducer:
    """A minimal acyclic automaton over byte strings that numbers its words, with the ids of each number.

    Edges lie in arrays ordered by (state, byte): ``edge`` = state * 256 + byte, ``to``, and ``skip``, the number of
    words that precede those behind the edge. A word's number is the sum of the skips on its path; ``ids`` between
    ``start[number]`` and ``start[number + 1]`` are its output. Lookups walk all words of a batch at once.
    """

    FIELDS = ("edge", "to", "skip", "final", "start", "ids")

    def __init__(self, **arrays: np.ndarray):
        self.__dict__.update(arrays)

    @classmethod
    def compile(cls, words: dict[bytes, list[int]]) -> Transducer:
        """Built word by word in sorted order; states that agree in finality and edges are merged as soon as they close."""
        order = sorted(words)
        kids: list[list[tuple[int, int]]] = [[]]  # of each state
        final: list[bool] = [False]
        known: dict[tuple, int] = {}
        path: list[int] = [0]  # open states along the last word

        def close(depth: int, last: bytes) -> None:
            while len(path) > depth + 1:
                s = path.pop()
                same = known.setdefault((final[s], tuple(kids[s])), s)
                kids[path[-1]][-1] = (last[len(path) - 1], same)

        last = b""
        for w in order:
            common = 0
            while common < min(len(w), len(last)) and w[common] == last[common]:
                common += 1
            close(common, last)
            for b in w[common:]:
                kids.append([])
                final.append(False)
                kids[path[-1]].append((b, len(kids) - 1))
                path.append(len(kids) - 1)
            final[path[-1]] = True
            last = w
        close(0, last)
        count: dict[int, int] = {}
        state: dict[int, int] = {0: 0}
        todo = [0]
        while todo:  # states in use, children before parents
            s = todo[-1]
            if open_ := [t for _, t in kids[s] if t not in count]:
                todo += open_
                continue
            todo.pop()
            if s not in count:
                count[s] = final[s] + sum(count[t] for _, t in kids[s])
                state.setdefault(s, len(state))
        edges = []
        for s, n in state.items():
            before = int(final[s])
            for b, t in kids[s]:
                edges.append((n * 256 + b, state[t], before))
                before += count[t]
        edges.sort()
        cols = list(zip(*edges)) or [(), (), ()]
        ends = np.zeros(len(state), bool)
        for s, n in state.items():
            ends[n] = final[s]
        out = [words[w] for w in order]
        return cls(edge=np.array(cols[0], np.int64), to=np.array(cols[1], np.int32), skip=np.array(cols[2], np.int32), final=ends, start=np.cumsum([0, *map(len, out)], dtype=np.int64), ids=np.array([i for x in out for i in x], np.int32))

    def to_bytes(self) -> bytes:
        """One file: six arrays after a header of their types, lengths and offsets."""
        parts, head, at = [], [], 4096
        for f in self.FIELDS:
            a = np.ascontiguousarray(getattr(self, f))
            head.append(f"{f} {a.dtype.str} {len(a)} {at}")
            parts.append(a.tobytes() + b"\0" * (-a.nbytes % 64))
            at += len(parts[-1])
        return "\n".join(head).encode().ljust(4096, b"\n") + b"".join(parts)

    @classmethod
    def open(cls, path: str) -> Transducer:
        """Memory-mapped: the tasks of a machine share its pages."""
        mapped = np.memmap(path, np.uint8, "r")
        arrays = {}
        for line in bytes(mapped[:4096]).decode().split("\n"):
            if line:
                f, kind, n, at = line.split()
                dtype = np.dtype(kind)
                arrays[f] = mapped[int(at) : int(at) + int(n) * dtype.itemsize].view(dtype)
        return cls(**arrays)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 for a word that isn't in it."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        first = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(words) else sizes
        state, number = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        active, step = np.arange(len(words)), 0
        if not len(self.edge):
            return np.where((sizes == 0) & self.final[0], 0, -1)
        while len(active := active[sizes[active] > step]):
            key = state[active] * 256 + flat[first[active] + step]
            at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            found = self.edge[at] == key
            number[active[~found]] = -1
            active, at = active[found], at[found]
            state[active] = self.to[at]
            number[active] += self.skip[at]
            step += 1
        return np.where((number >= 0) & self.final[state], number, -1)


@lru_cache(2)
def _opened(name: str) -> Transducer:
    from pyspark import SparkFiles

    return Transducer.open(SparkFiles.get(name))


def _count_pieces(batches):
    """Partial counts of pieces, handed on whenever many distinct ones have come together."""
    split, seen = _split(), Counter()

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["piece", "n"])

    for b in batches:
        for text in b.column(0).to_pylist():
            if text:
                seen.update(split(text))
                if len(seen) > FLUSH:
                    yield rows()
                    seen.clear()
    yield rows()


def _smaller(batches):
    """Batches of (key, text) cut so that their texts have about ``BLOCK`` characters."""
    for b in batches:
        for lo, hi in blocks(b.column(1).to_pylist(), BLOCK):
            yield b.slice(lo, hi - lo)


def frequent_pieces(df: DataFrame, text: str, words: int = LEXICON_WORDS) -> list[str]:
    """The ``words`` most frequent pieces of all texts that occur more than once (ties: in order of their bytes)."""
    counts = df.select(F.col(text).alias("t")).where("t <> ''").mapInArrow(_count_pieces, "piece string, n bigint")
    counts = counts.where(F.octet_length("piece") <= WORD_BYTES).groupBy("piece").agg(F.sum("n").alias("n")).where("n > 1")
    return [r.piece for r in counts.orderBy(F.col("n").desc(), "piece").limit(words).collect()]  # at most words x WORD_BYTES


def encode(df: DataFrame, key: str, text: str, *, vocabulary_path: str | None = None, words: int = LEXICON_WORDS) -> DataFrame:
    """The token ids of every text: (key, ids array<int>), one row per row of ``df``.

    A null and an empty text have the empty list. Texts are encoded as they stand, special tokens' strings as ordinary
    text. Long texts are encoded whole; equal texts and keys stay separate rows. Nothing is shuffled but piece counts,
    and the rows of a table too small to have a split for every task.
    """
    path = vocabulary_path or vocabulary()
    encoder = _encoder(path)
    pieces = frequent_pieces(df, text, words)
    blob = Transducer.compile({p.encode(): ids for p, ids in zip(pieces, map(encoder.encode_ordinary, pieces))}).to_bytes()
    name = ship_file(df.sparkSession, f"lexicon-{uuid.uuid4().hex}.bin", blob)
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        split, lexicon, merge = _split(), _opened(name), _encoder(path).encode_ordinary
        known: dict[str, int] = {}  # piece -> its place in starts/sizes of this task's table
        for b in _smaller(batches):
            texts = b.column(1).to_pylist()
            found = [split(t) if t else [] for t in texts]
            new = [p for p in dict.fromkeys(p for x in found for p in x) if p not in known]
            if len(known) + len(new) > FLUSH:
                known.clear()
                new = list(dict.fromkeys(p for x in found for p in x))
            if not known:
                starts, sizes, table = [], [], []
                total = 0
            raw = [p.encode() for p in new]
            for p, n, w in zip(new, lexicon.numbers(raw).tolist(), raw):
                ids = lexicon.ids[lexicon.start[n] : lexicon.start[n + 1]].tolist() if n >= 0 else merge(p)
                known[p] = len(starts)
                starts.append(total)
                sizes.append(len(ids))
                table += ids
                total += len(ids)
            which = np.fromiter((known[p] for x in found for p in x), np.int64)
            first, size = np.array(starts, np.int64), np.array(sizes, np.int64)
            each = size[which] if len(which) else np.zeros(0, np.int64)
            ends = np.cumsum(each)
            # gather: position within the output minus where its piece began, plus where the piece lies in the table
            at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[which] - (ends - each), each) if len(which) else np.zeros(0, np.int64)
            ids = np.array(table, np.int32)[at]
            per_text = np.concatenate(([0], np.cumsum([len(x) for x in found])))
            bounds = np.concatenate(([0], ends))[per_text]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))], ["k", "ids"])

    out = spread_scan(df.select(F.col(key).alias("k"), F.col(text).alias("t")), "k").mapInArrow(run, f"k {kind}, ids array<int>")
    return out.withColumnRenamed("k", key)
