"""Postings as flat lists in the shared folder, on which a task answers whole questions: hits are ranked where they are
found, and none of them is shuffled or written before it is a row of the result.

Documents are dealt to segments by a hash of doc_id. Of each segment there is a file of its doc_ids in order and one of
their lengths; a list holds, for a token and a segment, the places of its documents there, and their frequencies.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkdex.functions.scoring import bm25_values
from inkdex.model import BM25Parameters
from inkdex.runtime import materialize, partitions, shared_path

#: Documents of a segment, about; rows of a result that are handed over at once.
SEGMENT, ROWS = 1 << 21, 1 << 17
#: Tokens that are sent to every task at most, so that postings nobody asks for aren't shuffled.
SENT = 300_000


def _append(folder: str, name: str):
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    return fs.open_output_stream(f"{path}/{name}")


@lru_cache(512)
def _local(folder: str, name: str, kind: str) -> np.ndarray | None:
    """A whole file, mapped; None where the folder is not on a file system of this machine."""
    fs, path = pafs.FileSystem.from_uri(folder)
    if not isinstance(fs, pafs.LocalFileSystem):
        return None
    path = f"{path}/{name}"
    return np.asarray(np.memmap(path, kind, "r")) if os.path.getsize(path) else np.zeros(0, kind)


@lru_cache(64)
def _far(folder: str, name: str, kind: str, begin: int, count: int) -> np.ndarray:
    fs, path = pafs.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{path}/{name}") as f:
        size = np.dtype(kind).itemsize
        return np.frombuffer(f.read_at(count * size, begin * size), kind)


def _read(folder: str, name: str, kind: str, begin: int, count: int) -> np.ndarray:
    whole = _local(folder, name, kind)
    return _far(folder, name, kind, begin, count) if whole is None else whole[begin : begin + count]


def segment_of(doc_id: Column, many: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(many)).cast("int")


class Lists:
    """Lists of the tokens ``asked`` (tok, distinct), from clean ``postings`` (tok, doc_id, tf) and ``stats`` (doc_id, token_length).

    ``directory``: (tok, df, lists array<struct<seg, file, begin, count>>).
    """

    def __init__(self, postings: DataFrame, stats: DataFrame, asked: DataFrame):
        spark = postings.sparkSession
        self.n_docs, self.average = stats.agg(F.count(F.lit(1)), F.coalesce(F.avg("token_length"), F.lit(0.0)).cast("double")).first()
        docs = stats.select("doc_id", F.col("token_length").cast("double").alias("n")).unionByName(postings.select("doc_id", F.lit(None).cast("double").alias("n")))
        docs = materialize(docs.groupBy("doc_id").agg(F.coalesce(F.max("n"), F.lit(0.0)).alias("n")), "lengths")
        many = max(1, -(-docs.count() // SEGMENT))
        folder = self.folder = shared_path(spark, "lists")
        docs = docs.withColumn("seg", segment_of(F.col("doc_id"), many)).repartition(many, "seg").sortWithinPartitions("seg", "doc_id")
        self.segments = {r.seg: (r.file, r.n) for r in docs.mapInArrow(_write_docs(folder), "seg int, file string, n bigint").collect()}
        segments = self.segments
        self.kind = kind = "<f4" if postings.schema["tf"].dataType.simpleString() == "float" else "<f8"
        asked = F.broadcast(asked) if asked.count() <= SENT else asked
        rows = postings.select("tok", "doc_id", F.coalesce(F.col("tf").cast("float" if kind == "<f4" else "double"), F.lit(0.0)).alias("tf")).join(asked, "tok", "left_semi")
        rows = rows.withColumn("seg", segment_of(F.col("doc_id"), many)).repartition(partitions(spark), "tok", "seg").sortWithinPartitions("tok", "seg", "doc_id")
        lists = materialize(rows.select("tok", "seg", "doc_id", "tf").mapInArrow(_write_lists(folder, segments, kind), "tok string, seg int, file string, begin bigint, count bigint"), "directory")
        self.directory = lists.groupBy("tok").agg(F.sum("count").alias("df"), F.collect_list(F.struct("seg", "file", "begin", "count")).alias("lists"))

    def answer(self, units: DataFrame, bm25: BM25Parameters, digits: int | None) -> DataFrame:
        """(request_id, rank, doc_id, bm25) of ``units``: (keys array<struct<tok, times, df, lists>>, asks array<struct<request_id, lo, hi, rev, skip, most>>).

        All keys of a unit have lists. One unit's hits are in memory at a time.
        """
        folder, segments, kind, n_docs, average = self.folder, self.segments, self.kind, self.n_docs, self.average

        def hits(keys: list[dict]) -> tuple[np.ndarray, np.ndarray]:
            keys = sorted(keys, key=lambda k: (k["df"], k["tok"]))
            where = [{x["seg"]: x for x in k["lists"]} for k in keys]
            docs, scores = [], []
            for seg, (file, n) in segments.items():
                if not all(seg in w for w in where):
                    continue
                read = lambda k, end, kind: _read(folder, where[k][seg]["file"] + end, kind, where[k][seg]["begin"], where[k][seg]["count"])  # noqa: E731, B023
                here, at = read(0, ".docs", "<u4"), [slice(None)]
                for k in range(1, len(keys)):
                    there = read(k, ".docs", "<u4")
                    place = np.minimum(np.searchsorted(there, here), len(there) - 1)
                    both = there[place] == here
                    if not both.all():
                        here, at = here[both], [np.flatnonzero(both) if isinstance(a, slice) else a[both] for a in at]
                        place = place[both]
                    at.append(place)
                    if not len(here):
                        break
                if not len(here):
                    continue
                lengths, total = _read(folder, file + ".lengths", "<f8", 0, n)[here], np.zeros(len(here))
                for k, key in enumerate(keys):
                    if key["times"]:
                        total += key["times"] * bm25_values(read(k, ".tf", kind)[at[k]].astype(float), key["df"], lengths, n_docs, average, bm25)
                docs.append(_read(folder, file + ".ids", "<i8", 0, n)[here])
                scores.append(total)
            if not docs:
                return np.zeros(0, np.int64), np.zeros(0)
            doc, score = np.concatenate(docs), np.concatenate(scores)
            if len(docs) > 1:
                order = np.argsort(doc)
                doc, score = doc[order], score[order]
            return doc, score if digits is None else _round(score, digits)

        def run(batches):
            out = _Rows()
            for b in batches:
                for unit in (u for k in range(0, b.num_rows, 256) for u in b.slice(k, 256).to_pylist()):
                    doc, score = hits(unit["keys"])
                    if not len(doc):
                        continue
                    unit["asks"].sort(key=lambda a: (a["lo"] is not None, a["lo"] or 0, a["hi"] or 0, a["rev"], a["most"] is not None, -a["skip"] - (a["most"] or 0)))
                    known, order = None, None
                    for a in unit["asks"]:
                        lo, hi = (0, len(doc)) if a["lo"] is None else (int(np.searchsorted(doc, a["lo"], "left")), int(np.searchsorted(doc, a["hi"], "right")))
                        last = hi - lo if a["most"] is None else min(hi - lo, a["skip"] + a["most"])
                        if last <= a["skip"]:
                            continue
                        if known is None or known[:3] != (lo, hi, a["rev"]) or known[3] < last:
                            order, known = lo + _first(score[lo:hi], last, a["rev"]), (lo, hi, a["rev"], last)
                        yield from out.add(a["request_id"], a["skip"], doc, score, order[a["skip"] : last])
            yield from out.rest()

        return units.select("keys", "asks").mapInArrow(run, "request_id bigint, rank int, doc_id bigint, bm25 double")


def _round(x: np.ndarray, digits: int) -> np.ndarray:
    """Half away from zero, as SQL rounds."""
    y = np.abs(x) * 10.0**digits
    low = np.floor(y)
    return np.copysign((low + (y - low >= 0.5)) / 10.0**digits, x)


def _first(score: np.ndarray, last: int, rev: bool) -> np.ndarray:
    """Places of the first ``last`` scores in order, of equals the later place first."""
    key = (score if rev else -score)[::-1]
    some = None
    if last < len(key) // 4:  # ties at the end are all kept until they are ordered
        some = np.flatnonzero(key <= np.partition(key, last - 1)[last - 1])
        key = key[some]
    order = np.argsort(key, kind="stable")[:last]
    return len(score) - 1 - (order if some is None else some[order])


class _Rows:
    """Result rows, handed over as batches of ``ROWS``."""

    def __init__(self):
        self.parts, self.n = [], 0

    def add(self, request_id: int, skip: int, doc: np.ndarray, score: np.ndarray, order: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(order), ROWS):
            part = order[k : k + ROWS]
            self.parts.append((request_id, skip + k + 1, doc[part], score[part]))
            self.n += len(part)
            if self.n >= ROWS:
                yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            sizes = np.array([len(p[2]) for p in self.parts])
            starts = np.array([p[1] for p in self.parts]) - (np.cumsum(sizes) - sizes)
            ids = np.repeat(np.array([p[0] for p in self.parts], np.int64), sizes)
            rank = (np.arange(self.n) + np.repeat(starts, sizes)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, rank, np.concatenate([p[2] for p in self.parts]), np.concatenate([p[3] for p in self.parts]))], ["request_id", "rank", "doc_id", "bm25"])
        self.parts, self.n = [], 0


def _write_docs(folder: str):
    def run(batches):
        now, parts = None, []

        def close():
            name = uuid.uuid4().hex  # of its own for each attempt
            for k, end in enumerate((".ids", ".lengths")):
                with _append(folder, name + end) as f:
                    for p in parts:
                        f.write(p[k].tobytes())
            return pa.RecordBatch.from_pydict({"seg": pa.array([now], pa.int32()), "file": [name], "n": pa.array([sum(len(p[0]) for p in parts)], pa.int64())})

        for b in batches:
            doc, n, seg = (np.asarray(b.column(b.schema.get_field_index(c))) for c in ("doc_id", "n", "seg"))
            edges = np.flatnonzero(np.diff(seg)) + 1
            for begin, end in zip([0, *edges], [*edges, len(seg)]):
                if end > begin:
                    if now is not None and seg[begin] != now:
                        yield close()
                        parts.clear()
                    now = int(seg[begin])
                    parts.append((doc[begin:end].astype("<i8"), n[begin:end].astype("<f8")))
        if parts:
            yield close()

    return run


def _write_lists(folder: str, segments: dict[int, tuple[str, int]], kind: str):
    def run(batches):
        name, at, last = uuid.uuid4().hex, 0, None
        files = None
        done: list[tuple[str, int, str, int, int]] = []

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["tok", "seg", "file", "begin", "count"])
            done.clear()
            return out

        try:
            for b in batches:
                if not b.num_rows:
                    continue
                files = files or [_append(folder, name + end) for end in (".docs", ".tf")]
                words = b.column(0).dictionary_encode()
                tok, seg, doc = np.asarray(words.indices), np.asarray(b.column(1)), np.asarray(b.column(2))
                place = np.empty(len(doc), "<u4")
                for s in np.unique(seg):
                    mine = seg == s
                    file, n = segments[int(s)]
                    place[mine] = np.searchsorted(_read(folder, file + ".ids", "<i8", 0, n), doc[mine])
                files[0].write(place.tobytes())
                files[1].write(np.asarray(b.column(3)).astype(kind).tobytes())
                edges = (np.flatnonzero((np.diff(tok) != 0) | (np.diff(seg) != 0)) + 1).tolist()
                for begin, end in zip([0, *edges], [*edges, len(doc)]):
                    key = (words.dictionary[int(tok[begin])].as_py(), int(seg[begin]))
                    if last and last[0] == key:  # begun in an earlier batch
                        last = (key, last[1], last[2] + end - begin)
                    else:
                        if last:
                            done.append((*last[0], name, last[1], last[2]))
                        last = (key, at + begin, end - begin)
                at += len(doc)
                if len(done) > 10_000:
                    yield rows()
        finally:
            for f in files or ():
                f.close()
        if last:
            done.append((*last[0], name, last[1], last[2]))
            yield rows()

    return run
