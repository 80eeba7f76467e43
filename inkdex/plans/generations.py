"""The index on disk: generations that are written once and never changed, and a manifest that says which count.

A generation holds the documents of one ``index`` call (doc_id, token_length, shard, fields) and their postings, sorted
by token. A new manifest, one small file a commit, names the generations in order with their totals; its number is
one above the last, and as it must not exist yet, of two writers one fails. What no manifest names is never read.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkdex.model import IndexType
from inkdex.operators import index as ix
from inkdex.runtime import file_system, read_file, shared_path, write_file


@dataclass(frozen=True)
class Generation:
    """``kind`` 'index' or 'fields' (a change of scoring fields alone). ``totals``: (shard, documents, summed length).
    ``fields``: where the scoring fields that it brings are, if any."""

    path: str
    kind: str = "index"
    n_docs: int = 0
    totals: list = field(default_factory=list)
    fields: str | None = None


@dataclass(frozen=True)
class Manifest:
    """``disjoint``: no document is in two generations, so that all rows count and totals add up."""

    number: int = 0
    generations: list[Generation] = field(default_factory=list)
    disjoint: bool = True
    streams: dict[str, int] = field(default_factory=dict)

    @property
    def indexed(self) -> list[Generation]:
        return [g for g in self.generations if g.kind == "index"]

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        x: dict[str, Any] = json.loads(text)
        return cls(**(x | {"generations": [Generation(**g) for g in x["generations"]]}))


def _united(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _numbered(parts: list[DataFrame]) -> list[DataFrame]:
    return [p.withColumn("generation", F.lit(g)) for g, p in enumerate(parts)]


def _newest(parts: list[DataFrame]) -> DataFrame:
    """Of each document the row of its newest part, with ``generation``."""
    if len(parts) == 1:
        return _numbered(parts)[0]
    newest = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("generation").desc()))
    return _united(_numbered(parts)).withColumn("n", newest).where("n = 1").drop("n")


class Generations:
    """All generations under a folder; without one, in the session's shared folder, and gone with the session."""

    def __init__(self, spark: SparkSession, path: str | None, index_type: IndexType, upsert_mode: str):
        self.spark, self.upsert_mode = spark, upsert_mode
        self.durable = path is not None
        self.path = (path or shared_path(spark, "index")).rstrip("/")
        self.postings_schema = "tok string, doc_id bigint" + (", tf float" if index_type >= IndexType.FREQUENCIES else "") + (", starts array<int>" if index_type == IndexType.LOCATIONS else "")
        self._known: dict[str, DataFrame] = {}
        self.manifest = self._last()

    # -- the manifest

    def _last(self) -> Manifest:
        fs, folder = file_system(self.spark, f"{self.path}/manifest")
        if not fs.exists(folder):
            return Manifest()
        for name in sorted((f.getPath().getName() for f in fs.listStatus(folder)), reverse=True):
            try:
                return Manifest.from_json(read_file(self.spark, f"{self.path}/manifest/{name}"))
            except ValueError:  # a writer was lost while it wrote
                continue
        return Manifest()

    def commit(self, **changes: Any) -> None:
        """The manifest with these changes becomes the current one."""
        fresh = replace(self.manifest, number=self.manifest.number + 1, **changes)
        write_file(self.spark, f"{self.path}/manifest/{fresh.number:012d}.json", fresh.to_json().encode())
        self.manifest = fresh

    # -- writing

    def write_documents(self, documents: DataFrame, columns: list[str]) -> tuple[str, DataFrame]:
        """Starts a generation: its documents, with everything that postings are made of."""
        path = f"{self.path}/generation-{uuid.uuid4().hex}"
        rows = documents.select("doc_id", "token_length", "shard", "_u", "tokens", "labels", *columns)
        return path, self._write(rows, f"{path}/documents")

    def _write(self, rows: DataFrame, path: str) -> DataFrame:
        rows.write.parquet(path)
        return self._read(path, rows.schema)

    def _read(self, path: str, schema=None) -> DataFrame:
        """A part of a generation; as it never changes, it is looked at once."""
        if path not in self._known:
            self._known[path] = (self.spark.read.schema(schema) if schema is not None else self.spark.read).parquet(path)
        return self._known[path]

    def add(self, path: str, documents: DataFrame, postings: DataFrame, stream: tuple[str, int] | None = None) -> None:
        """Completes a generation with its postings and lets it count."""
        ix.write_sorted(postings, f"{path}/postings")
        self._read(f"{path}/postings", postings.schema)
        totals = documents.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("token_length").cast("double").alias("t"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).collect()  # a row a shard
        disjoint = self.manifest.disjoint
        if disjoint and totals and self.manifest.indexed:
            older = _united([self._documents(g).select("doc_id") for g in self.manifest.indexed]).where(F.col("doc_id").between(min(r.lo for r in totals), max(r.hi for r in totals)))
            disjoint = older.join(documents.select("doc_id"), "doc_id", "left_semi").isEmpty()
        streams = self.manifest.streams | (dict([stream]) if stream else {})
        if not totals and self.manifest.generations:  # nothing came: only the stream has moved on
            return self.commit(streams=streams)
        new = Generation(path, n_docs=sum(r.n for r in totals), totals=[[r.shard, r.n, r.t] for r in totals], fields=f"{path}/documents" if "fields" in documents.columns else None)
        self.commit(generations=[*self.manifest.generations, new], disjoint=disjoint, streams=streams)

    def add_fields(self, fields: DataFrame) -> None:
        """A change of scoring fields: (doc_id, fields), null where they are taken away."""
        path = f"{self.path}/generation-{uuid.uuid4().hex}"
        self._write(fields.select("doc_id", "fields"), f"{path}/fields")
        self.commit(generations=[*self.manifest.generations, Generation(path, "fields", fields=f"{path}/fields")])

    def merge(self, most: int) -> None:
        """Merges the newest generations of like size where there are more than ``most``: of N batches about log N
        generations stay, and a document is rewritten about as often."""
        gens = self.manifest.generations
        if len(gens) > most:
            first, total = len(gens) - 1, gens[-1].n_docs
            while first and gens[first - 1].n_docs <= 4 * total:
                first -= 1
                total += gens[first].n_docs
            if len(gens) - first > 1:
                self.compact(first)

    def compact(self, first: int = 0, gone: DataFrame | None = None) -> None:
        """Merges the generations from ``first`` on into one, without the documents of ``gone`` (doc_id)."""
        before, these = self.manifest.generations[:first], self.manifest.generations[first:]
        if not these or (len(these) == 1 and gone is None):
            return
        part = replace(self.manifest, generations=these)
        postings, stats, fields = *self.tables(part), self.fields(part)
        if gone is not None:
            postings, stats = (x.join(gone, "doc_id", "left_anti") for x in (postings, stats))
        path = f"{self.path}/generation-{uuid.uuid4().hex}"
        documents = self._write(stats.select("doc_id", "token_length", "shard"), f"{path}/documents")
        if fields is not None:
            self._write(fields, f"{path}/fields")
        ix.write_sorted(postings, f"{path}/unclustered")  # stored first, as finding the ranges computes it twice
        ix.write_postings(self.spark.read.schema(postings.schema).parquet(f"{path}/unclustered"), f"{path}/postings")
        self._read(f"{path}/postings", postings.schema)
        fs, there = file_system(self.spark, f"{path}/unclustered")
        fs.delete(there, True)
        totals = documents.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("token_length").cast("double").alias("t")).collect()
        merged = Generation(path, n_docs=sum(r.n for r in totals), totals=[[r.shard, r.n, r.t] for r in totals], fields=f"{path}/fields" if fields is not None else None)
        self.commit(generations=[*before, merged], disjoint=self.manifest.disjoint or not any(g.kind == "index" for g in before))

    # -- reading

    def _documents(self, g: Generation) -> DataFrame:
        return self._read(f"{g.path}/documents")

    def tables(self, manifest: Manifest | None = None) -> tuple[DataFrame, DataFrame]:
        """(postings, stats (doc_id, token_length, shard)) as they count now; empty ones where nothing is indexed."""
        m = manifest or self.manifest
        gens = m.indexed
        if not gens:
            return self.spark.createDataFrame([], self.postings_schema), self.spark.createDataFrame([], "doc_id bigint, token_length float, shard int")
        stats = [self._documents(g).select("doc_id", "token_length", "shard") for g in gens]
        postings = [self._read(f"{g.path}/postings") for g in gens]
        if len(gens) == 1 or m.disjoint:
            return _united(postings), _united(stats)
        live, rows = _newest(stats), _united(_numbered(postings))
        if self.upsert_mode == "replace":
            rows = rows.join(live.select("doc_id", "generation"), ["doc_id", "generation"], "left_semi")
        else:
            last = F.row_number().over(Window.partitionBy("doc_id", "tok").orderBy(F.col("generation").desc()))
            rows = rows.withColumn("n", last).where("n = 1").drop("n")
        return rows.drop("generation"), live.drop("generation")

    def corpus(self) -> DataFrame | None:
        """(shard, n_docs, total_length, avg_length) from the manifest, where the totals add up; else None."""
        m = self.manifest
        if not m.disjoint and len(m.indexed) > 1:
            return None
        sums: dict[int, list] = {}
        for g in m.indexed:
            for shard, n, t in g.totals:
                own = sums.setdefault(shard, [0, 0.0])
                own[0] += n
                own[1] += t
        rows = [(s, n, t, t / n) for s, (n, t) in sums.items()]
        return self.spark.createDataFrame(rows, "shard int, n_docs bigint, total_length double, avg_length double")

    def fields(self, manifest: Manifest | None = None) -> DataFrame | None:
        """(doc_id, fields) as they count now; None where no generation has any."""
        parts = [self._read(g.fields).select("doc_id", "fields") for g in (manifest or self.manifest).generations if g.fields]
        return _newest(parts).drop("generation") if parts else None
