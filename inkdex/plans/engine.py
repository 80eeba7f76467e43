"""The engine: index documents, find them, keep them over restarts."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkdex.functions.hashing import index_shard
from inkdex.model import EngineOptions, IndexType, RankOptions, Request, Response, Segmenter
from inkdex.operators import index as ix
from inkdex.operators import segment as seg
from inkdex.plans.generations import Generations
from inkdex.plans.parts import FieldRanker, PostingIndexer
from inkdex.runtime import materialize


def query_tokens(request: Request, stop: list[str] | tuple[str, ...] = (), dictionary: Segmenter | DataFrame | None = None) -> list[str]:
    """The tokens a request asks for: its text in fine mode without stop tokens, or where it is empty its tokens as they stand."""
    if not request.text:
        return list(request.tokens)
    if isinstance(dictionary, DataFrame):
        one = dictionary.sparkSession.createDataFrame([(0, request.text)], "id int, content string")
        cut = [s.text for s in seg.segment_by_join(one, "id", "content", dictionary).first().segments]
    else:
        cut = (dictionary or seg.Lexicon()).tokens(request.text)
    there = set(stop)
    return [t for t in cut if t not in there]


class Engine:
    """Documents in, ranked documents out; a context manager.

    The index is a set of generations, one per ``index`` call, each written once and never changed: a document's
    newest generation counts, so that indexing adds work in proportion to what is new. Generations of like size are
    merged once there are more than ``most_generations``. With ``index_path`` an engine that starts on the same folder
    finds everything that was indexed before, without indexing it again.
    """

    def __init__(self, spark: SparkSession, options: EngineOptions = EngineOptions()):
        self.spark, self.options = spark, options
        self.indexer = (options.indexer or PostingIndexer)(options)
        self.ranker = (options.ranker or FieldRanker)(options)
        self.generations = Generations(spark, options.index_path, options.index_type, options.upsert_mode)
        self._lock = threading.Lock()
        self.streams: list = []
        if options.storage is not None and not self.generations.manifest.generations:
            self.recover()

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    # -- indexing

    def index(self, docs: DataFrame, store: bool = True, *, stream: tuple[str, int] | None = None) -> None:
        """Adds or replaces documents (doc_id, content, tokens, labels, fields; all but doc_id optional).

        Of a doc_id's repeats within ``docs`` the one of the greatest ``revision`` counts, or any without that column.
        With upsert_mode 'merge' keywords that a document no longer has still find it. ``stream``: (name, batch) that
        is committed together with what it brings; a batch that was committed before is left out.

        Contents are cut once and shuffled twice, to find the current rows and to group their tokens.
        """
        o = self.options
        if stream and self.generations.manifest.streams.get(stream[0], -1) >= stream[1]:
            return
        docs = ix.current_rows(docs if "revision" in docs.columns else docs.withColumn("revision", F.lit(0)))
        keep = o.storage is not None and store
        docs = materialize(docs, "documents") if keep else docs  # it goes two ways: to the index and to the store
        rows = ix.prepare(docs, o.dictionary)
        rows = rows.withColumn("shard", index_shard(F.col("doc_id"), F.col("content"), o.num_shards) if o.num_shards > 1 else F.lit(0))
        with self._lock:
            path, rows = self.generations.write_documents(rows, ["fields"] if "fields" in docs.columns else [])
            self.generations.add(path, rows, self.indexer.postings(rows), stream)
            self.generations.merge(o.most_generations)
        if keep:
            o.storage.set(docs)

    def recover(self) -> None:
        """Indexes everything the store holds."""
        self.index(self.options.storage.recover(), store=False)

    def tables(self) -> tuple[DataFrame, DataFrame]:
        """(postings, doc_stats) as they count now; without rows where nothing is indexed."""
        return self.generations.tables()

    def compact(self) -> None:
        """Merges all generations into one."""
        with self._lock:
            self.generations.compact()

    def remove_document(self, ids: DataFrame) -> None:
        """Takes away scoring fields and stored documents (doc_id); the index itself still finds them, with null fields."""
        with self._lock:
            if (fields := self.generations.fields()) is not None:
                kind = fields.schema["fields"].dataType
                self.generations.add_fields(ids.select("doc_id").where("doc_id is not null").distinct().withColumn("fields", F.lit(None).cast(kind)))
        if self.options.storage is not None:
            self.options.storage.delete(ids)

    def delete_document(self, ids: DataFrame) -> None:
        """Removes documents from the index, too, which rewrites it."""
        self.remove_document(ids)
        with self._lock:
            self.generations.compact(gone=ids.select("doc_id").distinct())

    def flush(self) -> None:
        """Waits until all streams have indexed what has arrived."""
        for s in self.streams:
            s.processAllAvailable()

    def counters(self) -> dict[str, int]:
        """Postings and documents indexed so far."""
        postings, stats = self.tables()
        return {"num_token_index_added": postings.count(), "num_documents_indexed": stats.count()}

    def close(self) -> None:
        self.flush()
        for s in self.streams:
            s.stop()
        self.streams.clear()
        if self.options.storage is not None:
            self.options.storage.close()

    # -- finding

    def find(self, request: Request) -> Response:
        """Documents that hold all tokens and labels, scored, in order, sliced; a lazy plan unless there is a timeout.

        With one, the plan runs at once; if it isn't done in time its jobs are cancelled and no documents come back.
        Where nothing is indexed nothing is found.
        """
        o, options = self.options, request.rank_options
        tokens = query_tokens(request, o.stop_tokens, o.dictionary)
        hits = self.indexer.lookup(*self.tables(), self.generations.corpus(), tokens, request.labels, request.range())
        docs = self.ranker.rank(hits, self.generations.fields(), options)
        if request.timeout_ms <= 0:
            return Response(tokens, docs)
        group, context, late = f"find-{uuid.uuid4().hex}", self.spark.sparkContext, threading.Event()

        def stop() -> None:
            late.set()
            context._jsc.sc().cancelJobGroupAndFutureJobs(group)

        timer = threading.Timer(request.timeout_ms / 1000, stop)
        context.setJobGroup(group, "find", interruptOnCancel=True)
        timer.start()
        found = None
        try:
            found = materialize(docs, "found")
        except Exception:
            if not late.is_set():
                raise
        finally:
            timer.cancel()
            context.setLocalProperty("spark.jobGroup.id", None)
        if found is None or late.is_set():
            return Response(tokens, self.spark.createDataFrame([], docs.schema), timeout=True)
        return Response(tokens, found)


__all__ = ["Engine", "EngineOptions", "IndexType", "RankOptions", "Request", "Response", "query_tokens"]
