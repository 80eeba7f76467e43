"""The engine's own indexer and ranker, which options can replace."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkdex.model import EngineOptions, RankOptions
from inkdex.operators import index as ix
from inkdex.operators import lookup as lk
from inkdex.operators import ranking as rk


class PostingIndexer:
    """Postings by document and token, conjunctive lookup with BM25 and proximity."""

    def __init__(self, options: EngineOptions):
        self.options = options

    def postings(self, documents: DataFrame) -> DataFrame:
        return ix.build_postings(documents, list(self.options.stop_tokens), self.options.index_type)

    def lookup(self, postings: DataFrame, stats: DataFrame, corpus: DataFrame | None, tokens: list[str], labels: list[str], doc_range: tuple[int, int] | None) -> DataFrame:
        o, shard = self.options, None
        if o.num_shards > 1:
            postings, shard = postings.join(stats.select("doc_id", "shard"), "doc_id"), F.col("shard")
        return lk.lookup(postings, stats, tokens, labels, doc_range, index_type=o.index_type, bm25=o.bm25, corpus=corpus, shard=shard, compat_truncate=o.compat_truncate)


class FieldRanker:
    """Scores from the documents' fields and relevance, top-k without a global sort."""

    def __init__(self, options: EngineOptions):
        self.options = options

    def rank(self, hits: DataFrame, fields: DataFrame | None, options: RankOptions) -> DataFrame:
        return rk.rank(rk.score(hits, fields, options.scorer), options)
