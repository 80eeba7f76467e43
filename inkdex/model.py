"""Plain values of the API: options, requests and responses."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from enum import IntEnum
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, SparkSession


class IndexType(IntEnum):
    """What an index holds of each posting."""

    DOC_IDS = 0
    FREQUENCIES = 1
    LOCATIONS = 2


@dataclass(frozen=True)
class BM25Parameters:
    k1: float = 2.0
    b: float = 0.75


@dataclass(frozen=True)
class RankOptions:
    """``scorer`` None: the engine's own. ``max_outputs`` 0: no limit. Ties go to the greater doc_id."""

    scorer: Callable[[DataFrame], Column] | None = None
    reverse_order: bool = False
    output_offset: int = 0
    max_outputs: int = 0

    def __post_init__(self):
        if self.output_offset < 0 or self.max_outputs < 0:
            raise ValueError("offset and limit must not be negative")


@dataclass(frozen=True)
class Request:
    """``text`` is segmented and freed of stop tokens; where it is empty ``tokens`` are taken as they stand.

    ``doc_ids``: nothing, or the inclusive range [lo, hi]. ``timeout_ms`` 0: none.
    """

    text: str = ""
    tokens: list[str] = field(default_factory=list)
    labels: list[str] = field(default_factory=list)
    doc_ids: list[int] = field(default_factory=list)
    rank_options: RankOptions = RankOptions()
    timeout_ms: int = 0

    def range(self) -> tuple[int, int] | None:
        """The doc_id range, None for no restriction; a malformed one is an error rather than a hang."""
        if not self.doc_ids:
            return None
        if len(self.doc_ids) != 2 or self.doc_ids[0] > self.doc_ids[1]:
            raise ValueError("doc_ids must be [lo, hi] with lo <= hi")
        return self.doc_ids[0], self.doc_ids[1]


@dataclass
class Response:
    tokens: list[str]
    docs: DataFrame
    timeout: bool = False


class Segmenter(Protocol):
    """What cuts texts into tokens, at index and query alike; ``operators.segment.Lexicon`` is one."""

    def tokens(self, text: str) -> list[str]: ...
    def column(self, text: Column, spark: SparkSession) -> Column:
        """The tokens of every text of a column, array<string>; [] for an empty text."""


class Indexer(Protocol):
    """What makes postings of documents and finds documents by them; ``plans.parts.PostingIndexer`` is the engine's own."""

    def postings(self, documents: DataFrame) -> DataFrame:
        """(tok, doc_id, ...) of prepared documents (see ``operators.index.prepare``)."""

    def lookup(self, postings: DataFrame, stats: DataFrame, corpus: DataFrame | None, tokens: list[str], labels: list[str], doc_range: tuple[int, int] | None) -> DataFrame:
        """The documents with all tokens and labels, as ``operators.lookup.lookup`` gives them."""


class Ranker(Protocol):
    """What scores, orders and slices documents; ``plans.parts.FieldRanker`` is the engine's own."""

    def rank(self, hits: DataFrame, fields: DataFrame | None, options: RankOptions) -> DataFrame: ...


@dataclass(frozen=True)
class EngineOptions:
    """``num_shards`` 1: statistics of the whole collection; n: local statistics of n shards by the content hash.

    ``index_path``: a folder that outlives the session, where the index is kept; None: it ends with the session.
    ``indexer`` and ``ranker`` make other parts than the engine's own from these options.
    """

    index_type: IndexType = IndexType.FREQUENCIES
    bm25: BM25Parameters = BM25Parameters()
    num_shards: int = 1
    stop_tokens: tuple[str, ...] = ()
    dictionary: Any = None  # a Segmenter such as operators.segment.Lexicon, or its entries as a DataFrame where they are too many for one
    index_path: str | None = None
    most_generations: int = 8  # beyond so many, generations of like size are merged
    indexer: Callable[[EngineOptions], Indexer] | None = None
    ranker: Callable[[EngineOptions], Ranker] | None = None
    storage: Any = None  # a document store, see sources.store
    upsert_mode: str = "replace"  # or "merge": postings of dropped keywords stay
    compat_truncate: bool = False  # a located index ends a lookup at the first document without locations

    def __post_init__(self):
        if self.num_shards < 1 or self.most_generations < 1 or self.upsert_mode not in ("replace", "merge"):
            raise ValueError("num_shards and most_generations must be positive, upsert_mode 'replace' or 'merge'")
