"""Scoring, dropping, ordering and slicing what a lookup found."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkdex.functions.scoring import bm25_scorer
from inkdex.model import RankOptions

Scorer = Callable[[DataFrame], Column]


def score(docs: DataFrame, fields: DataFrame | None = None, scorer: Scorer | None = None) -> DataFrame:
    """Adds ``scores`` array<double> by the scorer and drops documents with none (an empty or null array).

    ``fields`` (doc_id, fields): joined on the left, a document without has null fields. The scorer is an expression
    over the joined columns. Each key of ``fields`` must occur once.
    """
    rows = docs if fields is None else docs.join(fields.select("doc_id", "fields"), "doc_id", "left")
    if fields is None and "fields" not in rows.columns:
        rows = rows.withColumn("fields", F.lit(None).cast("struct<none:int>"))
    return rows.withColumn("scores", (scorer or bm25_scorer)(rows)).where(F.size("scores") > 0)


def order(options: RankOptions) -> list[Column]:
    """Scores are compared element by element, a longer array before its own beginning; ties by doc_id, the greater first."""
    return [F.col("scores").asc() if options.reverse_order else F.col("scores").desc(), F.col("doc_id").desc()]


def rank(scored: DataFrame, options: RankOptions = RankOptions()) -> DataFrame:
    """The documents in order, from the offset, at most ``max_outputs``: planned as one top-k without a global sort."""
    out = scored.orderBy(*order(options))
    if options.output_offset:
        out = out.offset(options.output_offset)
    return out.limit(options.max_outputs) if options.max_outputs else out


def rank_within(scored: DataFrame, group: list[str], options: RankOptions = RankOptions()) -> DataFrame:
    """The same within each group (a shard, a request), with ``rank`` from 1; Spark prunes it before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order(options)))
    rows = scored.withColumn("rank", place)
    if options.max_outputs:
        rows = rows.where(F.col("rank") <= options.output_offset + options.max_outputs)
    return rows.where(F.col("rank") > options.output_offset)


def remove_fields(fields: DataFrame, removed: DataFrame) -> DataFrame:
    """Scoring fields without those of the removed documents (doc_id)."""
    return fields.join(removed.select("doc_id").distinct(), "doc_id", "left_anti")


def merge_fields(fields: DataFrame, fresh: DataFrame) -> DataFrame:
    """Scoring fields with those of ``fresh`` in place of older ones (both: doc_id unique, same columns)."""
    return remove_fields(fields, fresh).unionByName(fresh)
