"""Conjunctive lookup with relevance: documents that have all tokens and all labels."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkdex.functions.scoring import bm25_term
from inkdex.model import BM25Parameters, IndexType
from inkdex.operators.proximity import add_proximity

HIT = "doc_id bigint, bm25 double, token_proximity int, token_snippet_locations array<int>, token_locations array<array<int>>"


def matching(postings: DataFrame, keys: list[str], doc_range: tuple[int, int] | None = None) -> DataFrame:
    """The doc_ids that have a posting for every key; none for no keys. Postings are clean; a repeat counts once.

    The filters on tok and doc_id reach the Parquet scan; one aggregation by document replaces a join per key, so the
    order of the keys and their lengths don't matter.
    """
    wanted = sorted(set(keys))
    rows = postings.where(F.col("tok").isin(wanted) if wanted else F.lit(False))
    if doc_range:
        rows = rows.where(F.col("doc_id").between(*doc_range))
    return rows.groupBy("doc_id").agg(F.count_distinct("tok").alias("n")).where(F.col("n") == len(wanted)).select("doc_id")


def lookup(
    postings: DataFrame, stats: DataFrame, tokens: list[str], labels: list[str] = (), doc_range: tuple[int, int] | None = None, *,
    index_type: IndexType = IndexType.FREQUENCIES, bm25: BM25Parameters | None = BM25Parameters(), corpus: DataFrame | None = None, shard: Column | None = None, compat_truncate: bool = False,
) -> DataFrame:
    """Documents that hold all ``tokens`` and ``labels`` (one key space): (doc_id, bm25, token_proximity, token_snippet_locations, token_locations).

    A repeated token scores once per occurrence in the query; labels and postings of frequency 0 never score. ``stats``
    (doc_id, token_length), clean; a document missing there has length 0. Statistics cover the whole collection, or
    each shard by itself where ``shard``, an expression over doc_id, is given. No keys, or a key that no document has:
    no rows. Locations (places, proximity) are null unless the index has them; with them, a document where a token has
    none scores 0. ``compat_truncate``: such a document, the one of the greatest doc_id in its shard, ends the lookup:
    itself it is kept, lower doc_ids are not.

    One aggregation over the postings of the keys; frequencies of the keys ride along as a second small aggregation.
    """
    keys = sorted({*tokens, *labels})
    times = Counter(tokens)
    located = index_type == IndexType.LOCATIONS
    rows = postings.where(F.col("tok").isin(keys) if keys else F.lit(False))
    by = ["shard"] if shard is not None else []
    if shard is not None:
        rows, stats = rows.withColumn("shard", shard), stats.withColumn("shard", shard)
    frequency = {IndexType.LOCATIONS: F.size("starts").cast("double") if located else None, IndexType.FREQUENCIES: F.col("tf").cast("double") if "tf" in postings.columns else None}.get(index_type)
    frequency = F.lit(0.0) if frequency is None else frequency
    df = rows.groupBy(*by, "tok").agg(F.count(F.lit(1)).alias("df"))  # at most one row per key and shard
    inside = rows.where(F.col("doc_id").between(*doc_range)) if doc_range else rows
    # documents first: only those with all keys are scored
    hits = inside.groupBy(*by, "doc_id").agg(F.collect_list(F.struct("tok", frequency.alias("f"), (F.col("starts") if located else F.lit(None).cast("array<int>")).alias("starts"))).alias("p")).where(F.size("p") == len(keys))
    hits = hits.join(stats.select("doc_id", F.col("token_length").cast("double").alias("_len")), "doc_id", "left")
    if corpus is None:
        corpus = stats.groupBy(*by).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("token_length").cast("double").alias("total_length"))
        corpus = corpus.withColumn("avg_length", F.col("total_length") / F.col("n_docs"))
    table = df.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("tok", "df"))).alias("_df"))
    side = corpus.join(table, by, "left") if by else corpus.crossJoin(F.broadcast(table))
    hits = hits.join(F.broadcast(side), by) if by else hits.crossJoin(F.broadcast(side))  # one row, or one per shard
    complete = F.lit(True)
    if located and tokens:
        asked = F.array(*map(F.lit, times))
        complete = ~F.exists("p", lambda x: F.array_contains(asked, x["tok"]) & (F.size(x["starts"]) == 0))
    score = F.lit(0.0)
    if bm25 is not None and tokens and index_type != IndexType.DOC_IDS:
        count = F.create_map(*[F.lit(x) for t, n in times.items() for x in (t, float(n))])
        term = lambda x: F.coalesce(count[x["tok"]], F.lit(0.0)) * bm25_term(x["f"], F.col("_df")[x["tok"]], F.coalesce("_len", F.lit(0.0)), F.col("n_docs"), F.coalesce("avg_length", F.lit(0.0)), bm25)
        score = F.when(complete, F.aggregate(F.array_sort("p"), F.lit(0.0), lambda a, x: a + term(x))).otherwise(F.lit(0.0))
    none = F.lit(None).cast("array<array<int>>")
    places = none
    if located and tokens:
        of = lambda t: F.filter("p", lambda x: x["tok"] == t)[0]["starts"]
        places = F.when(complete, F.array(*map(of, tokens))).otherwise(none)
    out = hits.select(*by, "doc_id", score.alias("bm25"), places.alias("token_locations"), complete.alias("_complete"))
    if located and tokens and compat_truncate:
        last = out.where(~F.col("_complete")).groupBy(*by).agg(F.max("doc_id").alias("_last"))
        out = (out.join(F.broadcast(last), by, "left") if by else out.crossJoin(F.broadcast(last))).where(F.col("_last").isNull() | (F.col("doc_id") >= F.col("_last")))
    out = out.select("doc_id", "bm25", "token_locations")
    if located and tokens:
        out = add_proximity(out, tokens)
    else:
        out = out.withColumns({"token_proximity": F.lit(None).cast("int"), "token_snippet_locations": F.lit(None).cast("array<int>")})
    return out.select("doc_id", "bm25", "token_proximity", "token_snippet_locations", "token_locations")
