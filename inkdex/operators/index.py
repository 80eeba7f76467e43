"""Building the inverted index: postings, document lengths, collection statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkdex.functions.text import several, units
from inkdex.model import IndexType, Segmenter
from inkdex.operators import segment as seg
from inkdex.runtime import spread

NO_STARTS = "array<int>"


def current_rows(docs: DataFrame, key: str = "doc_id", revision: str = "revision") -> DataFrame:
    """Of each key the row of the greatest revision (null is the lowest; equal revisions are repeats, any one counts)."""
    latest = Window.partitionBy(key).orderBy(F.col(revision).desc_nulls_last())
    return spread(docs, key).withColumn("_latest", F.row_number().over(latest)).where("_latest = 1").drop("_latest")


#: Stop tokens that are compared as literals at most; more of them are joined.
LITERALS = 1_000


def without_stop_tokens(rows: DataFrame, column: str, stop: list[str] | DataFrame) -> DataFrame:
    """``rows`` whose ``column`` is not null and no stop token (a list, or a DataFrame with a column ``tok`` of any size)."""
    there = rows.where(F.col(column).isNotNull())
    if isinstance(stop, DataFrame):
        return there.join(stop.select(F.col("tok").alias(column)).distinct(), column, "left_anti")
    if len(stop) <= LITERALS:
        return there.where(~F.col(column).isin(list(stop))) if stop else there
    return there.join(rows.sparkSession.createDataFrame([(t,) for t in stop], f"`{column}` string"), column, "left_anti")


def _units(content: Column, segmenter, spark) -> Column:
    """The tokens of a content in order; in fine mode a text of one unit has none."""
    if segmenter is None:
        return several(units(content))
    return segmenter.column(content, spark)


def prepare(docs: DataFrame, segmenter: Segmenter | DataFrame | None = None) -> DataFrame:
    """Documents with ``_u``, the texts of their content's tokens in order (null where there is no content), and
    ``token_length``: how many tokens they have in all, stop tokens too. Columns that are missing are added as nulls.

    A projection without any shuffle, but for a dictionary that is a DataFrame, which contents meet in a join.
    """
    if "_u" in docs.columns:
        return docs
    for c, t in (("content", "string"), ("tokens", "array<struct<text:string,locations:array<int>>>"), ("labels", "array<string>")):
        docs = docs if c in docs.columns else docs.withColumn(c, F.lit(None).cast(t))
    there = F.coalesce(F.col("content"), F.lit("")) != ""
    if isinstance(segmenter, DataFrame):
        cuts = seg.segment_by_join(docs.select("doc_id", "content"), "doc_id", "content", segmenter).select("doc_id", F.transform("segments", lambda s: s["text"]).alias("_u"))
        docs = docs.join(cuts, "doc_id").withColumn("_u", F.when(there, F.col("_u")))
    else:
        docs = docs.withColumn("_u", F.when(there, _units(F.col("content"), segmenter, docs.sparkSession)))
    return docs.withColumn("token_length", F.coalesce(F.size("_u"), F.size("tokens"), F.lit(0)).cast("float"))


def _occurrences(docs: DataFrame) -> DataFrame:
    """One row per keyword occurrence of prepared documents: (doc_id, kind, pos, tok, starts): kind 0 content, 1 given token, 2 label."""
    none = F.array().cast("array<struct<kind:int,tok:string,starts:array<int>>>")
    one = lambda kind, tok, starts: F.struct(F.lit(kind).alias("kind"), tok.alias("tok"), starts.alias("starts"))
    null = F.lit(None).cast(NO_STARTS)
    content = F.when(F.col("_u").isNotNull(), F.transform("_u", lambda u: one(0, u, null))).otherwise(none)
    tokens = F.when(F.col("_u").isNull() & F.col("tokens").isNotNull(), F.transform("tokens", lambda t: one(1, t["text"], F.coalesce(t["locations"], F.array().cast(NO_STARTS))))).otherwise(none)
    labels = F.when(F.col("labels").isNotNull(), F.transform("labels", lambda x: one(2, x, null))).otherwise(none)
    # one explode for all three kinds: the rows of a document stay in the partition it came in
    return docs.select("doc_id", F.posexplode(F.concat(content, tokens, labels)).alias("pos", "k")).select("doc_id", "pos", "k.kind", "k.tok", "k.starts")


def _with_start(rows: DataFrame) -> DataFrame:
    """Occurrences with ``start``, the byte where a content token begins."""
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.when(F.col("kind") == 0, F.coalesce(F.sum(F.octet_length("tok")).over(before), F.lit(0)).cast("int")))


def tokenize(docs: DataFrame, segmenter: Segmenter | DataFrame | None = None) -> DataFrame:
    """Every content token with its place: (doc_id, pos, tok, start, end), bytes, end exclusive.

    Fine mode: a content of one unit has no tokens. Null and empty contents have none. doc_id must be unique.
    """
    rows = _with_start(_occurrences(prepare(spread(docs.select("doc_id", "content"), "doc_id"), segmenter)).where("kind = 0"))
    return rows.select("doc_id", "pos", "tok", "start", (F.col("start") + F.octet_length("tok")).cast("int").alias("end"))


def doc_stats(docs: DataFrame, segmenter: Segmenter | DataFrame | None = None) -> DataFrame:
    """(doc_id, token_length float) of every document: all its tokens, stop tokens too; 0 without any. A projection."""
    return prepare(docs, segmenter).select("doc_id", "token_length")


def build_postings(docs: DataFrame, stop: list[str] | DataFrame = (), index_type: IndexType = IndexType.LOCATIONS, segmenter: Segmenter | DataFrame | None = None, *, placed: bool = False) -> DataFrame:
    """The postings of documents (doc_id unique, content, tokens, labels; missing columns count as null).

    Content takes precedence over given tokens; of a given token's repeats the last counts; labels share the keys and
    take away the locations of an equal token. Stop tokens and null tokens or labels have no posting; null locations
    are empty. Result by index type: (tok, doc_id), plus tf float, plus starts ascending.

    Texts are shuffled once, by doc_id, before their tokens are exploded; grouping then needs no further exchange.
    ``placed``: the plan of ``docs`` already lies by doc_id, as ``current_rows`` leaves it, so they aren't even then.
    """
    rows = _occurrences(prepare(docs if placed else spread(docs, "doc_id"), segmenter))
    if index_type == IndexType.LOCATIONS:  # only here places are worked out, which takes a sort by document and place
        rows = without_stop_tokens(_with_start(rows), "tok", stop)
        given = F.max_by(F.when(F.col("kind") == 1, F.col("starts")), F.when(F.col("kind") == 1, F.col("pos")))
        starts = F.when(F.max("kind") == 2, F.array().cast(NO_STARTS)).otherwise(F.coalesce(given, F.sort_array(F.collect_list("start"))))
        return rows.groupBy("doc_id", "tok").agg(starts.alias("starts")).select("tok", "doc_id", F.size("starts").cast("float").alias("tf"), "starts")
    rows = without_stop_tokens(rows, "tok", stop)
    if index_type == IndexType.DOC_IDS:
        return rows.groupBy("doc_id", "tok").agg(F.lit(1).alias("_1")).select("tok", "doc_id")
    # counts alone: of a given token the size of its last repeat, packed with its place into one number for a plain maximum
    given = F.max(F.when(F.col("kind") == 1, F.shiftleft(F.col("pos").cast("bigint"), 32) + F.size("starts"))).bitwiseAND(F.lit(0xFFFFFFFF))
    n = F.when(F.max("kind") == 2, 0).otherwise(F.coalesce(given, F.count(F.when(F.col("kind") == 0, 1))))
    return rows.groupBy("doc_id", "tok").agg(n.cast("float").alias("tf")).select("tok", "doc_id", "tf")


def clean_postings(postings: DataFrame) -> DataFrame:
    """Each (tok, doc_id) once: (tok, doc_id, tf double, starts). Null or empty toks and null doc_ids are left out; null, NaN
    and negative tf count 0; null starts are empty. Repeats are exact (else the greatest tf and the greatest starts count).

    Rows are shuffled once, by document, which also serves what is grouped by document afterwards; filters on tok and
    doc_id go through it to the scan, and starts are only read where they are used.
    """
    tf = F.coalesce(F.col("tf").cast("double"), F.lit(0.0))
    rows = postings.select("tok", "doc_id", F.when((tf > 0) & ~F.isnan(tf), tf).otherwise(F.lit(0.0)).alias("tf"), F.coalesce(F.col("starts"), F.array().cast(NO_STARTS)).alias("starts")).where("tok <> '' and doc_id is not null")
    return rows.repartition("doc_id").groupBy("tok", "doc_id").agg(F.max("tf").alias("tf"), F.max("starts").alias("starts"))


def clean_stats(stats: DataFrame) -> DataFrame:
    """Each document once: (doc_id, token_length double); null and negative lengths count 0."""
    n = F.greatest(F.coalesce(F.col("token_length").cast("double"), F.lit(0.0)), F.lit(0.0))
    return stats.where("doc_id is not null").groupBy("doc_id").agg(F.max(n).alias("token_length"))


def document_frequency(postings: DataFrame) -> DataFrame:
    """(tok, df) of clean postings."""
    return postings.groupBy("tok").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(stats: DataFrame, shard: Column | None = None) -> DataFrame:
    """One row, or one per shard: (n_docs, total_length, avg_length). Documents without tokens count too."""
    rows = stats.withColumn("shard", shard) if shard is not None else stats
    keys = ["shard"] if shard is not None else []
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("token_length"), F.lit(0.0)).cast("double").alias("total_length"))
    return out.withColumn("avg_length", F.when(F.col("n_docs") > 0, F.col("total_length") / F.col("n_docs")).otherwise(F.lit(0.0)))


def write_postings(postings: DataFrame, path: str) -> None:
    """Clustered by (tok, doc_id), so that a lookup of few toks reads few row groups of few files. A tok may span several
    files. Finding the ranges computes ``postings`` twice: they should be stored already."""
    postings.repartitionByRange("tok", "doc_id").sortWithinPartitions("tok", "doc_id").write.mode("overwrite").option("parquet.block.size", 32 << 20).parquet(path)


def write_sorted(postings: DataFrame, path: str) -> None:
    """Sorted by (tok, doc_id) within each partition as it lies: without a shuffle, and yet a lookup reads few row groups of each file."""
    postings.sortWithinPartitions("tok", "doc_id").write.option("parquet.block.size", 32 << 20).parquet(path)
