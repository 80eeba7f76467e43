"""Many requests at once: a table of requests meets the index in joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkdex.functions.scoring import bm25_term
from inkdex.functions.text import asked_units
from inkdex.model import BM25Parameters, Segmenter
from inkdex.operators.index import LITERALS, without_stop_tokens
from inkdex.operators.lists import Lists
from inkdex.operators.ranking import score
from inkdex.runtime import materialize, partitions

#: Places that are ranked in one task at most where hits are joined; limits beyond it are ranked like none.
BOUND = 10_000
#: Questions whose rarest key is in more documents are joined, others answered in one task. Requests of a question to a task.
BROAD, TOGETHER = 1 << 22, 64


def asked_tokens(text: Column, tokens: Column, stop: list[str], own: Column | None = None) -> Column:
    """The tokens of a request: of its text in fine mode without stop tokens, or, where it is null or empty, ``tokens`` as they stand.

    ``own``: the text's tokens where they aren't cut without a dictionary.
    """
    own = asked_units(text) if own is None else own
    own = F.filter(own, lambda t: ~t.isin(stop)) if stop else own
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(text, F.lit("")) != "", own).otherwise(F.coalesce(F.filter(tokens, lambda t: t.isNotNull()), none))


def with_tokens(requests: DataFrame, stop: list[str] | DataFrame, segmenter: Segmenter | None = None) -> DataFrame:
    """``requests`` (request_id unique) with ``q``, the tokens they ask for; stop tokens beyond a bounded list are joined."""
    own = segmenter.column(F.coalesce("text", F.lit("")), requests.sparkSession) if segmenter else None
    if not isinstance(stop, DataFrame) and len(stop) <= LITERALS:
        return requests.withColumn("q", asked_tokens(F.col("text"), F.col("tokens"), list(stop), own))
    rows = requests.withColumn("q", asked_tokens(F.col("text"), F.col("tokens"), [], own))
    each = rows.where("text <> ''").select("request_id", F.posexplode("q").alias("_i", "tok"))
    kept = without_stop_tokens(each, "tok", stop).groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("_i", "tok")))["tok"].alias("_q"))
    none = F.array().cast("array<string>")
    return rows.join(kept, "request_id", "left").withColumn("q", F.when(F.coalesce("text", F.lit("")) != "", F.coalesce("_q", none)).otherwise(F.col("q"))).drop("_q")


def valid_range(doc_ids: Column) -> Column:
    """Whether a request's range can be met: none at all, or [lo, hi] with lo <= hi."""
    return doc_ids.isNull() | (F.size(doc_ids) == 0) | ((F.size(doc_ids) == 2) & (F.get(doc_ids, F.lit(0)) <= F.get(doc_ids, F.lit(1))))


def rank_all(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``rows`` with ``rank`` from 1 within each group, however many rows one group has: no group gathers in one task.

    Rows are stored in ranges of (group, order), places are counted within a range, and what lies in earlier ranges is
    added from counts, one for each range and group it holds.
    """
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), group, *order)
    dealt = materialize(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    place = F.row_number().over(Window.partitionBy(group, "_range").orderBy(*order))
    return dealt.withColumn("_place", place).join(counts.select(group, "_range", "_before"), [group, "_range"]).withColumn("rank", (F.col("_place") + F.col("_before")).cast("int")).drop("_range", "_place", "_before")


def rank_some(rows: DataFrame, group: str, order: list[Column], record: str, most: int) -> DataFrame:
    """The first ``most`` rows of each group with ``rank`` from 1: ranked among shares of a group's records, map side first,
    then among what is left of them."""
    salts = partitions(rows.sparkSession)
    part = rows.withColumn("_salt", F.pmod(F.xxhash64(record), F.lit(salts)))
    part = part.withColumn("_place", F.row_number().over(Window.partitionBy(group, "_salt").orderBy(*order))).where(F.col("_place") <= most)
    return part.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= most).drop("_salt", "_place")


def answer_all(
    requests: DataFrame, postings: DataFrame, stats: DataFrame, stop: list[str] | DataFrame = (), bm25: BM25Parameters = BM25Parameters(), *,
    segmenter: Segmenter | None = None, fields: DataFrame | None = None, scorer: Callable[[DataFrame], Column] | None = None, shard: Column | None = None, digits: int | None = None,
) -> DataFrame:
    """The ranked documents of every request: (request_id, rank int, doc_id, bm25), with a scorer also scores array<double>.

    ``requests`` as in the log (request_id, text, tokens, labels, doc_ids, reverse_order, output_offset, max_outputs);
    repeats of a request_id count once; requests with a malformed range or without any key find nothing; a null or
    zero ``max_outputs`` sets no limit, as in ``ranking.rank``. ``postings`` and ``stats`` are clean. ``segmenter``,
    ``fields``, ``scorer`` and ``shard`` (an expression over doc_id) as in ``Engine``, ``ranking.score`` and
    ``lookup.lookup``. ``digits``: relevance is rounded so before it is compared; None: not at all.

    Without ``scorer`` and ``shard`` questions are answered on the lists of their keys, each in one task that ranks its
    hits, so that hits go nowhere before they are rows of the result; only those whose rarest key is in more than
    ``BROAD`` documents are joined, as all are with ``scorer`` or ``shard``.
    """
    none = F.array().cast("array<string>")
    rows = requests.dropDuplicates(["request_id"]).where(valid_range(F.col("doc_ids")))
    rows = with_tokens(rows, stop, segmenter)
    rows = rows.select("request_id", "q", F.array_distinct(F.filter(F.coalesce("labels", none), lambda x: x.isNotNull())).alias("l"), F.when(F.size("doc_ids") == 2, F.get("doc_ids", F.lit(0))).alias("lo"), F.when(F.size("doc_ids") == 2, F.get("doc_ids", F.lit(1))).alias("hi"), F.coalesce("reverse_order", F.lit(False)).alias("rev"), F.greatest(F.coalesce("output_offset", F.lit(0)), F.lit(0)).cast("bigint").alias("skip"), F.coalesce("max_outputs", F.lit(0)).cast("bigint").alias("most"))
    rows = rows.withColumn("most", F.when(F.col("most") > 0, F.col("most")))
    rows = materialize(rows.withColumn("question", F.to_json(F.struct("q", "l", "lo", "hi", "rev", "skip", "most"), {"ignoreNullFields": "false"})), "requests")
    if scorer or shard is not None:
        return answer_joined(rows, postings, stats, bm25, fields=fields, scorer=scorer, shard=shard, digits=digits)
    return answer_listed(rows, postings, stats, bm25, digits)


def answer_listed(rows: DataFrame, postings: DataFrame, stats: DataFrame, bm25: BM25Parameters, digits: int | None) -> DataFrame:
    """The answers by lists. Requests with the same keys meet in groups of ``TOGETHER``, about, that find their hits once."""
    times = lambda t: F.size(F.filter("q", lambda x: x == t)).alias("times")
    rows = rows.withColumn("keys", F.array_sort(F.transform(F.array_distinct(F.concat("q", "l")), lambda t: F.struct(t.alias("tok"), times(t)))))
    sets = materialize(rows.where(F.size("keys") > 0).groupBy("keys").agg(F.min("request_id").alias("set"), F.count(F.lit(1)).alias("many")), "sets")
    keys = sets.select("set", "many", F.size("keys").alias("n"), F.explode("keys").alias("k")).select("set", "many", "n", "k.tok", "k.times")
    lists = Lists(postings, stats, materialize(keys.select("tok").distinct(), "asked"))
    found = keys.join(lists.directory, "tok").groupBy("set").agg(F.first("n").alias("n"), F.min("df").alias("least"), F.collect_list(F.struct("tok", "times", "df", "lists")).alias("keys")).where(F.size("keys") == F.col("n"))
    found = materialize(found, "found")
    asks = rows.join(sets, "keys").withColumn("group", F.pmod(F.xxhash64("request_id"), F.ceil(F.col("many") / TOGETHER)))
    asks = asks.groupBy("set", "group").agg(F.collect_list(F.struct("request_id", "lo", "hi", "rev", "skip", "most")).alias("asks"))
    units = asks.join(found.where(F.col("least") <= BROAD).select("set", "keys"), "set").repartition(4 * partitions(rows.sparkSession), "set", "group")
    out = lists.answer(units, bm25, digits)
    broad = found.where(F.col("least") > BROAD).select("set")
    if broad.limit(1).count():
        joined = rows.join(sets.join(broad, "set", "left_semi").select("keys"), "keys", "left_semi").drop("keys")
        out = out.unionByName(answer_joined(joined, postings, stats, bm25, digits=digits))
    return out


def answer_joined(
    rows: DataFrame, postings: DataFrame, stats: DataFrame, bm25: BM25Parameters, *,
    fields: DataFrame | None = None, scorer: Callable[[DataFrame], Column] | None = None, shard: Column | None = None, digits: int | None = None,
) -> DataFrame:
    """The answers by joins.

    Requests that ask the same are answered once. Of each question the rarest key is looked up first, what the second
    rarest doesn't have is left out at once, and all keys only have to agree with what those two found, so that the
    length of a common key's list never multiplies; the (question, document) pairs are spread by both, so no key gathers
    in one task. Nor does the ranking of a broad
    question: limits are ranked in two stages, questions without one over ranges of their order.
    """
    asked = rows.groupBy("question").agg(F.min("request_id").alias("qid"), *[F.first(c).alias(c) for c in ("q", "l", "lo", "hi", "rev", "skip", "most")]).where(F.size("q") + F.size("l") > 0)
    asked = materialize(asked, "questions")
    keys = asked.select("qid", "lo", "hi", F.explode(F.array_distinct(F.concat("q", "l"))).alias("tok"), "q").select("qid", "lo", "hi", "tok", F.size(F.filter("q", lambda x: x == F.col("tok"))).alias("times"))
    df = postings.groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    keys = keys.join(df, "tok", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    per = Window.partitionBy("qid")
    keys = keys.withColumn("n", F.count(F.lit(1)).over(per)).withColumn("least", F.min("df").over(per)).withColumn("first", F.row_number().over(per.orderBy("df", "tok"))).withColumn("second", F.lead("tok").over(per.orderBy("df", "tok"))).where("least > 0")
    keys = materialize(keys, "keys")
    found = keys.where("first = 1").join(postings.select("tok", "doc_id"), "tok").where("lo is null or doc_id between lo and hi").select("qid", "doc_id", "second")
    both = found.where("second is not null").join(postings.select(F.col("tok").alias("second"), "doc_id"), ["second", "doc_id"], "left_semi")
    found = found.where("second is null").select("qid", "doc_id").unionByName(both.select("qid", "doc_id"))
    pairs = found.join(keys.select("qid", "tok", "times", "df", "n"), "qid").join(postings.select("tok", "doc_id", "tf"), ["tok", "doc_id"])
    sums = (F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.avg("token_length"), F.lit(0.0)).alias("average"))
    pairs = pairs.join(stats.select("doc_id", "token_length"), "doc_id", "left")
    if shard is None:
        pairs = pairs.crossJoin(F.broadcast(stats.agg(*sums)))
    else:  # every shard with its own statistics
        own = postings.withColumn("_shard", shard).groupBy("tok", "_shard").agg(F.count(F.lit(1)).alias("df"))
        pairs = pairs.withColumn("_shard", shard).drop("df").join(own, ["tok", "_shard"]).join(F.broadcast(stats.withColumn("_shard", shard).groupBy("_shard").agg(*sums)), "_shard")
    term = F.col("times") * bm25_term(F.col("tf"), F.col("df"), F.coalesce("token_length", F.lit(0.0)), F.col("n_docs"), F.col("average"), bm25)
    total = F.sum(term) if digits is None else F.round(F.sum(term), digits)
    hits = pairs.groupBy("qid", "doc_id").agg(F.count(F.lit(1)).alias("m"), F.max("n").alias("n"), total.alias("bm25")).where("m = n")
    columns = ["doc_id", "bm25"]
    if scorer:
        hits, columns = score(hits, fields, scorer), [*columns, "scores"]
    hits = materialize(hits.join(asked.select("qid", "rev", "skip", "most"), "qid").select("qid", "rev", "skip", "most", *columns), "hits")
    by = F.col(columns[-1])  # one of the two orders is null throughout a question
    order = [F.when(~F.col("rev"), by).desc(), F.when(F.col("rev"), by).asc(), F.col("doc_id").desc()]
    last = F.col("skip") + F.col("most")
    most = asked.where(last <= BOUND).agg(F.max(last)).first()[0]
    ranked = rank_all(hits.where(last.isNull() | (last > BOUND)), "qid", order).where(last.isNull() | (F.col("rank") <= last))
    if most:
        ranked = ranked.unionByName(rank_some(hits.where(last <= BOUND), "qid", order, "doc_id", most).where(F.col("rank") <= last))
    ranked = ranked.where(F.col("rank") > F.col("skip")).select("qid", "rank", *columns)
    return rows.select("request_id", "question").join(asked.select("question", "qid"), "question").join(ranked, "qid").select("request_id", "rank", *columns)
