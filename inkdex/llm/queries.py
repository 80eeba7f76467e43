"""The queries of this subpackage and the SQL that those expressible in SQL must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkdex.llm import canonical, containment, lexicon, minmax, mojibake
from inkdex.llm import term_counts as tc
from inkdex.runtime import materialize, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# -- problem 2: term frequencies

_TERMS = """
p as (select tok as term, count(*) as documents, sum(w) as occurrences from
  (select tok, doc_id, max(greatest(coalesce(cast(tf as double), 0), 0)) as w from postings where tok <> '' group by tok, doc_id) group by tok),
d as (select text as term, count(*) as documents, sum(w) as occurrences from
  (select entry_id, text, max(greatest(coalesce(cast(freq as double), 0), 0)) as w from dictionary where text <> '' group by entry_id, text) group by text)"""


def _postings_terms(spark, sf_dir):
    return tc.term_counts(table(spark, sf_dir, "postings"), "tok", "doc_id", "tf")


def _dictionary_terms(spark, sf_dir):
    return tc.term_counts(table(spark, sf_dir, "dictionary"), "text", "entry_id", "freq")


@query(f"""with {_TERMS}
select 'postings' as origin, term, documents, occurrences from p union all select 'dictionary', term, documents, occurrences from d""")
def p2_counts(spark, sf_dir):
    """Documents and occurrences of every term of either table."""
    return _postings_terms(spark, sf_dir).select(F.lit("postings").alias("origin"), "term", "documents", "occurrences").unionByName(_dictionary_terms(spark, sf_dir).select(F.lit("dictionary").alias("origin"), "term", "documents", "occurrences"))


@query(f"""with {_TERMS}, n as (select count(distinct doc_id) as n from postings)
select 'postings' as origin, term, case when documents * 20 > n or occurrences * 100 > (select sum(occurrences) from p) then 'common' else 'rare' end as verdict
from p, n where documents * 20 > n or occurrences * 100 > (select sum(occurrences) from p) or documents <= 2
union all
select 'dictionary', term, case when occurrences * 1000 > (select sum(occurrences) from d) then 'common' else 'rare' end
from d where occurrences * 1000 > (select sum(occurrences) from d) or occurrences < 5""")
def p2_found(spark, sf_dir):
    """Terms too common or too rare to be useful."""
    p = materialize(_postings_terms(spark, sf_dir), "p2-postings")
    d = materialize(_dictionary_terms(spark, sf_dir), "p2-dictionary")
    n = table(spark, sf_dir, "postings").agg(F.count_distinct("doc_id").alias("n"))
    total = lambda x: x.agg(F.sum("occurrences").alias("total"))
    p = tc.verdicts(p.crossJoin(F.broadcast(n)).crossJoin(F.broadcast(total(p))), (F.col("documents") * 20 > F.col("n")) | (F.col("occurrences") * 100 > F.col("total")), F.col("documents") <= 2)
    d = tc.verdicts(d.crossJoin(F.broadcast(total(d))), F.col("occurrences") * 1000 > F.col("total"), F.col("occurrences") < 5)
    return p.select(F.lit("postings").alias("origin"), "term", "verdict").unionByName(d.select(F.lit("dictionary").alias("origin"), "term", "verdict"))


# -- problem 6: encoding with a public tokenizer


@query()
def p6_ids(spark, sf_dir):
    """Token ids of every document by byte_bpe_50k."""
    return lexicon.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


# -- problem 7: evaluation passages in the corpus


_PASSAGES = """select {k}, array_to_string(w[i:i + 11], ' ') as passage from (select {k}, w, unnest(range(1, len(w) - 10)) as i
  from (select {k}, regexp_extract_all(regexp_replace(replace(lower(text), 'ß', 'ss'), '([\\x{{4E00}}-\\x{{9FFF}}])', ' \\1 ', 'g'), '[\\p{{L}}\\p{{N}}]+') as w from {t}) where len(w) >= 12)"""


@query(f"select distinct doc_id, item_id from ({_PASSAGES.format(k='doc_id', t='documents')}) d join ({_PASSAGES.format(k='item_id', t='eval_items')}) i on d.passage = i.passage")
def p7_found(spark, sf_dir):
    """Documents that hold 12 consecutive words of an evaluation item."""
    return containment.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), "doc_id", "item_id")


# -- problem 1: near-duplicate contents


@query("""with cur as (select doc_id, content from docs qualify row_number() over (partition by doc_id order by revision desc nulls last) = 1),
x as (select doc_id, lower(trim(regexp_replace(content, '[ \\t\\r\\n]+', ' ', 'g'))) as t from cur),
y as (select doc_id, t from x where length(t) >= 40),
s as materialized (select distinct doc_id, t[i:i + 4] as g from (select doc_id, t, unnest(range(1, length(t) - 3)) as i from y)),
n as (select doc_id, count(*) as n from s group by doc_id),
b as (select a.doc_id as doc_a, b.doc_id as doc_b, count(*) as both_ from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all)
select doc_a, doc_b from b join n na on na.doc_id = doc_a join n nb on nb.doc_id = doc_b where both_ * 10 >= 6 * (na.n + nb.n - both_)""")
def p1_found(spark, sf_dir):
    """Pairs of records whose current contents have a similarity of 0.6 or more."""
    return minmax.near_duplicates(table(spark, sf_dir, "docs"), "doc_id", "content", "revision").pairs()


@query()
def p1_groups(spark, sf_dir):
    """Of each record the representative of its text, the text's links, and its group."""
    found = minmax.near_duplicates(table(spark, sf_dir, "docs"), "doc_id", "content", "revision")
    return found.groups().withColumnRenamed("k", "doc_id")


# -- problem 5: texts that look the same


@query()
def p5_found(spark, sf_dir):
    """Pairs of records of a field that look the same in print but differ in characters."""
    fields = [("content", "docs", "doc_id", "content", F.col("revision")), ("request", "requests", "request_id", "text", F.lit(0)), ("dictionary", "dictionary", "entry_id", "text", F.lit(0))]
    rows = [table(spark, sf_dir, t).select(F.lit(f).alias("field_name"), F.col(k).alias("id"), F.col(x).alias("text"), v.alias("version")) for f, t, k, x, v in fields]
    return canonical.lookalike_pairs(rows[0].unionByName(rows[1]).unionByName(rows[2]), "field_name", "id", "text", "version")


@query()
def p5_canonical(spark, sf_dir):
    """The canonical form of every current content."""
    return canonical.canonical_rows(table(spark, sf_dir, "docs"), "doc_id", "content", "revision")


# -- problem 8: text read in a wrong encoding


def _garbled(spark, sf_dir):
    return mojibake.garbled(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"))


@query()
def p8_found(spark, sf_dir):
    """Documents that were read, in whole or in part, in a wrong encoding."""
    return _garbled(spark, sf_dir).select("doc_id")


@query()
def p8_restored(spark, sf_dir):
    """Those documents with the mistakes found and their text as it was, as far as it can be recovered."""
    return _garbled(spark, sf_dir).select("doc_id", "pairs", "restored")
