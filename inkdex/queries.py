"""The core's registered queries and the SQL that each must agree with (the llm subpackage has its own)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from inkdex.functions import hashing, scoring, text
from inkdex.model import BM25Parameters, EngineOptions, IndexType, RankOptions, Request
from inkdex.operators import index, lookup, ranking, segment, skew
from inkdex.plans import requests
from inkdex.plans.engine import Engine
from inkdex.runtime import materialize, shared_path, table
from inkdex.sources import dictionary, reject_csv
from inkdex.sources.store import ParquetStore
from inkdex.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_ONE = "select tok, doc_id, max(greatest(coalesce(cast(tf as double), 0), 0)) as w, count(*) as c from postings where tok <> '' group by tok, doc_id"


@query(f"""
with big as (select tok from postings where tok <> '' group by tok having count(*) >= 0.01 * (select count(*) from postings)),
r as (select tok, doc_id, row_number() over (partition by tok order by w desc, doc_id) as k from ({_ONE}) where tok in (select tok from big))
select tok, doc_id from r where k <= 5""")
def p3_found(spark, sf_dir):
    """Of each tok with 1 % of all postings or more, the 5 documents of greatest tf."""
    return skew.top_records_per_key(table(spark, sf_dir, "postings"), "tok", "doc_id", "tf", 5, min_share=0.01, exact_repeats=True).select("tok", "doc_id")


@query(f"""
select tok, doc_id, w as tf, cast(k as int) as rank from
(select *, row_number() over (partition by tok order by w desc, doc_id) as k from ({_ONE})) where k <= 5""")
def p3_top_docs(spark, sf_dir):
    """The 5 documents of greatest tf of every tok."""
    return skew.top_records_per_key(table(spark, sf_dir, "postings"), "tok", "doc_id", "tf", 5, exact_repeats=True)


@query(f"select tok, cast(sum(c) as bigint) as n_rows, count(doc_id) as n_records, cast(sum(w) as double) as total from ({_ONE}) group by tok")
def p3_totals(spark, sf_dir):
    """Rows, documents and summed tf of every tok."""
    return skew.totals_per_key(table(spark, sf_dir, "postings"), "tok", "doc_id", "tf")


# -- problem 4: dictionary lines that fail to parse

_LINES = r"""
with l as (select line_id, coalesce(raw_line, '') as r, coalesce(raw_line, '') as s from dict_lines),
w as (select line_id, regexp_full_match(r, '[ \t\r]*(?:(?:"(?:[^"]|"")*"|[^" \t\r]+)(?:[ \t\r]+(?:"(?:[^"]|"")*"|[^" \t\r]+))*)?[ \t\r]*', 's') as fine,
  [case when x[1] = '"' then replace(x[2:-2], '""', '"') else x end for x in regexp_extract_all(s, '"(?:[^"]|"")*"|[^" \t\r]+', 0, 's')] as f from l),
v as (select line_id, f, case when not fine then 'quoting' when len(f) not in (2, 3) then 'columns'
  when trim(f[1]) = '' or regexp_matches(f[1], '[\x00-\x1F\x7F\x{FFFD}]') then 'text'
  when not regexp_full_match(f[2], '0*[0-9]{1,10}') or try_cast(f[2] as bigint) not between 2 and 2147483647 then 'freq'
  when len(f) = 3 and not regexp_full_match(f[3], '[a-z]{1,3}') then 'pos' end as reason from w)
"""


def _parsed(spark, sf_dir):
    return reject_csv.parse_lines(table(spark, sf_dir, "dict_lines"), "line_id", "raw_line")


@query(_LINES + "select line_id, reason from v where reason is not null")
def p4_found(spark, sf_dir):
    """Bad dictionary lines with the reason."""
    return reject_csv.rejected(_parsed(spark, sf_dir), "line_id")


@query(_LINES + "select line_id, f[1] as text, cast(f[2] as integer) as freq, f[3] as pos from v where reason is null")
def p4_entries(spark, sf_dir):
    """The entries of all valid dictionary lines."""
    return reject_csv.valid(_parsed(spark, sf_dir), "line_id")


# -- splitting and segmenting the corpus

_UNIT = text.UNIT
_LOW = f"translate(%s, '{text.UPPER}', '{text.LOWER}')"
#: Current documents; their content tokens with places; stop tokens.
_CUR = "cur as (select * from docs qualify row_number() over (partition by doc_id order by revision desc nulls last) = 1)"
_TOKENS = f"""{_CUR},
un as (select doc_id, u as tok, i - 1 as pos from (select doc_id, unnest(a) as u, generate_subscripts(a, 1) as i
  from (select doc_id, regexp_extract_all({_LOW % "coalesce(content, '')"}, '{_UNIT}') as a from cur) where len(a) > 1)),
tk as (select doc_id, cast(pos as int) as pos, tok, cast(coalesce(sum(strlen(tok)) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) as int) as start from un)"""
_STOP = "stop as (select distinct tok from stop_tokens where tok <> '')"
_LENGTHS = """
len_ as (select cur.doc_id, cast(case when coalesce(content, '') <> '' then coalesce(c.n, 0) else coalesce(len(tokens), 0) end as float) as token_length
  from cur left join (select doc_id, count(*) as n from tk group by doc_id) c on c.doc_id = cur.doc_id)"""
_KEYWORDS = f"""{_TOKENS}, {_STOP},
given as (select doc_id, tok, starts from (select doc_id, t.text as tok, coalesce(t.locations, []) as starts, row_number() over (partition by doc_id, t.text order by i desc) as rn
  from (select doc_id, unnest(tokens) as t, generate_subscripts(tokens, 1) as i from cur where coalesce(content, '') = '')) where rn = 1 and tok is not null),
kw as (select doc_id, tok, list(start order by start) as starts from tk group by doc_id, tok union all select doc_id, tok, starts from given),
lab as (select distinct doc_id, tok from (select doc_id, unnest(labels) as tok from cur) where tok is not null),
post as (select * from (select coalesce(k.doc_id, l.doc_id) as doc_id, coalesce(k.tok, l.tok) as tok, case when l.tok is not null then [] else k.starts end as starts
  from kw k full outer join lab l on k.doc_id = l.doc_id and k.tok = l.tok) where tok not in (select tok from stop)),
{_LENGTHS}"""


def _docs(spark, sf_dir):
    return index.current_rows(table(spark, sf_dir, "docs"))


def _stop(spark, sf_dir):
    return dictionary.stop_list(table(spark, sf_dir, "stop_tokens"))


def _built(spark, sf_dir, stop, index_type):
    """An index of the current documents: postings, lengths, fields. Contents are cut once."""
    docs = materialize(index.prepare(_docs(spark, sf_dir)).select("doc_id", "token_length", "_u", "tokens", "labels", "fields"), "documents")
    return materialize(index.build_postings(docs, stop, index_type), "postings"), docs.select("doc_id", "token_length"), docs.select("doc_id", "fields")


def _joined(c: str):
    return F.array_join(F.col(c).cast("array<string>"), " ")


@query(f"""select doc_id, cast(i - 1 as int) as pos, raw from (select doc_id, unnest(a) as raw, generate_subscripts(a, 1) as i
from (select doc_id, regexp_extract_all(text, '{_UNIT}') as a from documents))""")
def split_words(spark, sf_dir):
    """The units of every document as they stand."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.split_words(F.col("text"))).alias("pos", "raw"))


@query(f"select distinct raw, {_LOW % 'raw'} as lowered from (select unnest(regexp_extract_all(text, '{_UNIT}')) as raw from documents)")
def ascii_lower(spark, sf_dir):
    """The distinct units of the corpus with their lower-case form."""
    raw = table(spark, sf_dir, "documents").select(F.explode(text.split_words(F.col("text"))).alias("raw")).distinct()
    return raw.select("raw", text.ascii_lower(F.col("raw")).alias("lowered"))


@query(f"select doc_id, cast(case when len(a) > 1 then len(a) else 0 end as int) as n from (select doc_id, regexp_extract_all(coalesce(text, ''), '{_UNIT}') as a from documents)")
def segment_nodict(spark, sf_dir):
    """The number of fine-mode tokens of every document, without a dictionary."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.asked_units(F.col("text"))).alias("n"))


@query(f'with {_TOKENS} select doc_id, pos, tok, start, cast(start + strlen(tok) as int) as "end" from tk')
def token_offsets(spark, sf_dir):
    """Every content token with its byte places."""
    return index.tokenize(_docs(spark, sf_dir))


@query(f"with {_TOKENS}, {_LENGTHS} select doc_id, token_length from len_")
def doc_token_length(spark, sf_dir):
    """The length of every document."""
    return index.doc_stats(_docs(spark, sf_dir))


@query(f"with {_TOKENS}, {_STOP} select doc_id, tok, count(*) as n from tk where tok not in (select tok from stop) group by doc_id, tok")
def stop_token_filter(spark, sf_dir):
    """Content tokens that are no stop tokens, counted."""
    rows = index.tokenize(_docs(spark, sf_dir))
    stop = table(spark, sf_dir, "stop_tokens").where("tok <> ''").distinct()
    return rows.join(stop, "tok", "left_anti").groupBy("doc_id", "tok").agg(F.count(F.lit(1)).alias("n"))


@query("select distinct tok from stop_tokens where tok <> ''")
def stop_tokens_load(spark, sf_dir):
    """The stop tokens in use, through a file of one token per line."""
    path = shared_path(spark, "stop")
    table(spark, sf_dir, "stop_tokens").select(F.coalesce("tok", F.lit("")).alias("value")).coalesce(1).write.text(path)
    return dictionary.read_stop_tokens(spark, path)


# -- the index


@query(f"with {_KEYWORDS} select g.doc_id, g.tok, array_to_string(g.starts, ' ') as starts from given g where g.tok not in (select tok from stop)")
def external_tokens(spark, sf_dir):
    """Postings of the tokens that were given with documents without content."""
    rows = _docs(spark, sf_dir).where("coalesce(content, '') = ''").drop("labels")
    return index.build_postings(rows, _stop(spark, sf_dir)).select("doc_id", "tok", _joined("starts").alias("starts"))


@query(f"with {_KEYWORDS} select tok, doc_id from post")
def postings_docids(spark, sf_dir):
    """The index that holds documents only."""
    return index.build_postings(_docs(spark, sf_dir), _stop(spark, sf_dir), IndexType.DOC_IDS, placed=True)


@query(f"with {_KEYWORDS} select tok, doc_id, cast(len(starts) as float) as tf from post")
def postings_freq(spark, sf_dir):
    """The index with frequencies."""
    return index.build_postings(_docs(spark, sf_dir), _stop(spark, sf_dir), IndexType.FREQUENCIES, placed=True)


@query(f"with {_KEYWORDS} select tok, doc_id, cast(len(starts) as float) as tf, array_to_string(starts, ' ') as starts from post")
def postings_locations(spark, sf_dir):
    """The index with places."""
    return index.build_postings(_docs(spark, sf_dir), _stop(spark, sf_dir), placed=True).withColumn("starts", _joined("starts"))


@query(f"with {_KEYWORDS} select (select count(*) from post) as num_token_index_added, (select count(*) from cur) as num_documents_indexed")
def index_counters(spark, sf_dir):
    """How much an engine has indexed."""
    with Engine(spark, EngineOptions(stop_tokens=tuple(_stop(spark, sf_dir)))) as engine:
        engine.index(table(spark, sf_dir, "docs"))
        return spark.createDataFrame([engine.counters()], "num_token_index_added bigint, num_documents_indexed bigint")


# -- statistics, lookup and relevance over the given index

_INDEX = """
ps as (select tok, doc_id, max(greatest(coalesce(cast(tf as double), 0), 0)) as tf, max(coalesce(starts, [])) as starts from postings where tok <> '' and doc_id is not null group by tok, doc_id),
st as (select doc_id, max(greatest(coalesce(cast(token_length as double), 0), 0)) as len_ from doc_stats group by doc_id),
df as (select tok, count(*) as df from ps group by tok),
g as (select count(*) as n, cast(coalesce(sum(len_), 0) as double) as total, cast(avg(len_) as double) as a from st)"""


def _index(spark, sf_dir):
    return index.clean_postings(table(spark, sf_dir, "postings")), index.clean_stats(table(spark, sf_dir, "doc_stats"))


@query(f"with {_INDEX} select tok, df from df")
def document_frequency(spark, sf_dir):
    """In how many documents each tok is."""
    return index.document_frequency(_index(spark, sf_dir)[0])


@query(f"with {_INDEX} select tok, round(log2(g.n / df.df + 1), 6) as idf from df, g")
def idf(spark, sf_dir):
    """The smoothed inverse document frequency of each tok."""
    postings, stats = _index(spark, sf_dir)
    rows = index.document_frequency(postings).crossJoin(F.broadcast(index.corpus_stats(stats)))
    return rows.select("tok", F.round(scoring.idf(F.col("n_docs"), F.col("df")), 6).alias("idf"))


@query(f"with {_INDEX} select n as n_docs, total as total_length, round(a, 6) as avg_length from g")
def corpus_stats(spark, sf_dir):
    """Number of documents, total and average length."""
    return index.corpus_stats(_index(spark, sf_dir)[1]).withColumn("avg_length", F.round("avg_length", 6))


def _and(*keys: str) -> str:
    listed = ", ".join(f"'{k}'" for k in keys)
    return f"select doc_id from ps where tok in ({listed}) group by doc_id having count(*) = {len(set(keys))}"


@query(f"with {_INDEX} {_and('the', 'of')}")
def lookup_and_2(spark, sf_dir):
    """Documents with two toks."""
    return lookup.matching(_index(spark, sf_dir)[0], ["the", "of"])


@query(f"with {_INDEX} {_and('the', 'of', 'and')}")
def lookup_and_3(spark, sf_dir):
    """Documents with three toks."""
    return lookup.matching(_index(spark, sf_dir)[0], ["the", "of", "and"])


@query(f"with {_INDEX} {_and('the', 'no such tok')}")
def lookup_missing_keyword(spark, sf_dir):
    """A tok that no document has: nothing is found."""
    return lookup.matching(_index(spark, sf_dir)[0], ["the", "no such tok"])


@query(f"with {_INDEX} {_and('the', 'en')}")
def lookup_with_label(spark, sf_dir):
    """A tok and a label; labels share the key space."""
    return lookup.lookup(*_index(spark, sf_dir), ["the"], ["en"]).select("doc_id")


@query(f"with {_INDEX} select doc_id, cast(0 as double) as bm25 from ({_and('en')})")
def lookup_label_only(spark, sf_dir):
    """A label alone: every document scores 0."""
    return lookup.lookup(*_index(spark, sf_dir), [], ["en"]).select("doc_id", "bm25")


@query(f"with {_INDEX}, r as (select min(doc_id) + (max(doc_id) - min(doc_id)) // 4 as lo, max(doc_id) - (max(doc_id) - min(doc_id)) // 4 as hi from ps) select doc_id from ({_and('the', 'of')}), r where doc_id between lo and hi")
def docid_range_filter(spark, sf_dir):
    """Documents with two toks within a range of ids: the middle half."""
    postings, stats = _index(spark, sf_dir)
    r = postings.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    request = Request(tokens=["the", "of"], doc_ids=[r.lo + (r.hi - r.lo) // 4, r.hi - (r.hi - r.lo) // 4])
    return lookup.lookup(postings, stats, request.tokens, request.labels, request.range()).select("doc_id")


def _bm25(keys: list[str], labels: tuple[str, ...] = (), k1: str = "2.0", b: str = "0.75", extra: str = "", tf: str = "p.tf") -> str:
    asked = ", ".join(f"('{k}')" for k in keys)
    need = ", ".join(f"'{k}'" for k in {*keys, *labels})
    return f"""k(tok) as (values {asked}),
hit as (select doc_id from ps where tok in ({need}) group by doc_id having count(*) = {len({*keys, *labels})}),
bm as (select p.doc_id, round(sum(case when {tf} > 0 and g.a <> 0 then log2(g.n / df.df + 1) * {tf} * ({k1} + 1) / ({tf} + {k1} * (1 - {b} + {b} * coalesce(st.len_, 0) / g.a)) else 0 end), 6) as bm25
  from k join ps p on p.tok = k.tok join hit on hit.doc_id = p.doc_id join df on df.tok = p.tok left join st on st.doc_id = p.doc_id cross join g {extra} group by p.doc_id)"""


def _scored(hits):
    return hits.select("doc_id", F.round("bm25", 6).alias("bm25"))


@query(f"with {_INDEX}, {_bm25(['the', 'of'])} select doc_id, cast(bm25 as double) as bm25 from bm")
def bm25_two_terms(spark, sf_dir):
    """Relevance for two toks."""
    return _scored(lookup.lookup(*_index(spark, sf_dir), ["the", "of"]))


@query(f"with {_INDEX}, {_bm25(['the', 'of', 'the'])} select doc_id, cast(bm25 as double) as bm25 from bm")
def bm25_duplicate_terms(spark, sf_dir):
    """A repeated tok counts as often as it is asked for."""
    return _scored(lookup.lookup(*_index(spark, sf_dir), ["the", "of", "the"]))


@query(f"with {_INDEX}, {_bm25(['the', 'en'], ('thread',))} select doc_id, cast(bm25 as double) as bm25 from bm")
def bm25_label_clobber(spark, sf_dir):
    """A label asked for as a tok has frequency 0 and adds nothing; a label as such filters only."""
    return _scored(lookup.lookup(*_index(spark, sf_dir), ["the", "en"], ["thread"]))


@query(f"with {_INDEX}, {_bm25(['the', 'of'], k1='1.2', b='0.5')} select doc_id, cast(bm25 as double) as bm25 from bm")
def bm25_custom_params(spark, sf_dir):
    """Other parameters of the relevance."""
    return _scored(lookup.lookup(*_index(spark, sf_dir), ["the", "of"], bm25=BM25Parameters(1.2, 0.5)))


_SHARDED = _INDEX.replace("df as (select tok,", "df as (select doc_id % 2 as shard, tok,").replace("from ps group by tok),", "from ps group by doc_id % 2, tok),").replace("g as (select", "g as (select doc_id % 2 as shard,").replace("from st)", "from st group by doc_id % 2)")


@query(f"with {_SHARDED}, {_bm25(['the', 'of'], extra='where df.shard = p.doc_id % 2 and g.shard = p.doc_id % 2')} select doc_id, cast(bm25 as double) as bm25 from bm")
def bm25_sharded(spark, sf_dir):
    """Relevance by the statistics of each of two shards."""
    return _scored(lookup.lookup(*_index(spark, sf_dir), ["the", "of"], shard=F.pmod("doc_id", F.lit(2))))


# -- places

_PAIR = "select a.doc_id, a.starts as s1, b.starts as s2 from (select doc_id, starts from post where tok = 'these') a join (select doc_id, starts from post where tok = 'our') b on a.doc_id = b.doc_id"


def _located_hits(spark, sf_dir, tokens):
    return lookup.lookup(*_built(spark, sf_dir, [], IndexType.LOCATIONS)[:2], tokens, index_type=IndexType.LOCATIONS)


#: Without stop tokens; each step is worked out once, and of the postings only those asked for.
_ALL = _KEYWORDS.replace(_STOP, "stop as (select '' as tok)").replace("tk as (", "tk as materialized (").replace("as starts from tk group by", "as starts from tk where tok in ('these', 'our') group by").replace("where rn = 1 and tok is not null", "where rn = 1 and tok in ('these', 'our')").replace("unnest(labels) as tok from cur) where tok is not null", "unnest(labels) as tok from cur) where tok in ('these', 'our')")


@query(f"with {_ALL} select doc_id, cast(case when len(s1) > 0 and len(s2) > 0 then list_min(flatten([[abs(b - a - 5) for b in s2] for a in s1])) end as int) as token_proximity from ({_PAIR})")
def proximity_two_terms(spark, sf_dir):
    """How close two tokens stand to each other."""
    return _located_hits(spark, sf_dir, ["these", "our"]).select("doc_id", "token_proximity")


@query(f"with {_ALL} select doc_id, array_to_string(s1, ' ') || '|' || array_to_string(s2, ' ') as places from ({_PAIR})")
def token_locations(spark, sf_dir):
    """The places of the tokens asked for, in their order."""
    return _located_hits(spark, sf_dir, ["these", "our"]).select("doc_id", F.array_join(F.transform("token_locations", lambda x: F.array_join(x.cast("array<string>"), " ")), "|").alias("places"))


@query(f"""with {_ALL}, pair as ({_PAIR}),
one as (select doc_id, s1, s2, unnest(range(1, len(s1) + 1)) as i from pair where len(s1) > 0 and len(s2) > 0),
to2 as (select *, abs(s2[j] - s1[i] - 5) as c2 from (select doc_id, s1, s2, i, unnest([low, low + 1]) as j from (select *, greatest(len(list_filter(s2, lambda x: x < s1[i])), 1) as low from one)) where j <= len(s2)),
best2 as (select * from to2 qualify row_number() over (partition by doc_id, j order by c2, i) = 1),
to3 as (select *, c2 + abs(s1[l] - s2[j] - 3) as c3 from (select doc_id, s1, s2, i, j, c2, unnest([low, low + 1]) as l from (select *, greatest(len(list_filter(s1, lambda x: x < s2[j])), 1) as low from best2)) where l <= len(s1)),
best3 as (select * from to3 qualify row_number() over (partition by doc_id, l order by c3, j) = 1),
best as (select * from best3 qualify row_number() over (partition by doc_id order by c3, l) = 1)
select pair.doc_id, cast(c3 as int) as token_proximity, best.s1[i] || ' ' || best.s2[j] || ' ' || best.s1[l] as snippet from pair left join best on best.doc_id = pair.doc_id""")
def snippet_locations(spark, sf_dir):
    """Where the tokens stand closest; three tokens, one of them twice."""
    return _located_hits(spark, sf_dir, ["these", "our", "these"]).select("doc_id", "token_proximity", _joined("token_snippet_locations").alias("snippet"))


# -- ranking

_RANKED = f"{_KEYWORDS}, ps as (select tok, doc_id, len(starts) as tf from post), st as (select doc_id, token_length as len_ from len_), df as (select tok, count(*) as df from ps group by tok), g as (select count(*) as n, avg(len_) as a from st), {_bm25(['most', 'these'])}"
_FIELDS = "left join (select doc_id, fields from cur) f on f.doc_id = bm.doc_id"


def _hits(spark, sf_dir, tokens=("most", "these")):
    postings, stats, fields = _built(spark, sf_dir, _stop(spark, sf_dir), IndexType.FREQUENCIES)
    return lookup.lookup(postings, stats, list(tokens)).withColumn("bm25", F.round("bm25", 6)), fields


def _stars(df):
    """Documents without stars are dropped."""
    return F.when(df["fields.stars"].isNotNull(), F.array(df["fields.stars"].cast("double"))).otherwise(F.array().cast("array<double>"))


def _numbered(ranked, options):
    """With the place in the order, as the order of rows isn't compared."""
    w = Window.orderBy(*ranking.order(options))  # over what the slice left, a bounded number of rows
    return ranked.withColumn("rank", F.row_number().over(w) + options.output_offset)


@query(f"with {_RANKED} select bm.doc_id, fields.stars as stars from bm {_FIELDS}")
def rank_fields_left_join(spark, sf_dir):
    """Scoring fields of the documents found, null where there are none."""
    hits, fields = _hits(spark, sf_dir)
    return ranking.score(hits, fields).select("doc_id", "fields.stars")


@query(f"with {_RANKED} select bm.doc_id, cast(fields.stars as double) as score from bm {_FIELDS} where fields.stars is not null")
def scorer_filter(spark, sf_dir):
    """A scorer that gives no score drops the document."""
    hits, fields = _hits(spark, sf_dir)
    return ranking.score(hits, fields, _stars).select("doc_id", F.col("scores")[0].alias("score"))


@query(f"with {_RANKED} select bm.doc_id, cast(row_number() over (order by coalesce(fields.stars, -1) desc, bm25 desc, bm.doc_id desc) as int) as rank from bm {_FIELDS} qualify rank <= 50")
def multi_score_sort(spark, sf_dir):
    """The 50 best by two scores, one after the other."""
    hits, fields = _hits(spark, sf_dir)
    options = RankOptions(max_outputs=50)
    scored = ranking.score(hits, fields, lambda d: F.array(F.coalesce(d["fields.stars"].cast("double"), F.lit(-1.0)), d["bm25"]))
    return _numbered(ranking.rank(scored, options), options).select("doc_id", "rank")


@query(f"with {_RANKED} select doc_id, cast(row_number() over (order by bm25, doc_id desc) as int) as rank from bm qualify rank <= 20")
def rank_reverse(spark, sf_dir):
    """The 20 least relevant documents, the least first."""
    options = RankOptions(reverse_order=True, max_outputs=20)
    return _numbered(ranking.rank(ranking.score(_hits(spark, sf_dir)[0]), options), options).select("doc_id", "rank")


@query(f"with {_RANKED} select doc_id, cast(bm25 as double) as bm25, cast(row_number() over (order by bm25 desc, doc_id desc) as int) as rank from bm qualify rank <= 10")
def topk_bm25(spark, sf_dir):
    """From raw documents to the 10 most relevant for 'most these' (a text; the blank is a stop token or asked for, too)."""
    options = RankOptions(max_outputs=10)
    return _numbered(ranking.rank(ranking.score(_hits(spark, sf_dir)[0]), options), options).select("doc_id", "bm25", "rank")


@query(f"with {_RANKED} select doc_id, cast(bm25 as double) as bm25, cast(row_number() over (order by bm25 desc, doc_id desc) as int) as rank from bm qualify rank > 5 and rank <= 15")
def topk_offset(spark, sf_dir):
    """Ten documents from the sixth on."""
    options = RankOptions(output_offset=5, max_outputs=10)
    return _numbered(ranking.rank(ranking.score(_hits(spark, sf_dir)[0]), options), options).select("doc_id", "bm25", "rank")


# -- updates and stores

_OLD = "select * from docs qualify row_number() over (partition by doc_id order by revision nulls first) = 1"


@query(f"with {_CUR} select doc_id, case when fields.stars = 0 then null else fields.stars end as stars from cur")
def remove_document_fields(spark, sf_dir):
    """Removed documents (here those without stars) stay in the index but lose their scoring fields."""
    docs = _docs(spark, sf_dir)
    fields = docs.select("doc_id", "fields")
    left = ranking.remove_fields(fields, docs.where("fields.stars = 0"))
    return docs.select("doc_id").join(left, "doc_id", "left").select("doc_id", "fields.stars")


@query(f"with {_KEYWORDS.replace(_STOP, 'stop as (select chr(0) as tok)')} select tok, count(*) as df from post group by tok")
def reindex_replace(spark, sf_dir):
    """Documents indexed in their first revision, then again in their last: only the last counts."""
    docs = table(spark, sf_dir, "docs")
    first = docs.withColumn("revision", -F.col("revision"))
    with Engine(spark) as engine:
        engine.index(first)
        engine.index(docs)
        return engine.tables()[0].groupBy("tok").agg(F.count(F.lit(1)).alias("df"))


def _store(spark, mode="upsert"):
    return ParquetStore(spark, shared_path(spark, "store"), _STORED, mode=mode)


_STORED = StructType([StructField("doc_id", LongType()), StructField("content", StringType()), StructField("revision", IntegerType())])


@query(f"with {_CUR} select doc_id, content, revision from cur")
def store_roundtrip(spark, sf_dir):
    """What is stored comes back."""
    store = _store(spark)
    store.set(_docs(spark, sf_dir))
    return store.recover()


@query(f"with {_CUR} select doc_id, content, revision from cur where not (revision > 1)")
def store_delete(spark, sf_dir):
    """Deleted documents (here those that were revised) don't."""
    store = _store(spark)
    store.set(_docs(spark, sf_dir))
    store.delete(_docs(spark, sf_dir).where("revision > 1"))
    return store.recover()


@query(f"with {_CUR} select doc_id, content, revision from cur")
def store_upsert_latest(spark, sf_dir):
    """Of a document stored twice the later version comes back."""
    store = _store(spark)
    store.set(index.current_rows(table(spark, sf_dir, "docs").withColumn("revision", -F.col("revision"))).withColumn("revision", -F.col("revision")))
    store.set(_docs(spark, sf_dir))
    return store.recover()


_PLAIN = _KEYWORDS.replace(_STOP, "stop as (select chr(0) as tok)").replace("unnest(labels)", "unnest(cast([] as varchar[]))").replace("unnest(tokens)", "unnest(case when false then tokens else [] end)").replace("generate_subscripts(tokens, 1)", "generate_subscripts(case when false then tokens else [] end, 1)")


@query(f"with {_PLAIN} select tok, count(*) as df from post group by tok")
def store_recover(spark, sf_dir):
    """An engine that starts on a store indexes what it holds."""
    store = _store(spark)
    store.set(_docs(spark, sf_dir))
    with Engine(spark, EngineOptions(storage=store)) as engine:
        return engine.tables()[0].groupBy("tok").agg(F.count(F.lit(1)).alias("df"))


@query(f"with {_KEYWORDS.replace(_STOP, 'stop as (select chr(0) as tok)')} select tok, count(*) as df from post group by tok")
def ingest_documents(spark, sf_dir):
    """Documents that arrive as a stream of files, the engine and its stream started anew in between, are indexed like those of one batch."""
    docs = table(spark, sf_dir, "docs")
    path, options, progress = shared_path(spark, "arriving"), EngineOptions(index_path=shared_path(spark, "index")), shared_path(spark, "progress")
    for half in range(2):
        docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == half).repartition(4, "doc_id").write.mode("append").parquet(path)
        with Engine(spark, options) as engine:
            ingest.start_ingest(engine, ingest.document_stream(spark, path, docs.schema), progress)
            engine.flush()
            found = engine.tables()[0].groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    return found


# -- the dictionary

_ENTRIES = f"""en as (select {_LOW % 'text'} as text, freq, coalesce(pos, '') as pos, entry_id from dictionary where text <> '' and freq >= 2 qualify row_number() over (partition by {_LOW % 'text'} order by entry_id) = 1)"""


def _entries(spark, sf_dir):
    return segment.load_entries(table(spark, sf_dir, "dictionary"), "text", "freq", "pos", "entry_id")


@query(f"with {_ENTRIES} select text, freq, pos from en")
def dictionary_load(spark, sf_dir):
    """The entries of the dictionary: the first of each text, frequent enough."""
    return _entries(spark, sf_dir).select("text", "freq", "pos")


@query(f"with {_ENTRIES.replace('where text', 'where freq is not null and not regexp_matches(text, chr(91) || chr(32) || chr(9) || chr(13) || chr(10) || chr(93)) and text')} select text, freq, pos from en")
def dictionary_file(spark, sf_dir):
    """The same through dictionary files of one 'text freq pos' a line, of the entries that such a line can hold."""
    path = shared_path(spark, "dictionary")
    rows = table(spark, sf_dir, "dictionary").dropDuplicates(["entry_id"]).where("freq is not null and text <> '' and not text rlike '[ \\t\\r\\n]'")
    rows.coalesce(1).sortWithinPartitions("entry_id").select(F.concat_ws(" ", "text", F.col("freq").cast("string"), "pos").alias("value")).write.text(path)
    return dictionary.read_dictionary(spark, path).select("text", "freq", "pos")


@query(f"with {_ENTRIES} select count(*) as num_tokens, cast(coalesce(sum(freq), 0) as bigint) as total_frequency, cast(coalesce(max(len(regexp_extract_all(text, '{_UNIT}'))), 0) as int) as max_token_length from en")
def dictionary_totals(spark, sf_dir):
    """Entries, frequencies and the longest entry in units."""
    return segment.dictionary_totals(_entries(spark, sf_dir))


@query(f"with {_ENTRIES}, t as (select sum(freq) as total from en) select text, round(cast(log2(total) as float) - cast(log2(freq) as float), 4) as distance from en, t")
def token_distance(spark, sf_dir):
    """What an entry costs on a path."""
    return _entries(spark, sf_dir).select("text", F.round("distance", 4).alias("distance"))


@query(f"""with {_ENTRIES}, q as (select distinct {_LOW % 'text'} as text from dictionary where text <> ''), w as (select text, regexp_extract_all(text, '{_UNIT}') as a from q),
h as (select text, cast(n as int) as n_words, array_to_string(a[1:n], '') as entry from (select text, a, unnest(range(1, len(a) + 1)) as n from w))
select text, h.entry, n_words from h where h.entry in (select text from en)""")
def dict_prefix_lookup(spark, sf_dir):
    """The entries that begin each text of the dictionary, those too rare to be entries included."""
    asked = table(spark, sf_dir, "dictionary").select(text.ascii_lower(F.col("text")).alias("text")).where("text <> ''").distinct()
    entries = materialize(_entries(spark, sf_dir), "entries")
    return segment.prefix_lookup(text.units(F.col("text")), entries, asked).select("text", "entry", "n_words")


def _segments(keyed: str) -> str:
    """SQL of the cheapest segmentation of (k, t, fine) rows: costs unit by unit, each from the costs of the units before, then
    the way back from the end. Of equal costs the first start counts, so costs are compared as they add up in 32 bits.
    Texts in which no entry spans units and none costs more than a unit without leave no choice and need no way."""
    return f"""{_ENTRIES}, total as (select sum(freq) as total from en),
dist as materialized (select text, pos, cast(log2(total) as float) - cast(log2(freq) as float) as d from en, total),
longest as (select coalesce(max(len(regexp_extract_all(text, '{_UNIT}'))), 1) as longest from en),
keyed as ({keyed}),
un as materialized (select k, a, len(a) as u, fine from (select k, fine, regexp_extract_all({_LOW % 't'}, '{_UNIT}') as a from keyed) where len(a) > cast(fine as int)),
unit as (select k, a, u, fine, unnest(range(u)) as i from un),
sizes as materialized (select distinct len(regexp_extract_all(text, '{_UNIT}')) as n from en),
gram as (select k, u, i, n, array_to_string(a[i + 1:i + n], '') as text from unit, sizes where i + n <= u and not (fine and n = u)),
hit as materialized (select k, i as b, i + n as e, d, pos from gram join dist using (text)),
alone as (select unit.k, i as b, i + 1 as e, cast(32 as float) as d, 'x' as pos from unit left join hit on hit.k = unit.k and hit.b = i and hit.e = i + 1 where hit.k is null or strlen(a[i + 1]) > 1),
alone_ as (select distinct on (k, b) * from alone),
open_ as materialized (select distinct k from hit where e - b > 1 or d > 32),
step as materialized (select k, e, list(struct_pack(b := b, d := d, pos := pos) order by b, o) as c from (select *, 0 as o from hit union all select *, 1 from alone_) where k in (select k from open_) group by k, e),
way(k, e, costs, came, pos) as (
  select k, 0, [cast(0 as float)], cast(0 as bigint), '' from un where k in (select k from open_)
  union all
  select k, e + 1, (costs || [best.d])[-(select longest from longest) - 1:], best.b, best.pos from (
    select w.k, w.e, w.costs, list_reduce([struct_pack(b := x.b, d := w.costs[x.b - w.e - 1] + x.d, pos := x.pos) for x in s.c], lambda p, q: case when q.d < p.d then q else p end) as best
    from way w join step s on s.k = w.k and s.e = w.e + 1)),
back(k, e, b, pos) as (
  select way.k, way.e, came, pos from way join un on un.k = way.k and way.e = u
  union all
  select way.k, way.e, way.came, way.pos from back join way on way.k = back.k and way.e = back.b where back.b > 0),
seg as (select back.k, b, e, pos, array_to_string(a[b + 1:e], '') as text, coalesce(strlen(array_to_string(a[1:b], '')), 0) as start, e - b as n from back join un using (k)
  union all
  select u.k, u.i, u.i + 1, coalesce(h.pos, 'x'), u.a[u.i + 1], coalesce(sum(strlen(u.a[u.i + 1])) over (partition by u.k order by u.i rows between unbounded preceding and 1 preceding), 0), 1
  from unit u left join hit h on h.k = u.k and h.b = u.i and h.e = u.i + 1 where u.k not in (select k from open_))"""


@query(f"""with recursive {_CUR}, {_segments("select doc_id as k, content as t, true as fine from cur where content <> ''")}
select k as doc_id, cast(row_number() over (partition by k order by b) - 1 as int) as n, text, cast(start as int) as start, cast(start + strlen(text) as int) as "end", pos from seg""")
def segment_dict(spark, sf_dir):
    """Current contents segmented by the dictionary, which goes to every task if it is small enough and else meets them in a join."""
    entries = materialize(_entries(spark, sf_dir), "entries")
    found = segment.segment_by(_docs(spark, sf_dir), "doc_id", "content", entries)
    return found.select("doc_id", F.posexplode("segments").alias("n", "s")).select("doc_id", "n", "s.*")


def _cut_requests(spark, sf_dir, fine=True):
    entries = materialize(_entries(spark, sf_dir), "entries")
    asked = table(spark, sf_dir, "requests").select("text").where("text <> ''").distinct()
    lexicon = segment.small_lexicon(entries)
    cuts = segment.segment_by_join(asked, "text", "text", entries, fine) if lexicon is None else segment.segment(asked, "text", "text", lexicon, fine)
    return cuts, lexicon, entries


@query(f"""with recursive {_segments("select distinct 'r' || text as k, text as t, false as fine from requests where text <> '' union all select 'e' || text, text, true from en")},
node(k, path, text) as (
  select k, [b], text from seg where k[1] = 'r'
  union all
  select node.k, path || [seg.b], seg.text from node join seg on seg.k = 'e' || node.text and seg.n > 1)
select keyed.t as text, coalesce(tokens, '') as tokens from keyed left join (select k, string_agg(text, '|' order by path || [1000000000]) as tokens from node group by k) n on n.k = keyed.k where keyed.k[1] = 'r'""")
def subtoken_expand(spark, sf_dir):
    """The texts asked for, segmented, with the finer entries inside each."""
    cuts, lexicon, entries = _cut_requests(spark, sf_dir, False)
    parts = segment.expand_by_join(cuts, "text", "segments", entries) if lexicon is None else segment.expand(cuts, "segments", lexicon)
    return parts.select("text", F.array_join("tokens", "|").alias("tokens"))


@query(f"""with recursive {_segments("select distinct text as k, text as t, true as fine from requests where text <> ''")}
select keyed.k as text, coalesce(line, '') as line from keyed left join (select k, string_agg(text || '/' || pos || ' ', '' order by b) as line from seg group by k) s on s.k = keyed.k""")
def segments_to_string(spark, sf_dir):
    """The texts asked for, segmented, with parts of speech."""
    return _cut_requests(spark, sf_dir)[0].select("text", segment.segments_to_string(F.col("segments")).alias("line"))


@query(f"""with {_STOP}, rq as (select distinct on (request_id) request_id, text, tokens from requests),
a as (select request_id, text, tokens, regexp_extract_all({_LOW % "coalesce(text, '')"}, '{_UNIT}') as a from rq),
u as (select request_id, unnest(a) as tok, generate_subscripts(a, 1) as i from a where len(a) > 1),
k as (select request_id, string_agg(tok, '|' order by i) as q from u where tok not in (select tok from stop) group by request_id)
select a.request_id, case when coalesce(text, '') <> '' then coalesce(k.q, '') else coalesce(array_to_string(tokens, '|'), '') end as tokens from a left join k on k.request_id = a.request_id""")
def query_tokens(spark, sf_dir):
    """What each request asks for: its text without stop tokens, or where it is empty its tokens."""
    rows = table(spark, sf_dir, "requests").dropDuplicates(["request_id"])
    return rows.select("request_id", F.array_join(requests.asked_tokens(F.col("text"), F.col("tokens"), _stop(spark, sf_dir)), "|").alias("tokens"))


#: The published hash over the bytes of '%d' and an id, word by word, in 64-bit arithmetic.
_MURMUR = """k as (select doc_id, '%d' || doc_id as s from cur),
w as (select doc_id, length(s) as n, [ascii(x)::ubigint for x in string_split(s || chr(0) || chr(0) || chr(0), '')] as b from k),
x as (select doc_id, n, [(b[4 * i + 1] | (b[4 * i + 2] << 8) | (b[4 * i + 3] << 16) | (b[4 * i + 4] << 24))::ubigint for i in range((n + 3) // 4)] as v from w),
m as (select doc_id, n, [((((y * 3432918353 & 4294967295) << 15) | ((y * 3432918353 & 4294967295) >> 17)) & 4294967295) * 461845907 & 4294967295 for y in v] as v from x),
h as (select doc_id, n, list_reduce([1::ubigint] || [case when 4 * i <= n then y else y | (1::ubigint << 32) end for y, i in v],
  lambda a, y: case when y >> 32 = 1 then xor(a, y & 4294967295) else ((((xor(a, y) << 13) | (xor(a, y) >> 19)) & 4294967295) * 5 + 3864292196) & 4294967295 end) as a from m),
f1 as (select doc_id, xor(a, n::ubigint) as a from h), f2 as (select doc_id, xor(a, a >> 16) * 2246822507 & 4294967295 as a from f1),
f3 as (select doc_id, xor(a, a >> 13) * 3266489909 & 4294967295 as a from f2), f4 as (select doc_id, xor(a, a >> 16) as a from f3)"""


@query(f"with {_CUR}, {_MURMUR} select doc_id, cast(a % 8 as int) as storage_shard from f4")
def storage_shard_hash(spark, sf_dir):
    """The storage shard of every document."""
    return _docs(spark, sf_dir).select("doc_id", hashing.storage_shard(F.col("doc_id"), 8).alias("storage_shard"))


_CLEAN_REQUESTS = f"""rq as (select distinct on (request_id) * from requests),
ok as (select * from rq where doc_ids is null or len(doc_ids) = 0 or (len(doc_ids) = 2 and doc_ids[1] <= doc_ids[2])),
a as (select *, regexp_extract_all({_LOW % "coalesce(text, '')"}, '{_UNIT}') as a from ok),
q as (select request_id, unnest(a) as tok, 1 as is_tok from a where coalesce(text, '') <> '' and len(a) > 1
  union all select request_id, unnest(tokens), 1 from a where coalesce(text, '') = ''),
k as (select request_id, tok, is_tok from q where tok is not null and (tok not in (select tok from stop) or request_id in (select request_id from ok where coalesce(text, '') = ''))
  union all select request_id, tok, 0 from (select distinct request_id, unnest(labels) as tok from ok) where tok is not null),
kk as (select request_id, tok, sum(is_tok) as times from k group by request_id, tok),
need as (select request_id, count(*) as n from kk group by request_id)"""


@query(f"""with {_KEYWORDS}, ps as (select tok, doc_id, len(starts) as tf from post), st as (select doc_id, token_length as len_ from len_), df as (select tok, count(*) as df from ps group by tok), g as (select count(*) as n, avg(len_) as a from st), {_CLEAN_REQUESTS},
hit as (select kk.request_id, p.doc_id, count(*) as m, round(sum(case when p.tf > 0 and g.a <> 0 then kk.times * log2(g.n / df.df + 1) * p.tf * 3.0 / (p.tf + 2.0 * (0.25 + 0.75 * coalesce(st.len_, 0) / g.a)) else 0 end), 6) as bm25
  from kk join ps p on p.tok = kk.tok join df on df.tok = p.tok left join st on st.doc_id = p.doc_id cross join g group by kk.request_id, p.doc_id),
r as (select hit.request_id, hit.doc_id, hit.bm25, rq.output_offset as skip, rq.max_outputs as most,
  row_number() over (partition by hit.request_id order by case when coalesce(rq.reverse_order, false) then hit.bm25 else -hit.bm25 end, hit.doc_id desc) as rank
  from hit join need on need.request_id = hit.request_id and need.n = hit.m join rq on rq.request_id = hit.request_id
  where rq.doc_ids is null or len(rq.doc_ids) = 0 or hit.doc_id between rq.doc_ids[1] and rq.doc_ids[2])
select request_id, cast(rank as int) as rank, doc_id, cast(bm25 as double) as bm25 from r
where rank > greatest(coalesce(skip, 0), 0) and (coalesce(most, 0) <= 0 or rank <= greatest(coalesce(skip, 0), 0) + most)""")
def answer_requests(spark, sf_dir):
    """Every request of the log answered from an index of the current documents, with all hits where it sets no limit."""
    docs, stop = _docs(spark, sf_dir), _stop(spark, sf_dir)
    postings = materialize(index.build_postings(docs, stop, IndexType.FREQUENCIES, placed=True), "postings")
    return requests.answer_all(table(spark, sf_dir, "requests"), postings, materialize(index.doc_stats(docs), "stats"), stop, digits=6)
