"""The engine over a small collection worked by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from inkdex.model import EngineOptions, IndexType, RankOptions, Request
from inkdex.operators import index, lookup, proximity, ranking
from inkdex.plans import requests
from inkdex.plans.engine import Engine
from inkdex.plans.requests import answer_all
from inkdex.sources.store import ParquetStore
from inkdex.streaming.ingest import document_stream, start_ingest

SCHEMA = "doc_id bigint, content string, tokens array<struct<text:string,locations:array<int>>>, labels array<string>, fields struct<stars:int>"
DOCS = [
    (1, "red apple, green apple", None, ["fruit"], (5,)),
    (2, "green pear red pear apple", None, ["fruit"], None),
    (3, "red car green light", None, ["vehicle"], (3,)),
    (4, "apple", None, ["fruit"], (1,)),
    (5, "red apple apple apple pie", None, ["apple", "food"], (4,)),
    (6, None, [("apple", [9]), ("apple", [0, 30]), ("red", [10])], ["fruit", None], (2,)),
]
STOP = (" ", ",")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).cache()


def engine(spark, docs, **options):
    e = Engine(spark, EngineOptions(stop_tokens=STOP, **options))
    e.index(docs)
    return e


@pytest.fixture(scope="module")
def counted(spark, docs):
    return engine(spark, docs)


@pytest.fixture(scope="module")
def located(spark, docs):
    return engine(spark, docs, index_type=IndexType.LOCATIONS)


def found(e, **request):
    return [(r.doc_id, round(r.scores[0], 5)) for r in e.find(Request(**request)).docs.collect()]


def test_statistics(counted):
    postings, stats = counted.tables()
    row = index.corpus_stats(stats).first()
    # document 6 has three tokens given, one of them twice: all count
    assert (row.n_docs, row.total_length) == (6, 8 + 9 + 7 + 0 + 9 + 3)
    assert {r.tok: r.df for r in index.document_frequency(postings).collect() if r.tok in ("red", "apple", "green", "fruit")} == {"red": 5, "apple": 4, "green": 3, "fruit": 4}
    assert counted.counters()["num_documents_indexed"] == 6


def test_lookup_and_order(counted):
    assert [d for d, _ in found(counted, text="red apple")] == [6, 1, 2, 5]
    assert [d for d, _ in found(counted, text="Red APPLE", labels=["fruit"])] == [6, 1, 2]
    assert [d for d, _ in found(counted, text="green apple")] == [1, 2]
    assert found(counted, text="apple") == [] == found(counted, text="red zebra") == found(counted)
    assert found(counted, labels=["fruit"]) == [(6, 0), (4, 0), (2, 0), (1, 0)]
    assert [d for d, _ in found(counted, text="red apple", doc_ids=[1, 2])] == [1, 2]
    assert found(counted, tokens=["apple", " "]) == []  # stop tokens in tokens aren't taken out
    once, twice = dict(found(counted, tokens=["red"])), dict(found(counted, tokens=["red", "red"]))
    assert all(abs(2 * v - twice[k]) < 1e-4 for k, v in once.items())
    with pytest.raises(ValueError):
        found(counted, text="red apple", doc_ids=[3, 1])


def test_bm25_by_hand(counted):
    postings, stats = counted.tables()
    n, avg = 6, 36 / 6

    def term(tf, df, length):
        return np.log2(n / df + 1) * tf * 3 / (tf + 2 * (0.25 + 0.75 * length / avg))

    score = dict(found(counted, text="red apple"))
    assert abs(score[1] - term(1, 5, 8) - term(2, 4, 8)) < 1e-5
    assert abs(score[6] - term(1, 5, 3) - term(2, 4, 3)) < 1e-5
    assert abs(score[5] - term(1, 5, 9)) < 1e-5  # the label took the frequency of 'apple'


def test_rank_options(counted):
    best = [d for d, _ in found(counted, text="red apple")]
    ask = lambda **o: [d for d, _ in found(counted, text="red apple", rank_options=RankOptions(**o))]
    assert ask(max_outputs=2) == best[:2] and ask(output_offset=1, max_outputs=2) == best[1:3]
    assert ask(output_offset=9) == [] and ask(reverse_order=True) == best[::-1]
    stars = lambda d: F.when(d["fields.stars"] > 2, F.array(d["fields.stars"].cast("double"))).otherwise(F.array().cast("array<double>"))
    assert ask(scorer=stars) == [1, 5]


def test_score_arrays_compare_like_words(spark):
    rows = spark.createDataFrame([(1, [1.0]), (2, [1.0, 0.0]), (3, [2.0]), (4, [1.0]), (5, [])], "doc_id bigint, s array<double>")
    scored = ranking.score(rows, None, lambda d: d["s"])
    assert [r.doc_id for r in ranking.rank(scored).collect()] == [3, 2, 4, 1]
    assert {r.doc_id: r.rank for r in ranking.rank_within(scored.withColumn("g", F.col("doc_id") % 2), ["g"], RankOptions(max_outputs=1)).collect()} == {3: 1, 2: 1}


def test_locations(located):
    rows = {r.doc_id: r for r in located.find(Request(text="red apple")).docs.collect()}
    assert {d: r.token_proximity for d, r in rows.items()} == {1: 1, 2: 6, 6: 13, 5: None}
    assert {d: r.token_snippet_locations for d, r in rows.items()} == {1: [0, 4], 2: [11, 20], 6: [10, 0], 5: None}
    assert rows[1].token_locations == [[0], [4, 17]] and rows[5].bm25 == 0
    twice = {r.doc_id: r for r in located.find(Request(text="red red")).docs.collect()}
    assert twice[1].token_proximity == 3 and twice[1].token_snippet_locations == [0, 0]
    assert located.find(Request(labels=["fruit"])).docs.where("token_proximity is not null").count() == 0


def test_truncation_and_document_index(spark, docs):
    e = engine(spark, docs, index_type=IndexType.LOCATIONS, compat_truncate=True)
    assert [d for d, _ in found(e, text="red apple")] == [6, 5]
    assert [d for d, _ in found(e, text="green apple")] == [1, 2]
    ids = engine(spark, docs, index_type=IndexType.DOC_IDS)
    assert found(ids, text="red apple") == [(6, 0), (5, 0), (2, 0), (1, 0)]


def test_shards(spark, docs, counted):
    postings, stats = counted.tables()
    one = lookup.lookup(postings, stats, ["red", "apple"]).select("doc_id", F.round("bm25", 9)).collect()
    same = lookup.lookup(postings, stats, ["red", "apple"], shard=F.lit(0)).select("doc_id", F.round("bm25", 9)).collect()
    assert sorted(one) == sorted(same)
    assert {d for d, _ in found(engine(spark, docs, num_shards=3), text="red apple")} == {1, 2, 5, 6}


def test_reindex(spark, docs):
    fresh = spark.createDataFrame([(3, "blue bus stops", None, None, None)], SCHEMA)
    for mode, want in (("replace", []), ("merge", [3])):
        e = engine(spark, docs, upsert_mode=mode)
        e.index(fresh)
        assert [d for d, _ in found(e, text="red car")] == want
        assert [d for d, _ in found(e, text="blue bus")] == [3] and e.counters()["num_documents_indexed"] == 6
        before = sorted(found(e, text="red apple"))
        e.compact()
        assert sorted(found(e, text="red apple")) == before


def test_remove(spark, docs):
    e = engine(spark, docs)
    e.remove_document(docs.where("doc_id = 1"))
    rows = {r.doc_id: r.fields for r in e.find(Request(text="red apple")).docs.collect()}
    assert rows[1] is None and rows[5].stars == 4
    e.delete_document(docs.where("doc_id = 1"))
    assert 1 not in dict(found(e, text="red apple"))


def test_timeout(counted):
    fine = counted.find(Request(text="red apple", timeout_ms=60_000))
    assert not fine.timeout and [r.doc_id for r in ranking.rank(fine.docs).collect()] == [6, 1, 2, 5]
    late = counted.find(Request(text="red apple", timeout_ms=1))
    assert late.timeout and late.docs.count() == 0
    assert len(found(counted, text="red apple")) == 4  # nothing is left cancelled


def test_stream_equals_batch(spark, docs, counted, tmp_path):
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    with Engine(spark, EngineOptions(stop_tokens=STOP)) as e:
        start_ingest(e, document_stream(spark, str(tmp_path / "in"), docs.schema, 1), str(tmp_path / "progress"))
        e.flush()
        assert sorted(found(e, text="red apple")) == sorted(found(counted, text="red apple"))
        assert e.counters() == counted.counters()


def test_store(spark, docs, tmp_path):
    schema = StructType([StructField("doc_id", LongType()), StructField("content", StringType()), StructField("n", IntegerType())])
    df = lambda *rows: spark.createDataFrame(rows, schema)
    for mode, want in (("upsert", [(2, "b", 1)]), ("append", [(1, "a", 1), (2, "b", 1)])):
        s = ParquetStore(spark, str(tmp_path / mode), schema, 4, mode)
        assert s.recover().count() == 0 and s.storage_shards() == 4
        s.set(df((1, "a", 1), (2, "b", 1)))
        s.set(df((1, "c", 2)))
        s.delete(df((1, None, None), (7, None, None)))
        assert sorted(map(tuple, s.recover().collect())) == want
        assert sorted(map(tuple, s.compact(str(tmp_path / f"{mode}2")).recover().collect())) == want
        with pytest.raises(Exception, match="needs a doc_id"):
            s.set(df((None, "x", 1)))
    store = ParquetStore(spark, str(tmp_path / "docs"), docs.schema)
    with engine(spark, docs, storage=None) as plain:
        store.set(docs)
        with Engine(spark, EngineOptions(stop_tokens=STOP, storage=store)) as e:
            assert sorted(found(e, text="red apple")) == sorted(found(plain, text="red apple"))


def test_jdbc_store(spark):
    from inkdex.sources.store import JdbcStore

    schema = StructType([StructField("doc_id", LongType()), StructField("content", StringType())])
    s = JdbcStore(spark, "jdbc:derby:memory:inkdex;create=true", "docs", schema)
    s.create()
    s.create()
    assert s.recover().count() == 0
    s.set(spark.createDataFrame([(1, "a"), (2, None)], schema))
    stored = lambda: sorted(map(tuple, s.recover().collect()))
    assert stored() == [(1, "a"), (2, None)] and s.recover().columns == ["doc_id", "content"]
    s.set(spark.createDataFrame([(1, "b"), (3, "c"), (3, "c")], schema))
    s.delete(spark.createDataFrame([(2,), (9,), (None,)], "doc_id bigint"))
    assert stored() == [(1, "b"), (3, "c")]
    s.set(spark.createDataFrame([(2, "back")], schema))
    assert stored() == [(1, "b"), (2, "back"), (3, "c")]
    with pytest.raises(Exception, match="needs a doc_id"):
        s.set(spark.createDataFrame([(None, "x")], schema))


def test_mongo_store_deletes(spark, tmp_path):
    """Against a stand-in for the connector: upserts by doc_id in a folder, read through the pipeline of the options."""
    import json
    import time
    import uuid
    from pathlib import Path

    from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, WriterCommitMessage

    from inkdex.sources.store import MongoStore

    class Reader(DataSourceReader):
        def __init__(self, rows):
            self.rows = rows

        def read(self, partition):
            yield from self.rows

    class Writer(DataSourceWriter):
        def __init__(self, options):
            assert (options["operationType"], options["idFieldList"]) == ("replace", "doc_id")
            self.folder = options["connection.uri"]

        def write(self, rows):
            lines = [json.dumps(r.asDict()) for r in rows]
            Path(self.folder, f"{time.time_ns()}-{uuid.uuid4().hex}").write_text("\n".join(lines))
            return WriterCommitMessage()

    class StandIn(DataSource):
        @classmethod
        def name(cls):
            return "mongodb"

        def kept(self):
            by = {}
            for p in sorted(Path(self.options["connection.uri"]).iterdir()):
                by |= {x["doc_id"]: x for x in map(json.loads, p.read_text().splitlines())}
            match = json.loads(self.options.get("aggregation.pipeline", "{}")).get("$match", {})
            return [x for x in by.values() if all(x.get(k) != v["$ne"] for k, v in match.items())]

        def schema(self):
            return "doc_id bigint, content string" + ", _deleted boolean" * any("_deleted" in x for x in self.kept())

        def reader(self, schema):
            return Reader([tuple(x.get(f.name) for f in schema) for x in self.kept()])

        def writer(self, schema, overwrite):
            return Writer(self.options)

    spark.dataSource.register(StandIn)
    store = MongoStore(spark, str(tmp_path), "inkdex", "docs")
    stored = lambda: sorted(map(tuple, store.recover().collect()))
    store.set(spark.createDataFrame([(1, "red apple"), (2, "green pear"), (3, "red pear")], "doc_id bigint, content string"))
    with Engine(spark, EngineOptions(storage=store)) as e:
        e.remove_document(spark.createDataFrame([(1,), (2,), (2,), (9,), (None,)], "doc_id bigint"))
    assert stored() == [(3, "red pear")] and store.recover().columns == ["doc_id", "content"]
    store.set(spark.createDataFrame([(2, "blue pear")], "doc_id bigint, content string"))
    assert stored() == [(2, "blue pear"), (3, "red pear")]


def test_postings_on_disk(spark, counted, tmp_path):
    postings, stats = counted.tables()
    index.write_postings(postings, str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p"))
    assert sorted(back.collect()) == sorted(postings.collect())
    plan = lookup.matching(back, ["red", "apple"], (1, 2))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "In(tok" in plan and "GreaterThanOrEqual(doc_id" in plan
    assert {r.doc_id for r in lookup.matching(back, ["red", "apple"], (1, 2)).collect()} == {1, 2}


def test_proximity_properties():
    rng = np.random.default_rng(5)
    for _ in range(300):  # tokens don't overlap, so that the nearest places give the true minimum
        spots = rng.permutation(20) * 4
        places = [sorted(spots[:4].tolist()), sorted(spots[4:9].tolist()), sorted(spots[9:11].tolist())]
        near, chosen = proximity.best_places(places, [3, 4, 2])
        every = min(abs(b - a - 3) + abs(c - b - 4) for a in places[0] for b in places[1] for c in places[2])
        assert near == every == abs(chosen[1] - chosen[0] - 3) + abs(chosen[2] - chosen[1] - 4)
    for _ in range(300):  # repeated tokens: the best of the paths that only step to the places around
        own = sorted(rng.choice(50, rng.integers(1, 6), replace=False).tolist())
        places = [own, sorted(rng.choice(50, rng.integers(1, 6), replace=False).tolist()), own]

        def steps(k, at):
            nxt = places[k + 1]
            low = max([j for j, b in enumerate(nxt) if b < at], default=0)
            return [j for j in (low, low + 1) if j < len(nxt)]

        def paths(k, i):
            return [[i]] if k == 2 else [[i, *p] for j in steps(k, places[k][i]) for p in paths(k + 1, j)]

        cost = lambda p: sum(abs(places[k + 1][p[k + 1]] - places[k][p[k]] - 3) for k in range(2))
        near, chosen = proximity.best_places(places, [3, 3, 3])
        assert near == min(cost(p) for i in range(len(own)) for p in paths(0, i)) == sum(abs(b - a - 3) for a, b in zip(chosen, chosen[1:]))
    assert proximity.best_places([[1], []], [1, 1]) == (-1, []) and proximity.best_places([[7, 9]], [2]) == (0, [7])


def test_odd_documents(spark):
    """Nulls everywhere, repeats, clashing columns, a long text, an empty table."""
    rows = [(1, None, None, None, None, "x"), (2, "", [(None, None), ("a", None)], [None, "l", "l"], None, "x"), (3, "a b " * 20_000, None, [], None, "x"), (3, "a b " * 20_000, None, [], None, "x")]
    df = spark.createDataFrame(rows, SCHEMA + ", tok string")
    with Engine(spark) as e:
        e.index(df)
        postings, stats = e.tables()
        assert {(r.tok, r.doc_id, r.tf) for r in postings.collect()} == {("a", 2, 0), ("l", 2, 0), ("a", 3, 20_000), ("b", 3, 20_000), (" ", 3, 40_000)}
        assert {r.doc_id: r.token_length for r in stats.collect()} == {1: 0, 2: 2, 3: 80_000}
    with Engine(spark) as e:
        e.index(df.limit(0))
        assert e.find(Request(tokens=["a"])).docs.count() == 0 and index.corpus_stats(e.tables()[1]).first().n_docs == 0


def test_dictionary(spark):
    from inkdex.operators import segment as seg

    raw = spark.createDataFrame([("中国", 80), ("人口", 30), ("有", 90), ("人口多", 9)], "text string, freq int")
    entries = seg.load_entries(raw.withColumn("pos", F.lit("n")), "text", "freq", "pos", "text").cache()
    rows = spark.createDataFrame([(1, "中国有十三亿人口"), (2, "中国人口多"), (3, "中国"), (4, None), (5, "国中有人")], "doc_id bigint, content string")
    for dictionary in (seg.Lexicon.collect(entries), entries):
        with Engine(spark, EngineOptions(dictionary=dictionary, index_type=IndexType.LOCATIONS)) as e:
            e.index(rows)
            postings, stats = e.tables()
            assert {(r.tok, tuple(r.starts)) for r in postings.where("doc_id = 1").collect()} == {("中国", (0,)), ("有", (6,)), ("十", (9,)), ("三", (12,)), ("亿", (15,)), ("人口", (18,))}
            assert {r.doc_id: r.token_length for r in stats.collect()} == {1: 6, 2: 2, 3: 2, 4: 0, 5: 4}
            assert e.find(Request(text="中国人口")).tokens == ["中国", "人口"]
            assert [d for d, _ in found(e, text="中国人口")] == [1] and [d for d, _ in found(e, tokens=["人口多"])] == [2]


def test_requests_in_bulk(spark, counted):
    schema = "request_id bigint, text string, tokens array<string>, labels array<string>, doc_ids array<bigint>, reverse_order boolean, output_offset int, max_outputs int"
    asked = [(1, "red apple", None, None, None, False, 0, 2), (1, "red apple", None, None, None, False, 0, 2), (2, None, ["red"], ["fruit"], [1, 2], True, 0, 0), (3, "apple", None, None, None, None, None, None), (4, "red apple", None, None, [2, 1], False, 0, 5), (5, None, None, None, None, None, None, None), (6, "red zebra", None, [None], [], False, 0, 5), (7, "Red  apple", [], [], None, False, 1, 2)]
    postings, stats = counted.tables()
    got = answer_all(spark.createDataFrame(asked, schema), postings, stats, list(STOP)).collect()
    rows = {}
    for r in sorted(got, key=lambda r: (r.request_id, r.rank)):
        rows.setdefault(r.request_id, []).append(r.doc_id)
    assert rows == {1: [6, 1], 2: [2, 1], 7: [1, 2]}
    assert answer_all(spark.createDataFrame([], schema), postings, stats, []).count() == 0


def test_requests_without_a_limit(spark):
    docs = spark.range(25).selectExpr("id as doc_id", "repeat('word ', int(id % 7) + 1) as content", "array('all') as labels")
    schema = "request_id bigint, text string, tokens array<string>, labels array<string>, doc_ids array<bigint>, reverse_order boolean, output_offset int, max_outputs int"
    asked = [(1, None, ["word"], ["all"], None, False, 0, 0), (2, None, ["word"], None, None, True, 3, None), (3, None, ["word"], None, None, False, 2, 4), (4, None, ["word"], None, [5, 20], None, None, 0)]
    with Engine(spark, EngineOptions(stop_tokens=STOP)) as e:
        e.index(docs)
        rows = {}
        for r in sorted(answer_all(spark.createDataFrame(asked, schema), *e.tables(), list(STOP)).collect(), key=lambda r: (r.request_id, r.rank)):
            rows.setdefault(r.request_id, []).append((r.rank, r.doc_id))
        one = [d for d, _ in found(e, tokens=["word"], labels=["all"])]
    assert len(one) == 25 and rows[1] == list(enumerate(one, 1))
    assert {k: [n for n, _ in x] for k, x in rows.items()} == {1: [*range(1, 26)], 2: [*range(4, 26)], 3: [3, 4, 5, 6], 4: [*range(1, 17)]}


def test_an_empty_engine_finds_nothing(spark):
    for kind in IndexType:
        with Engine(spark, EngineOptions(index_type=kind)) as e:
            assert e.find(Request(tokens=["a"], labels=["b"])).docs.count() == 0 and e.counters() == {"num_token_index_added": 0, "num_documents_indexed": 0}


def test_restart(spark, docs, counted, tmp_path):
    """A second engine on the same folder finds everything, with its fields, without indexing it again."""
    options = EngineOptions(stop_tokens=STOP, index_path=str(tmp_path / "index"), most_generations=2)
    with Engine(spark, options) as e:
        for k in range(1, 7):
            e.index(docs.where(f"doc_id = {k}"))
        assert len(e.generations.manifest.generations) <= 3 and e.generations.manifest.disjoint
    want = sorted(found(counted, text="red apple"))
    with Engine(spark, options) as e:
        assert sorted(found(e, text="red apple")) == want and e.counters() == counted.counters()
        assert {r.doc_id: r.fields and r.fields.stars for r in e.find(Request(text="red apple")).docs.collect()} == {1: 5, 2: None, 5: 4, 6: 2}
        assert e.generations.corpus() is not None
        e.index(docs.where("doc_id = 2"))  # the same again: it doesn't count twice
        assert e.counters() == counted.counters()
        assert sorted(found(e, text="red apple")) == want
        e.remove_document(docs.where("doc_id = 5"))
    with Engine(spark, options) as e:
        e.compact()
        assert len(e.generations.manifest.generations) == 1 and sorted(found(e, text="red apple")) == want
        assert {r.doc_id: r.fields and r.fields.stars for r in e.find(Request(text="red apple")).docs.collect()} == {1: 5, 2: None, 5: None, 6: 2}
    late = Engine(spark, options)
    with Engine(spark, options) as e:
        e.index(docs.where("doc_id = 1"))
    with pytest.raises(Exception, match="exist"):  # of two writers that start from the same manifest one fails
        late.index(docs.where("doc_id = 2"))


def test_stream_restart(spark, docs, counted, tmp_path):
    options = EngineOptions(stop_tokens=STOP, index_path=str(tmp_path / "index"))
    for part in ("doc_id < 4", "doc_id >= 4"):
        docs.where(part).write.mode("append").parquet(str(tmp_path / "in"))
        with Engine(spark, options) as e:
            start_ingest(e, document_stream(spark, str(tmp_path / "in"), docs.schema, 1), str(tmp_path / "progress"))
            e.flush()
            n = e.counters()["num_documents_indexed"]
    assert n == 6
    with Engine(spark, options) as e:
        assert sorted(found(e, text="red apple")) == sorted(found(counted, text="red apple"))
        name, number = next(iter(e.generations.manifest.streams.items()))
        e.index(docs, stream=(name, number))  # a batch that was committed before
        assert len(e.generations.manifest.indexed) == len(Engine(spark, options).generations.manifest.indexed)
    with Engine(spark, EngineOptions(stop_tokens=STOP)) as e, pytest.raises(ValueError, match="checkpoint"):
        start_ingest(e, document_stream(spark, str(tmp_path / "in"), docs.schema, 1), str(tmp_path / "progress"))


def test_own_parts(spark, docs):
    """A segmenter, an indexer and a ranker of one's own."""
    from inkdex.plans.parts import FieldRanker, PostingIndexer

    class Blanks:
        def tokens(self, text):
            return text.split(" ")

        def column(self, text, spark):
            return F.split(text, " ")

    class Fresh(PostingIndexer):
        def postings(self, documents):
            return super().postings(documents.where("doc_id <> 5"))

    class Oldest(FieldRanker):
        def rank(self, hits, fields, options):
            return hits.orderBy("doc_id").withColumn("scores", F.array(F.col("doc_id").cast("double")))

    with Engine(spark, EngineOptions(dictionary=Blanks(), indexer=Fresh, ranker=Oldest)) as e:
        e.index(docs)
        got = e.find(Request(text="red apple"))
        assert got.tokens == ["red", "apple"] and [r.doc_id for r in got.docs.collect()] == [1, 2, 6]
        assert [r.doc_id for r in e.find(Request(tokens=["red", "apple,"])).docs.collect()] == [1]


def test_many_stop_tokens(spark, docs):
    many = [f"stop{i}" for i in range(2_000)] + ["red", " "]
    few = {(r.tok, r.doc_id) for r in index.build_postings(docs, ["red", " "], IndexType.DOC_IDS).collect()}
    for stop in (many, spark.createDataFrame([(t,) for t in many], "tok string")):
        assert {(r.tok, r.doc_id) for r in index.build_postings(docs, stop, IndexType.DOC_IDS).collect()} == few
    asked = [(1, "Red apple pie", None), (2, None, ["red"]), (3, "red ", None), (4, "", None)]
    rows = spark.createDataFrame(asked, "request_id bigint, text string, tokens array<string>")
    for stop in (["red", " "], many, spark.createDataFrame([(t,) for t in many], "tok string")):
        assert {r.request_id: r.q for r in requests.with_tokens(rows, stop).collect()} == {1: ["apple", "pie"], 2: ["red"], 3: [], 4: []}


def test_lengths_need_no_shuffle(spark, docs):
    plan = index.doc_stats(docs)._jdf.queryExecution().sparkPlan().toString()
    assert "Generate" not in plan and "Window" not in plan and "Exchange" not in plan
    plan = index.build_postings(docs, [], IndexType.FREQUENCIES)._jdf.queryExecution().sparkPlan().toString()
    assert "Window" not in plan


def test_ranking_in_bulk(spark):
    """Whole and bounded rankings over skewed groups against a plain sort."""
    rows = [(g, (i * 37 % 100) / 7, i) for g, n in ((1, 3000), (2, 5), (3, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "g int, s double, doc_id bigint")
    order = [F.col("s").desc(), F.col("doc_id").desc()]
    want = {g: [d for _, _, d in sorted((x for x in rows if x[0] == g), key=lambda x: (-x[1], -x[2]))] for g in (1, 2, 3)}
    for got, most in ((requests.rank_all(df, "g", order), None), (requests.rank_some(df, "g", order, "doc_id", 7), 7)):
        by = {}
        for r in sorted(got.collect(), key=lambda r: r.rank):
            by.setdefault(r.g, []).append((r.rank, r.doc_id))
        assert by == {g: list(enumerate(x[:most], 1)) for g, x in want.items()}
    plan = requests.rank_some(df, "g", order, "doc_id", 7)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_bulk_options(spark, docs):
    """Dictionary, scorer, fields and shards for a whole log, against the engine's single requests."""
    from inkdex.operators import segment as seg

    schema = "request_id bigint, text string, tokens array<string>, labels array<string>, doc_ids array<bigint>, reverse_order boolean, output_offset int, max_outputs int"
    log = spark.createDataFrame([(1, "red apple", None, None, None, False, 0, 0), (2, None, ["apple"], ["fruit"], None, True, 0, 2)], schema)
    lexicon = seg.Lexicon({"red apple": (1.0, "n"), "pie": (2.0, "n")})
    stars = lambda d: F.when(d["fields.stars"].isNotNull(), F.array(d["fields.stars"].cast("double")))
    with Engine(spark, EngineOptions(stop_tokens=STOP, dictionary=lexicon)) as e:
        e.index(docs)
        got = requests.answer_all(log, *e.tables(), list(STOP), segmenter=lexicon, fields=e.generations.fields(), scorer=stars)
        rows = {}
        for r in sorted(got.collect(), key=lambda r: (r.request_id, r.rank)):
            rows.setdefault(r.request_id, []).append((r.doc_id, r.scores[0]))
        options = (RankOptions(scorer=stars), RankOptions(scorer=stars, reverse_order=True, max_outputs=2))
        for k, ask in enumerate((Request(text="red apple", rank_options=options[0]), Request(tokens=["apple"], labels=["fruit"], rank_options=options[1])), 1):
            assert rows.get(k, []) == [(r.doc_id, r.scores[0]) for r in e.find(ask).docs.collect()]
    with Engine(spark, EngineOptions(stop_tokens=STOP, num_shards=3)) as e:
        e.index(docs)
        postings, stats = e.tables()
        shards = {r.doc_id: r.shard for r in stats.collect()}
        shard = F.create_map(*[F.lit(x) for kv in shards.items() for x in kv])[F.col("doc_id")]
        got = {(r.request_id, r.doc_id): r.bm25 for r in requests.answer_all(log, postings, stats, list(STOP), shard=shard).collect()}
        for d, s in found(e, text="red apple"):
            assert got[1, d] == pytest.approx(s, abs=1e-5)
