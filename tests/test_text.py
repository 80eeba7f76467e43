"""Units, hashes, segmentation: values worked by hand, and properties."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkdex.functions import hashing, text
from inkdex.operators import segment as seg
from inkdex.sources import dictionary

LINES = "中华 50 nz\n人民 60 n\n共和 10 nz\n共和国 40 ns\n人民共和国 8 nt\n中华人民共和国 20 ns\n中国 80 ns\n人口 30 n\n有 90 v\n稀 1 a\n中国 5 dup\nbad\nmany words 3 n\nx y z w\nhalf 3.5 n\n\n未读 9 n\n"


@pytest.fixture(scope="module")
def entries(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("dict") / "d.txt"
    path.write_text(LINES)
    return dictionary.read_dictionary(spark, str(path)).cache()


def test_units(spark):
    df = spark.createDataFrame([("Hello, WORLD 42中国Été",), ("",), (None,), ("áb",), ("👩‍💻x",)], "t string")
    got = [r[0] for r in df.select(text.units(F.col("t"))).collect()]
    assert got[0] == ["hello", ",", " ", "world", " ", "42", "中", "国", "Été"]
    assert got[1] == [] and got[2] is None and got[3] == ["a", "́", "b"] and got[4] == ["👩", "‍", "💻", "x"]
    one = [r[0] for r in df.select(text.asked_units(F.lit("hello"))).limit(1).collect()]
    assert one == [[]]


def test_token_text(spark):
    assert spark.range(1).select(text.token_text(text.units(F.lit("Ab 中")))).first()[0] == "ab 中"


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_units_join_to_the_lowered_text(t):
    assert "".join(seg.unit_list(t)) == t.translate(str.maketrans(text.UPPER, text.LOWER))


def test_units_in_python_and_jvm_agree(spark, data):
    rows = spark.read.parquet(f"{data}/docs.parquet").select("content", text.units(F.col("content")).alias("u")).where("content is not null").collect()
    assert all(seg.unit_list(r.content) == r.u for r in rows)


def test_murmur3():
    assert hashing.murmur3_batch([b"hello", b"", b"%d17"]).tolist() == [3142237357, 1364076727, 2377053663]
    assert hashing.murmur3_batch([]).tolist() == []
    many = [bytes(range(n % 256)) * (1 + n // 256) for n in range(600)]
    assert hashing.murmur3_batch(many).tolist() == [int(hashing.murmur3_batch([k])[0]) for k in many]


def test_murmur3_column(spark):
    got = spark.createDataFrame([("hello",), (None,), ("",)], "t string").select(hashing.murmur3(F.col("t"))).collect()
    assert [r[0] for r in got] == [3142237357, None, 1364076727]


def test_dictionary_file(entries):
    rows = {r.text: r for r in entries.collect()}
    assert len(rows) == 9 and rows["中国"].pos == "ns"  # the first wins, a blank line ends the file
    t = seg.dictionary_totals(entries).first()
    assert (t.num_tokens, t.total_frequency, t.max_token_length) == (9, 388, 7)
    want = {"中华": 2.956057, "人民": 2.693022, "共和": 5.277985, "人民共和国": 5.599913, "有": 2.108059}
    assert all(abs(rows[k].distance - v) < 1e-6 for k, v in want.items())


@pytest.mark.parametrize(
    "line, fine, want, parts",
    [
        ("中华人民共和国", False, [("中华人民共和国", 0, 21, "ns")], "中华 人民 共和 共和国 人民共和国 中华人民共和国"),
        ("中华人民共和国", True, [("中华", 0, 6, "nz"), ("人民共和国", 6, 21, "nt")], "中华 人民 共和 共和国 人民共和国"),
        ("中国有十三亿人口", True, [("中国", 0, 6, "ns"), ("有", 6, 9, "v"), ("十", 9, 12, "x"), ("三", 12, 15, "x"), ("亿", 15, 18, "x"), ("人口", 18, 24, "n")], "中国 有 十 三 亿 人口"),
        ("中国", True, [("中", 0, 3, "x"), ("国", 3, 6, "x")], "中 国"),
        ("hello", False, [("hello", 0, 5, "x")], "hello"),
        ("hello", True, [], ""),
        ("", True, [], ""),
        ("hello world", True, [("hello", 0, 5, "x"), (" ", 5, 6, "x"), ("world", 6, 11, "x")], None),
    ],
)
def test_segments(entries, line, fine, want, parts):
    lex = seg.Lexicon.collect(entries)
    got = lex.cut(line, fine)
    assert got == want
    if parts is not None:
        assert " ".join(p for t, *_ in got for p in (lex.parts(t) if t in lex.entries else [t])) == parts


def test_segment_paths_agree(spark, entries):
    df = spark.createDataFrame([(1, "中华人民共和国有人口 Hello"), (2, None), (3, ""), (4, "中国"), (5, "中国有 人口" * 50)], "id bigint, content string")
    lex = seg.Lexicon.collect(entries)
    for fine in (True, False):
        a = {r.id: r.segments for r in seg.segment(df, "id", "content", lex, fine).collect()}
        b = {r.id: r.segments for r in seg.segment_by_join(df, "id", "content", entries, fine).collect()}
        assert a == b and a[2] == [] and a[3] == []
    c = {r.id: r.segments for r in seg.segment_by(df, "id", "content", entries, most=1).collect()}
    assert c == {r.id: r.segments for r in seg.segment_by(df, "id", "content", entries).collect()}
    with pytest.raises(ValueError):
        seg.Lexicon.collect(entries, 3)


def test_lone_entry_has_distance_zero_and_counts_as_unset():
    lex = seg.Lexicon({"中": (0.0, "n")})
    assert lex.cut("中国", True) == [("中", 0, 3, "x"), ("国", 3, 6, "x")]


def test_cheapest_is_optimal():
    rng = np.random.default_rng(1)
    letters = "甲乙丙"
    for _ in range(60):
        lex = seg.Lexicon({"".join(rng.choice(list(letters), rng.integers(1, 4))): (float(np.float32(rng.uniform(1, 9))), "n") for _ in range(6)})
        t = "".join(rng.choice(list(letters), 7))

        def best(s):
            if not s:
                return 0.0
            return min([lex.entries[s[:k]][0] + best(s[k:]) for k in range(1, len(s) + 1) if s[:k] in lex.entries] + [32 + best(s[1:])])

        cost = sum(lex.entries[x][0] if p == "n" else 32 for x, _, _, p in lex.cut(t, False))
        assert abs(cost - best(t)) < 1e-3


def test_format_and_expand(spark, entries):
    lex = seg.Lexicon.collect(entries)
    df = seg.segment(spark.createDataFrame([(1, "中华人民共和国")], "id int, t string"), "id", "t", lex)
    assert df.select(seg.segments_to_string(F.col("segments"))).first()[0] == "中华/nz 人民共和国/nt "
    assert seg.expand(df, "segments", lex).first().tokens == ["中华", "人民", "共和", "共和国", "人民共和国"]


def test_expand_paths_agree(spark, entries):
    df = spark.createDataFrame([(1, "中华人民共和国有人口 Hello"), (2, None), (3, ""), (4, "中华人民共和国"), (5, "中国有 人民共和国" * 20)], "id bigint, content string")
    cuts = seg.segment(df, "id", "content", seg.Lexicon.collect(entries), False).withColumn("segments", F.when(F.col("id") != 2, F.col("segments")))
    odd = cuts.where("id = 1").select(F.lit(6).cast("bigint").alias("id"), F.transform("segments", lambda s: s.withField("text", F.lit("中国人民"))).alias("segments"))
    cuts = cuts.unionByName(odd)  # a text that is no entry, as another dictionary might give
    a = {r.id: r.tokens for r in seg.expand(cuts, "segments", seg.Lexicon.collect(entries)).collect()}
    b = {r.id: r.tokens for r in seg.expand_by_join(cuts, "id", "segments", entries).collect()}
    assert a == b and b[2] is None and b[3] == [] and b[4] == ["中华", "人民", "共和", "共和国", "人民共和国", "中华人民共和国"]


@pytest.mark.parametrize("name", ["subtoken_expand", "segments_to_string"])
def test_queries_with_a_large_dictionary(spark, data, monkeypatch, name):
    from inkdex import queries

    want = sorted(map(tuple, queries.QUERIES[name](spark, data).collect()))
    for f in (seg.Lexicon.collect.__func__, getattr(seg, "small_lexicon", None)):
        if f:
            monkeypatch.setattr(f, "__defaults__", (*f.__defaults__[:-1], 3))
    assert sorted(map(tuple, queries.QUERIES[name](spark, data).collect())) == want and want


def test_stop_tokens(spark, tmp_path):
    (tmp_path / "s.txt").write_text("the\n\n ,\nthe\r\nof")
    assert dictionary.stop_list(dictionary.read_stop_tokens(spark, str(tmp_path / "s.txt"))) == [" ,", "of", "the"]
    assert dictionary.is_stop_token("of", ["of"]) and not dictionary.is_stop_token("Of", ["of"])


def test_both_patterns_tell_the_same_units(spark):
    every = spark.createDataFrame([(chr(c),) for c in range(0x3000) if not 0xD800 <= c < 0xE000], "c string")
    both = every.select(F.regexp_extract_all(F.concat(F.lit("a"), "c", F.lit("b")), F.lit(text.UNIT), F.lit(0)).alias("x"), F.regexp_extract_all(F.concat(F.lit("a"), "c", F.lit("b")), F.lit(text.JAVA_UNIT), F.lit(0)).alias("y"))
    assert both.where("x <> y").count() == 0 and both.where("size(x) = 1").count() > 500
