import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkdex.llm import lexicon as lx

encoder = lx._encoder(lx.vocabulary())


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.binary(max_size=6), st.lists(st.integers(0, 50_000), max_size=4), max_size=60), st.lists(st.binary(max_size=7), max_size=40))
def test_transducer(words, others):
    t = lx.Transducer.compile(words)
    asked = [*words, *others]
    for w, n in zip(asked, t.numbers(asked).tolist()):
        assert (n >= 0) == (w in words)
        if n >= 0:
            assert t.ids[t.start[n] : t.start[n + 1]].tolist() == words[w]


def test_automaton_is_minimal_and_survives_a_file(tmp_path):
    words = {(a + b + c).encode(): [1] for a in "abc" for b in "abc" for c in "abc"}
    t = lx.Transducer.compile(words)
    assert len(t.final) == 4  # all suffixes are shared
    (tmp_path / "x").write_bytes(t.to_bytes())
    u = lx.Transducer.open(str(tmp_path / "x"))
    assert u.numbers(list(words)).tolist() == list(range(27)) and not u.edge.flags.writeable


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" '\n\tsdmtrelv1é中")), max_size=40))
def test_pieces_encode_alone_as_in_their_text(t):
    assert [i for p in lx._split()(t) for i in encoder.encode_ordinary(p)] == encoder.encode_ordinary(t)


@pytest.mark.parametrize("words", [0, 3, 1 << 16])
def test_encode(spark, words):
    rng = random.Random(1)
    base = "don't  stop\n\n the 1234 naïve 中文 🙂👩‍💻 <|endoftext|> it's '' x's".split(" ")
    texts = [None, "", " ", "\n", "a" * 100_000, "word " * 30_000, *(" ".join(rng.choices(base, k=rng.randint(1, 30))) for _ in range(200))]
    rows = [(i % 150, t, "clash", [1]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, k string, ids array<int>").repartition(3)
    got = sorted((r.doc_id, list(r.ids)) for r in lx.encode(df, "doc_id", "text", words=words).collect())
    assert got == sorted((d, encoder.encode_ordinary(t) if t else []) for d, t, *_ in rows)
    assert lx.encode(df, "doc_id", "text", words=words).schema.simpleString() == "struct<doc_id:bigint,ids:array<int>>"


def test_empty_and_null_tables(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert lx.encode(df, "doc_id", "text").count() == 0
    assert [tuple(r) for r in lx.encode(spark.createDataFrame([(None, None)], "doc_id bigint, text string"), "doc_id", "text").collect()] == [(None, [])]


def test_frequent_pieces_cover_the_whole_corpus(spark):
    counts = lx.frequent_pieces(spark.createDataFrame([("a a a b b c",)] * 3, "text string"), "text", 2)
    assert counts == [" a", " b"]
