import random

import pytest

from inkdex.llm import mojibake as mo


@pytest.fixture(scope="module")
def clean(spark, data):
    return [r.text for r in spark.read.parquet(f"{data}/eval_items.parquet").collect()]


@pytest.fixture(scope="module")
def model(clean):
    return mo.train(clean)


RUSSIAN = ["Новые книги лежат на столе между старыми словарями, и каждый может взять нужную страницу.", "Однако некоторые журналы выходят утром, другие тихо ждут вечера около реки."]


def test_clean_texts_stay(clean, model):
    more = ["São João, Ålesund, Łódź and Þingvellir.", "LES TÂCHES DE L’ÂGE MÛR", "With √3 ≈ 1.73 and π ≤ 4", "├── a\n│   └── b", "The letters Ã and Â sort after A here.", "«ainsi», ¿qué?, ¡no!", "naïve résumé…", "é", "…", *RUSSIAN]
    assert [t for t, s in zip(clean + more, mo.label(clean + more, model)) if s] == []


@pytest.mark.parametrize("written, read", [("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp850"), ("utf-8", "cp1251"), ("cp1252", "mac_roman"), ("gbk", "cp1252"), ("gbk", "cp1251")])
def test_held_out_accuracy(spark, data, model, clean, written, read):
    """Texts that the model has not seen, garbled: nearly all are found and most of those restored exactly."""
    rng = random.Random(3)
    texts = [r.content for r in spark.read.parquet(f"{data}/docs.parquet").collect() if r.content and len(r.content) > 60 and not r.content.isascii() and r.content.isprintable()]
    texts = [t for t in texts if all(mo.kind_of(c) not in ("greek", "cyrillic", "hidden", "private") for c in t)]
    garbled = [(t, mo.misread(t, written, read)) for t in rng.sample(texts, min(80, len(texts)))]
    garbled = [(t, g) for t, g in garbled if g and g != t and "�" not in g and sum(a > "\x7f" for a in t) >= 6]
    assert len(garbled) >= 3
    spans = mo.label([g for _, g in garbled], model)
    hits = [(t, mo.restore(g, s, model)) for (t, g), s in zip(garbled, spans) if s]
    assert len(hits) >= 0.9 * len(garbled)
    assert sum(t == r for t, r in hits) >= 0.6 * len(hits)


@pytest.mark.parametrize("written, read", [("cp1251", "cp1252"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1251"), ("utf-8", "cp1251"), ("utf-8", "cp1252")])
def test_cyrillic(model, written, read):
    for t in RUSSIAN:
        g = mo.misread(t, written, read)
        (spans,) = mo.label([g], model)
        assert spans and mo.restore(g, spans, model) == t


def test_parts_and_layers(model):
    t = "Plain words first. Les numéros très légers précèdent l’été à côté. Plain words last."
    g = "Plain words first. " + mo.misread("Les numéros très légers précèdent l’été à côté.", "utf-8", "cp1252") + " Plain words last."
    (spans,) = mo.label([g], model)
    assert mo.restore(g, spans, model) == t and spans[0][0] >= 19 and spans[-1][1] <= len(g) - 18
    twice = mo.misread(mo.misread(t, "utf-8", "cp1252"), "utf-8", "cp1252")
    for _ in range(2):
        (spans,) = mo.label([twice], model)
        twice = mo.restore(twice, spans, model)
    assert twice == t


def test_long_texts_go_in_pieces(model):
    g = mo.misread("Les numéros très légers précèdent l’été à côté. " * 400, "utf-8", "cp1252")
    whole, parts = mo.label(["x", g, ""], model), mo.label(["x", g, ""], model, 3_000)
    for spans in (whole, parts):
        assert spans[0] == spans[2] == [] and mo.restore(g, spans[1], model) == "Les numéros très légers précèdent l’été à côté. " * 400
    assert "".join(mo._pieces("é" * 10_000, 3_000)) == "é" * 10_000 and mo._pieces("", 5) == [""]


def test_lost_bytes_are_found_and_stay(model):
    (spans,) = mo.label(["Los res�menes peque�os"], model)
    assert [model.names[s] for *_, s in spans] == ["lost"] and mo.restore("a�b", spans, model) == "a�b"


@pytest.mark.parametrize("written, read, _", mo.PAIRS)
def test_inverse_is_exact(written, read, _):
    for t in ("Füße, été à l’âge, año", "Ёлка и чай", "中文，标点。"):
        g = mo.misread(t, written, read)
        if g is not None and "�" not in g:
            assert mo.inverse(g, written, read) == t


def test_operator(spark, clean):
    good = spark.createDataFrame([(t,) for t in clean], "text string")
    rows = [(1, None), (2, ""), (3, "plain"), (4, "Les numÃ©ros trÃ¨s lÃ©gers"), (4, "Les numÃ©ros trÃ¨s lÃ©gers"), (5, "été"), (6, "word " * 40_000 + "naÃ¯ve rÃ©sumÃ©"), (None, "Ã©tÃ© cÃ´tÃ©"), (7, "x\U0010ffff\x00é")]
    df = spark.createDataFrame([(k, t, "clash", ["p"]) for k, t in rows], "doc_id bigint, text string, k string, pairs array<string>").repartition(2)
    got = mo.garbled(df, "doc_id", "text", good)
    assert got.columns == ["doc_id", "n_chars", "pairs", "restored"]
    found = sorted(((r.doc_id, r.restored[-15:]) for r in got.collect()), key=repr)
    assert found == sorted([(4, "Les numéros très légers"[-15:])] * 2 + [(6, "word naïve résumé"[-15:]), (None, "été côté")], key=repr)
    assert mo.garbled(df.limit(0), "doc_id", "text", good).count() == 0
    assert mo.garbled(df, "doc_id", "text", good.limit(0)).count() >= 0


def test_many_layers(spark, clean):
    text = "Les numéros très légers de l'été à Zürich"
    now = text
    for _ in range(5):
        now = now.encode().decode("cp1252")
    df = spark.createDataFrame([(1, now)], "doc_id bigint, text string")
    assert [r.restored for r in mo.garbled(df, "doc_id", "text", spark.createDataFrame([(t,) for t in clean], "text string")).collect()] == [text]


def test_the_model_is_made_of_all_texts(spark, clean):
    """A long text of the clean table, and texts of the corpus, however many, tell what is clean."""
    good = spark.createDataFrame([(t,) for t in [*clean, "plain Ã©tÃ© words, " * 2_000]], "text string")
    df = spark.createDataFrame([(1, "plain Ã©tÃ© words"), (2, "Les numÃ©ros trÃ¨s lÃ©gers")], "doc_id bigint, text string")
    assert [r.doc_id for r in mo.garbled(df, "doc_id", "text", good).collect()] == [2]


def test_counts_of_a_table(spark, clean, model):
    same = lambda a, b: all((x == y).all() for p, q in zip(a, b) for x, y in zip(mo.total_of([p]), mo.total_of([q])))
    texts = [f"{t[:80]} {k}" for k in range(40) for t in clean] + ["word é " * 5_000, "naÃ¯ve rÃ©sumÃ©", "Ã", "a�b"]
    df = spark.createDataFrame([(t,) for t in [*texts, None, ""]], "t string").repartition(3)
    assert len(texts) > 9_000 and same(mo.tally_all(df, "t"), mo.tally(texts))
    fine = mo.fine_texts(texts, model)
    assert set(texts) - set(fine) >= {"naÃ¯ve rÃ©sumÃ©", "a�b"} and same(mo.tally_all(df, "t", model), mo.tally(fine))


@pytest.mark.parametrize("written, read, _", [p for p in mo.PAIRS if p[0] in ("utf-8", "gbk") and p[1] != "gbk"])
def test_counts_put_through_a_pair(clean, written, read, _):
    texts = [*clean, *RUSSIAN, "中文，标点。", "x"]
    want = mo.total_of([mo.bigrams(mo.misread(t, written, read) for t in texts)])
    got = mo.misread_counts(mo.total_of([mo.bigrams(texts)]), written, read)
    kept = (want[0] >> 21 != 0xFFFD) & (want[0] & mo.CODE != 0xFFFD)
    assert got[0].tolist() == want[0][kept].tolist() and got[1].tolist() == want[1][kept].tolist()


def test_many_probabilities_at_once(model):
    rng = random.Random(5)
    chars = "ab \n1.éÃ©ÐÑ中文鎴�\x85я\U0010ffff\u0301"
    pairs = [(rng.choice(chars), rng.choice(chars)) for _ in range(300)]
    codes = [mo.np.array([ord(p[k]) for p in pairs], mo.np.int64) for k in (0, 1)]
    for m in (model.clean, *model.pairs.values()):
        assert mo.np.allclose(m.logs_of(*codes), [m.log(*p) for p in pairs], rtol=1e-12)
