import random

import pytest

from inkdex.llm import containment as co
from inkdex.llm.words import words_of

SCHEMA = "doc_id bigint, text string, t string, i bigint"
WORDS = "alpha beta gamma delta épée straße 中文 42 x y z omega".split()


def brute(docs, items, run=12):
    out = set()
    for i, t, *_ in items:
        own = co.passages(t, run)
        out |= {(d, i) for d, u, *_ in docs if d is not None and i is not None and own & co.passages(u, run)}
    return out


def planted(seed):
    rng = random.Random(seed)
    say = lambda n: " ".join(f"{rng.choice(WORDS)}{rng.randrange(40)}" for _ in range(n))
    items = [(i, say(rng.choice([5, 11, 12, 13, 40]))) for i in range(25)]
    docs = []
    for d in range(120):
        w = say(rng.randint(0, 200)).split()
        if rng.random() < 0.6:
            own = rng.choice(items)[1].split()
            a = rng.randrange(len(own))
            part = own[a : a + rng.choice([10, 11, 12, 13, 30])]
            if rng.random() < 0.3 and len(part) > 3:
                part.insert(rng.randrange(len(part)), "other")
            at = rng.randint(0, len(w))
            w[at:at] = [rng.choice([p, p.upper()]) for p in part]
        docs.append((d, rng.choice([" ", "\n", ", ", "-- "]).join(w)))
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("limit", [co.BROADCAST_CHARS, 0])
def test_both_ways_against_brute_force(spark, seed, limit):
    docs, items = planted(seed)
    docs += [(200, None), (201, ""), (202, docs[0][1]), (202, docs[0][1]), (None, items[4][1]), (203, "w " * 30_000 + max((t for _, t in items), key=len))]
    items += [(90, None), (91, ""), (92, items[0][1]), (93, "中文字母" * 4), (94, max((t for _, t in items), key=len))]
    docs += [(204, "x中文字母中文字母中文字母 y")]
    frame = lambda rows: spark.createDataFrame([(k, t, "clash", 1) for k, t in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in co.leaks(frame(docs), frame(items).withColumnRenamed("doc_id", "item_id"), "doc_id", "item_id", broadcast_chars=limit).collect()]
    want = brute(docs, items)
    assert len(got) == len(set(got)) and set(got) == want and (204, 93) in want and (203, 94) in want


def test_empty_tables(spark):
    e = spark.createDataFrame([], "k bigint, text string")
    d = spark.createDataFrame([(1, "a " * 20)], "k bigint, text string")
    for limit in (100, 0):
        for x, y in ((e, e), (e, d), (d, e)):
            assert co.leaks(x, y.withColumnRenamed("k", "j"), "k", "j", broadcast_chars=limit).count() == 0


def test_words():
    assert words_of("Don't STOP—now_5 中文ok Été") == ["don", "t", "stop", "now", "5", "中", "文", "ok", "été"] and words_of(None) == []


def test_a_shared_window_always_has_a_shared_signature():
    rng = random.Random(9)
    for _ in range(50):
        w = [rng.choice("abcdefgh") for _ in range(40)]
        a = rng.randrange(28)
        _, s = co.signatures([" ".join(w), " ".join(["q"] * rng.randrange(9) + w[a : a + 12] + ["r"])])
        owner, _ = co.signatures([" ".join(w), " ".join(w[a : a + 12])])
        own, part = co.signatures([" ".join(w)])[1], co.signatures([" ".join(w[a : a + 12])])[1]
        assert set(part) <= set(own)
