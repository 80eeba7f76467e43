import random
from collections import defaultdict

from inkdex.llm import term_counts as tc

SCHEMA = "term string, rec bigint, w float, _t string, documents bigint"


def brute(rows):
    best = defaultdict(dict)
    for t, r, w, *_ in rows:
        if t:
            best[t].setdefault(r, 0.0)
            best[t][r] = max(best[t][r], w if w and w == w else 0.0)
    return {t: (len(x) - (None in x), sum(w for r, w in x.items() if r is not None)) for t, x in best.items()}


def got(df, **kw):
    rows = tc.term_counts(df, "term", "rec", "w", **kw).collect()
    assert len({r.term for r in rows}) == len(rows)
    return {r.term: (r.documents, r.occurrences) for r in rows}


def test_against_brute_force(spark):
    rng = random.Random(8)
    terms = ["hot", "Hot", " ", None, "", "ho​t"] + [f"t{i}" for i in range(300)]
    rows = [(rng.choices(terms, [900, 200, 300, 50, 50, 100] + [3] * 300)[0], rng.choice([None, rng.randrange(-500, 500)]), rng.choice([None, -2.0, 0.0, 1.0, 1.0, 2.5, float("nan")]), "clash", 1) for _ in range(8000)]
    rows += rows[:2000]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    want = brute(rows)
    for share in (0.005, 0.1, 0.9):  # many heavy terms, few, none
        assert got(df, heavy_share=share) == want


def test_edges(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == {}
    assert got(spark.createDataFrame([(None, None, None, None, None), ("", 1, 1.0, "", 1)], SCHEMA)) == {}
    big = 2**62
    assert got(spark.createDataFrame([("a", big, 1.0, "", 1), ("a", -big, 1.0, "", 1), ("a", big, 1.0, "", 1), ("x" * 10**6, 1, 2.0, "", 1)], SCHEMA)) == {"a": (2, 2.0), "x" * 10**6: (1, 2.0)}


def test_heavy_rows_collapse_before_the_shuffle(spark):
    df = spark.range(0, 100_000, 1, 4).selectExpr("if(id % 2 = 0, 'heavy', concat('t', id)) as term", "id as rec", "cast(1 as float) as w")
    plan = tc.term_counts(df, "term", "rec", "w")
    assert plan.where("term = 'heavy'").first().documents == 50_000
    assert plan.count() == 50_001


def test_unequal_repeats_and_null_records(spark):
    rows = [("h", r % 70_000, float(r % 5), "x", 1) for r in range(100_000)] + [("n", None, 1.0, "x", 1)] * 5_000 + [("l", 1, 3.0, "x", 1), ("l", 1, 1.0, "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    want = brute(rows)
    assert got(df) == want and want["n"] == (0, 0.0) and want["l"] == (1, 3.0)
