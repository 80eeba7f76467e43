"""Salted per-key results against brute force, and their edge cases."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from inkdex.operators import skew

SCHEMA = "tok string, doc_id bigint, tf float, _salt int"


def brute(rows, k, share=0.0):
    best = defaultdict(dict)
    n = defaultdict(int)
    for t, d, w, _ in rows:
        if t:
            n[t] += 1
            best[t][d] = max(best[t].get(d, 0.0), max(w or 0.0, 0.0))
    return {(t, d) for t, x in best.items() if n[t] >= share * len(rows) for d in sorted(x, key=lambda d: (-x[d], d is None, d or 0))[:k]}


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(6000):
        t = rng.choices(["hot", "warm", None, "", f"t{rng.randrange(500)}"], [40, 8, 3, 3, 46])[0]
        rows.append((t, rng.randrange(900), rng.choice([None, -1.0, 0.0, 1.0, 2.0, float(rng.randrange(9))]), 1))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for exact, kw in ((False, {}), (False, {"min_share": 0.05})):
        got = skew.top_records_per_key(df, "tok", "doc_id", "tf", 5, exact_repeats=exact, **kw).collect()
        assert {(r.tok, r.doc_id) for r in got} == brute(rows, 5, kw.get("min_share", 0)) and len(got) == len({(r.tok, r.doc_id) for r in got})
    same = [(t, d, float(d * 7 % 11), s) for t, d, _, s in rows]  # exact repeats
    got = skew.top_records_per_key(spark.createDataFrame(same * 2, SCHEMA), "tok", "doc_id", "tf", 5, min_share=0.01, exact_repeats=True).collect()
    assert {(r.tok, r.doc_id) for r in got} == brute(same, 5, 0.01)
    totals = {r.tok: (r.n_rows, r.n_records, r.total) for r in skew.totals_per_key(df, "tok", "doc_id", "tf").collect()}
    for t in ("hot", "warm"):
        own = [(d, max(w or 0.0, 0.0)) for x, d, w, _ in rows if x == t]
        best = defaultdict(float)
        for d, w in own:
            best[d] = max(best[d], w)
        assert totals[t] == (len(own), len(best), sum(best.values()))


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert skew.hot_keys(empty, "tok", 0.01) == [] and skew.top_records_per_key(empty, "tok", "doc_id", "tf", 5, min_share=0.1).count() == 0
    assert skew.totals_per_key(empty, "tok", "doc_id", "tf").count() == 0
    nulls = spark.createDataFrame([(None, None, None, None), ("a", None, None, 1), ("a", 2, None, 1), ("x" * 5000, 1, 1.0, 1)], SCHEMA)
    assert skew.hot_keys(nulls, "tok", 0.01) == ["a"]  # long keys take the plain path
    got = {(r.tok[:1], r.doc_id, r.rank) for r in skew.top_records_per_key(nulls, "tok", "doc_id", "tf", 5).collect()}
    assert got == {("a", 2, 1), ("a", None, 2), ("x", 1, 1)}
    assert {r.tok[:1]: (r.n_rows, r.n_records, r.total) for r in skew.totals_per_key(nulls, "tok", "doc_id", "tf").collect()} == {"a": (2, 1, 0.0), "x": (1, 1, 1.0)}


def test_hot_rows_spread_before_the_shuffle(spark):
    df = spark.range(200_000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 5000)) as tok", "id as doc_id", "cast(id % 97 as float) as tf", "0 as _salt")
    plan = skew.top_records_per_key(df, "tok", "doc_id", "tf", 5, exact_repeats=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2  # pruned on the map side


def test_long_hot_keys_count(spark):
    long = ["x" * 2000, "é" * 1000, "x" * 1999 + "y"]
    rows = [(t, d, float(d * 7 % 11), 1) for t, n in zip([*long, "hot", "y" * 1024, "y" * 1025], (300, 40, 5, 200, 30, 30)) for d in range(n)]
    rows += [(f"t{i}", i, 1.0, 1) for i in range(500)] + [("z" * 1500 + str(i), i, 1.0, 1) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for exact in (True, False):
        got = skew.top_records_per_key(df, "tok", "doc_id", "tf", 5, min_share=0.02, exact_repeats=exact).collect()
        assert {(r.tok, r.doc_id) for r in got} == brute(rows, 5, 0.02) and len(got) == 25
    got = skew.top_records_per_key(df, "tok", "doc_id", "tf", 5).collect()
    assert {(r.tok, r.doc_id) for r in got} == brute(rows, 5)
    totals = {r.tok: (r.n_rows, r.n_records) for r in skew.totals_per_key(df, "tok", "doc_id", "tf").collect()}
    assert [totals[t] for t in long] == [(300, 300), (40, 40), (5, 5)]


def test_unequal_repeats_count_once(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 3.0), ("a", 2, 2.0), ("a", 2, float("nan")), ("b", None, 1.0)], "tok string, doc_id bigint, tf double")
    got = {(r.tok, r.rank): (r.doc_id, r.tf) for r in skew.top_records_per_key(df, "tok", "doc_id", "tf", 5).collect()}
    assert got == {("a", 1): (1, 3.0), ("a", 2): (2, 2.0), ("b", 1): (None, 1.0)}
    assert {r.tok: (r.n_rows, r.n_records, r.total) for r in skew.totals_per_key(df, "tok", "doc_id", "tf").collect()} == {"a": (4, 2, 5.0), "b": (1, 0, 0.0)}


def test_salts_follow_the_share(spark):
    hot = skew.Hot(1_000_000, {"a": 300_000, "b": 10_000})
    df = spark.range(2000).selectExpr("if(id % 2 = 0, 'a', if(id % 4 = 1, 'b', 'c')) as tok", "id as doc_id")
    n = {r.tok: r.n for r in skew.with_salt(df, F.col("tok"), F.col("doc_id"), hot).groupBy("tok").agg(F.count_distinct("_salt").alias("n")).collect()}
    assert n == {"a": 4, "b": 2, "c": 1}  # of 4 tasks: 0.3 x 4 x 2, rounded up to a power of two
