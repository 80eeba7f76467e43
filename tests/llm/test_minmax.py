import random
import re
from itertools import combinations

import numpy as np

from inkdex.llm import minmax as mm

SCHEMA = "doc_id bigint, content string, revision int, k bigint, x string"


def visible(t):
    return re.sub("[ \t\r\n]+", " ", t).strip(" ").lower()


def brute(rows, threshold=0.6):
    last = {}
    for d, t, r, *_ in rows:
        if d is not None and (d not in last or (r is not None and (last[d][1] is None or r > last[d][1]))):
            last[d] = (t, r)
    texts = {d: visible(t) for d, (t, _) in last.items() if t is not None and len(visible(t)) >= 40}
    sets = {d: mm.shingles(t, 5) for d, t in texts.items()}
    return texts, {(a, b) for a, b in combinations(sorted(sets), 2) if mm.similarity(sets[a], sets[b]) >= threshold}


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    rows, texts = [], []
    for i in range(n):
        if texts and rng.random() < 0.6:
            w = rng.choice(texts).split()
            for _ in range(rng.randint(0, len(w) // 5)):
                w[rng.randrange(len(w))] = rng.choice(words)
            if rng.random() < 0.3:
                w = w[len(w) // 2 :] + w[: len(w) // 2]
            t = " ".join(w)
        else:
            t = " ".join(rng.choice(words) for _ in range(rng.randint(20, 60)))
        texts.append(t)
        rows.append((i, rng.choice([t, t.upper(), t.replace(" ", " \n\t", 2)]), 1, None, None))
    return rows


def test_pairs_and_groups_against_brute_force(spark, data):
    real = [(r.doc_id, r.content, r.revision, None, None) for r in spark.read.parquet(f"{data}/docs.parquet").collect()]
    for rows in (corpus(1), corpus(2), real):
        df = spark.createDataFrame(rows, SCHEMA).repartition(3)
        texts, want = brute(rows)
        found = mm.near_duplicates(df, "doc_id", "content", "revision")
        got = [tuple(r) for r in found.pairs().collect()]
        assert len(got) == len(set(got)) and set(got) == want
        parent = {d: d for d in texts}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in want:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
        groups = found.groups().collect()
        assert {r.k: r.group_id for r in groups} == {d: root(d) for d in texts} and len(groups) == len(texts)


def test_long_chains_settle(spark):
    n = 70
    members = spark.range(n).selectExpr("id as k", "id as rep")
    links = spark.range(n - 1).selectExpr("id as a", "id + 1 as b")
    groups = mm.NearDuplicates(members, links).groups().collect()
    assert {r.group_id for r in groups} == {0} and sum(r.n_links for r in groups) == 2 * (n - 1)


def test_rounds_are_few_for_shuffled_chains(spark, monkeypatch):
    written, keep = [], mm.materialize
    keys = np.random.default_rng(8).permutation(1000).tolist()
    near = np.random.default_rng(9).permutation(np.arange(2000, 2030)).tolist()

    def counted(df, name):
        written.append(name)
        assert len(written) <= 20
        return keep(df, name)

    monkeypatch.setattr(mm, "materialize", counted)
    members = spark.createDataFrame([(k, k) for k in [*keys, *near, 5000]], "k bigint, rep bigint")
    links = [(min(x), max(x)) for c in (keys, near) for x in zip(c, c[1:])]
    groups = mm.NearDuplicates(members, spark.createDataFrame(links, "a bigint, b bigint")).groups().collect()
    assert {r.k: r.group_id for r in groups} == {k: 0 for k in keys} | {k: 2000 for k in near} | {5000: 5000}
    assert sum(r.n_links for r in groups) == 2 * len(links)


def test_edges(spark):
    long = "lorem ipsum dolor sit amet consectetur " * 3000
    text = "the quick brown fox jumps over the lazy dog again"
    rows = [(1, None, 1, 1, "a"), (2, "", 1, 1, "a"), (3, "short", None, None, None), (4, long, 1, 1, "a"), (5, long + "x", 1, 1, "a"), (5, long + "x", 1, 1, "a"), (6, text, 1, 1, "a"), (7, "  " + text.upper() + "\n", 1, 1, "a"), (8, text, 1, 1, "a"), (8, None, 2, 1, "a"), (9, text, None, 1, "a"), (None, text, 1, 1, "a"), (10, "naïve café 中文" * 9, 1, 1, "a"), (11, "naïve café 中文" * 9 + "é", 1, 1, "a")]
    df = spark.createDataFrame(rows, SCHEMA)
    found = mm.near_duplicates(df, "doc_id", "content", "revision")
    assert {tuple(r) for r in found.pairs().collect()} == brute(rows)[1] == {(4, 5), (6, 7), (6, 9), (7, 9), (10, 11)}
    empty = mm.near_duplicates(df.limit(0), "doc_id", "content", "revision")
    assert empty.pairs().count() == 0 and empty.groups().count() == 0


def test_signature_values_agree_with_the_similarity():
    rng = np.random.default_rng(3)
    p = mm.MinMax(bands=400)
    alphabet = list("abcdefghijklmnopqrstuvwxyz ")
    base = rng.choice(alphabet, 600)
    for cut in (30, 120, 240):
        other = np.concatenate((base[cut:], rng.choice(alphabet, cut)))
        a, b = "".join(base), "".join(other)
        j = mm.similarity(mm.shingles(a, 5), mm.shingles(b, 5))
        n, sketch, keys = mm.signature([a, b], p)
        assert n.tolist() == [len(mm.shingles(a, 5)), len(mm.shingles(b, 5))]
        agree = (keys[0] == keys[1]).mean()
        assert abs(agree - j**p.rows) < 0.08
        bits = sum(int(x).bit_count() for x in (sketch[0] ^ sketch[1]).view(np.uint64))
        assert abs(bits - mm.SKETCH * (1 - j) / 2) < 40


def test_exchange_of_buckets_is_shared(spark):
    df = spark.createDataFrame(corpus(5, 30), SCHEMA)
    texts = df.selectExpr("doc_id as k", "content as x")
    plan = mm.similar_pairs(texts, "k", "x", mm.MinMax())._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
