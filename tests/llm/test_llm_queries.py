"""The registered queries against their SQL; the others, on whole small tables, against plain versions."""

from collections import Counter, defaultdict
from itertools import combinations

import pytest

from inkdex.llm import canonical, lexicon, queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_agrees_with_sql(agrees, name):
    agrees(queries.QUERIES, queries.SQL, name)


@pytest.fixture(scope="module")
def rows(spark, data):
    known = {}

    def run(name):
        if name not in known:
            known[name] = queries.QUERIES[name](spark, data).collect()
        return known[name]

    return run


def current(spark, data):
    best = {}
    for r in spark.read.parquet(f"{data}/docs.parquet").select("doc_id", "content", "revision").collect():
        v = -1 if r.revision is None else r.revision
        if r.doc_id not in best or v > best[r.doc_id][0]:
            best[r.doc_id] = (v, r.content)
    return {k: t for k, (_, t) in best.items()}


def test_ids(spark, data, rows):
    encode = lexicon._encoder(lexicon.vocabulary()).encode_ordinary
    want = {r.doc_id: encode(r.text or "") for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    assert {r.doc_id: list(r.ids) for r in rows("p6_ids")} == want and len(rows("p6_ids")) == len(want)


def test_groups(spark, data, rows):
    pairs = [tuple(r) for r in rows("p1_found")]
    groups = {r.doc_id: r for r in rows("p1_groups")}
    top = {k: k for k in groups}

    def find(x):
        while top[x] != x:
            x = top[x] = top[top[x]]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    members = defaultdict(set)
    for k in groups:
        members[find(k)].add(k)
    told = defaultdict(set)
    for k, r in groups.items():
        told[r.group_id].add(k)
    assert sorted(map(sorted, members.values())) == sorted(map(sorted, told.values()))
    links = Counter(x for a, b in pairs if groups[a].rep != groups[b].rep for x in {groups[a].rep, groups[b].rep} if {a, b} == {groups[a].rep, groups[b].rep})
    assert all(r.n_links == links[r.rep] for r in groups.values())


def test_canonical(spark, data, rows):
    look = canonical.look(spark)
    forms = {k: t if t is None else canonical.canonical_text(t, look) for k, t in current(spark, data).items()}
    assert {r.doc_id: r.canonical for r in rows("p5_canonical")} == forms
    texts = {("content", k): t for k, t in current(spark, data).items()}
    for field, name, key in (("request", "requests", "request_id"), ("dictionary", "dictionary", "entry_id")):
        texts |= {(field, r[0]): r[1] for r in spark.read.parquet(f"{data}/{name}.parquet").select(key, "text").collect()}
    alike = defaultdict(list)
    for (field, k), t in texts.items():
        if t is not None:
            alike[field, canonical.canonical_text(t, look)].append((k, t))
    want = {(f, *sorted((a, b))) for (f, _), x in alike.items() for (a, s), (b, t) in combinations(x, 2) if s != t}
    assert {tuple(r) for r in rows("p5_found")} == want and len(rows("p5_found")) == len(want) > 0


def test_garbled(spark, data, rows):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    restored = {r.doc_id: r for r in rows("p8_restored")}
    assert {r.doc_id for r in rows("p8_found")} == set(restored) and restored
    for k, r in restored.items():
        assert r.pairs and not texts[k].isascii() and (r.restored != texts[k] or "lost" in " ".join(r.pairs))
