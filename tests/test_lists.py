import numpy as np
import pytest

from inkdex.model import BM25Parameters
from inkdex.operators import lists
from inkdex.plans import requests

SCHEMA = "request_id bigint, text string, tokens array<string>, labels array<string>, doc_ids array<bigint>, reverse_order boolean, output_offset int, max_outputs int"


@pytest.fixture(scope="module")
def index(spark):
    """Documents with ids far apart and below zero, one without a length; tokens of all frequencies."""
    rows = [(t, (d - 150) * 10**15, float(1 + d * k % 5) if t != "label" else 0.0) for d in range(300) for k, t in enumerate(["all", "half", "third", "label", "one"], 1) if d % k == 0 and (t != "one" or d == 120)]
    postings = spark.createDataFrame(rows, "tok string, doc_id bigint, tf float").repartition(3)
    stats = spark.range(299).selectExpr("(id - 150) * 1000000000000000 as doc_id", "cast(id % 9 as float) as token_length")
    return postings, stats


@pytest.fixture(scope="module")
def log(spark):
    asked = []
    for n, (tokens, labels) in enumerate([(["all"], None), (["half", "all", "half"], ["label"]), (["third", "half"], None), (["one"], ["all"]), (["one", "third", "none"], None), (None, ["label"]), ([], [])]):
        for m, (span, rev, skip, most) in enumerate([(None, False, 0, 0), (None, True, 3, None), ([-(10**16), 5 * 10**16], False, 2, 7), ([10**18, 10**18 + 1], None, None, 5), (None, False, 0, 3), (None, True, 290, 20)]):
            asked.append((100 * n + m, None, tokens, labels, span, rev, skip, most))
    asked += [(1000 + k, None, ["all", "half"], None, None, False, k % 4, 5) for k in range(150)]  # one question of many requests
    return spark.createDataFrame([*asked, *asked[:9]], SCHEMA)


def answers(log, index, **more):
    return sorted(tuple(r) for r in requests.answer_all(log, *index, digits=6, **more).collect())


@pytest.fixture(scope="module")
def joined(log, index):
    """The same by joins, which a scorer asks for."""
    from inkdex.functions.scoring import bm25_scorer

    return sorted(r[:4] for r in answers(log, index, scorer=bm25_scorer))


def test_lists_agree_with_joins(log, index, joined):
    assert len(joined) > 1_500 and answers(log, index) == joined


def test_segments_batches_and_broad_questions(log, index, joined, monkeypatch):
    monkeypatch.setattr(lists, "SEGMENT", 40)
    monkeypatch.setattr(requests, "TOGETHER", 4)
    monkeypatch.setattr(requests, "BROAD", 120)
    assert answers(log, index) == joined


def test_folder_that_is_not_mapped(log, index, joined, monkeypatch):
    monkeypatch.setattr(lists, "_local", lambda *_: None)
    assert answers(log, index) == joined


def test_no_hits_are_shuffled(log, index):
    """Hits leave the task that finds them as rows of the result: nothing but the requests and keys is exchanged behind the lists."""
    plan = requests.answer_all(log, *index, digits=6)._jdf.queryExecution().sparkPlan().toString()
    head = plan.split("MapInArrow")[0]
    assert "MapInArrow" in plan and not any(x in head for x in ("Exchange", "Join", "Window", "Sort"))


def test_first_and_round():
    rng = np.random.default_rng(1)
    for n in (1, 7, 100):
        score = rng.integers(0, 6, n) / 4
        for rev in (False, True):
            want = sorted(range(n), key=lambda k: (score[k] if rev else -score[k], -k))
            for last in {1, n // 5 or 1, n}:
                assert lists._first(score, last, rev).tolist() == want[:last]
    assert lists._round(np.array([0.5, 1.5, -0.5, 2.25]), 0).tolist() == [1, 2, -1, 2]


def test_bm25_of_arrays(spark):
    from pyspark.sql import functions as F

    from inkdex.functions import scoring

    p = BM25Parameters(k1=1.2, b=0.5)
    df = spark.createDataFrame([(float(tf), float(n)) for tf in (-1, 0, 1, 3) for n in (0, 2, 9)], "tf double, n double")
    for average in (0.0, 3.5):
        want = [r.x for r in df.select(scoring.bm25_term(F.col("tf"), F.lit(4), F.col("n"), F.lit(10), F.lit(average), p).alias("x")).collect()]
        rows = [tuple(r) for r in df.collect()]
        got = scoring.bm25_values(np.array([r[0] for r in rows]), 4, np.array([r[1] for r in rows]), 10, average, p)
        assert np.allclose(got, want, rtol=1e-14)
