import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexfold.llm import segment_topk as st
from lexfold.llm.queries import ORACLE_SQL, op4_segment_topk


def brute(rows, asks, k=5):
    """(query, rank, vec, score), over rows (id, vector)."""
    good = [(i, [math.floor(256 * float(c)) for c in x]) for i, x in rows if x is not None and all(c is not None and math.isfinite(c) for c in x)]
    out = []
    for a, (i, q) in enumerate(good):
        if asks(i):
            clamp = lambda s: max(-(1 << 63), min(s, (1 << 63) - 1))
            scores = [(-clamp(sum(x * y for x, y in zip(q, v))), j is None, j or 0, j) for b, (j, v) in enumerate(good) if b != a and len(v) == len(q)]
            out += [(i, r + 1, j, -s) for r, (s, _, _, j) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def fifty(i):
    return i is not None and i % 50 == 0


def got(df, **k):
    return sorted(map(tuple, st.top_k(df, F.col("vec_id") % 50 == 0, **k).collect()), key=str)


SCHEMA = "vec_id bigint, embedding array<float>, label int, score double, rank int"


@pytest.mark.parametrize("block", [1 << 19, 60])
def test_messy_rows(spark, monkeypatch, block):
    monkeypatch.setattr(st, "BLOCK_COMPONENTS", block)
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=12)]) for i in range(300)]
    rows += [(50, rows[50][1]), (50, rows[3][1]), (None, rows[100][1]), (7, None), (100, [None, 1.0]), (150, [float("nan")] * 12), (151, [float("inf")] * 12)]
    rows += [(200, [1.0, 2.0]), (201, [1.5, -2.0]), (250, []), (251, []), (900, [0.0] * 12), (901, [0.0] * 12)]
    df = spark.createDataFrame([(*r, 1, 0.5, 3) for r in rows], SCHEMA)
    assert got(df) == brute(rows, fifty)


def test_ties_and_few_candidates(spark):
    rows = [(i, [1.0, 0.0]) for i in range(100)]
    df = spark.createDataFrame([(*r, 1, 0.5, 3) for r in rows], SCHEMA)
    assert got(df) == brute(rows, fifty)
    few = spark.createDataFrame([(0, [1.0], 1, 0.5, 3), (1, [2.0], 1, 0.5, 3)], SCHEMA)
    assert got(few) == [(0, 1, 1, 256 * 512)]
    assert got(df.limit(0)) == []


def test_the_largest_id_is_not_null(spark):
    rows = [(i, [float(i % 7), 1.0]) for i in range(60)] + [((1 << 63) - 1, [9.0, 9.0]), (None, [9.0, 9.0])]
    df = spark.createDataFrame([(*r, 1, 0.5, 3) for r in rows], SCHEMA)
    assert got(df) == brute(rows, fifty)
    assert [r[2] for r in sorted(got(df), key=lambda r: (r[0], r[1])) if r[0] == 0][:2] == [(1 << 63) - 1, None]


def test_seeds_are_reached():
    rng = np.random.default_rng(1)
    for n in (1, 5, 6, 40, 700):
        v = np.floor(256 * rng.normal(size=(n, 8)))
        found = st.seeds(v, 5)
        for k in range(0, n, 37):
            others = sorted((float(v[k] @ v[j]) for j in range(n) if j != k), reverse=True)
            assert found[k] == (others[4] if len(others) >= 5 else -np.inf)


def test_large_components_stay_exact(spark):
    rows = [(0, [3e7, 1.0]), (1, [3e7, 2.0]), (2, [-3e7, 2.0]), (50, [1e30, 0.0])]
    df = spark.createDataFrame([(*r, 1, 0.5, 3) for r in rows], "vec_id bigint, embedding array<double>, label int, score double, rank int")
    first = [r for r in got(df) if r[0] == 0]
    want = [r for r in brute(rows, fifty) if r[0] == 0]
    assert first == want


def test_bounds_hold():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(40, 13)), rng.normal(size=(50, 13)) * 3
    exact = a @ b.T
    last = np.full(exact.shape, np.inf)
    for begins in st.levels(13):
        bound = st.statistics(a, begins) @ st.statistics(b, begins).T
        assert (bound >= exact - 1e-9).all() and bound.mean() <= last.mean()
        last = bound


def test_whole_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, op4_segment_topk(spark, sf).collect()), key=str) == brute(rows, fifty)
    assert "op4_segment_topk" in ORACLE_SQL
