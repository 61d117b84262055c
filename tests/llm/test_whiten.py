"""Whitening against plain integers and numpy."""

import math

import numpy as np
import pytest
from docketry.llm.queries import op13_embedding_whitening
from docketry.llm.whiten import Scatter, whiten

SCHEMA = "vec_id long, embedding array<double>, n long, width string"


def plain(rows, scale=256):
    """x-vectors, the distinct ones, n*x - S and the covariance, in Python's integers."""
    kept = [(i, [math.floor(scale * c) for c in v]) for i, v, *_ in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, d = len(fit), len(fit[0])
    s = [sum(x[k] for x in fit) for k in range(d)]
    y = [[n * x[k] - s[k] for k in range(d)] for x in fit]
    v = np.array([[sum(r[a] * r[b] for r in y) / n**3 for b in range(d)] for a in range(d)])
    return kept, fit, n, s, v


def check(got, rows):
    kept, fit, n, s, v = plain(rows)
    d = len(s)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    some = min(4, d)
    assert len(got) == some * len(kept)
    want = {(i, sum((n * c - t) ** 2 for c, t in zip(x, s))) for i, x in kept}
    assert {(r.vec_id, int(r.deviation)) for r in got} == want and {r.n for r in got} == {n}
    for k in range(some):
        of = {}
        for r in got:
            if r.component == k + 1:
                of.setdefault(r.vec_id, []).append(r)
                assert r.explained == pytest.approx(e[k] / e.sum(), rel=1e-9) and r.identity_error < 1e-6
        for i in of:
            xs = [x for j, x in kept if j == i]
            made = sorted(abs(r.whitened) for r in of[i])
            assert made == pytest.approx(sorted(abs(np.dot(np.array(x) - np.array(s) / n, u[:, k])) / math.sqrt(e[k]) for x in xs), rel=1e-6, abs=1e-8)


def test_equals_plain_integers(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 6)) * [1, 2, 3, 4, 5, 6]
    rows = [(i, [float(c) for c in v], 1, "x") for i, v in enumerate(base)]
    rows += [(100 + i, rows[0][1], 1, "x") for i in range(30)]  # copies count once in the fit
    rows += [(7, rows[1][1], 2, "y"), (200, None, 0, None), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0, None), (202, [math.nan] * 6, 0, None), (203, [], 0, None), (204, [math.inf] * 6, 0, None)]
    got = whiten(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    check(got, rows)


def test_odd_tables(spark):
    assert whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    one = whiten(spark.createDataFrame([(1, [0.5, -0.0], 0, ""), (2, [0.5, 0.0], 0, ""), (None, [0.5, 0.0], 0, "")], SCHEMA)).collect()
    assert {(r.vec_id, r.component, r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in one} == {(i, k, 1, 0, None, None, None) for i in (1, 2, None) for k in (1, 2)}
    flat = whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0], 0, "") for i in range(5)], SCHEMA)).collect()
    assert {r.component for r in flat if r.whitened is not None} == {1} and {r.component for r in flat} == {1, 2, 3}
    lengths = [(1, [1.0, 2.0], 0, ""), (2, [2.0, 1.0], 0, ""), (3, [1.0], 0, ""), (4, [5.0], 0, "")]
    assert sorted((r.vec_id, r.component, r.n) for r in whiten(spark.createDataFrame(lengths, SCHEMA)).collect()) == [(1, 1, 2), (1, 2, 2), (2, 1, 2), (2, 2, 2), (3, 1, 2), (4, 1, 2)]


def test_large_entries_stay_exact(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.integers(-(2**62), 2**62, (5, 3)), rng.integers(-(2**20), 2**20, (9, 3)), rng.integers(-(2**25), 2**25, (2000, 3))])
    for shift in (x[0], x[-1], np.zeros(3, np.int64)):
        scatter = Scatter(shift)
        for a, b in ((0, 5), (5, 14), (14, 900), (900, 2014)):
            scatter.add(x[a:b])
        n, s, xx = scatter.about_zero()
        o = x.astype(object)
        assert n == len(x) and (s == o.sum(axis=0)).all() and (xx == o.T @ o).all()
    rows = [(i, [float(c) for c in v], 0, "") for i, v in enumerate(rng.standard_normal((12, 2)) * 2.0**40)]
    check(whiten(spark.createDataFrame(rows, SCHEMA)).collect(), rows)
    wide = whiten(spark.createDataFrame([(1, [1e300, 0.0], 0, ""), (2, [-1e300, 1.0], 0, "")], SCHEMA)).collect()
    assert len(wide) == 4 and all(r.n == 2 for r in wide)
    over = op13_rows(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0])])
    assert {r.deviation for r in over} == {None}


def op13_rows(spark, rows):
    from pyspark.sql import functions as F

    return whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).withColumn("deviation", F.expr("try_cast(deviation as bigint)")).collect()


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(op13_embedding_whitening(spark, sf).collect(), rows)
