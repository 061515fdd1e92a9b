import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import sums
from gleaner.llm import whitening as w
from gleaner.session import Workspace


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id bigint, embedding array<float>, component string, n int")


def expected(x, k=32):
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    at = np.argsort(-e)[:k]
    return centred @ u[:, at] / np.sqrt(e[at]), e[at] / e.sum(), ((n * x - s) ** 2).sum(axis=1)


def result(df, **parameters):
    rows = w.whitened_rows(df, "vec_id", "embedding", **{"scale": 64, "offset": 1_000_000} | parameters).collect()
    return {(r.vec_id, r.component): r for r in rows}


@pytest.mark.parametrize("lanes", [0, 3])
def test_against_dense_eigenvectors(spark, lanes, monkeypatch):
    monkeypatch.setattr(w, "BLOCK", 200)  # several blocks
    monkeypatch.setattr(sums, "DIRECT_TASKS", 0 if lanes else 1 << 20)
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((150, 12)) * np.linspace(3, 0.5, 12) + 5
    df = table(spark, [(i, [float(c) for c in v]) for i, v in enumerate(vectors)]).repartition(5)
    got = result(df, components=7)
    x = np.floor(64 * vectors.astype(np.float32).astype(float)).astype(np.int64) + 1_000_000
    white, share, deviation = expected(x, 7)
    found = np.array([[got[i, c + 1].whitened for c in range(7)] for i in range(150)])
    assert len(got) == 150 * 7
    sign = np.sign((found * white).sum(axis=0))
    assert np.abs(found * sign - white).max() < 1e-9
    assert all(got[i, 1].deviation == deviation[i] and got[i, 1].n == 150 for i in range(150))
    assert np.allclose([got[0, c + 1].explained for c in range(7)], share, rtol=1e-10)
    assert max(r.identity_error for r in got.values()) < 1e-10


def test_rows_that_are_left_out(spark):
    good = [(i, [float(i % 3), float(i % 2), 1.0]) for i in range(12)]
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, math.nan, 2.0]), (103, [math.inf, 0.0, 0.0]), (104, [0.0, -math.inf, 0.0])]
    got = result(table(spark, good + bad))
    assert {i for i, _ in got} == set(range(12))
    assert {c for _, c in got} == {1, 2}  # the third dimension doesn't vary
    assert all(r.n == 12 for r in got.values())


def test_null_ids_repeated_rows_and_short_vectors(spark):
    rows = [(None, [1.0, 2.0]), (None, [1.0, 2.0]), (3, [4.0]), (4, []), (5, [0.5, -1.0])]
    out = w.whitened_rows(table(spark, rows), "vec_id", "embedding").collect()
    assert len(out) == 5 * 2 and sum(r.vec_id is None for r in out) == 4
    x = np.floor(64 * np.array([[1, 2], [1, 2], [4, 0], [0, 0], [0.5, -1]])).astype(np.int64)
    by_id = {r.vec_id: r.deviation for r in out}
    assert [by_id[i] for i in (None, 3, 4, 5)] == expected(x)[2][[0, 2, 3, 4]].tolist()


def test_nothing_to_whiten(spark):
    assert result(table(spark, [])) == {}
    assert result(table(spark, [(1, None)])) == {}
    assert result(table(spark, [(1, [1.0, 2.0])])) == {}
    assert result(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])) == {}
    assert result(table(spark, [(1, []), (2, [])])) == {}


def test_equal_variances_are_all_found(spark):
    # Three orthogonal directions with one variance: a Krylov space from one start holds only one of them.
    rows = [(2 * i + s, [float(2 * s - 1) if j == i else 0.0 for j in range(3)]) for i in range(3) for s in (0, 1)]
    got = result(table(spark, rows))
    assert {c for _, c in got} == {1, 2, 3}
    assert max(r.identity_error for r in got.values()) < 1e-10


def test_bidiagonal_form():
    rng = np.random.default_rng(2)
    for x in (rng.standard_normal((40, 9)), rng.standard_normal((5, 9)), np.eye(6), np.outer(np.arange(5.0), np.ones(4))):
        d = x.shape[1]
        v, b = w.bidiagonalise(lambda z: x.T @ (x @ z), d, np.linalg.norm(x))  # noqa: B023
        assert np.allclose(v.T @ v, np.eye(d))
        assert np.allclose(b, np.triu(np.tril(b, 1)))
        assert np.allclose(np.linalg.svd(b)[1][: min(x.shape)], np.linalg.svd(x)[1], atol=1e-7)


def test_deviations_beyond_a_long():
    model = w.Whitening(10**6, [0, 0], np.zeros((2, 1)), np.ones(1), 1.0)
    rows = np.array([[1 << 40, 0], [3, 4]])
    assert w._deviations(model, rows) == [None, 25 * 10**12]


def test_wide_numbers_are_exact(spark):
    df = spark.createDataFrame([(i, [float(1 << 45) + i, 1.0]) for i in range(4)], "vec_id bigint, embedding array<double>")
    got = w.whitened_rows(df.withColumn("extra", F.lit(1)), "vec_id", "embedding", scale=64).collect()
    x = [64 * i for i in range(4)]
    assert {r.vec_id: r.deviation for r in got} == {i: (4 * v - sum(x)) ** 2 for i, v in enumerate(x)}


def test_blocks_hold_every_row(spark, monkeypatch):
    monkeypatch.setattr(w, "BLOCK", 10)
    df = spark.range(101).select("id", F.array(F.col("id"), -F.col("id"), F.lit(1).cast("bigint")).alias("x"))
    blocks = w.pack(df, Workspace(spark, "blocks"))
    assert blocks.d == 3 and blocks.table.agg(F.sum("n")).first()[0] == 101
    assert sorted(i for r in blocks.table.collect() for i in r.ids) == list(range(101))
