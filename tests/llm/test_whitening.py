"""Whitening against numpy's own eigenvectors and exact whole numbers."""

import math
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from cueflow.llm import whitening as W
from cueflow.llm.queries import op12


def plain(vectors):
    """x, S, covariance (in long doubles), values and vectors by falling value."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    y = np.array([[n * c - s for c, s in zip(v, sums, strict=True)] for v in x], float) / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    return x, sums, y, values[::-1], axes[:, ::-1]


def compare(rows, vectors, ids, many=32):
    x, sums, y, values, axes = plain(vectors)
    n, total = len(x), values.sum()
    used = min(many, int((values > 1e-10 * total).sum()))
    by_id = defaultdict(dict)
    for r in rows:
        assert r.component not in by_id[r.vec_id]
        by_id[r.vec_id][r.component] = r
    assert sorted(by_id) == sorted(ids) and len(rows) == n * used
    want = y @ (axes[:, :used] / np.sqrt(values[:used]))
    got = np.array([[by_id[i][k + 1].whitened for k in range(used)] for i in ids])
    sign = np.sign((want * got).sum(0))
    gaps = [min([abs(values[k] - v) for j, v in enumerate(values) if j != k] or [total])
            for k in range(used)]
    for k in range(used):
        if gaps[k] > 1e-6 * total:
            assert np.allclose(got[:, k] * sign[k], want[:, k], atol=1e-6)
        assert np.isclose(by_id[ids[0]][k + 1].explained, values[k] / total, rtol=1e-9)
    assert np.abs(np.cov(got.T, bias=True) - np.eye(used)).max() < 1e-5
    for i, own in zip(ids, x, strict=True):
        for r in by_id[i].values():
            assert r.n == n and r.identity_error == rows[0].identity_error <= 1e-5
            assert r.deviation == sum((n * c - s) ** 2 for c, s in zip(own, sums, strict=True))


@pytest.mark.parametrize("kind", ["random", "repeated", "graded", "diagonal", "zero", "one"])
def test_components_of_symmetric_matrices(kind):
    rng = np.random.default_rng(5)
    d = 1 if kind == "one" else 40
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    spectrum = {
        "random": rng.random(d), "repeated": np.repeat([3.0, 2.0, 2.0 + 1e-13, 0.5], 10),
        "graded": 10.0 ** -np.arange(d), "diagonal": np.arange(1.0, d + 1), "zero": np.zeros(d),
        "one": np.array([2.0])}[kind]
    a = np.diag(spectrum) if kind == "diagonal" else (q * spectrum) @ q.T
    values, vectors = W.leading_components(a, 32)
    assert np.allclose(values, np.sort(spectrum)[::-1][:32], atol=1e-14 * max(1, spectrum.max()))
    assert np.abs(vectors.T @ vectors - np.eye(vectors.shape[1])).max() < 1e-12
    assert np.abs(a @ vectors - vectors * values).max() < 1e-13 * max(1, spectrum.max())


def test_query_is_the_plain_result(spark):
    folder = "/root/testdata/sf0.001"
    table = pq.read_table(f"{folder}/embeddings.parquet").to_pylist()
    compare(op12(spark, folder).collect(), [r["embedding"] for r in table],
            [r["vec_id"] for r in table])


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    good = [(i, rng.standard_normal(5).tolist()) for i in range(40)]
    good += [(40, good[3][1]), (41, good[3][1])]  # repeated
    bad = [(50, None), (51, []), (52, [1.0, None, 0.0, 0.0, 0.0]), (53, [float("nan")] * 5),
           (54, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (55, [1.0, 2.0])]
    docs = spark.createDataFrame(
        [(i, v, "a", 1) for i, v in good + bad],
        "vec_id long, embedding array<double>, x string, w int").repartition(5)
    compare(W.whiten(docs).collect(), [v for _, v in good], [i for i, _ in good])
    assert W.whiten(docs, many=2).agg({"component": "max"}).first()[0] == 2
    alone = docs.filter("vec_id = 1")
    for none in (docs.limit(0), alone, alone.unionByName(alone), docs.filter("vec_id = 50")):
        out = W.whiten(none)
        assert out.count() == 0 and out.columns[:3] == ["vec_id", "component", "n"]
    flat = spark.createDataFrame([(None, [float(i), 1.0, 2.0 * i]) for i in range(9)],
                                 "vec_id long, embedding array<float>")
    rows = W.whiten(flat).collect()  # one direction only
    assert len(rows) == 9 and {r.component for r in rows} == {1}
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [0.0, 1.0]), (3, [-1e300, 0.5])],
                                 "vec_id long, embedding array<double>")
    rows = W.whiten(huge).collect()
    assert {r.deviation for r in rows if r.vec_id == 1} == {None}
