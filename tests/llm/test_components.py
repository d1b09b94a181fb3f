"""Connected components against union-find; native plans."""

import contextlib
import io
import random

import pytest

from cueflow.llm import queries as Q
from cueflow.llm.components import components


@pytest.mark.parametrize("seed", [1, 2])
def test_roots(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randint(-40, 40), rng.randint(-40, 40)) for _ in range(45)]
    pairs += [(100 + i, 101 + i) for i in range(30)] + [(500, 500 + i) for i in range(20)]
    root = {n: n for p in pairs for n in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    edges = spark.createDataFrame([*pairs, (None, 3), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    linked = {n for a, b in pairs if a != b for n in (a, b)}
    assert got == {n: root[n] for n in linked}
    assert components(edges.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op1", "op2"])
def test_native_queries_have_no_python(spark, name):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        getattr(Q, name)(spark, "/root/testdata/sf0.001").explain("extended")
    assert "Python" not in out.getvalue() and "Arrow" not in out.getvalue()
