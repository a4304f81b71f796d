"""Whitening by polarisation against a plain computation with exact fractions."""

import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bitext.llm import queries, whitening

from ..conftest import SF_SMALL


def plain(rows):
    """n, S and the exact covariance of the distinct quantised vectors, and each row's x."""
    own = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max((len(x) for _, x in own), default=0)
    own = [(i, x + [0] * (d - len(x))) for i, x in own]
    fit = sorted({tuple(x) for _, x in own})
    n, total = len(fit), [sum(x[k] for x in fit) for k in range(d)]
    cov = [[Fraction(sum((n * x[i] - total[i]) * (n * x[j] - total[j]) for x in fit), max(n, 1) ** 3) for j in range(d)] for i in range(d)]
    return own, fit, n, total, np.array([[float(c) for c in row] for row in cov]).reshape(d, d)


def check(rows, out, most=4):
    own, fit, n, total, cov = plain(rows)
    d = len(total)
    count = min(most, d)
    assert len(out) == len(own) * count
    e, u = (np.linalg.eigh(cov) if d else (np.zeros(0), np.zeros((0, 0))))
    e, u = e[::-1][:count], u[:, ::-1].T[:count]
    by_row = {}
    for r in out:
        by_row.setdefault(r.vec_id, []).append(r)
    expected = {}
    for i, x in own:
        expected.setdefault(i, []).append(x)
    assert {k: len(v) for k, v in by_row.items()} == {k: len(v) * count for k, v in expected.items() if count}
    mean = np.array([t / n for t in total]) if n else np.zeros(d)
    for i, found in by_row.items():
        assert {r.n for r in found} == {n}
        deviations = sorted(sum((n * a - s) ** 2 for a, s in zip(x, total)) for x in expected[i])
        for k in range(1, count + 1):
            mine = [r for r in found if r.component == k]
            assert sorted(int(r.deviation) for r in mine) == deviations
            if e[k - 1] > 1e-9 * max(e[0], 1e-300):
                gap = min([abs(e[k - 1] - x) for j, x in enumerate(np.linalg.eigvalsh(cov)[::-1]) if j != k - 1], default=1)
                assert all(math.isclose(r.explained, e[k - 1] / np.trace(cov), rel_tol=1e-6) for r in mine)
                if gap > 1e-3 * e[0]:
                    want = sorted(abs(float((np.array(x) - mean) @ u[k - 1]) / math.sqrt(e[k - 1])) for x in expected[i])
                    assert np.allclose(sorted(abs(r.whitened) for r in mine), want, atol=1e-6)
                assert all(r.identity_error < 1e-6 for r in mine)


def test_whitening_equals_the_plain_computation(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    out = queries.op13_whitening(spark, SF_SMALL).collect()
    check(rows, out)
    signs = {}
    e, u = whitening.components(plain(rows)[4], 4)
    own, _, n, total, _ = plain(rows)
    for i, x in own:  # one sign for all rows
        signs[i] = (np.array(x) - np.array(total) / n) @ u.T / np.sqrt(e)
    assert all(math.isclose(r.whitened, signs[r.vec_id][r.component - 1], abs_tol=1e-6) for r in out)


EDGE = [(1, [0.5, 0.25, -1.0]), (2, [0.5, 0.25, -1.0]), (2, [0.5, 0.25, -1.0]), (None, [0.1, 0.0, 3.0]), (4, None), (5, [float("nan"), 0.0, 0.0]), (6, [None, 1.0, 1.0]), (7, [1.0]), (8, []), (9, [float("inf"), 0.0, 1.0]), (10, [-2.0, 1.5, 0.125])]
SCHEMA = "vec_id long, embedding array<float>, x int, n string, key int"


@pytest.mark.parametrize("rows", [EDGE, [], [(1, [1.0, 2.0])], [(1, []), (2, [])], [(1, None)], [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [1.0, 1.0])], [(k, [0.25] * 5) for k in range(6)]])
def test_edge_rows(spark, rows):
    df = spark.createDataFrame([(i, v, 1, "a", 2) for i, v in rows], SCHEMA)
    out = whitening.whiten(df).collect()
    huge = any(v and any(c and math.isfinite(c) and abs(c) > 1e30 for c in v if c is not None) for _, v in rows)
    if huge:  # entries are cut to a long's range, deviations beyond a decimal are null
        assert len(out) == 6 and {r.n for r in out} == {3} and out[0].deviation is None or out[0].deviation > 10**30
    else:
        check(rows, out)
    if len({tuple(v) for _, v in rows if v}) < 2:
        assert all(r.whitened is None for r in out)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-(2**40), 2**40), min_size=3, max_size=3), min_size=1, max_size=8), st.integers(0, 2))
def test_sums_are_exact(rows, first):
    sums = whitening._Sums()
    for k in range(0, len(rows), 2):
        m = np.array(rows[k : k + 2], object if k % 4 else np.int64)
        sums.add(m.sum(axis=0), first)
    batch = sums.batch()
    found = {}
    for k, limb, v in zip(*(batch.column(c).to_pylist() for c in ("key", "limb", "value"))):
        found[k] = found.get(k, 0) + (v << whitening.LIMB * limb)
    assert [found[first + j] for j in range(3)] == [sum(r[j] for r in rows) for j in range(3)]
