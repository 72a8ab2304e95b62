import math

import numpy as np
import pytest

from tessera.llm import whitening as W


@pytest.fixture(scope="module")
def table_of(spark):
    return lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string, whitened string")


def brute(vectors, k=8):
    """Plain Python integers and numpy's own eigensolver."""
    x = [[math.floor(1024 * c) + 100000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    dev = [sum((n * r[j] - s[j]) ** 2 for j in range(d)) for r in x]
    y = np.array([[(n * r[j] - s[j]) / n for j in range(d)] for r in x])
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return n, dev, y @ u / np.sqrt(e), e / np.trace(y.T @ y / n)


def test_query_against_brute_force(table_of):
    rng = np.random.default_rng(3)
    good = (rng.standard_normal((300, 24)) @ np.diag(np.linspace(3, 0.1, 24)) @ rng.standard_normal((24, 24))).tolist()
    rows = [(i, v, "a", "b") for i, v in enumerate(good)] + [(7, good[7], "a", "b"), (None, good[8], "a", "b")]
    bad = [(900, None, "a", "b"), (901, [None] + good[0][1:], "a", "b"), (902, [float("nan")] + good[0][1:], "a", "b"),
           (903, [float("inf")] + good[0][1:], "a", "b"), (904, good[0][:5], "a", "b"), (905, [], "a", "b")]
    table = table_of(rows + bad).repartition(5)
    model = W.fit(table)
    got = W.digests(W.transform(table, model), model).collect()
    n, dev, white, share = brute([r[1] for r in rows])
    assert len(got) == 8 * len(rows) and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
    want = {}
    for (i, *_), d, w in zip(rows, dev, white):
        want.setdefault(i, (d, w))
    signs = {}
    for r in got:
        d, w = want[r.vec_id]
        assert r.deviation == d and r.explained == pytest.approx(share[r.component - 1], rel=1e-9)
        if abs(w[r.component - 1]) > 0.1:
            signs.setdefault(r.component, set()).add(np.sign(w[r.component - 1] * r.whitened))
        assert abs(abs(r.whitened) - abs(w[r.component - 1])) < 1e-7
    assert all(len(s) == 1 for s in signs.values())  # one sign for all rows


@pytest.mark.parametrize("spectrum", [
    np.linspace(1, 10, 40), np.array([5.0] * 6 + [1.0] * 20), 10.0 ** -np.arange(12), np.r_[1e6, np.ones(30)],
    np.r_[np.ones(3), 1 - 1e-9, 0.5, 1e-3, np.zeros(10)], np.array([2.0]), np.ones(9)])
def test_feast_against_dense_solver(spectrum):
    rng = np.random.default_rng(len(spectrum))
    q, _ = np.linalg.qr(rng.standard_normal((len(spectrum),) * 2))
    m = q @ np.diag(spectrum) @ q.T
    m = (m + m.T) / 2
    values, vectors = W.leading(m, 8)
    want = np.sort(spectrum)[::-1]
    want = want[want > 1e-9 * want[0]] if (spectrum == 0).any() else want
    assert len(values) == min(8, len(want)) and np.allclose(values, want[:8], rtol=1e-9, atol=1e-11 * want[0])
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-7
    assert np.linalg.norm(m @ vectors - vectors * values, axis=0).max() < 1e-11 * max(1, want[0])


def test_inertia_counts():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 30):
        a = rng.standard_normal((n, n))
        a = a + a.T
        e = np.linalg.eigvalsh(a)
        for s in (-1.0, 0.0, 0.37, float(e.mean())):
            assert W.count_above(a, s) == int((e > s).sum())
    assert W.count_above(np.zeros((3, 3)), 0.0) == 0 and W.count_above(np.array([[0.0, 1], [1, 0]]), 0.0) == 1


@pytest.mark.parametrize("rows", [[], [(1, None, "", "")], [(1, [1.0, 2.0], "", "")], [(1, [1.0], "", ""), (2, [1.0], "", "")], [(1, [], "", "")]])
def test_tables_without_variance_give_no_rows(table_of, rows):
    table = table_of(rows)
    model = W.fit(table)
    out = W.digests(W.transform(table, model), model)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 0


def test_huge_entries_and_few_dimensions(table_of):
    table = table_of([(i, [1e300 * (-1) ** i, float(i)], "", "") for i in range(6)])
    model = W.fit(table)
    got = W.digests(W.transform(table, model), model).collect()
    assert {r.deviation for r in got} == {None} and {r.component for r in got} <= {1, 2}
    table = table_of([(i, [float(i % 3), float(i)], "", "") for i in range(9)])
    model = W.fit(table)
    assert {r.component for r in W.digests(W.transform(table, model), model).collect()} == {1, 2} and model.identity_error < 1e-9
