import math

import numpy as np
import pytest

from wardloom.llm import whitening
from wardloom.llm.common import table


def brute(rows, top=16):
    """{row number: (deviation, whitened up to sign)}, explained; from the eigenvectors of the covariance."""
    xs = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in rows]
    fitted = sorted(set(map(tuple, xs)))
    n, d = len(fitted), len(fitted[0])
    s = [sum(col) for col in zip(*fitted)]
    deviation = [sum((n * a - b) ** 2 for a, b in zip(x, s)) for x in xs]
    a = np.array([[(n * p - q) / n for p, q in zip(x, s)] for x in fitted])
    values, vectors = np.linalg.eigh(a.T @ a / n)
    values, vectors = values[::-1][:top], vectors[:, ::-1][:, :top]
    own = np.array([[(n * p - q) / n for p, q in zip(x, s)] for x in xs])
    return n, deviation, own @ vectors / np.sqrt(values), values / np.trace(a.T @ a / n), d


def check(df, ids, rows):
    n, deviation, white, explained, d = brute(rows)
    got = {}
    for r in df.collect():
        got.setdefault(r.vec_id, {})[r.component] = r
        assert r.n == n and 0 <= r.identity_error <= 1e-9
    assert sorted(got) == sorted(ids)
    for i, v in enumerate(ids):
        assert sorted(got[v]) == list(range(1, min(16, d) + 1))
        assert {r.deviation for r in got[v].values()} == {deviation[i]}
    for c in range(min(16, d)):
        own = np.array([got[v][c + 1].whitened for v in ids])
        sign = np.sign(own @ white[:, c])
        assert own * sign == pytest.approx(white[:, c], abs=1e-7)
        assert got[ids[0]][c + 1].explained == pytest.approx(explained[c], rel=1e-9)


def test_table(spark, folder):
    source = table(spark, folder, "embeddings")
    found = sorted((r.vec_id, r.embedding) for r in source.collect())
    check(whitening.report(source), [v for v, _ in found], [e for _, e in found])


def test_cases(spark, rows):
    rng = np.random.default_rng(5)
    base = (rng.normal(size=(60, 5)) * [30, 3, 1, 0.5, 8] + [1e4, -5, 0, 0, 1]).astype("float32").tolist()
    good = [(i, v) for i, v in enumerate(base)] + [(100 + i, base[0]) for i in range(40)]  # repeats count once
    bad = [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0]), (902, [1.0, float("nan"), 0.0, 0.0, 0.0]), (903, [float("-inf")] + [0.0] * 4)]
    df = rows([(i, v, 1, 2) for i, v in good + bad], "vec_id long, embedding array<float>, n int, Component int")
    check(whitening.report(df), [i for i, _ in good], [v for _, v in good])
    other = whitening.report(df.union(rows([(950, [1.0], 1, 1), (None, base[1], 1, 1)], df.schema)))
    assert [(r.deviation, r.whitened) for r in other.where("vec_id = 950").collect()] == [(None, None)] * 5
    assert other.where("vec_id is null").count() == 5


def test_no_variance_and_large(spark, rows):
    # the third dimension repeats the first, the fourth never changes
    flat = rows([(i, [float(i), float(i * i % 7), float(i), 2.0]) for i in range(50)], "vec_id long, embedding array<double>")
    got = whitening.report(flat).collect()
    assert {(r.component, r.whitened is None) for r in got} == {(1, False), (2, False), (3, True), (4, True)}
    assert max(r.identity_error for r in got) < 1e-9
    one = whitening.report(rows([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert len(one) == 4 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained == 0 for r in one)
    assert whitening.report(rows([], "vec_id long, embedding array<float>")).count() == 0
    assert whitening.report(rows([(1, None), (2, [])], "vec_id long, embedding array<float>")).count() == 0
    wide = [(i, [float(i) * 1e6, float(i % 3), 0.5 * (i % 5)]) for i in range(30)] + [(99, [3e38, 0.0, 0.0])]
    found = {r.vec_id: r for r in whitening.report(rows(wide, "vec_id long, embedding array<float>")).where("component = 1").collect()}
    xs = [[min(math.floor(64 * np.float64(np.float32(c))), 1 << 40) + 1_000_000 for c in v] for _, v in wide]
    sums = [sum(c) for c in zip(*xs)]
    exact = {i: sum((31 * a - s) ** 2 for a, s in zip(x, sums)) for (i, _), x in zip(wide, xs)}
    assert {i: r.deviation for i, r in found.items()} == {i: v if v < 1 << 63 else None for i, v in exact.items()}


def test_ill_conditioned(spark, rows):
    """Axes whose deviations span eight powers of ten are told apart."""
    rng = np.random.default_rng(9)
    turn, _ = np.linalg.qr(rng.normal(size=(6, 6)))
    spread = np.array([1e9, 1e7, 1e5, 1e4, 1e3, 1e2])
    vectors = (rng.normal(size=(400, 6)) * spread) @ turn.T
    df = rows([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    model = whitening.fit(whitening.integer_vectors(df, scale=1, offset=0))
    assert model.identity_error < 1e-6
    x = np.floor(vectors)
    x -= x.mean(axis=0)
    assert np.sqrt(model.eigenvalues) == pytest.approx(np.linalg.svd(x)[1] / 20, rel=1e-6)
