from fractions import Fraction

import numpy as np
import pytest
from compare import DATA

from mnemara.llm import whitening


def matrices():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 8, 31, 64):
        q, _ = np.linalg.qr(rng.standard_normal((n, n)))
        x = rng.standard_normal((5 * n, n)) * np.geomspace(1, 1000, n)
        yield x.T @ x
        yield q * np.r_[np.full(n // 2, 3.0), np.full(n - n // 2, 1.0)] @ q.T  # equal eigenvalues
        yield q * np.geomspace(1e-9, 1e5, n) @ q.T
        yield np.eye(n) * 7
        yield np.ones((n, n))  # rank one, even diagonal
        yield q * np.r_[np.zeros(n // 2), np.arange(n - n // 2) + 1.0] @ q.T


@pytest.mark.parametrize("v", list(matrices()), ids=lambda v: str(len(v)))
def test_divide_and_conquer_gives_eigenpairs(v):
    v = (v + v.T) / 2
    values, q = whitening.eigen(v)
    size = np.linalg.norm(v, 2)
    assert np.abs(q.T @ q - np.eye(len(v))).max() < 1e-12
    assert np.abs(v @ q - q * values).max() < 1e-12 * size * max(1, len(v) / 8)
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1], rtol=1e-12, atol=1e-13 * size)


def test_polar_factor_is_the_matrix_sign():
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.standard_normal((20, 20)))
    e = np.r_[-np.geomspace(1e-10, 1, 10), np.geomspace(1e-10, 1, 10)]
    assert np.abs(whitening.polar((q * e) @ q.T) - (q * np.sign(e)) @ q.T).max() < 1e-5  # gaps of 1e-10 leave six digits
    e = np.r_[-np.geomspace(1e-2, 1, 10), np.geomspace(1e-2, 1, 10)]
    assert np.abs(whitening.polar((q * e) @ q.T) - (q * np.sign(e)) @ q.T).max() < 1e-12


def plain(rows, components=16):
    """Whitening of (id, vector) rows by exact fractions and a library's eigenvectors."""
    good = [(i, [int(np.floor(64.0 * float(c))) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, d = len(fit), len(fit[0])
    s = [sum(x[j] for x in fit) for j in range(d)]
    z = np.array([[float(Fraction(n * x[j] - s[j], n)) for j in range(d)] for x in fit])
    e, q = np.linalg.eigh(z.T @ z / n)
    e, q = e[::-1], q[:, ::-1]
    k = min(components, int((e > e.max() * d * 1e-15).sum()))
    out = {}
    for i, x in good:
        dev = sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True))
        w = np.array([float(Fraction(n * a - b, n)) for a, b in zip(x, s, strict=True)]) @ q[:, :k] / np.sqrt(e[:k])
        out.setdefault(i, []).append((n, dev, w, e[:k] / e.sum()))
    return out


def check(got, want):
    by_id = {}
    for r in got:
        by_id.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
        assert abs(r["identity_error"]) <= 1e-4
    assert set(by_id) == set(want)
    signs = {}
    for i, rows in want.items():
        n, dev, w, explained = rows[0]
        assert sorted(by_id[i]) == list(range(1, len(w) + 1))
        for c, x in enumerate(w, 1):
            assert len(by_id[i][c]) == len(rows)
            r = by_id[i][c][0]
            assert (r["n"], r["deviation"]) == (n, dev) and r["explained"] == pytest.approx(explained[c - 1], rel=1e-9)
            if abs(x) > 1e-3:
                assert signs.setdefault(c, np.sign(x * r["whitened"])) == np.sign(x * r["whitened"])
            assert abs(r["whitened"]) == pytest.approx(abs(x), abs=1e-7)


def test_query_equals_plain_version(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DATA}/sf0.001/embeddings.parquet").collect()]
    check(whitening.op13_whitening(spark, f"{DATA}/sf0.001").collect(), plain(rows))


def test_odd_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 5)).round(3).tolist()
    odd = [(100, None), (101, []), (102, [1.0, None, 0.0, 0.0, 0.0]), (103, [float("nan")] * 5), (104, [float("inf"), 0.0, 0.0, 0.0, 0.0])]
    rows = [*enumerate(base), (50, base[0]), (51, base[0]), (51, base[0]), (None, base[1]), *odd]
    schema = "vec_id long, embedding array<double>, component int, x string"
    got = whitening.whiten(spark.createDataFrame([(i, v, 1, "x") for i, v in [*rows, (105, [1.0, 2.0])]], schema)).collect()
    check(got, plain(rows))
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 1, "x")] * 3, schema)).count() == 0
    flat = [(i, [float(i), 2.0 * i, 0.0], 1, "x") for i in range(6)]  # one direction only
    out = whitening.whiten(spark.createDataFrame(flat, schema)).collect()
    assert {r["component"] for r in out} == {1} and all(r["explained"] == pytest.approx(1) for r in out)
    far = [(i, [1e12 + i, -1e12 * (i % 3), 1e9 * i * i], 1, "x") for i in range(9)]
    check(whitening.whiten(spark.createDataFrame(far[:0] + [(i, [x / 1e6 for x in v], 1, "x") for i, v, _, _ in far], schema)).collect(), plain([(i, [x / 1e6 for x in v]) for i, v, _, _ in far]))
