import math
from fractions import Fraction

import numpy as np
import pytest

from groundframe.llm.queries import QUERIES
from groundframe.llm.whiten import fit_whitening, primes, reconstruct, whiten


def brute(vectors):
    """(n, exact covariance as fractions, deviations, x, sums) by whole numbers."""
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[k] for r in x) for k in range(d)]
    cov = [[Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x), n**3) for j in range(d)] for i in range(d)]
    return n, cov, [sum((n * r[k] - s[k]) ** 2 for k in range(d)) for r in x], np.array(x, float), np.array(s, float)


def test_remainders():
    moduli = primes(10**40)
    assert len(set(moduli)) == len(moduli) and np.prod([float(p) for p in moduli]) > 1e40 and max(moduli) < 1 << 20
    for x in (0, 1, -1, 10**39, -(10**39), 123456789**4):
        assert reconstruct([x % p for p in moduli], moduli) == x


def test_query_equals_exact_arithmetic(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    good = [r for r in rows if r["embedding"] is not None and all(c is not None and math.isfinite(c) for c in r["embedding"])]
    n, cov, deviation, x, s = brute([r["embedding"] for r in good])
    v = np.array([[float(c) for c in row] for row in cov])
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    want = (x - s / n) @ q[:, :8] / np.sqrt(e[:8])
    out = QUERIES["op12_whiten"](spark, sf).collect()
    assert len(out) == 8 * len(good) and {r["n"] for r in out} == {n}
    got = {(r["vec_id"], r["component"]): r for r in out}
    for k in range(8):
        mine = np.array([got[r["vec_id"], k + 1]["whitened"] for r in good])
        assert min(abs(mine - want[:, k]).max(), abs(mine + want[:, k]).max()) < 1e-7
        assert abs(got[good[0]["vec_id"], k + 1]["explained"] - e[k] / np.trace(v)) < 1e-10
    assert [got[r["vec_id"], 1]["deviation"] for r in good] == deviation
    assert len({r["identity_error"] for r in out}) == 1 and out[0]["identity_error"] < 1e-8
    w = np.array([[got[r["vec_id"], k + 1]["whitened"] for k in range(8)] for r in good])
    assert abs(np.cov(w.T, bias=True) - np.eye(8)).max() < 1e-8


def test_fit_is_exact_for_wide_values_and_blocks(spark, monkeypatch):
    import groundframe.llm.whiten as m

    monkeypatch.setattr(m, "ROWS", 7)
    rng = np.random.default_rng(2)
    rows = [[float(c) for c in rng.normal(size=3) * 10.0 ** rng.integers(0, 13)] for _ in range(50)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "vec_id long, embedding array<double>").repartition(4)
    fit = fit_whitening(df)
    n, cov, deviation, x, s = brute(rows)
    assert fit.n == n and fit.sums == [sum(math.floor(1024 * r[k]) + 100_000 for r in rows) for k in range(3)]
    e = np.linalg.eigvalsh([[float(c) for c in r] for r in cov])[::-1]
    assert np.allclose(np.array(fit.explained) * e.sum(), e, rtol=1e-9)
    out = {r["vec_id"]: r for r in whiten(df).collect()}
    assert [out[i]["deviation"] for i in range(n)] == [d if d < 1 << 63 else None for d in deviation]
    assert any(out[i]["deviation"] is None for i in range(n)) and out[0]["identity_error"] < 1e-6


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [0.5, -3.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, []), (7, [1.0]), (8, [3.0, 1e300])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, N int, `a.b` int")
    out = whiten(df)
    assert out.columns == ["vec_id", "a.b", "n", "deviation", "whitened", "explained", "identity_error"]
    got = out.collect()
    assert sorted(str(r["vec_id"]) for r in got) == ["1", "1", "None"] and {r["n"] for r in got} == {3}
    assert all(len(r["whitened"]) == 2 for r in got) and got[0]["identity_error"] < 1e-6  # the second component has no variance: null
    assert all(r["whitened"][1] is None for r in got)
    same = whiten(df.where("vec_id = 1")).collect()
    assert [r["whitened"] for r in same] == [[None, None]] * 2 and same[0]["identity_error"] == 0 and same[0]["deviation"] == 0
    for none in (df.limit(0), df.where("vec_id = 2")):
        assert whiten(none).columns == out.columns and whiten(none).count() == 0
    one = whiten(df.where("vec_id is null")).collect()
    assert one[0]["n"] == 1 and one[0]["explained"] == pytest.approx([0, 0])
