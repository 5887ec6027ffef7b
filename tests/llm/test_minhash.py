import numpy as np
import pytest

from groundframe.llm.minhash import near_duplicates, super_min_hash
from groundframe.llm.queries import QUERIES

from . import brute


def got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_query_equals_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(QUERIES["op8_minhash"](spark, sf)) == brute.minhash(rows)


def test_random_families_equal_brute_force(spark):
    rng, rows = np.random.default_rng(5), []
    for family in range(12):
        base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
        for _ in range(12):
            t = list(base)
            for at in rng.integers(0, 120, rng.integers(0, 6)):
                t[at] = f"x{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(near_duplicates(df)) == brute.minhash(rows)


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n\t", "x"), (4, "a b", "x"), (5, "A\nB", "y"), (5, "A\nB", "y"), (None, "a b", "z"), (6, "b a", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    out = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(df).collect()), key=str)
    assert out == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (5, 1, 4, False), (None, 1, 4, False), (6, 1, 6, True)], key=str)
    assert near_duplicates(df.limit(0)).count() == 0


def test_null_and_repeated_ids(spark):
    base = [f"w{k}" for k in range(60)]
    near = " ".join(base[:30] + ["x"] + base[31:])
    base = " ".join(base)
    rows = [(5, base), (None, near), (7, "a b c d e f"), (7, base.upper()), (None, "lone text"), (None, "lone text"), (9, "a b c d e f g h"), (3, near + " end")]
    out = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    want = [(5, 56, 3, False), (None, 56, 3, False), (7, 2, 7, True), (7, 56, 3, False), (None, 1, None, True), (None, 1, None, True), (9, 4, 9, True), (3, 57, 3, True)]
    assert out == sorted(want, key=str)


@pytest.mark.parametrize("n", [3, 60, 2000])
def test_signatures_estimate_similarity(n):
    rng = np.random.default_rng(n)
    est = []
    for _ in range(40):
        a = rng.integers(0, 1 << 62, n).astype(np.uint64)
        b = a.copy()
        b[: n // 3] = rng.integers(0, 1 << 62, n // 3).astype(np.uint64)
        s = super_min_hash(np.concatenate([a, b]), np.repeat([0, 1], n), 2)
        assert np.isfinite(s).all()
        est.append((s[0] == s[1]).mean())
    true = (n - n // 3) / (n + n // 3)
    assert abs(np.mean(est) - true) < 0.04
