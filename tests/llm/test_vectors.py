import math

import numpy as np
import pytest

from groundframe.llm.queries import QUERIES
from groundframe.llm.vectors import near_vectors

from .brute import closure


def brute(rows):
    ok = [(i, l, np.array(v, float)) for i, v, l in rows if l is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = []
    for l in {x[1] for x in ok}:
        own = [x for x in ok if x[1] == l]
        m = np.stack([x[2] / np.linalg.norm(x[2]) for x in own])
        for a, b in zip(*np.nonzero(np.triu(m @ m.T >= 0.98, 1)), strict=True):
            links.append((own[a][0], own[b][0]))
    comp = closure([r[0] for r in rows], links)
    n = {r[0]: 0 for r in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return {i: (n[i], comp[i]) for i in n}


def got(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in df.collect()}


def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert got(QUERIES["op9_vectors"](spark, sf)) == brute(rows)


def test_clusters_equal_brute_force(spark):
    rng, rows = np.random.default_rng(3), []
    for c in range(40):
        base = rng.normal(size=64)
        for _ in range(60 if c == 0 else 8):
            v = base + rng.normal(size=64) * rng.choice([0, 0.08, 0.13, 0.2])
            rows.append((len(rows), [float(x) for x in v], c % 2))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert got(near_vectors(df)) == brute(rows)


@pytest.mark.parametrize("block", [16])
def test_large_cells_are_split(spark, block, monkeypatch):
    import groundframe.llm.vectors as m

    monkeypatch.setattr(m, "BLOCK", block)
    rng = np.random.default_rng(4)
    base = rng.normal(size=64)
    rows = [(i, [float(x) for x in base + rng.normal(size=64) * 0.1], 1) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert got(near_vectors(df)) == brute(rows)


def test_edges(spark):
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [float("nan"), 1.0], 1), (6, [1.0, 0.0], None), (7, [1.0, 0.0], 1), (8, [2.0, 0.0], 1), (9, [1.0, 0.0], 1), (10, [1.0, 0.0], 2), (11, [float("inf"), 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert got(near_vectors(df)) == brute(rows)
    extra = spark.createDataFrame([(None, [1.0, 0.0], 1, 0), (7, [1.0, 0.0], 1, 0), (7, [1.0, 0.0], 1, 0)], "vec_id long, embedding array<double>, label int, node int")
    assert sorted(map(str, near_vectors(extra).collect())) == sorted(
        ["Row(vec_id=None, n_links=2, component_id=7, kept=False)"] + ["Row(vec_id=7, n_links=2, component_id=7, kept=True)"] * 2
    )
    assert near_vectors(df.limit(0)).count() == 0
