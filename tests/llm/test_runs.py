import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from groundframe.llm.queries import QUERIES
from groundframe.llm.runs import find_runs, periodic_runs


def slow_runs(ids, least=24, times=3):
    """All runs by definition: stretches for every period, those of a smaller period of the same stretch left out."""
    n, out = len(ids), {}
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            if ids[i] != ids[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and ids[j] == ids[j + p]:
                j += 1
            if j + p - i >= max(least, times * p):
                out.setdefault((i, j + p), p)
            i = j
    return sorted((s, e - s, p) for (s, e), p in out.items())


@pytest.mark.parametrize("seed", range(60))
def test_equals_the_definition(seed):
    rng = random.Random(seed)
    ids = []
    while len(ids) < rng.choice([10, 60, 400]):
        base = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randint(1, 25))]
        ids += (base * rng.randint(1, 9))[: rng.randint(1, 120)]
    ids = np.array(ids, np.int32)
    assert find_runs(ids) == slow_runs(ids.tolist())
    assert find_runs(ids, 4, 2) == slow_runs(ids.tolist(), 4, 2)


def test_blocks_of_periods(monkeypatch):
    import groundframe.llm.runs as m

    rng = random.Random(5)
    base = [rng.randrange(4) for _ in range(17)]
    ids = np.array([rng.randrange(3) for _ in range(200)] + base * 20 + [1] * 90 + [rng.randrange(2) for _ in range(300)], np.int32)
    want = slow_runs(ids.tolist())
    for block, chunk in ((1, 40), (700, 64), (1 << 20, 1 << 16)):
        monkeypatch.setattr(m, "BLOCK", block)
        monkeypatch.setattr(m, "CHUNK", chunk)
        assert find_runs(ids) == want and len(want) > 1


def test_long_texts_in_reasonable_time():
    import time

    start = time.perf_counter()
    assert find_runs(np.zeros(1_000_000, np.int32)) == [(0, 1_000_000, 1)]
    base = np.random.default_rng(1).integers(0, 500, 70_001).astype(np.int32)
    (run,) = [r for r in find_runs(np.tile(base, 5)) if r[1] > 1000]
    assert run == (0, 350_005, 70_001) and time.perf_counter() - start < 30


def test_query_equals_brute_force(spark, sf):
    out = {r["doc_id"]: r for r in QUERIES["op13_runs"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(out) == len(docs)
    changed = 0
    for d in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")
        h, n = zlib.crc32(str(d["doc_id"]).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            changed += 1
        if n > 4000:  # too slow by definition; tested above
            continue
        runs = slow_runs(words)
        gone = {i for s, k, q in runs for i in range(s + q, s + k)}
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        r = out[d["doc_id"]]
        assert r["n_runs"] == len(runs)
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()
    assert changed > 5


def test_edges(spark):
    loop = "x y " * 12
    rows = [(1, None), (1, None), (2, ""), (None, " \t\n "), (3, loop), (3, loop), (4, "é z " * 30), (5, "word " * 23), (6, "a b c d e f")]
    df = spark.createDataFrame([(i, t, 7, 8) for i, t in rows], "doc_id long, text string, RUNS int, `a.b` int")
    out = periodic_runs(df)
    assert out.columns == ["doc_id", "text", "a.b", "n_words", "runs", "collapsed"]
    got = sorted((str(r["doc_id"]), r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in out.collect())
    want = [("1", 0, [], ""), ("1", 0, [], ""), ("2", 0, [], ""), ("None", 0, [], ""), ("3", 24, [(0, 24, 2)], "x y"), ("3", 24, [(0, 24, 2)], "x y")]
    want += [("4", 30, [(0, 30, 1)], "é z"), ("5", 23, [], ("word " * 23).strip()), ("6", 5, [], "a b c d e f")]
    assert got == sorted(want)
    assert periodic_runs(df.limit(0)).count() == 0
