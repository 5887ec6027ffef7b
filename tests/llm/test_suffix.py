import hashlib
import random

import numpy as np
import pytest

from groundframe.llm.queries import QUERIES
from groundframe.llm.suffix import Hashed, dedup_substrings, sort_suffixes


def brute(rows, length=100):
    """{doc: (bytes, removed, spans, kept)}"""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\x01" * length
            seen.add(s)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[doc] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def got(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in df.collect()}


def test_query_equals_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in QUERIES["op10_suffix"](spark, sf).collect()}
    assert out == brute(rows)


@pytest.fixture(scope="module")
def repetitive(spark):
    random.seed(2)
    words = ["".join(random.choices("abé ", k=random.randint(1, 40))) for _ in range(30)]
    rows = []
    for i in range(60):
        kind = i % 4
        text = "".join(random.choices(words, k=random.randint(1, 80))) if kind else random.choice("xy") * random.randint(0, 900)
        if kind == 2 and rows:
            old = random.choice(rows)[1]
            at = random.randint(0, len(old))
            text = text[:50] + old[at : at + 300] + text[50:]
        rows.append((i, text))
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


@pytest.mark.parametrize("bits", [64, 40, 2])
def test_repetitive_texts_equal_brute_force(repetitive, bits):
    """With 2 bits nearly all hashes collide, of runs and of strings: verification alone tells texts apart."""
    rows, df = repetitive
    assert got(dedup_substrings(df, bits=bits)) == brute(rows)


@pytest.mark.parametrize("bits", [64, 3])
def test_a_line_in_a_third_of_all_documents(spark, bits):
    random.seed(5)
    word = lambda: "".join(random.choices("abcdefgh", k=7))
    line = " ".join(word() for _ in range(40))
    rows = [(i, " ".join(word() for _ in range(30)) + (f"\n{line}\n" if i % 3 == 0 else "") + " ".join(word() for _ in range(20))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert got(dedup_substrings(df, bits=bits)) == brute(rows)


def test_segments_part_runs_not_results(monkeypatch):
    """Long texts go in segments: the runs of all segments hold every start once."""
    import groundframe.llm.suffix as m

    monkeypatch.setattr(m, "SEGMENT", 700)
    random.seed(3)
    text = "".join(random.choices("ab", k=5000)).encode()
    _, p, n, _, _ = m._all_runs([text])
    assert sorted(x for a, k in zip(p, n) for x in range(a, a + k)) == list(range(5000 - m.LENGTH + 1))


def test_edges(spark):
    t = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(60))
    rows = [(1, None, 0), (2, "", 0), (3, t, 0), (4, t, 0), (None, t + "z", 0), (4, t, 0), (5, t[:99], 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, doc int")
    out = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"]) for r in dedup_substrings(df).collect())
    n = len(t)
    assert out == sorted([("1", 0, 0), ("2", 0, 0), ("3", n, 0), ("4", n, n), ("None", n + 1, n), ("4", n, n), ("5", 99, 0)])
    assert dedup_substrings(df.limit(0)).count() == 0


def test_suffix_sort():
    random.seed(1)
    b = "".join(random.choices("ab", k=3000)).encode()
    start = np.array([random.randint(0, 2800) for _ in range(500)])
    length = np.array([random.randint(1, 200) for _ in range(500)])
    group = np.sort(np.array([random.randint(0, 20) for _ in range(500)]))
    o = sort_suffixes(Hashed(np.frombuffer(b, np.uint8)), start, length, group)
    assert (group[o] == group).all()
    assert [(g, b[s : s + n]) for g, s, n in zip(group[o], start[o], length[o])] == sorted((g, b[s : s + n]) for g, s, n in zip(group, start, length))
