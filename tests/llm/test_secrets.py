import hashlib
import math
import re
from collections import Counter

from groundframe.llm.queries import QUERIES
from groundframe.llm.secrets import ALLOW, BITS, CANDIDATE, HEX_CLASS, KINDS, WINDOW, scan_secrets, written


def plain(text):
    """(base spans, all spans)"""
    text = text or ""
    base = []
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    base += [(m.start(), 0, m.end()) for m in re.finditer(assign, text, re.I | re.A) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    more = []
    for m in re.finditer(CANDIDATE, text):
        if any(re.search(a, m[0]) for a in ALLOW):
            continue
        kind = 3 if re.search(HEX_CLASS, m[0]) else 4
        runs = []
        for i in range(len(m[0]) - WINDOW + 1):
            n = Counter(m[0][i : i + WINDOW]).values()
            if sum(x * math.log2(x) for x in n) <= WINDOW * (math.log2(WINDOW) - BITS[KINDS[kind]]) + 1e-9:
                if runs and runs[-1][1] >= i:
                    runs[-1][1] = i + WINDOW
                else:
                    runs.append([i, i + WINDOW])
        more += [(m.start() + a, kind, m.start() + b) for a, b in runs]
    more = [x for x in more if not any(b[0] < x[2] and x[0] < b[2] for b in base)]
    return sorted(base), sorted(base + more)


def text_of(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    out = {r["doc_id"]: r for r in QUERIES["op2_secrets"](spark, sf).collect()}
    assert len(out) == len(docs)
    for d in docs:
        base, spans = plain(d["text"])
        r = out[d["doc_id"]]
        assert r["spans"] == text_of(spans) and r["base_sha256"] == hashlib.sha256(text_of(base).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[1] == k for s in base) for k in range(3)]


def test_edges(spark):
    texts = [
        None, "", "é password: 'abcdef' API_KEY=12345 Secret=token=abcdef", "secret: token : abcdef", "AKIA" + "A" * 15, "x AKIA" + "B7" * 8 + "é", "f" * 24, "g" + "0f" * 13,
        "é " + "aB3dE5gH7jK9mN1pQ3sT5vW7" + " 123e4567-e89b-12d3-a456-426614174000 https/path/without/digits/at/all 12345678901234567890123",
        "q" * 30 + "aB3dE5gH7jK9mN1pQ3sT5vW7xY" + "q" * 40 + "1Z2x3C4v5B6n7M8a9S0d1F2g" + "==", "0123456789ABCDEF0123", "Zk9" * 20_000, "token=" + "a.b" * 5_000,
    ]
    df = spark.createDataFrame([(i % 3 if i % 4 else None, t, i) for i, t in enumerate(texts)], "doc_id long, text string, secrets_base int")
    out = {r["secrets_base"]: r["w"] for r in scan_secrets(df).select("secrets_base", written("secrets").alias("w")).collect()}
    assert out == {i: text_of(plain(t)[1]) for i, t in enumerate(texts)}
    assert scan_secrets(df).columns == ["doc_id", "text", "secrets_base", "secrets"]
    assert scan_secrets(df.limit(0)).count() == 0


def test_work_grows_with_the_hits(spark):
    import time

    took = []
    for n in (500, 8_000, 16_000):  # the first is a warm-up
        text = " ".join(f"token={k}abcdef x{k}Zq8" + ("aB3dE5gH7jK9mN1pQ3sT5vW7" if k % 2 else "") for k in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        start = time.perf_counter()
        got = scan_secrets(df).select(written("secrets")).first()[0]
        took.append(time.perf_counter() - start)
        assert got == text_of(plain(text)[1])
    assert took[2] < 3 * took[1] + 2


def test_long_candidates_and_names(spark):
    import random

    rng = random.Random(3)
    text = "".join(rng.choice("abcdefghijkABCDEFGHIJKL0123456789") if (k // 50) % 2 else "q" for k in range(9_000))
    text += " " + "".join(rng.choice("0123456789abcdef") if (k // 2050) % 2 else "0" for k in range(9_000)).upper()
    df = spark.createDataFrame([(1, text, 2)], "doc_id long, text string, `a.b` int")
    out = scan_secrets(df)
    assert out.columns == ["doc_id", "text", "a.b", "secrets"]
    assert out.select(written("secrets")).first()[0] == text_of(plain(text)[1])
