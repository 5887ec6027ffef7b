import numpy as np

from groundframe.llm.decontam import EDITS, best_match, decontaminate, edits_of, find_leaks, parts_of, words_of
from groundframe.llm.queries import QUERIES


def plain_distance(item, part):
    prev = [0] * (len(part) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(part, 1):
            new.append(min(prev[j - 1] + (w != x), prev[j] + 1, new[-1] + 1))
        prev = new
    return min(prev)


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    want = set()
    its = [(i["item_id"], words_of(i["text"])) for i in items]
    for d in docs:
        w = words_of(d["text"])
        for i, x in its:
            if len(np.intersect1d(w, x)) >= (1 - EDITS) * len(np.unique(x)) * 0.9 and best_match(x, w)[0] <= int(EDITS * len(x)):
                want.add((d["doc_id"], i))
    assert want
    assert {(r["doc_id"], r["item_id"]) for r in QUERIES["op4_leaks"](spark, sf).collect()} == want


def test_distance_is_exact():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(1, 12)).astype(np.uint64), rng.integers(0, 4, rng.integers(0, 25)).astype(np.uint64)
        assert best_match(a, b)[0] == plain_distance(a.tolist(), b.tolist())


def test_edited_items_are_found(spark):
    rng = np.random.default_rng(2)
    items = [(k, " ".join(f"i{x}" for x in rng.integers(0, 3000, rng.integers(14, 60)))) for k in range(100)]
    docs = []
    for k, t in items:
        w = t.split()
        for _ in range(len(w) // 15):
            at, what = rng.integers(0, len(w)), rng.integers(0, 3)
            w[at : at + int(what > 0)] = [f"e{rng.integers(0, 99)}"] * int(what < 2)
        fill = [f"f{x}" for x in rng.integers(0, 3000, 300)]
        at = rng.integers(0, 300)
        docs.append((k, " ".join(fill[:at] + w + fill[at:])))
    out = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], x["item"]) for r in out.collect() for x in r["leaks"]}
    assert got <= {(k, k) for k, _ in items} and len(got) >= 97


def test_edges(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [(1, None, 0), (2, "", 0), (3, "!!", 0), (4, "One, two\nthree four five six seven eight nine TEN.", 0), (5, f"x y {item}", 0), (5, f"x y {item}", 0), (None, f"{item} " * 30000, 0), (6, "one two three", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, leaks int")
    items = spark.createDataFrame([(1, item), (None, "x"), (2, None), (3, " "), (4, "zz")], "item_id long, text string")
    out = {(r["doc_id"], tuple((x["item"], x["distance"], x["start"], x["end"]) for x in r["leaks"])) for r in find_leaks(df, items).collect()}
    assert out == {(1, ()), (2, ()), (3, ()), (4, ((1, 0, 0, 10),)), (5, ((1, 0, 2, 12),)), (None, ((1, 0, 0, 10),)), (6, ())}
    assert sorted(str(r["doc_id"]) for r in decontaminate(df, items).collect()) == ["1", "2", "3", "6"]
    assert decontaminate(df, items.limit(0)).count() == len(docs) and find_leaks(df.limit(0), items).count() == 0


def test_recall_at_the_greatest_distance(spark):
    rng = np.random.default_rng(4)
    sizes, items, docs = (4, 8, 13, 20, 30, 60, 120), [], []
    for n in sizes:
        for _ in range(60):
            k = len(items)
            words = [f"v{x}" for x in rng.integers(0, 5000, n)]
            items.append((k, " ".join(words)))
            for at in rng.choice(n, int(EDITS * n), replace=False) if k % 2 else rng.integers(0, n - int(EDITS * n), int(EDITS * n)):
                kind = 0 if k % 2 else int(rng.integers(0, 3))  # changes only, or also added and dropped words
                words[at : at + (kind != 1)] = [f"e{rng.integers(0, 5000)}"] * (kind != 2)
            fill = [f"v{x}" for x in rng.integers(0, 5000, 80)]
            at = int(rng.integers(0, 80))
            docs.append((k, " ".join(fill[:at] + words + fill[at:])))
    out = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = {r["doc_id"] for r in out.collect() for x in r["leaks"] if x["item"] == r["doc_id"] and x["distance"] <= int(EDITS * len(items[x["item"]][1].split()))}
    for i, n in enumerate(sizes):
        assert sum(60 * i <= k < 60 * i + 60 for k in found) >= 56, n


def test_parts_are_more_than_edits():
    for n in range(1, 300):
        at = parts_of(n)
        assert at[0] == 0 and at[-1] == n and len(at) == edits_of(n) + 2 and all(a < b for a, b in zip(at, at[1:], strict=False))


def test_blocks_of_a_large_benchmark(spark, monkeypatch):
    import groundframe.llm.decontam as m

    docs = spark.createDataFrame([(k, f"a{k} b{k} c{k} d{k} e{k} f{k} g{k} h{k} and more") for k in range(6)], "doc_id long, text string")
    items = spark.createDataFrame([(k, f"a{k} b{k} c{k} d{k} e{k} f{k} g{k} h{k}") for k in range(6)], "item_id long, text string")
    monkeypatch.setattr(m, "BLOCK_WORDS", 12)
    assert [[x["item"] for x in r["leaks"]] for r in find_leaks(docs, items).orderBy("doc_id").collect()] == [[k] for k in range(6)]


def test_long_items_are_found_at_the_greatest_distance(spark):
    """One edit in every part but one: a single part of the item stands unedited."""
    rng = np.random.default_rng(17)
    items, docs = [], []
    for n in (150, 200, 300, 400, 1000):
        for _ in range(12):
            k = len(items)
            words = [f"i{x}" for x in rng.integers(0, 100_000, n)]
            items.append((k, " ".join(words)))
            at, whole, out = parts_of(n), int(rng.integers(edits_of(n) + 1)), []
            for j, (a, b) in enumerate(zip(at, at[1:], strict=False)):
                part = words[a:b]
                if j != whole:
                    x, what = int(rng.integers(len(part))), int(rng.integers(3))
                    part = part[:x] + [f"e{rng.integers(0, 999)}"] * (what < 2) + part[x + (what > 0) :]
                out += part
            fill = [f"f{x}" for x in rng.integers(0, 3000, 200)]
            docs.append((k, " ".join(fill[:90] + out + fill[90:])))
    out = find_leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], x["item"]) for r in out.collect() for x in r["leaks"]}
    assert got <= {(k, k) for k, _ in items}
    assert {(k, k) for k, t in items if len(t.split()) > 256} <= got and len(got) >= len(items) - 1
