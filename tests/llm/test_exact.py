import hashlib
import random
import re

from groundframe.llm.exact import exact_duplicates
from groundframe.llm.queries import QUERIES


def brute(rows):
    """Sorted (id, keep_id, size, sha256) and the number of rows kept a group."""
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (m[0], m[1], m[2] or 0))[2]
        out += [(str(m[2]), str(keep), len(members), hashlib.sha256(norm.encode()).hexdigest()) for m in members]
    return sorted(out), groups


def check(df, rows):
    got = exact_duplicates(df).collect()
    want, groups = brute(rows)
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in kept}) == len(groups)
    assert all(r["keep_id"] == r["doc_id"] for r in kept)


def test_groups_of_any_size_over_partitions(spark):
    """A group with a third of all rows and more lies in many partitions, whole partitions hold one group, and some are empty."""
    rng = random.Random(4)
    rows = [(i, "same text" + " " * rng.randrange(3)) for i in range(700)] + [(1000 + i, f"near {i % 40}\n") for i in range(300)] + [(2000 + i, f"own {i}") for i in range(300)]
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "3", "90"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\x0b\x0c\r\n"), (4, "a b"), (4, "a b"), (5, "ab  "), (None, "a b "), (None, None), (6, " "), (7, "é" * 3), (8, "é" * 3), (9, "x" * 300_000), (9, "x " * 300_000)]
    df = spark.createDataFrame([(i, t, "k", 2) for i, t in rows], "doc_id long, text string, KEPT string, `a.b` int")
    out = exact_duplicates(df)
    assert out.columns == ["doc_id", "text", "a.b", "keep_id", "group_size", "kept", "text_sha256"]
    assert exact_duplicates(df, carry=["a.b"]).columns[:2] == ["doc_id", "a.b"]
    check(df, rows)
    check(df.limit(0), [])
    text_ids = exact_duplicates(spark.createDataFrame([("b", "x"), ("a", "x")], "doc_id string, text string")).collect()
    assert {r["keep_id"] for r in text_ids} == {"a"}


def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in QUERIES["op11_exact"](spark, sf).collect())
    assert got == brute(rows)[0]
