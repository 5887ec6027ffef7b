import zlib

from groundframe.llm.langid import fit_language, identify
from groundframe.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = {r["doc_id"]: r for r in QUERIES["op7_language"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(out) == len(docs)
    hits = total = 0
    for d in docs:
        r = out[d["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        if r["held_out"]:
            total += 1
            hits += r["lang_pred"] == d["lang"]
    assert total > 200 and hits / total > 0.97


def test_edges(spark):
    rows = [(i, "the quick brown fox and the dog " * 4, "en", 0) for i in range(1, 30)] + [(i, "der schnelle braune fuchs und ein hund " * 4, "de", 0) for i in range(30, 60)]
    rows += [(100, None, "en", 0), (101, "", "en", 0), (102, "12 !! 34", "en", 0), (None, "the fox", None, 0), (103, "the fox " * 50_000, None, 0), (103, "the fox", None, 0), (103, "the fox", None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, told int")
    out = [(r["doc_id"], r["lang_pred"], r["told"]) for r in identify(df, fit_language(df)).collect()]
    assert len(out) == len(rows)
    assert {p for i, p, _ in out if i in (100, 101, 102)} == {"und"} and {p for i, p, _ in out if i in (None, 103)} == {"en"}
    assert {p for i, p, _ in out if i and i < 30} == {"en"} and {p for i, p, _ in out if i and 30 <= i < 60} == {"de"}
    empty = df.limit(0)
    assert fit_language(empty) is None and identify(empty, None).count() == 0
    assert {r["lang_pred"] for r in identify(df, None).collect()} == {"und"}
