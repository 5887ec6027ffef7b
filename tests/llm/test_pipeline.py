import unicodedata

from pyspark.sql import types as T

import corpus_pipeline
from groundframe.llm.decontam import EDITS, best_match, words_of
from groundframe.llm.queries import QUERIES

from . import brute


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def test_run_equals_brute_force(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    docs = {i: t for i, t in docs.items() if t and any(unicodedata.category(c)[0] == "L" for c in t)}
    seen = {}
    for i, t in docs.items():
        for line in {key(x) for x in t.split("\n")} - {""}:
            seen.setdefault(line, set()).add(i)
    docs = {i: "\n".join(x for x in t.split("\n") if len(seen.get(key(x), ())) < 10) for i, t in docs.items()}
    comp = brute.minhash(list(docs.items()))
    docs = {i: t for i, t in docs.items() if comp[i][1] == i}
    items = [words_of(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = {i: t for i, t in docs.items() if not any(best_match(x, words_of(t))[0] <= int(EDITS * len(x)) for x in items)}
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"]: r["text"] for r in out} == docs
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in out)


def test_stages_keep_columns_and_bear_odd_rows(spark, sf, tmp_path):
    whole = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None, 1), (1, "", "en", "s", 0, 2), (2, "12 34", None, None, None, 3), (2, "12 34", None, None, None, 3), (3, "word " * 9, "en", "s", 1, 4)], T.StructType([*whole.schema, T.StructField("ids", T.IntegerType())]))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, sf)
        assert out.columns == odd.columns, name
        assert stage(spark, odd.limit(0), sf).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, odd, sf).count() == 5


def test_one_row_of_each_group_stays(spark):
    t, u = " ".join(f"t{k}" for k in range(40)), " ".join(f"u{k}" for k in range(40))
    for rows, want in [
        ([(1, t), (None, t), (None, u)], [(1, t), (None, u)]),
        ([(0, t), (1, t), (1, u)], [(0, t), (1, u)]),
        ([(0, t), (0, t), (None, u), (None, u)], [(0, t), (None, u)]),
        ([(0, None), (0, None), (1, None)], [(0, None), (1, None)]),
    ]:
        df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "1L as n_chars", "5 as `a.b`")
        out = corpus_pipeline.near_dedup(spark, df, "")
        assert out.columns == df.columns and sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted(want, key=str)


def test_line_dedup_keeps_own_columns(spark):
    df = spark.createDataFrame([(k, "same\nown" + str(k), 777, 888) for k in range(12)], "doc_id long, text string, n_lines int, N_dropped int").selectExpr("*", "0L as n_chars", "1 as `a.b`")
    out = corpus_pipeline.line_dedup(spark, df, "")
    assert out.columns == df.columns
    assert {tuple(r) for r in out.collect()} == {(k, f"own{k}", 777, 888, len(f"own{k}"), 1) for k in range(12)}


def test_every_operator_has_its_query():
    assert {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 14)}
