from groundframe.llm.lines import dedup_lines
from groundframe.llm.queries import QUERIES, SQL

from .oracle import same


def test_edges(spark):
    rows = [(i, f" Same Line\t\nown {i}\n\nÉcole", 0) for i in range(9)]
    rows += [(9, "same line", 0), (9, "same line", 0), (10, None, 0), (11, "", 0), (None, "SAME LINE\n\x0b", 0), (12, "école", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, line_id int")
    out = sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["text"]) for r in dedup_lines(df).collect())
    want = [(str(i), 4, 1, f"own {i}\n\nÉcole") for i in range(9)]
    want += [("9", 1, 1, ""), ("9", 1, 1, ""), ("10", 1, 0, ""), ("11", 1, 0, ""), ("None", 2, 1, "\x0b"), ("12", 1, 0, "école")]
    assert out == sorted(want)
    few = dedup_lines(df.where("doc_id < 9 or doc_id = 10"))  # nine documents: kept
    assert few.agg({"n_dropped": "sum"}).first()[0] == 0
    assert dedup_lines(df.limit(0)).count() == 0
    assert dedup_lines(df.where("doc_id = 9"), threshold=1).first()["n_dropped"] == 1


def test_shuffled_join_gives_the_same(spark, sf, monkeypatch):
    import groundframe.llm.lines as m

    monkeypatch.setattr(m, "BROADCAST_ROWS", -1)
    same(spark, sf, QUERIES["op3_lines"], SQL["op3_lines"])


def test_names_and_brute_force(spark, sf):
    own = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = {r["doc_id"]: (r["text"] or "").split("\n") for r in own.collect()}
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    seen = {}
    for i, lines in docs.items():
        for k in {key(x) for x in lines} - {""}:
            seen.setdefault(k, set()).add(i)
    df = own.selectExpr("doc_id", "text", "1 as N_LINES", "2 as `a.b`", "3 as line_parts", "4 as `n_dropped`")
    out = dedup_lines(df)
    assert out.columns == ["doc_id", "a.b", "line_parts", "n_lines", "n_dropped", "text"]
    for r in out.collect():
        left = [x for x in docs[r["doc_id"]] if len(seen.get(key(x), ())) < 10]
        assert (r["n_lines"], r["n_dropped"], r["text"], r["a.b"]) == (len(docs[r["doc_id"]]), len(docs[r["doc_id"]]) - len(left), "\n".join(left), 2)


def test_work_grows_with_the_lines(spark):
    import time

    took = []
    for n in (1_000, 30_000, 60_000):  # the first is a warm-up
        text = "\n".join(f"line {k}" for k in range(n))
        df = spark.createDataFrame([(i, text) for i in range(10)], "doc_id long, text string")
        start = time.perf_counter()
        assert dedup_lines(df).agg({"n_dropped": "sum"}).first()[0] == 10 * n
        took.append(time.perf_counter() - start)
    assert took[2] < 3 * took[1] + 2
