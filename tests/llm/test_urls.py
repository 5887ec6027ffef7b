import re

from groundframe.llm.queries import QUERIES
from groundframe.llm.urls import RULES, fit_urls, judge_urls


def plain(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].lower(), m[2]) if m else ("", "")
    best = None
    for verdict, rule in RULES:
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    return host, path, best


def test_query_follows_the_rules(spark, sf):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    out = QUERIES["op5_urls"](spark, sf).collect()
    assert len(out) == len(pages)
    for r in out:
        host, path, best = plain(pages[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[1])
        assert r["verdict"] == best[0] if best else r["verdict"] in ("allow", "block")


def test_trees_learn_lexical_patterns(spark):
    rows = [(f"http://site{i}.org/{'a' * (i % 5 + 1)}/{i}" + ("?x=1&y=2&z=3" if i % 2 else ""), i % 2) for i in range(600)]
    df = spark.createDataFrame(rows, "url string, label int")
    model = fit_urls(df.where("label is not null").limit(400))
    out = judge_urls(df, model, rules=()).collect()
    assert sum((r["verdict"] == "block") == bool(r["label"]) for r in out) > 0.97 * len(out)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "HTTP://A.COM/x?y"), (5, "x://net/es/#f"), (6, "http://com"), (7, "http://www.Example.com/en/a"), (8, "http://x.example.com/en/a?u=http://b.net/fr/"), (8, "a://b.org/" + "q/" * 20000)]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("page_id", "url", "page_id as score", "url as host")
    out = judge_urls(df).collect()
    assert len(out) == len(rows)
    for r in out:
        host, path, best = plain(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[1]) and r["verdict"] in ("allow", "block")
    assert judge_urls(df.limit(0)).count() == 0
