"""URL filters (operator 5): longest matching rule, else gradient-boosted trees on lexical features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut, fresh, others

#: (verdict, rule); a rule is a host and the start of a path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Labelled URLs that the trees are trained on, at most.
TRAIN_ROWS = 20_000
FEATURES = ("len", "host_len", "path_len", "depth", "dots", "hyphens", "digit_ratio", "entropy", "params", "fragment", "https", "suffix_rate", "suffix_n", "ext_rate")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule whose host is this one or above it and whose path this one starts with, and its verdict; else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, text in sorted(rules, key=lambda r: len(r[1])):
        top, at = text[: text.index("/")], text[text.index("/") :]
        fits = ((host == top) | host.endswith("." + top)) & path.startswith(at)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(say)).otherwise(verdict)
    return rule, verdict


def entropy_of(text: Column) -> Column:
    """Shannon entropy of a text's characters, in bits; 0 for an empty one."""
    n = F.length(text)
    chars = F.split(text, "", -1)
    each = F.transform(F.array_distinct(chars), lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.when(n > 0, F.aggregate(F.filter(each, lambda p: p > 0), F.lit(0.0), lambda s, p: s - p * F.log2(p))).otherwise(F.lit(0.0))


def with_lexical(df: DataFrame, url: str, host: str, path: str) -> DataFrame:
    """`df` with the lexical features, and the keys (suffix, ext) of the suffix statistics."""
    u = F.coalesce(F.col(url), F.lit(""))
    count = lambda pattern: F.size(F.split(u, pattern, -1)) - 1.0
    n = F.greatest(F.length(u), F.lit(1))
    return df.withColumns({
        "len": F.length(u) * 1.0, "host_len": F.length(host) * 1.0, "path_len": F.length(path) * 1.0,
        "depth": F.size(F.filter(F.split(path, "/", -1), lambda x: x != "")) * 1.0, "dots": F.size(F.split(host, "[.]", -1)) - 1.0,
        "hyphens": F.size(F.split(host, "-", -1)) - 1.0, "digit_ratio": count("[0-9]") / n, "entropy": entropy_of(u),
        "params": F.when(F.instr(u, "?") > 0, F.size(F.split(F.regexp_extract(u, r"\?([^#]*)", 1), "&", -1)) * 1.0).otherwise(0.0),
        "fragment": F.when(F.instr(u, "#") > 0, 1.0).otherwise(0.0), "https": F.when(u.startswith("https:"), 1.0).otherwise(0.0),
        "suffix": F.element_at(F.split(host, "[.]", -1), -1), "ext": F.regexp_extract(path, r"[.]([A-Za-z0-9]{1,8})$", 1),
    })


@dataclass
class UrlModel:
    """Fitted trees with the statistics of host suffixes and path extensions (each at most TRAIN_ROWS rows)."""

    trees: PipelineModel | None
    suffixes: DataFrame
    extensions: DataFrame
    prior: float


def _rates(train: DataFrame, key: str) -> DataFrame:
    """Labelled URLs and blocked ones for each value of `key`."""
    return train.groupBy(key).agg(F.count("*").alias(f"{key}_all"), F.sum("y").alias(f"{key}_blocked"))


def _featured(df: DataFrame, m: UrlModel, own: Column | None = None) -> DataFrame:
    """Smoothed shares of blocked URLs joined: both tables have at most TRAIN_ROWS short rows, so they are broadcast.

    A labelled row (`own`: its label) is left out of the shares that it is given, so they tell it nothing of its label.
    """
    df = df.join(F.broadcast(m.suffixes), "suffix", "left").join(F.broadcast(m.extensions), "ext", "left")
    for key in ("suffix", "ext"):
        n, y = F.coalesce(f"{key}_all", F.lit(0)), F.coalesce(f"{key}_blocked", F.lit(0.0))
        if own is not None:
            n, y = n - 1, y - own
        df = df.withColumns({f"{key}_rate": (y + 5 * m.prior) / (n + 5), f"{key}_n": F.log1p(n)})
    return df


def fit_urls(labelled: DataFrame, *, url: str = "url", label: str = "label", rows: int = TRAIN_ROWS, rounds: int = 20, depth: int = 4) -> UrlModel:
    """Trees on at most `rows` labelled URLs (label 1: block), those of the smallest hash of the URL.

    Rows that agree in URL and label count once, and are first thinned by hash to about twice as many, so that no task
    sorts more. Null labels are left out. With
    one class only, or no rows, the model is the share of blocked URLs (0 without rows).
    """
    base = labelled.where(F.col(label).isNotNull()).select(F.col(url).alias("u"), F.col(label).cast("double").alias("y")).withColumn("at", F.xxhash64("u", "y"))
    share = 2 * rows / max(1, base.agg(F.approx_count_distinct("at")).first()[0])
    if share < 1:
        base = base.where(F.pmod("at", F.lit(1 << 30)) < int(share * (1 << 30)))
    base = base.distinct().orderBy(F.pmod("at", F.lit(1 << 30)), "u", "y").limit(rows).drop("at")
    base = cut(with_lexical(base.withColumns({"h": host_of(F.col("u")), "p": path_of(F.col("u"))}), "u", "h", "p"))
    n, blocked = base.agg(F.count("*"), F.sum("y")).first()
    prior = (blocked or 0.0) / n if n else 0.0
    model = UrlModel(None, cut(_rates(base, "suffix")), cut(_rates(base, "ext")), prior)
    if n and 0 < blocked < n:
        data = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(_featured(base, model, F.col("y"))).select("x", "y").coalesce(4).persist()
        model.trees = PipelineModel([GBTClassifier(featuresCol="x", labelCol="y", maxIter=rounds, maxDepth=depth, seed=7, maxMemoryInMB=64, checkpointInterval=-1, cacheNodeIds=False).fit(data)])
        data.unpersist()
    return model


def judge_urls(pages: DataFrame, model: UrlModel | None = None, *, url: str = "url", rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """`pages` with host, path, rule, block_score (null where a rule decides) and verdict.

    Without a `model`, one is fitted on the URLs of `pages` that a rule decides. A null URL, or one
    without ://, has an empty host and path, so no rule; the trees judge it like any other. Rows are
    independent: repeated rows and extra columns pass through (columns of the same names are replaced).
    """
    made = ["host", "path", "rule", "block_score", "verdict"]
    rest = others(pages, *made)
    (u,) = fresh(pages, "url_in")
    own = pages.select(F.struct(*rest).alias(u), F.col(url).alias("url_"))
    own = own.withColumns({"host": host_of(F.col("url_")), "path": path_of(F.col("url_"))})
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    own = own.withColumns({"rule": rule, "said": verdict})
    if model is None:
        model = fit_urls(own.select(F.col("url_").alias("url"), F.when(F.col("said") == "block", 1).when(F.col("said") == "allow", 0).alias("label")))
    ready = _featured(with_lexical(own, "url_", "host", "path"), model)
    if model.trees is None:
        ready = ready.withColumn("score", F.lit(model.prior))
    else:
        ready = model.trees.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(ready)).withColumn("score", vector_to_array("probability")[1])
    score = F.when(F.col("said").isNull(), F.col("score"))
    verdict = F.coalesce("said", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return ready.select(f"{u}.*", "host", "path", "rule", score.alias("block_score"), verdict.alias("verdict"))
