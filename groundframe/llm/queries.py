"""The queries of the dealt operators, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sha(c):
    return F.sha2(c, 256)


def bpe_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    from .bpe import Bpe

    bpe = Bpe(spark, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
    ids = bpe.encode(_read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ids")
    return ids.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), _sha("ids").alias("ids_sha256"), _sha(bpe.decode(F.col("ids"))).alias("decoded_sha256"))


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan_secrets, written

    found = scan_secrets(_read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets")
    n = lambda k: F.size(F.filter("secrets", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("secrets", lambda x: x["kind"] < 3)
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), _sha(written(base)).alias("base_sha256"), written(F.col("secrets")).alias("spans"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import dedup_lines

    out = dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", _sha("text").alias("kept_sha256"))


def leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it leaks."""
    from .decontam import find_leaks

    out = find_leaks(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    out = out.select("doc_id", F.explode("leaks").alias("leak"))
    return out.select("doc_id", F.col("leak.item").alias("item_id"), "leak.distance", F.col("leak.start").alias("start_word"), F.col("leak.end").alias("end_word"))


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judge_urls

    return judge_urls(_read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "block_score")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each passage of 50 words or more that is like one of an earlier document."""
    from .passages import near_passages

    out = near_passages(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        F.col("doc").alias("doc_id"), F.col("start").alias("start_word"), F.col("end").alias("end_word"), F.col("other").alias("other_doc_id"),
        F.col("other_start").alias("other_start_word"), F.col("other_end").alias("other_end_word"), "similarity",
    )


def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit_language, held_out, identify

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs.select("doc_id", "text"), fit_language(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def near_vecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectors import near_vectors

    return near_vectors(_read(spark, sf_dir, "embeddings"))


def substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import dedup_substrings

    out = dedup_substrings(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", _sha("kept").alias("kept_sha256"))


def exact_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact import exact_duplicates

    return exact_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text"), carry=[])


def whitened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each vector and component."""
    from .whiten import whiten

    out = whiten(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    out = out.select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.get("explained", "at").alias("explained"), "identity_error")


def _periodic_texts(docs: DataFrame) -> DataFrame:
    """The documents, a tenth of them (by the hash of their ids) with words from a place on that repeat with a period, as the query asks."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    docs = docs.withColumn("w", F.when(h % 10 == 0, words))
    docs = docs.withColumn("g", F.floor(h / 10)).withColumn("a", F.col("g") % F.greatest(F.size("w"), F.lit(1)))
    docs = docs.withColumn("p", 1 + F.floor((F.size("w") - F.col("a")) / (3 + F.col("g") % 8)))
    repeated = F.transform("w", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return docs.select("doc_id", F.when(F.size("w") > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .runs import periodic_runs

    out = periodic_runs(_periodic_texts(_read(spark, sf_dir, "documents").select("doc_id", "text")))
    ahead = lambda x, y: x["length"] * y["period"] - y["length"] * x["period"]  # noqa: E731  of two runs, by exact length / period
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    # runs come by start, then period, so the first of equals stays
    best = F.aggregate("runs", none, lambda b, x: F.when(b.isNull() | (ahead(x, b) > 0), x).otherwise(b))
    written = F.array_join(F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n"))), "")
    out = out.withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        _sha(written).alias("runs_sha256"), _sha("collapsed").alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_bpe": bpe_ids,
    "op2_secrets": secrets,
    "op3_lines": lines,
    "op4_leaks": leaks,
    "op5_urls": urls,
    "op6_passages": passages,
    "op7_language": language,
    "op8_minhash": near_dups,
    "op9_vectors": near_vecs,
    "op10_suffix": substrings,
    "op11_exact": exact_dups,
    "op12_whiten": whitened,
    "op13_runs": word_runs,
}

LINES_SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
often AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE key IN (SELECT key FROM often)) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE key NOT IN (SELECT key FROM often)), '')) AS kept_sha256
FROM k GROUP BY doc_id
"""

#: Groups by the normalised text itself; the first row of a group by length, then id, stays.
EXACT_SQL = """
WITH d AS (SELECT doc_id, coalesce(length(text), 0) AS n, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS t FROM documents),
g AS (SELECT doc_id, t, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER w = 1 AS kept FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id))
SELECT doc_id, keep_id, group_size, kept, sha256(t) AS text_sha256 FROM g
"""

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Links between equal shingles, then everything reachable: for small tables.
MINHASH_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s), x AS (SELECT doc_id, unnest(s) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id AS id, doc_id AS r FROM n UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.id)
SELECT doc_id, n AS n_shingles, min(r) AS component_id, doc_id = min(r) AS kept FROM n JOIN reach ON id = doc_id GROUP BY doc_id, n
"""

VECTORS_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT vec_id AS id, vec_id AS r FROM embeddings UNION SELECT l.b, reach.r FROM reach JOIN l ON l.a = reach.id),
c AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(any_value(n), 0) AS n_links, min(r) AS component_id, vec_id = min(r) AS kept
FROM embeddings JOIN reach ON id = vec_id LEFT JOIN c ON a = vec_id GROUP BY vec_id
"""


def _secrets_sql() -> str:
    assign = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
    access, hexes, candidate, hex_class = "AKIA[A-Z0-9]+", "[0-9a-f]+", "[A-Za-z0-9+/_-]{20,}={0,2}", "^[0-9a-fA-F]+$"
    window, bits_hex, bits_base64 = 20, 3.0, 3.9
    allowed = ("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", "^[A-Za-z/_=+-]+$", "^[0-9/_=+-]+$")
    names = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
    q = lambda t: "'" + t.replace("'", "''") + "'"

    def found(name: str, pattern: str, group: int) -> str:
        p = q(pattern)
        return f"""{name}_r AS (SELECT doc_id, unnest(string_split_regex(t, {p})) AS gap, unnest(regexp_extract_all(t, {p})) AS hit, unnest(regexp_extract_all(t, {p}, {group})) AS part,
unnest(range(len(string_split_regex(t, {p})))) AS i FROM d WHERE regexp_matches(t, {p})),
{name} AS (SELECT doc_id, hit, part, CAST(sum(length(gap) + coalesce(length(hit), 0)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS stop FROM {name}_r)"""

    base = " UNION ALL ".join(
        f"SELECT doc_id, stop - length(hit) AS a, {k} AS k, stop AS b FROM {n} WHERE hit IS NOT NULL AND length(part) >= {least}" for k, (n, least) in enumerate((("assign", 6), ("access", 20), ("hex", 24)))
    )
    allow = " OR ".join(f"regexp_matches(hit, {q(a)})" for a in allowed)
    kinds = "[" + ", ".join(map(q, names)) + "]"
    words = f"string_agg({kinds}[k + 1] || ':' || a || ':' || b, ',' ORDER BY a, k, b)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {found("assign", assign, 2)}, {found("access", access, 0)}, {found("hex", hexes, 0)}, {found("cand", candidate, 0)},
base AS ({base}),
c AS (SELECT doc_id, hit, stop - length(hit) AS a, CASE WHEN regexp_matches(hit, {q(hex_class)}) THEN 3 ELSE 4 END AS k FROM cand WHERE hit IS NOT NULL AND NOT ({allow})),
win AS (SELECT doc_id, a, k, unnest(range(length(hit) - {window - 1})) AS i, hit FROM c),
hot AS (SELECT *, i - lag(i) OVER (PARTITION BY doc_id, a ORDER BY i) > {window} AS apart FROM (SELECT *, substr(hit, CAST(i + 1 AS BIGINT), {window}) AS w FROM win)
WHERE list_sum(list_transform(list_distinct(string_split(w, '')), lambda ch: ({window} - length(replace(w, ch, ''))) * log2({window} - length(replace(w, ch, '')))))
  <= {window} * (log2({window}) - CASE k WHEN 3 THEN {bits_hex} ELSE {bits_base64} END) + 1e-9),
runs AS (SELECT doc_id, a + min(i) AS a, k, a + max(i) + {window} AS b FROM (SELECT *, sum(CASE WHEN apart THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, a ORDER BY i) AS run FROM hot) h GROUP BY doc_id, h.a, k, run),
more AS (SELECT * FROM runs r WHERE NOT EXISTS (SELECT 1 FROM base x WHERE x.doc_id = r.doc_id AND x.a < r.b AND r.a < x.b)),
bs AS (SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n0, count(*) FILTER (WHERE k = 1) AS n1, count(*) FILTER (WHERE k = 2) AS n2, {words} AS s FROM base GROUP BY doc_id),
al AS (SELECT doc_id, {words} AS s FROM (SELECT * FROM base UNION ALL SELECT doc_id, a, k, b FROM more) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(bs.s, '')) AS base_sha256, coalesce(al.s, '') AS spans
FROM d LEFT JOIN bs ON bs.doc_id = d.doc_id LEFT JOIN al ON al.doc_id = d.doc_id"""


SQL = {"op2_secrets": _secrets_sql(), "op3_lines": LINES_SQL, "op8_minhash": MINHASH_SQL, "op9_vectors": VECTORS_SQL, "op11_exact": EXACT_SQL}
