"""Line dedup (operator 3): drops lines that many documents share. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, cut, fresh, others

#: The table of shared lines is broadcast up to this many rows of two longs (about 40 MB in memory).
BROADCAST_ROWS = 500_000


def line_key(line: Column) -> Column:
    """A line's key, up to renaming: ASCII white space stripped at both ends, A-Z lower-cased.

    Lines outside ASCII are lower-cased byte by byte, as Latin-1: `translate`, which leaves other letters alone, is ten
    times slower. That changes lead bytes too (C0 to DE), but no two different lines of UTF-8 become the same: the number
    of continuation bytes behind a lead byte, which stay, tells the changed ones from those that were so before.
    """
    line = F.trim(line, F.lit(WHITE))
    return F.lower(F.when(F.length(line) == F.octet_length(line), line).otherwise(F.decode(line.cast("binary"), "ISO-8859-1")))


def _hash(key: Column) -> Column:
    """128 bits of a key, as two independent 64-bit hashes; null for an empty key."""
    return F.when(key != "", F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2")))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: int = 10) -> DataFrame:
    """`docs` with `text_col` less its shared lines, and n_lines, n_dropped (before any such columns).

    Lines are exploded per document with their place and their normalised key hashed; a hash found in at least
    `threshold` distinct ids is dropped from every document and the rest is reassembled by place.
    A null or empty text is one empty line, and comes back empty; empty keys are never dropped. Rows
    that repeat an id count once; null ids count together as one more id. Each row keeps its own text
    and its extra columns (those named n_lines or n_dropped, in any case, are replaced). An empty table
    gives an empty table.

    Candidates are hashes of enough lines (a count combined before the shuffle); only their rows (id, hash, place)
    are counted again by distinct id, so a line that a third of all documents share is never
    gathered in one task. The rows find the candidates by a broadcast join
    while these are few, else by a shuffled join. A document's dropped places are taken from all its places as a set,
    so the work grows with its lines.
    """
    key, tag, hashes, gone, old, parts = fresh(docs, "line_id", "line_tag", "line_hashes", "line_gone", "line_text", "line_parts")
    own = docs.withColumn(old, F.coalesce(F.col(text_col), F.lit("")))
    lines = F.split(F.col(old), "\n", -1)
    seen = own.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tag"), F.posexplode(lines).alias("place", "line"))
    seen = seen.select("id", "tag", "place", _hash(line_key(F.col("line"))).alias("h")).where("h is not null").select("id", "tag", "place", "h.h1", "h.h2")
    often = cut(seen.groupBy("h1", "h2").count().where(F.col("count") >= threshold).select("h1", "h2"))
    few = often.count() <= BROADCAST_ROWS
    hits = cut(seen.join(F.broadcast(often) if few else often, ["h1", "h2"], "left_semi"))
    ids = hits.select("h1", "h2", "id").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n"))  # a null id counts
    shared = ids.where(F.col("n") >= threshold).select("h1", "h2")
    drop = (
        hits.join(F.broadcast(shared) if few else shared, ["h1", "h2"], "left_semi")
        .groupBy("id", "tag")
        .agg(F.collect_set("place").alias(gone))
        .select(F.col("id").alias(key), F.col("tag").alias(tag), gone)
    )
    out = own.withColumn(hashes, F.xxhash64(text_col))
    out = out.join(drop, F.col(id_col).eqNullSafe(F.col(key)) & (F.col(hashes) == F.col(tag)), "left")
    out = out.withColumn(parts, lines)
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone))
    kept = F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n")
    rest = others(docs, text_col, "n_lines", "n_dropped")
    return out.select(
        *rest, F.size(parts).cast("long").alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col(gone).isNull(), F.col(old)).otherwise(kept).alias(text_col),
    )
