"""The corpus pipeline: language ID, line dedup, MinHash near-dedup, benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of documents; extra columns are carried along. Stages define their results for nulls, repeated rows and empty tables
as their operators do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundframe.llm.bpe import Bpe
from groundframe.llm.common import cut, fresh, named, odd_ids, unique_key
from groundframe.llm.decontam import decontaminate
from groundframe.llm.langid import UNKNOWN, fit_language, identify
from groundframe.llm.lines import dedup_lines
from groundframe.llm.minhash import near_duplicates


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: a null text, or one without any letter."""
    model = fit_language(docs)
    (row,) = fresh(docs, "row")
    told = identify(docs.select("text", F.struct("*").alias(row)), model)
    return told.where(F.col("lang_pred") != UNKNOWN).select(f"{row}.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that ten documents or more share; n_chars follows the text. No document goes, and every other column stays."""
    (row,) = fresh(docs, "row")
    out = dedup_lines(docs.select("doc_id", "text", F.struct(*named(*docs.columns)).alias(row)))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*(new.get(c, F.col(row)[c]).alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, a single row, of each group of near copies: that of the smallest id (one without an id only if none has one)."""
    (key,) = fresh(docs, "row_key")
    odd = odd_ids(docs, "doc_id")
    keyed = unique_key(docs, "doc_id", "text", key)
    kept = near_duplicates(keyed.select(key, "text"), id_col=key).where("kept").select(key).distinct()
    out = keyed.join(kept, key, "left_semi")
    if odd:  # rows that agree in id and text have one key
        out = out.dropDuplicates([key])
    return out.select(*named(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that leak a benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids (packed) and count; the text is what the ids decode to."""
    import public_tokenizers as tokenizers

    coder = Bpe(spark, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
    out = coder.encode(docs, ids_col="ids").withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))
    return out.withColumn("text", coder.decode(F.col("ids")).cast("string"))


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("bpe", bpe)]
#: The language network and the edit distances can't be stated in SQL; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
