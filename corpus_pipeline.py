"""The corpus pipeline: quality classifier, line dedup, near-duplicates, decontamination, BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regimark.llm import bpe, decontaminate, line_dedup, minhash_dedup, quality_fm
from regimark.llm.common import default_path, read_table, stored

#: SQL can't express the first, third and fourth stage; tests hold the stages against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of these documents, doesn't reject."""
    machine = quality_fm.fit_quality(docs, read_table(spark, sf_dir, "labels"), metadata=("n_chars",))
    return quality_fm.append_quality(docs, machine, metadata=("n_chars",)).filter("predicted = 1").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their repeated lines; n_chars follows the text."""
    cut = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by a similarity of 0.8 or more of five-word shingles."""
    gone = stored(minhash_dedup.near_duplicates(docs).filter("NOT kept").select(F.col("doc_id").alias("__gone")).distinct(), "near-gone")
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    flagged = decontaminate.flag_leaks(docs, read_table(spark, sf_dir, "benchmark"))
    return flagged.filter(F.size("leaks") == 0).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text that is left, and digests of them and of the texts decoded from them."""
    return bpe.bpe_encode(docs, default_path("byte_bpe_50k.json"), with_ids=False)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("MinHash near-dedup", near), ("benchmark decontamination", decontaminated), ("BPE encoding and decoding", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written and read again by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
    return docs
