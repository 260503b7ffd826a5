"""The training-data pipeline: documents -> packed sequences, in five stages of Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafweave.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from leafweave.llm.common import broadcast_if_small, mark_of, persisted, scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose toxicity score is below the threshold of 0.3, by a model of labels that aren't held out."""
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def _kept(docs: DataFrame, mark: Column, verdicts: DataFrame) -> DataFrame:
    """The rows of docs that verdicts (id, mark, kept) keep. Rows are known by their id and their text's mark: an id that
    stands for several texts has a verdict for each, and of rows that repeat both as many stay as are kept. What is
    dropped is less than what stays, so that is what the documents are joined with."""
    found = verdicts.groupBy(F.col("id").alias("_id"), F.col("mark").alias("_mark")).agg(F.sum(F.col("kept").cast("int")).alias("stay"), F.count("*").alias("rows"))
    found = persisted(found.where("stay < rows"), lasting=True)
    whole = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("id"), mark.alias("mark"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))
    out = whole.join(broadcast_if_small(found.where("stay = 0")), same, "left_anti")
    if (several := found.where("stay > 0")).head(1):  # one row of each
        again = out.join(several, same, "left_semi").dropDuplicates(["id", "mark"])
        out = out.join(several, same, "left_anti").unionByName(again)
    return out.select("doc.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text the one with the largest doc_id."""
    found = exact_dedup.exact_duplicates(docs)
    return _kept(docs, F.sha2(F.coalesce("text", F.lit("")), 256), found.select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("mark"), "kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents of similarity 0.8 or more one."""
    found = near_dedup.near_duplicates(docs)
    return _kept(docs, mark_of(F.col("text")), found.select(F.col("doc_id").alias("id"), "mark", "kept"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's share asks for."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("mixing", mix_sources), ("packing", pack)]

#: Toxicity scores and signatures have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what a stage returns is written to the shared folder and read by the next. What it writes
    on its way goes when that is written."""
    docs = table(spark, sf_dir, "documents").select(COLUMNS)
    for _, stage in STAGES:
        with scratch():
            docs = persisted(stage(spark, docs, sf_dir), lasting=True)
    return docs
