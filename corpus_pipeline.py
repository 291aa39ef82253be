"""A corpus pipeline of five stages, each written as Parquet and read again as the next one's documents.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents. Rows are
dropped by a key of their own, not by doc_id, which may be null or repeated. Null and empty texts pass all stages; an empty table
stays empty. ORACLE_SQL is None: training and packing are beyond SQL; tests compare run() with brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardlore.llm.common import settle, table, unsettle
from shardlore.llm.decontaminate import contamination
from shardlore.llm.jaccard import similar
from shardlore.llm.packing import harmonic_pack
from shardlore.llm.secrets import redact
from shardlore.llm.toxicity import reject_toxic

ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.7 or more go."""
    return reject_toxic(docs, table(spark, sf_dir, "labels"))


def _own(docs: DataFrame, name: str) -> str:
    """A column name that docs don't have."""
    while name in docs.columns:
        name += "_"
    return name


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a key for each row, written once: numbers that are computed anew may change with the cluster."""
    row = _own(docs, "shardlore_row")
    return settle(docs.withColumn(row, F.monotonically_increasing_id())), row


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents, one row with the smallest doc_id stays, and one of the rows without a doc_id."""
    rows, row = _keyed(docs)
    groups = similar(rows, id_col=row).select(F.col("doc_id").alias(row), "component_id").join(rows.select(row, "doc_id"), row)
    kept = groups.groupBy("component_id", F.col("doc_id").isNull()).agg(F.min(F.struct("doc_id", row))[row].alias(row)).select(row)
    return rows.join(kept, row, "left_semi").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated rows go."""
    rows, row = _keyed(docs)
    gone = contamination(rows, table(spark, sf_dir, "benchmark"), id_col=row).where("contaminated").select(F.col("doc_id").alias(row))
    return rows.join(gone, row, "left_anti").select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows the text."""
    old = _own(docs, "shardlore_hash")
    out = redact(docs.withColumn(old, F.xxhash64("text")))
    return out.withColumn("n_chars", F.when(F.xxhash64("text") != F.col(old), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).drop(old)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return harmonic_pack(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
        if last is not None:
            unsettle(last)  # the next stage has been written from it
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
