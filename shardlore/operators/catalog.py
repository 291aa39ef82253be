"""Queries of a catalogue: DataFrames with a name column and whatever else."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tensor(catalog: DataFrame, name: str) -> DataFrame:
    """The row of a name, or none."""
    return catalog.where(F.col("name") == name)


def contains(catalog: DataFrame, name: str) -> bool:
    return not tensor(catalog, name).limit(1).isEmpty()


def names(catalog: DataFrame) -> DataFrame:
    """Names in byte order."""
    return catalog.select("name").orderBy("name")


def names_ranked(catalog: DataFrame, by: str) -> DataFrame:
    """Each name's place within its `by`, in byte order."""
    return catalog.select(by, "name", (F.row_number().over(Window.partitionBy(by).orderBy("name")) - 1).alias("place"))


def partition_ids(index: DataFrame) -> DataFrame:
    return index.select("partition_id").distinct().orderBy("partition_id")


def lookup(catalog: DataFrame, asked: DataFrame) -> DataFrame:
    return asked.join(catalog, "name")


def missing(catalog: DataFrame, asked: DataFrame) -> DataFrame:
    return asked.join(catalog, "name", "left_anti")


def duplicates(*catalogs: DataFrame) -> DataFrame:
    """Names that occur more than once in the union, with their count."""
    all_ = catalogs[0].select("name")
    for c in catalogs[1:]:
        all_ = all_.unionByName(c.select("name"))
    return all_.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")


def file_bytes(catalog: DataFrame) -> DataFrame:
    """Bytes of tensors, not of files, per source file."""
    return catalog.groupBy("file_index").agg(F.sum("size").alias("n_bytes"), F.count("*").alias("n_tensors"))


def total_bytes(files: DataFrame) -> DataFrame:
    """Sum of file lengths."""
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes"), F.count("*").alias("n_files"))


def descriptor(files: DataFrame) -> DataFrame:
    """One row for a checkpoint's files (path, name, length): shards in name order, their number and bytes."""
    return files.agg(F.sort_array(F.collect_list("name")).alias("shards"), F.count("*").alias("n_shards"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes"))


def access_order(catalog: DataFrame, order: str = "name", seed: int = 42) -> DataFrame:
    keys = {"name": [F.col("name")], "reverse": [F.desc("name")], "shuffled": [F.xxhash64("name", F.lit(seed)), F.col("name")]}
    if order not in keys:
        raise ValueError(f"unknown order: {order}")
    return catalog.orderBy(*keys[order])


def first_shard(files: DataFrame) -> DataFrame:
    return files.orderBy("path").limit(1)


def touched(chunks: DataFrame) -> DataFrame:
    """Bytes that a full read of all tensors delivers."""
    return chunks.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).alias("n_bytes"))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, with multiplicity; empty where both agree."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
