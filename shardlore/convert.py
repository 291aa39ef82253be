"""Conversion of flat shards into the indexed layout: list, check, plan, copy by range, commit the index.

    python -m shardlore.convert INPUT OUTPUT -p N [-e ENGINE]

The engine is taken for compatibility; Spark schedules reads and writes. Output may be the input folder: nothing is removed."""

from __future__ import annotations

import argparse
import sys
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import validate
from .plans import partition
from .sources import flat, indexed, sinks
from .sources.files import exists, listing

ENGINES = ("sync", "tokio", "io-uring")


@dataclass(frozen=True)
class Converter:
    """Converter().with_partitions(8).plan(spark, folder); .convert(spark, folder, out)."""

    partitions: int = 1
    engine: str = "sync"
    chunk_bytes: int = flat.CHUNK_BYTES

    def __post_init__(self):
        if self.partitions < 1:
            raise ValueError("partition count must be 1 at least")
        if self.engine not in ENGINES:
            raise ValueError(f"unsupported backend: {self.engine}")

    def with_partitions(self, n: int) -> Converter:
        return replace(self, partitions=n)

    def with_engine(self, engine: str) -> Converter:
        return replace(self, engine=engine)

    def plan(self, spark: SparkSession, directory: str) -> DataFrame:
        """The planned catalogue; raises for a manifest that differs, a repeated name, an unknown type, or no tensors."""
        files = listing(spark, directory, f"*{flat.SUFFIX}")
        tensors = flat.catalog(spark, directory).withColumn("model", F.lit(directory)).cache()
        manifests = listing(spark, directory, f"*{flat.SUFFIX}.index.json").select("path")
        if paths := [r["path"] for r in manifests.collect()]:
            texts = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("manifest"), F.col("value").alias("text"))
            validate.enforce(validate.manifest_mismatches(texts, files))
        validate.enforce(validate.violations(tensors))
        if tensors.isEmpty():
            raise partition.NothingToPlan(f"nothing to convert: the shards of {directory} hold no tensor")
        return partition.plan(tensors, self.partitions)

    def convert(self, spark: SparkSession, directory: str, output: str) -> DataFrame:
        """Writes the layout and returns its statistics."""
        planned = self.plan(spark, directory).cache()
        sinks.write_partitions(planned, output, self.chunk_bytes).collect()  # a row per partition
        sinks.commit_index(planned.select("name", F.col("dest_offset").alias("offset"), "size", "shape", "stride", "dtype", "partition_id"), output)
        return partition.stats(planned, self.partitions).drop("model")


def ensure_converted(spark: SparkSession, directory: str, output: str, partitions: int = 1) -> str:
    """output, converted first unless its index is there: the index is written last, so it marks a whole artefact."""
    if not exists(spark, f"{output.rstrip('/')}/{indexed.INDEX}"):
        Converter(partitions).convert(spark, directory, output)
    return output


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="shardlore.convert")
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("-p", "--partitions", type=int, required=True)
    p.add_argument("-e", "--engine", choices=ENGINES, default="sync")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("convert").getOrCreate()
    try:
        s = Converter(a.partitions, a.engine).convert(spark, a.input, a.output).first()
    except Exception as e:  # the command's contract: a message and 1
        print(f"conversion failed: {e}", file=sys.stderr)
        return 1
    print(f"{s['tensor_count']} tensors, {s['total_bytes']} bytes in {s['partition_count']} partitions (those without tensors have no file): {a.output}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
