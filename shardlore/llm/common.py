"""What the operators share: the shared folder, stages that are written and read again, and input columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import shared_dir


def settle(df: DataFrame, *partition_by: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again, so that its lineage ends there and a lost executor costs no recomputation. unsettle() removes it, else the session's end."""
    path = shared_dir(df.sparkSession, "stage")
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path) if not partition_by else df.sparkSession.read.parquet(path)
    out.settled_path = path
    return out


def unsettle(*tables: DataFrame) -> None:
    """Removes what settle() wrote, once nothing reads it any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.settled_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def input_bytes(df: DataFrame) -> int:
    """Spark's estimate of the size of what df reads, from its files; nothing is read. What has no known size counts nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)


def lowest(df: DataFrame, hashed: Column, most: int) -> DataFrame:
    """The rows with the `most` lowest hashes, with the hash as column "hash"; rows of one hash are one. The cut is found by counting hashes by their first 16 bits, so no task and no driver sees more than `most` and a 65,536th of all."""
    d = df.withColumn("hash", F.shiftrightunsigned(hashed, 1))
    hashes, first = d.select("hash").distinct(), F.shiftright("hash", 47)
    cut, n = 0, 0
    for r in sorted(hashes.groupBy(first.alias("first")).count().collect()):
        cut, n = r["first"], n + r["count"]
        if n >= most:
            break
    near = sorted(r["hash"] for r in hashes.where(first <= cut).collect())
    return d.where(F.col("hash") <= (near[min(most, len(near)) - 1] if near else -1)).dropDuplicates(["hash"])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns, under fixed names, whatever else the table has."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
