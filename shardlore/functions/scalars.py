"""Scalar functions over catalogue columns."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 512 << 20


def contiguous_stride(shape: Column) -> Column:
    """Row-major strides in elements: [2, 3, 4] gives [12, 4, 1], [] gives []."""
    tail = lambda i: F.aggregate(F.slice(shape, i + 1, F.size(shape)), F.lit(1).cast("long"), lambda a, x: a * x)
    return F.when(F.size(shape) == 0, F.expr("cast(array() as array<bigint>)")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(shape), F.lit(1))), tail))


def elements(shape: Column) -> Column:
    return F.aggregate(shape, F.lit(1).cast("long"), lambda a, x: a * x)


def slug(model_id: Column) -> Column:
    return F.lower(F.replace(model_id, F.lit("/"), F.lit("-")))


def cache_key(directory: Column, revision: Column, partitions: Column, shards: Column, version: str = "v3") -> Column:
    return F.substring(F.sha2(F.concat_ws(":", directory, revision, partitions.cast("string"), shards.cast("string"), F.lit(version)), 256), 1, 16)


def partition_file(pid: Column) -> Column:
    return F.concat(F.lit("tensor.data_"), pid.cast("string"))


def next_partition(pid: Column) -> Column:
    """The number after a partition's; null where 32 bits end."""
    return F.try_add(pid, F.lit(1))


def partition_ids(spark: SparkSession, n: int) -> DataFrame:
    """partition_id of n partitions, from 0."""
    if n < 1:
        raise ValueError("partition count must be 1 at least")
    return spark.range(n).select(F.col("id").cast("int").alias("partition_id"))


def cache_root(variable: str = "SHARDLORE_CACHE_DIR") -> str:
    """Where converted checkpoints may be kept: what the variable names, else the user's cache folder, else the temporary one."""
    if named := os.environ.get(variable):
        return named
    home = os.environ.get("XDG_CACHE_HOME") or (os.path.join(os.path.expanduser("~"), ".cache") if os.path.expanduser("~") != "~" else tempfile.gettempdir())
    return os.path.join(home, "shardlore")


def auto_partitions(total_bytes: Column, chunk: int = CHUNK) -> Column:
    """One partition per chunk of bytes, one at least."""
    up = total_bytes + F.lit(chunk - 1)
    return F.greatest(F.lit(1).cast("long"), ((up - F.pmod(up, F.lit(chunk))) / F.lit(chunk)).cast("long"))


def checked_end(offset: Column, size: Column) -> Column:
    """offset + size, null where it leaves 64 bits."""
    return F.try_add(offset, size)


def memory_share(model_id: Column) -> Column:
    """Share of a device's memory by the size in a model's name; the first that matches."""
    has = lambda *sizes: F.greatest(*(F.contains(F.lower(model_id), F.lit(s)) for s in sizes)) if len(sizes) > 1 else F.contains(F.lower(model_id), F.lit(sizes[0]))
    return F.when(has("8b"), 0.70).when(has("14b"), 0.50).when(has("32b"), 0.95).when(has("72b", "70b"), 0.15).otherwise(0.95)


def page_touch(data: Column, page: int = 4096) -> Column:
    """Sum modulo 256 of the first byte of each page and of the last byte; 0 for no bytes."""
    byte = lambda i: F.conv(F.hex(F.substring(data, i, 1)), 16, 10).cast("long")
    n = F.octet_length(data)
    pages = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(page)), F.lit(0).cast("long"), lambda a, i: a + byte(i))
    return F.when(n > 0, (pages + byte(n)) % 256).otherwise(F.lit(0).cast("long"))
