"""The partition plan: tensors, largest first, each go to the partition with the fewest bytes; of equals to one that already holds its
source file, then to the lowest number. Each choice depends on all before it, so a model is planned by one task; models are
planned side by side. A plan handles names and sizes, never bytes."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ShardloreError


class NothingToPlan(ShardloreError):
    pass


def assign(sizes: list[int], files: list[int], n: int) -> list[int]:
    """The partition of each tensor, given in planning order."""
    heap = [(0, p) for p in range(n)]
    held: list[set[int]] = [set() for _ in range(n)]
    out = []
    for size, file in zip(sizes, files, strict=True):
        # All partitions with the fewest bytes come off the heap: which is best depends on the tensor.
        tied = [heapq.heappop(heap)]
        while heap and heap[0][0] == tied[0][0]:
            tied.append(heapq.heappop(heap))
        bytes_, p = min(tied, key=lambda x: (file not in held[x[1]], x[1]))
        for x in tied:
            heapq.heappush(heap, (bytes_ + size, p) if x[1] == p else x)
        held[p].add(file)
        out.append(p)
    return out


def plan(tensors: DataFrame, n: int) -> DataFrame:
    """tensors (model, name, size, file_index, ...) with partition_id and dest_offset."""
    if n < 1:
        raise ValueError("a plan has one partition at least")

    def one(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group["size"].to_pylist(), group["name"].to_pylist(), group["file_index"].to_pylist(), strict=True), key=lambda r: (-r[0], r[1].encode()))
        got = assign([r[0] for r in rows], [r[2] for r in rows], n)
        return pa.table({"model": pa.array([group["model"][0].as_py()] * len(rows), pa.string()), "name": pa.array([r[1] for r in rows], pa.string()), "partition_id": pa.array(got, pa.int32())})

    placed = tensors.select("model", "name", "size", "file_index").groupBy("model").applyInArrow(one, "model string, name string, partition_id int")
    before = Window.partitionBy("model", "partition_id").orderBy(F.desc("size"), "name").rowsBetween(Window.unboundedPreceding, -1)
    return tensors.join(placed, ["model", "name"]).withColumn("dest_offset", F.coalesce(F.sum("size").over(before), F.lit(0).cast("long")))


def plan_by_fold(tensors: DataFrame, n: int) -> DataFrame:
    """The same plan as one expression per model, for some hundred tensors: it copies its state for each."""
    items = F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("neg"), "name", "file_index")))
    state = "struct<b:array<bigint>,f:array<array<int>>,out:array<struct<name:string,partition_id:int>>>"
    start = F.expr(f"cast(struct(array_repeat(0L, {n}), array_repeat(cast(array() as array<int>), {n}), array()) as {state})")

    def step(acc, x):
        key = lambda p: F.struct(F.get(acc["b"], p).alias("b"), F.when(F.array_contains(F.get(acc["f"], p), x["file_index"]), 0).otherwise(1).alias("new"), p.alias("p"))
        def put(best):
            p = best["p"]
            b = F.transform(acc["b"], lambda v, i: F.when(i == p, v - x["neg"]).otherwise(v))
            f = F.transform(acc["f"], lambda v, i: F.when(i == p, F.array_distinct(F.concat(v, F.array(x["file_index"])))).otherwise(v))
            return F.struct(b.alias("b"), f.alias("f"), F.concat(acc["out"], F.array(F.struct(x["name"].alias("name"), p.alias("partition_id")))).alias("out")).cast(state)
        return F.get(F.transform(F.array(F.array_min(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), key))), put), F.lit(0))

    return tensors.groupBy("model").agg(F.aggregate(items, start, step)["out"].alias("out")).select("model", F.inline("out"))


def copy_ops(planned: DataFrame) -> DataFrame:
    """name, source_file_index, path, offset, size, partition_id, dest_offset: one range copy per tensor."""
    return planned.select("model", "name", F.col("file_index").alias("source_file_index"), "path", "offset", "size", "partition_id", "dest_offset")


def partition_summary(index: DataFrame, *keys: str) -> DataFrame:
    """partition_id, max_required_size (the largest end, not the sum), tensor_names in order."""
    return index.groupBy(*keys, "partition_id").agg(F.max(F.col("offset") + F.col("size")).alias("max_required_size"), F.sort_array(F.collect_list("name")).alias("tensor_names"))


def gaps(planned: DataFrame) -> DataFrame:
    """Tensors that don't begin where the one before them in their partition ends. Empty tensors share an offset, so ends decide ties."""
    w = Window.partitionBy("model", "partition_id").orderBy("dest_offset", "size")
    end = F.coalesce(F.lag(F.col("dest_offset") + F.col("size")).over(w), F.lit(0).cast("long"))
    return planned.withColumn("expected", end).where(F.col("expected") != F.col("dest_offset"))


def stats(planned: DataFrame, n: int) -> DataFrame:
    """The 13 statistics of each model's plan. Means of bytes are whole numbers and count empty partitions and files without tensors up to the last."""
    whole = lambda a, b: F.expr(f"{a} div {b}")
    files = planned.groupBy("model", "file_index").agg(F.sum("size").alias("b")).groupBy("model").agg(F.max("b").alias("max_source_file_bytes"), (F.max("file_index") + 1).cast("long").alias("source_file_count"))
    parts = planned.groupBy("model", "partition_id").agg(F.sum("size").alias("b"), F.count_distinct("file_index").alias("f")).groupBy("model").agg(F.max("b").alias("max_partition_bytes"), F.sum("f").alias("f"), F.max("f").alias("max_source_files_per_partition"))
    own = planned.groupBy("model").agg(F.sum("size").alias("total_bytes"), F.count("*").alias("tensor_count"), F.max("size").alias("max_copy_size"))
    s = own.join(files, "model").join(parts, "model").withColumn("partition_count", F.lit(n).cast("long"))
    return s.select(
        "model", "total_bytes", "source_file_count", "partition_count", "tensor_count", "max_source_file_bytes", whole("total_bytes", "source_file_count").alias("mean_source_file_bytes"),
        "max_partition_bytes", whole("total_bytes", "partition_count").alias("mean_partition_bytes"), (F.col("f") / F.col("partition_count")).alias("mean_source_files_per_partition"), "max_source_files_per_partition",
        F.col("tensor_count").alias("copy_op_count"), (F.col("total_bytes") / F.col("tensor_count")).alias("mean_copy_size"), "max_copy_size",
    )
