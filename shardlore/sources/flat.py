"""Flat shards: an 8-byte little-endian header length, a JSON header, then the tensors' bytes.

The catalogue reads headers alone, file by file on the executors; bytes are read by range, in chunks, for the tensors that are
asked for and no others."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from ..errors import ShardloreError
from ..functions.dtypes import from_file
from ..functions.scalars import contiguous_stride
from .files import children, listing, read_range

SUFFIX = ".safetensors"
METADATA = "__metadata__"
CATALOG = "file_index int, path string, header_len long, file_bytes long, name string, file_dtype string, dtype string, shape array<long>, offset long, size long"
CHUNK_BYTES = 64 << 20


class NoShards(ShardloreError):
    pass


def discover(spark: SparkSession, directory: str) -> DataFrame:
    """file_index (rank in name order), path, name, length. Raises if there is none."""
    found = listing(spark, directory, f"*{SUFFIX}")
    if found.isEmpty():
        raise NoShards(f"no {SUFFIX} files in {directory}")
    return found.withColumn("file_index", (F.row_number().over(Window.orderBy("name")) - 1).cast("int"))


def parse_header(head: bytes, body_at: int, file_bytes: int) -> Iterator[tuple]:
    """(name, file_dtype, dtype, shape, absolute offset, size) of each tensor."""
    for name, t in json.loads(head).items():
        if name == METADATA:
            continue
        begin, end = t["data_offsets"]
        if not 0 <= begin <= end or body_at + end > file_bytes:
            raise ShardloreError(f"{name}: data_offsets {begin}, {end} leave the file")
        yield name, t["dtype"], from_file(t["dtype"]), [int(x) for x in t["shape"]], body_at + begin, end - begin


def read_header(path: str, length: int) -> tuple[int, bytes]:
    if length < 8:
        raise ShardloreError(f"{path}: no header")
    (n,) = struct.unpack("<Q", read_range(path, 0, 8))
    if n > length - 8:
        raise ShardloreError(f"{path}: the header is longer than the file")
    return n, read_range(path, 8, n)


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["file_index", "path", "header_len", "file_bytes", "name", "file_dtype", "dtype", "shape", "offset", "size"]
    types = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int64()]
    for b in batches:
        for i, path, length in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            n, head = read_header(path, length)
            rows = [(i, path, n, length, *t) for t in parse_header(head, n + 8, length)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def catalog(spark: SparkSession, directory: str) -> DataFrame:
    """A row per tensor, with contiguous strides; no bytes are read."""
    files = discover(spark, directory)
    spread = files.repartition(spark.sparkContext.defaultParallelism, "path")
    return spread.select("file_index", "path", "length").mapInArrow(_headers, CATALOG).withColumn("stride", contiguous_stride(F.col("shape")))


def file_metadata(spark: SparkSession, directory: str) -> DataFrame:
    """path, key, value of the files' own string metadata."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, length in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = json.loads(read_header(path, length)[1]).get(METADATA) or {}
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(own), pa.string()), pa.array([*own], pa.string()), pa.array([*own.values()], pa.string())], names=["path", "key", "value"])

    return discover(spark, directory).select("path", "length").mapInArrow(run, "path string, key string, value string")


def ranges(tensors: DataFrame, chunk_bytes: int = CHUNK_BYTES, *keep: str) -> DataFrame:
    """Range requests (name, path, chunk_no, at, length, and the columns to keep) in chunks of chunk_bytes at most; an empty tensor has one empty chunk."""
    last = F.greatest(F.lit(0), F.ceil(F.col("size") / chunk_bytes).cast("long") - 1)
    r = tensors.select("name", "path", "offset", "size", *keep, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk_no"))
    at = F.col("chunk_no") * chunk_bytes
    return r.select("name", "path", "chunk_no", (F.col("offset") + at).alias("at"), F.least(F.lit(chunk_bytes), F.col("size") - at).cast("long").alias("length"), *keep)


def fetch(requests: DataFrame, in_order: bool = False) -> DataFrame:
    """requests with the bytes they name, one read each, dealt evenly over tasks, or where the requests lie and in their order."""
    at = {c: k for k, c in enumerate(requests.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                path, begin, length = (b.column(at[c])[i].as_py() for c in ("path", "at", "length"))
                data = pa.array([read_range(path, begin, length) if length else b""], pa.binary())
                yield pa.RecordBatch.from_arrays([*(c.slice(i, 1) for c in b.columns), data], names=[*b.schema.names, "data"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema) + ", data binary"
    spread = requests if in_order else requests.repartition(requests.sparkSession.sparkContext.defaultParallelism)
    return spread.mapInArrow(run, schema)


def read_bytes(tensors: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """name, chunk_no, data of the given tensors alone."""
    return fetch(ranges(tensors, chunk_bytes)).select("name", "chunk_no", "data")


class _Shard(InputPartition):
    def __init__(self, index: int, path: str, length: int):
        self.index, self.path, self.length = index, path, length


class _Reader(DataSourceReader):
    def __init__(self, directory: str):
        self.directory = directory
        self.names: set[str] | None = None

    def partitions(self):
        found = [f for f in children(self.directory) if f[1].endswith(SUFFIX)]
        if not found:
            raise NoShards(f"no {SUFFIX} files in {self.directory}")
        return [_Shard(i, path, size) for i, (path, _, size) in enumerate(found)]

    def read(self, partition):
        n, head = read_header(partition.path, partition.length)
        for t in parse_header(head, n + 8, partition.length):
            if self.names is None or t[0] in self.names:
                yield (partition.index, partition.path, n, partition.length, *t)


class _PushingReader(_Reader):
    def pushFilters(self, filters):
        """Names asked for are all that is parsed into rows."""
        for f in filters:
            asked = wanted(f, "name")
            if asked is None:
                yield f
            else:
                self.names = asked if self.names is None else self.names & asked


def wanted(f, column: str) -> set | None:
    """The values that an equality or list on a column asks for, else None."""
    if getattr(f, "attribute", None) != (column,):
        return None
    return {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None


def pushes(options) -> bool:
    """Spark refuses a reader that takes filters where its setting doesn't allow them, so the option asks for one."""
    return options.get("pushdown", "false").lower() == "true"


class FlatShards(DataSource):
    """spark.dataSource.register(FlatShards); spark.read.format("flat_shards").load(directory) is the catalogue. With the option pushdown, which needs
    spark.sql.python.filterPushdown.enabled, a filter on name goes to the reader.

    Writing takes rows (name, file_dtype, shape, data): each task writes shards of its rows, of max_shard_bytes (256 MB unless
    set) or one tensor; they take their names when all tasks are done. The option engine is taken and has no effect."""

    @classmethod
    def name(cls):
        return "flat_shards"

    def schema(self):
        return CATALOG

    def reader(self, schema):
        return (_PushingReader if pushes(self.options) else _Reader)(self.options["path"])

    def writer(self, schema, overwrite):
        from .sinks import ShardWriter

        return ShardWriter(self.options["path"], int(self.options.get("max_shard_bytes", 256 << 20)), overwrite)
