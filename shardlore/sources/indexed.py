"""Indexed layout: tensor_index.json maps a name to [offset, size, shape, stride, dtype, partition]; bytes lie in tensor.data_<partition>."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from ..errors import ShardloreError
from ..functions.dtypes import canonical, parse
from ..functions.scalars import partition_file
from . import flat
from .files import exists, listing, read_file

INDEX, DATA = "tensor_index.json", "tensor.data_"
ENTRY = "name string, offset long, size long, shape array<long>, stride array<long>, dtype string, partition_id int"


class BadIndex(ShardloreError):
    pass


def parse_entry(name: str, e) -> tuple:
    """The row of one entry: six fields by position, shape and stride of one rank, a known dtype, and offset + size within 64 bits."""
    if not isinstance(e, list) or len(e) != 6:
        raise BadIndex(f"{name}: an entry has six fields")
    offset, size, shape, stride, dtype, pid = e
    if min(offset, size, pid, *shape, *stride, 0) < 0:
        raise BadIndex(f"{name}: negative number")
    if offset + size >= 1 << 64:
        raise BadIndex(f"{name}: offset and size overflow")
    if len(shape) != len(stride):
        raise BadIndex(f"{name}: shape has rank {len(shape)}, stride {len(stride)}")
    return name, offset, size, shape, stride, parse(dtype), pid


def decode_index(texts: DataFrame, column: str = "value") -> DataFrame:
    """Rows of index documents with DataFrame functions. An entry that breaks a rule has its reason in problem; repeated names stay, as rows."""
    e = texts.select(F.explode(F.from_json(F.col(column), "map<string,array<string>>")).alias("name", "e"))
    at = lambda i: F.get("e", F.lit(i))
    ints = lambda i: F.from_json(at(i), "array<bigint>")
    long = lambda i: at(i).try_cast("long")
    out = e.select(
        "name", long(0).alias("offset"), long(1).alias("size"), ints(2).alias("shape"), ints(3).alias("stride"), canonical(at(4)).alias("dtype"), at(5).try_cast("int").alias("partition_id"),
        F.when(F.size("e") != 6, "an entry has six fields").when(canonical(at(4)).isNull(), "unknown dtype").when(F.size(ints(2)) != F.size(ints(3)), "shape and stride differ in rank").when(F.try_add(long(0), long(1)).isNull(), "offset and size overflow").alias("problem"),
    )
    return out


def encode_entry(offset: Column, size: Column, shape: Column, stride: Column, dtype: Column, pid: Column) -> Column:
    ints = lambda a: F.concat(F.lit("["), F.array_join(a.cast("array<string>"), ","), F.lit("]"))
    return F.concat(F.lit("["), F.concat_ws(",", offset.cast("string"), size.cast("string"), ints(shape), ints(stride), F.concat(F.lit('"'), dtype, F.lit('"')), pid.cast("string")), F.lit("]"))


def index_text(entries: list) -> str:
    """The document of rows with the columns of ENTRY; empty is an error. Of repeated names the last stands."""
    if not entries:
        raise BadIndex("an index has at least one tensor")
    return json.dumps({r["name"]: [r["offset"], r["size"], list(r["shape"]), list(r["stride"]), r["dtype"], r["partition_id"]] for r in entries}, indent=2)


def read_index(spark: SparkSession, directory: str) -> DataFrame:
    """The index's rows, every rule enforced. The document is one file, read whole by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string(), pa.int32()]
        for b in batches:
            for text in b.column(0).to_pylist():
                rows = [parse_entry(n, e) for n, e in json.loads(text).items()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["name", "offset", "size", "shape", "stride", "dtype", "partition_id"])

    path = f"{directory.rstrip('/')}/{INDEX}"
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.text(path, wholetext=True).mapInArrow(run, ENTRY)


def partition_files(spark: SparkSession, directory: str) -> DataFrame:
    """partition_id, path, length of the partition files that exist."""
    f = listing(spark, directory, f"{DATA}*")
    return f.select(F.regexp_extract("name", r"^tensor\.data_(\d+)$", 1).try_cast("int").alias("partition_id"), "path", "length").where("partition_id is not null")


def located(index: DataFrame, files: DataFrame) -> DataFrame:
    """Index rows with path, and readable: false where the partition is missing or too short. No bytes are read."""
    f = files.select("partition_id", "path", "length")
    return index.join(F.broadcast(f) if files.count() <= 100_000 else f, "partition_id", "left").withColumn("readable", F.coalesce(F.try_add("offset", "size") <= F.col("length"), F.lit(False)))


def read_bytes(spark: SparkSession, directory: str, names: list[str] | None = None, chunk_bytes: int = flat.CHUNK_BYTES) -> DataFrame:
    """name, chunk_no, data of readable tensors; only referenced partitions and only the named ranges are touched."""
    rows = located(read_index(spark, directory), partition_files(spark, directory)).where("readable")
    return flat.read_bytes(rows.where(F.col("name").isin(names)) if names is not None else rows, chunk_bytes)


class _Reader(DataSourceReader):
    def __init__(self, directory: str):
        self.directory = directory
        self.asked: dict[str, set] = {}

    def read(self, partition):
        names, ids = self.asked.get("name"), self.asked.get("partition_id")
        for n, e in json.loads(read_file(f"{self.directory.rstrip('/')}/{INDEX}")).items():
            if names is None or n in names:
                row = parse_entry(n, e)
                if ids is None or row[-1] in ids:
                    yield row


class _PushingReader(_Reader):
    def pushFilters(self, filters):
        for f in filters:
            for column in ("name", "partition_id"):
                if (values := flat.wanted(f, column)) is not None:
                    self.asked[column] = self.asked.get(column, values) & values
                    break
            else:
                yield f


class TensorIndex(DataSource):
    """spark.read.format("tensor_index").load(directory). With the option pushdown filters on name and partition_id go to the reader.

    Writing takes rows (name, dtype, shape, data): each task writes a partition file of its rows, and the index follows when
    all tasks are done."""

    @classmethod
    def name(cls):
        return "tensor_index"

    def schema(self):
        return ENTRY

    def reader(self, schema):
        return (_PushingReader if flat.pushes(self.options) else _Reader)(self.options["path"])

    def writer(self, schema, overwrite):
        from .sinks import IndexWriter

        return IndexWriter(self.options["path"], overwrite)


__all__ = ["BadIndex", "TensorIndex", "decode_index", "encode_entry", "index_text", "located", "parse_entry", "partition_file", "partition_files", "read_bytes", "read_index"]
