"""Writers. A file is written by one task in the order of its bytes, chunk by chunk, under another name, and takes its own name when whole, so
a lost task leaves nothing that looks finished. An index is written last."""

from __future__ import annotations

import json
import math
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileType
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceWriter, WriterCommitMessage

from ..errors import ShardloreError
from ..functions.dtypes import UnknownDtype, from_file, parse
from . import flat
from .files import children, qualified, store
from .indexed import DATA, INDEX, BadIndex, index_text


def put(path: str, parts: Iterator[bytes]) -> int:
    fs, p = store(path)
    fs.create_dir(p.rsplit("/", 1)[0], recursive=True)
    part, n = f"{p}.{uuid.uuid4().hex}.part", 0
    with fs.open_output_stream(part) as out:
        for b in parts:
            out.write(b)
            n += len(b)
    fs.move(part, p)
    return n


def header(entries: list[tuple[str, str, list[int], int]], metadata: dict[str, str] | None = None) -> bytes:
    """The length and JSON header of tensors (name, file dtype, shape, size) in the order of their bytes."""
    at, head = 0, {flat.METADATA: metadata} if metadata else {}
    for name, dtype, shape, size in entries:
        head[name] = {"dtype": dtype, "shape": shape, "data_offsets": [at, at + size]}
        at += size
    raw = json.dumps(head, separators=(",", ":")).encode()
    raw += b" " * (-len(raw) % 8)
    return struct.pack("<Q", len(raw)) + raw


def check_entries(entries: list[tuple[str, str, list[int], int]]) -> None:
    if not entries:
        raise ShardloreError("a checkpoint has at least one tensor")
    for name, dtype, _, _ in entries:
        if not name:
            raise ShardloreError("a tensor's name is empty")
        if from_file(dtype) == "unknown" and dtype != "C64":
            raise UnknownDtype(f"{name}: unknown dtype {dtype}")


def flat_bytes(tensors: dict[str, tuple[list[int], str, bytes]], metadata: dict[str, str] | None = None) -> bytes:
    """A whole flat shard in memory. tensors: name to (shape, file dtype, bytes)."""
    entries = [(n, d, list(s), len(b)) for n, (s, d, b) in sorted(tensors.items())]
    check_entries(entries)
    return header(entries, metadata) + b"".join(tensors[e[0]][2] for e in entries)


def save_flat(tensors: dict[str, tuple[list[int], str, bytes]], path: str, metadata: dict[str, str] | None = None) -> int:
    return put(path, iter([flat_bytes(tensors, metadata)]))


def write_flat(tensors: DataFrame, directory: str, metadata: dict[str, str] | None = None, chunk_bytes: int = flat.CHUNK_BYTES) -> DataFrame:
    """Writes directory/<file> of tensors (file, name, file_dtype, shape) with their bytes in data, or in a range (size, path, offset) of another file; returns file, n_bytes. A task streams one file after another, tensors by name, a range in chunks."""
    own = "data" in tensors.columns
    size = F.coalesce(F.octet_length("data"), F.lit(0)).cast("long") if own else F.col("size")
    listed = tensors.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("name", "file_dtype", "shape", size.alias("size")))).alias("entries"))
    chunks = tensors.select("file", "name", F.lit(0).cast("long").alias("chunk_no"), "data") if own else flat.ranges(tensors, chunk_bytes, "file").select("file", "name", "chunk_no", "path", "at", "length")
    heads = listed.select("file", F.lit("").alias("name"), F.lit(-1).cast("long").alias("chunk_no"), "entries")
    rows = chunks.unionByName(heads, allowMissingColumns=True).repartition("file").sortWithinPartitions("file", F.col("chunk_no") >= 0, "name", "chunk_no")

    def first(entries: list[dict]) -> bytes:
        own = [(e["name"], e["file_dtype"], e["shape"], e["size"]) for e in entries]
        check_entries(own)
        return header(own, metadata)

    target = qualified(tensors.sparkSession, directory).rstrip("/")
    return rows.drop("name", "chunk_no").mapInArrow(_streams(lambda f: f"{target}/{f}", first), "file string, n_bytes long")


def _streams(target, first):
    """Writes runs of rows (file, then path, at and length, or data, or entries) as files; rows with entries give the file's beginning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ({c: b.column(k)[i].as_py() for k, c in enumerate(b.schema.names)} for b in batches for i in range(b.num_rows))
        row = next(rows, None)
        while row is not None:
            key = row["file"]

            def parts():
                nonlocal row
                while row is not None and row["file"] == key:
                    if row.get("entries") is not None:
                        yield first(row["entries"])
                    elif row.get("data"):
                        yield row["data"]
                    elif row.get("length"):
                        yield flat.read_range(row["path"], row["at"], row["length"])
                    row = next(rows, None)

            n = put(target(key), parts())
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([n], pa.int64())], names=["file", "n_bytes"])

    return run


def write_partitions(copy_ops: DataFrame, directory: str, chunk_bytes: int = flat.CHUNK_BYTES) -> DataFrame:
    """Copies every range of copy_ops (name, path, offset, size, partition_id, dest_offset) into its partition file, in order of its chunks' places there. Empty partitions get no file. Returns partition_id, n_bytes."""
    chunks = flat.ranges(copy_ops, chunk_bytes, "partition_id", "dest_offset").withColumn("to", F.col("dest_offset") + F.col("chunk_no") * chunk_bytes)
    # An empty tensor's place is that of the next one's first chunk.
    rows = chunks.repartition("partition_id").sortWithinPartitions("partition_id", "to", "length").select(F.col("partition_id").cast("string").alias("file"), "path", "at", "length")
    target = qualified(copy_ops.sparkSession, directory).rstrip("/")
    rows = rows.mapInArrow(_streams(lambda p: f"{target}/{DATA}{p}", None), "file string, n_bytes long")
    return rows.select(F.col("file").cast("int").alias("partition_id"), "n_bytes")


def commit_index(entries: DataFrame, directory: str) -> None:
    """Writes the index: a document of one row per tensor, so of the catalogue's size and not of the data's."""
    rows = entries.select("name", "offset", "size", "shape", "stride", "dtype", "partition_id").orderBy("name").toLocalIterator()
    put(f"{qualified(entries.sparkSession, directory).rstrip('/')}/{INDEX}", iter([index_text(list(rows)).encode()]))


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: (name under way, name), and index entries."""

    files: list[tuple[str, str]]
    entries: list[dict]


class _Writer(DataSourceWriter):
    """Tasks write under other names; the driver gives files their own names when all are done, or removes them."""

    def __init__(self, directory: str, overwrite: bool):
        self.directory, self.overwrite = directory.rstrip("/"), overwrite

    def _clear(self, old: Callable[[str], bool]) -> None:
        fs, p = store(self.directory)
        if self.overwrite and fs.get_file_info(p).type == FileType.Directory:
            for path, name, _ in list(children(self.directory)):
                if old(name):
                    fs.delete_file(store(path)[1])

    def _settle(self, messages) -> None:
        for m in messages:
            for part, name in m.files:
                fs, p = store(f"{self.directory}/{part}")
                fs.move(p, store(f"{self.directory}/{name}")[1])

    def abort(self, messages):
        for m in messages:
            for part, _ in m.files if m else ():
                fs, p = store(f"{self.directory}/{part}")
                if fs.get_file_info(p).type == FileType.File:
                    fs.delete_file(p)


class ShardWriter(_Writer):
    def __init__(self, directory: str, most: int, overwrite: bool):
        super().__init__(directory, overwrite)
        self.most = most

    def write(self, rows):
        from pyspark import TaskContext

        number, done, held, size = TaskContext.get().partitionId(), [], {}, 0

        def close() -> None:
            name = f"shard-{number:05d}-{len(done):05d}{flat.SUFFIX}"
            part = f".{name}.{uuid.uuid4().hex}.part"
            put(f"{self.directory}/{part}", iter([flat_bytes(held)]))
            done.append((part, name))
            held.clear()

        for r in rows:
            data = bytes(r["data"] or b"")
            if r["name"] in held:
                raise BadIndex(f"{r['name']}: repeated")
            if held and size + len(data) > self.most:
                close()
                size = 0
            held[r["name"]] = (list(r["shape"]), r["file_dtype"], data)
            size += len(data)
        if held:
            close()
        return Written(done, [])

    def commit(self, messages):
        self._clear(lambda name: name.endswith(flat.SUFFIX))
        self._settle(messages)


class IndexWriter(_Writer):
    def write(self, rows):
        from pyspark import TaskContext

        number, entries, at = TaskContext.get().partitionId(), [], 0
        name = f"{DATA}{number}"
        part = f".{name}.{uuid.uuid4().hex}.part"

        def parts() -> Iterator[bytes]:
            nonlocal at
            for r in rows:
                data, shape = bytes(r["data"] or b""), list(r["shape"])
                stride = [math.prod(shape[i + 1 :]) for i in range(len(shape))]
                entries.append({"name": r["name"], "offset": at, "size": len(data), "shape": shape, "stride": stride, "dtype": parse(r["dtype"]), "partition_id": number})
                at += len(data)
                yield data

        put(f"{self.directory}/{part}", parts())
        return Written([(part, name)], entries)

    def commit(self, messages):
        entries = sorted((e for m in messages for e in m.entries), key=lambda e: e["name"])
        names = [e["name"] for e in entries]
        if not all(names) or len(set(names)) < len(names):
            self.abort(messages)
            raise BadIndex("tensors need names that differ")
        text = index_text(entries)
        self._clear(lambda name: name == INDEX or name.startswith(DATA))
        self._settle(messages)
        put(f"{self.directory}/{INDEX}", iter([text.encode()]))


def save_indexed(entries: list[dict], partitions: list[bytes], directory: str) -> None:
    """A small indexed checkpoint from memory."""
    if any(not e["name"] for e in entries):
        raise BadIndex("a tensor's name is empty")
    if entries and max(e["partition_id"] for e in entries) >= len(partitions):
        raise BadIndex("an entry names a partition that isn't given")
    text = index_text(entries)
    for i, b in enumerate(partitions):
        put(f"{directory.rstrip('/')}/{DATA}{i}", iter([b]))
    put(f"{directory.rstrip('/')}/{INDEX}", iter([text.encode()]))
