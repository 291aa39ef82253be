"""Files by any store that pyarrow's file systems reach, and listings.

A path without a scheme means Spark's default file system where a function has the session, and is made a full one there
(`qualified`) before it goes to the executors; elsewhere it is a local path. Paths are taken as they are written, blanks included."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from fnmatch import fnmatchcase

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

LISTED = "path string, name string, length long"
# Schemes of Hadoop's connectors, and what pyarrow calls the same stores.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}
_URI = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):(?://([^/]*))?(/.*)?", re.S)


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it."""
    m = _URI.fullmatch(path)
    if not m or m[1] == "file":
        return pafs.LocalFileSystem(), (m[3] or "/") if m else path
    scheme, host = SCHEMES.get(m[1], m[1]), m[2] or ""
    if m[1].startswith("wasb"):
        host = host.replace(".blob.", ".dfs.")
    fs, root = pafs.FileSystem.from_uri(f"{scheme}://{host}/")
    return fs, f"{root.rstrip('/')}{m[3] or '/'}"


def read_range(path: str, offset: int, size: int) -> bytes:
    fs, p = store(path)
    with fs.open_input_file(p) as f:
        out = f.read_at(size, offset)
    if len(out) != size:
        raise EOFError(f"{path}: wanted {size} bytes at {offset}, got {len(out)}")
    return out


def read_ranges(path: str, ranges: list[tuple[int, int]]) -> list[bytes]:
    """Each (offset, size), in the order given, through one open file."""
    fs, p = store(path)
    with fs.open_input_file(p) as f:
        out = [f.read_at(size, offset) for offset, size in ranges]
    for (offset, size), b in zip(ranges, out, strict=True):
        if len(b) != size:
            raise EOFError(f"{path}: wanted {size} bytes at {offset}, got {len(b)}")
    return out


def read_file(path: str) -> bytes:
    fs, p = store(path)
    with fs.open_input_file(p) as f:
        return f.read()


def map_file(path: str) -> pa.Buffer:
    """A file's bytes, mapped and not read where it is local."""
    fs, p = store(path)
    if not isinstance(fs, pafs.LocalFileSystem):
        return pa.py_buffer(read_file(path))
    if fs.get_file_info(p).size == 0:
        return pa.py_buffer(b"")
    return pa.memory_map(p).read_buffer()


def children(directory: str) -> Iterator[tuple[str, str, int]]:
    """(path, name, length) of a folder's files, in byte order of their names."""
    fs, p = store(directory)
    for f in sorted((f for f in fs.get_file_info(pafs.FileSelector(p)) if f.is_file), key=lambda f: f.base_name.encode()):
        yield f"{directory.rstrip('/')}/{f.base_name}", f.base_name, f.size


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def qualified(spark: SparkSession, path: str) -> str:
    """path with the scheme and authority of its file system."""
    fs, p = _hadoop(spark, path)
    return fs.makeQualified(p).toString()


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def listing(spark: SparkSession, directory: str, glob: str) -> DataFrame:
    """path, name, length of the regular files of a folder, empty ones too, not of folders below it. Names are as many as shards, which the driver lists; contents are not read."""
    fs, p = _hadoop(spark, directory)
    if not fs.exists(p):
        raise FileNotFoundError(directory)
    if not fs.getFileStatus(p).isDirectory():
        raise NotADirectoryError(directory)
    found = [(f.getPath().toString(), f.getPath().getName(), f.getLen()) for f in fs.listStatus(p) if f.isFile()]
    return spark.createDataFrame([f for f in found if fnmatchcase(f[1], glob)], LISTED)


def shared_dir(spark: SparkSession, kind: str = "files") -> str:
    """A new path under the folder that spark.checkpoint.dir names, which driver and executors share; it goes when the session ends. Where that is unset a temporary folder becomes it, on one machine alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = current.get() if current.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="shardlore-")
        spark.sparkContext.setCheckpointDir(base)
    out = f"{base.rstrip('/')}/shardlore-{kind}-{uuid.uuid4().hex}"
    remove_at_exit(spark, out)
    return out


def remove_at_exit(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop(spark, path)
    fs.deleteOnExit(p)
