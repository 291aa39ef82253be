"""The Python surface: open a checkpoint, list its keys, get tensors; load and save small ones whole.

Errors of content are ShardloreError, a ValueError; a missing path is FileNotFoundError, a failed write is OSError. numpy gets
bf16 and 8-bit floats as float32; torch and tensorflow get them as they are, on the device that is asked for."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import ShardloreError
from .functions.dtypes import decode, encode, framework_name, parse, saved_spelling
from .operators import catalog as ops
from .operators import validate
from .plans.partition import assign
from .sources import flat, indexed, sinks
from .streaming.iterate import in_name_order

BACKENDS = (None, "default", "sync", "async", "io_uring")
FRAMEWORKS = ("numpy", "torch", "tensorflow", "tf")
__all__ = ["Catalog", "ShardloreError", "iter_flat", "iter_indexed", "load_flat", "load_indexed", "open_flat", "open_indexed", "save_flat", "save_flat_bytes", "save_indexed"]


def check_backend(backend: str | None) -> None:
    if backend not in BACKENDS:
        raise ValueError(f"unsupported backend: {backend}")


def check_serving(fmt: str, backend: str) -> None:
    """What a serving engine's loader may be asked for: fewer backends than checkpoints can be opened with."""
    if fmt not in ("safetensors", "serverlessllm"):
        raise ValueError(f"unsupported format: {fmt}")
    if backend not in ("default", "sync", "io_uring"):
        raise ValueError(f"unsupported backend: {backend}")


def tf_device(device: str) -> str:
    """cuda:1 and gpu:1 as /GPU:1; what begins with a slash is as it is."""
    if device.startswith("/"):
        return device
    kind, _, number = device.lower().partition(":")
    return f"/{'GPU' if kind in ('cuda', 'gpu') else kind.upper()}:{number or 0}"


def to_framework(data: bytes, dtype: str, shape: list[int], framework: str = "numpy", device: str = "cpu"):
    """The tensor of row-major little-endian bytes. dtype: canonical, or a file's spelling."""
    if framework not in FRAMEWORKS:
        raise ValueError(f"unsupported framework: {framework}")
    if framework == "numpy":
        if device != "cpu":
            raise ValueError(f"numpy has no device {device}")
        return decode(data, dtype, shape)
    name = framework_name(dtype.upper())
    try:
        if framework == "torch":
            import torch

            kind = getattr(torch, name)
            out = torch.frombuffer(bytearray(data), dtype=kind).reshape(shape) if data and 0 not in shape else torch.zeros(shape, dtype=kind)
            return out if device == "cpu" else out.to(device)
        import tensorflow as tf

        with tf.device(tf_device(device)):
            kind = tf.as_dtype(name)
            return tf.reshape(tf.io.decode_raw(data, kind), shape) if data and 0 not in shape else tf.zeros(shape, kind)
    except ImportError as e:
        raise ImportError(f"{framework} is not installed") from e


class Catalog:
    """A lazy handle. Metadata is one DataFrame; bytes are read for the tensors that are got."""

    def __init__(self, rows: DataFrame, located: DataFrame):
        self.rows, self.located = rows, located

    def keys(self) -> list[str]:
        return [r["name"] for r in ops.names(self.rows).collect()]

    def __len__(self) -> int:
        return self.rows.count()

    def is_empty(self) -> bool:
        return self.rows.isEmpty()

    def is_lazy(self) -> bool:
        return not self.rows.is_cached

    def listed(self, name: str) -> bool:
        """In the catalogue; its bytes may be missing."""
        return ops.contains(self.rows, name)

    def __contains__(self, name: str) -> bool:
        return ops.contains(self.located, name)

    def meta(self, name: str):
        return ops.tensor(self.rows, name).first()

    def _stored(self) -> DataFrame:
        """located, with the spelling of a file as dtype where there is one: it tells types that have no canonical name."""
        return self.located.withColumn("dtype", F.col("file_dtype")) if "file_dtype" in self.located.columns else self.located

    def get(self, name: str, framework: str = "numpy", device: str = "cpu"):
        """The tensor, or None if it isn't listed or has no bytes."""
        rows = ops.tensor(self._stored(), name)
        row = rows.first()
        if row is None:
            return None
        chunks = flat.read_bytes(rows).orderBy("chunk_no").toLocalIterator()
        return to_framework(b"".join(bytes(c["data"]) for c in chunks), row["dtype"], list(row["shape"]), framework, device)

    def items(self, framework: str = "numpy", device: str = "cpu") -> Iterator[tuple[str, object]]:
        """(name, tensor) in name order, one at a time."""
        for name, dtype, shape, data in in_name_order(self._stored()):
            yield name, to_framework(data, dtype, shape, framework, device)

    def load(self, framework: str = "numpy", device: str = "cpu") -> dict:
        """All of a small checkpoint."""
        return dict(self.items(framework, device))


def open_flat(spark: SparkSession, directory: str, backend: str | None = None) -> Catalog:
    check_backend(backend)
    rows = flat.catalog(spark, directory)
    validate.enforce(validate.duplicate_names(rows))
    return Catalog(rows, rows)


def open_indexed(spark: SparkSession, directory: str, backend: str | None = None) -> Catalog:
    check_backend(backend)
    rows = indexed.read_index(spark, directory)
    return Catalog(rows, indexed.located(rows, indexed.partition_files(spark, directory)).where(F.col("readable")))


def load_flat(spark: SparkSession, directory: str, framework: str = "numpy", backend: str | None = None, device: str = "cpu") -> dict:
    return open_flat(spark, directory, backend).load(framework, device)


def load_indexed(spark: SparkSession, directory: str, framework: str = "numpy", backend: str | None = None, device: str = "cpu") -> dict:
    return open_indexed(spark, directory, backend).load(framework, device)


def iter_flat(spark: SparkSession, directory: str, framework: str = "numpy", backend: str | None = None, device: str = "cpu") -> Iterator[tuple[str, object]]:
    return open_flat(spark, directory, backend).items(framework, device)


def iter_indexed(spark: SparkSession, directory: str, framework: str = "numpy", backend: str | None = None, device: str = "cpu") -> Iterator[tuple[str, object]]:
    return open_indexed(spark, directory, backend).items(framework, device)


def _torch_bytes(t) -> tuple[list[int], str, bytes]:
    import torch

    own = t.detach().cpu().contiguous()
    return list(own.shape), str(t.dtype).removeprefix("torch."), own.reshape(-1).view(torch.uint8).numpy().tobytes()


def _raw(tensors: dict) -> dict[str, tuple[list[int], str, bytes]]:
    """Arrays, (shape, dtype, bytes), or tensors of torch or tensorflow."""
    out = {}
    for name, v in tensors.items():
        if isinstance(v, tuple):
            shape, dtype, data = v
        elif hasattr(v, "detach"):
            shape, dtype, data = _torch_bytes(v)
        else:
            shape, dtype, data = encode(np.asarray(v.numpy() if hasattr(v, "numpy") else v))
        out[name] = (shape, saved_spelling(dtype), data)
    return out


def save_flat_bytes(tensors: dict, metadata: dict[str, str] | None = None) -> bytes:
    """tensors: name to array, to (shape, dtype, bytes), or to a framework's tensor."""
    return sinks.flat_bytes(_raw(tensors), metadata)


def save_flat(tensors: dict, path: str, metadata: dict[str, str] | None = None) -> int:
    return sinks.save_flat(_raw(tensors), path, metadata)


def save_indexed(tensors: dict, directory: str, partitions: int = 1) -> None:
    """A small indexed checkpoint: the tensors, largest first, each in the partition with the fewest bytes."""
    raw = _raw(tensors)
    order = sorted(raw, key=lambda n: (-len(raw[n][2]), n.encode()))
    files, entries = [b""] * partitions, []
    for name, p in zip(order, assign([len(raw[n][2]) for n in order], [0] * len(order), partitions), strict=True):
        shape, dtype, data = raw[name]
        stride = [int(np.prod(shape[i + 1 :], dtype=np.int64)) for i in range(len(shape))]
        entries.append({"name": name, "offset": len(files[p]), "size": len(data), "shape": shape, "stride": stride, "dtype": parse(dtype), "partition_id": p})
        files[p] += data
    sinks.save_indexed(sorted(entries, key=lambda e: e["name"]), files, directory)
