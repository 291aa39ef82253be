"""Tensors in name order, pulled one at a time: the driver holds one partition of chunks, never the checkpoint."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from ..sources import flat


def in_name_order(located: DataFrame, chunk_bytes: int = 8 << 20) -> Iterator[tuple[str, str, list[int], bytes]]:
    """(name, dtype, shape, bytes) of rows with name, dtype, shape, path, offset, size. The requests are ordered, not the bytes, which are read partition by partition as they are pulled."""
    requests = flat.ranges(located, chunk_bytes, "dtype", "shape").orderBy("name", "chunk_no")
    name, dtype, shape, parts = None, "", [], []
    for r in flat.fetch(requests, in_order=True).select("name", "dtype", "shape", "data").toLocalIterator():
        if r["name"] != name and name is not None:
            yield name, dtype, shape, b"".join(parts)
            parts = []
        name, dtype, shape = r["name"], r["dtype"], list(r["shape"])
        parts.append(bytes(r["data"]))
    if name is not None:
        yield name, dtype, shape, b"".join(parts)
