"""Texts in tablets, and questions about hashes that are put to hash segments and answered by tablet.

A tablet holds some megabytes of whole documents in one compressed cell. Tablets are written once, as a table bucketed by
tablet, so each later pass reads them in place and no text is ever shuffled. A pass sends requests, small binary blocks of sorted hashes
by segment of the hash space; each segment is answered by one task that sees every tablet's block; the answers, a bit or byte
per hash, go back to their tablet. A hash is in a tablet's block once, however often the tablet has it, so no hot hash, and no
hot group of documents, makes a large block."""

from __future__ import annotations

import math
import struct
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from ..sources.files import remove_at_exit
from .common import id_text, input_bytes
from .textbytes import U64, buffers, mix, release

#: Rows of a tablet at most: a row's key is the tablet's number << 20 and its place.
MOST_ROWS = 1 << 20
#: Names of the tables that tablets() made in this session; tidy() drops them.
MADE: list[str] = []


def squeeze(a: np.ndarray) -> bytes:
    """A compressed array; integers go by byte planes."""
    raw = np.ascontiguousarray(a)
    planes = raw.view(np.uint8).reshape(-1, raw.itemsize).T if len(raw) else raw.view(np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def expand(b: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel() if len(raw) else np.zeros(0, dtype)


def join_blocks(parts: Iterable[bytes]) -> bytes:
    parts = list(parts)
    return struct.pack(f"<{len(parts) + 1}q", len(parts), *map(len, parts)) + b"".join(parts)


def cut_blocks(b: bytes) -> list[bytes]:
    (n,) = struct.unpack_from("<q", b)
    out, at = [], 8 + 8 * n
    for size in struct.unpack_from(f"<{n}q", b, 8):
        out.append(b[at : at + size])
        at += size
    return out


class Tablet:
    """ids: doc_ids, 0 where null says that there is none. off: where each text starts in data. number: the tablet's. extra: what its maker laid beside the texts."""

    def __init__(self, content: bytes, number: int = 0):
        self.number = number
        ids, null, off, data, *more = cut_blocks(content)
        self.extra = more[0] if more else b""
        self.ids, self.off = expand(ids, np.int64), expand(off, np.int64)
        self.null = np.unpackbits(np.frombuffer(null, np.uint8), count=len(self.ids)).astype(bool)
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8) if data else np.zeros(0, np.uint8)

    def text(self, i: int) -> bytes:
        return self.data[self.off[i] : self.off[i + 1]].tobytes()

    def doc_ids(self) -> pa.Array:
        return pa.array(self.ids, mask=self.null)


def _content(ids: list[np.ndarray], null: list[np.ndarray], texts: list[np.ndarray], lens: list[np.ndarray]) -> bytes:
    data = np.concatenate(texts)
    off = np.concatenate(([0], np.cumsum(np.concatenate(lens))))
    return join_blocks([squeeze(np.concatenate(ids)), np.packbits(np.concatenate(null)).tobytes(), squeeze(off), zstandard.ZstdCompressor(level=1).compress(data.tobytes()) if len(data) else b""])


def _cutter(tablet_bytes: int, extra: Callable[[Tablet], bytes] | None):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list, list] = ([], [], [], [])
        made, size, n, base = 0, 0, 0, TaskContext.get().partitionId() << 20

        def out() -> pa.RecordBatch:
            nonlocal made, size, n
            content, total = _content(*held), size
            if extra:
                content = join_blocks([*cut_blocks(content), extra(Tablet(content))])
                release()
            for x in held:
                x.clear()
            made, size, n = made + 1, 0, 0
            return pa.RecordBatch.from_arrays([pa.array([base + made - 1]), pa.array([total]), pa.array([content], pa.binary())], names=["tablet", "n_bytes", "content"])

        for b in batches:
            data, off = buffers(b.column(1))
            ids, null = b.column(0).fill_null(0).to_numpy(zero_copy_only=False), b.column(0).is_null().to_numpy(zero_copy_only=False)
            a = 0
            while a < len(ids):
                c = max(a + 1, int(np.searchsorted(off, off[a] + tablet_bytes - size, "right")) - 1)
                c = min(c, len(ids), a + MOST_ROWS - n)
                for x, own in zip(held, (ids[a:c], null[a:c], data[off[a] : off[c]], np.diff(off[a : c + 1])), strict=True):
                    x.append(own)
                size += int(off[c] - off[a])
                n += c - a
                a = c
                if size >= tablet_bytes * 0.9 or n >= MOST_ROWS or a < len(ids):
                    yield out()
        if held[0]:
            yield out()

    return cut


def usual_bytes(input_size: int) -> int:
    """A tablet's size, which grows with the square root of the input: as many blocks as tablets times segments are asked for. From 4 MB to 32 MB, for which a core has about 3 GB."""
    return min(max(4 << 20, math.isqrt(input_size << 14)), 32 << 20)


def tablets(docs: DataFrame, tablet_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", extra: Callable[[Tablet], bytes] | None = None) -> DataFrame:
    """tablet, n_bytes, content; bucketed by tablet. tablet_bytes: usual_bytes of the input, unless given. extra: made once of each tablet and kept with it."""
    spark, own = docs.sparkSession, id_text(docs, id_col, text_col)
    name, size = f"shardlore_tablets_{uuid.uuid4().hex}", input_bytes(own)
    made = own.mapInArrow(_cutter(tablet_bytes or usual_bytes(size), extra), "tablet long, n_bytes long, content binary")
    made.write.bucketBy(partitions(spark, size), "tablet").format("parquet").saveAsTable(name)
    MADE.append(name)
    out = spark.table(name)
    remove_at_exit(spark, spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name = 'Location'").first()["data_type"])
    out.tablets_table, out.log_segments = name, segments(spark, size)
    return out


def discard(tabs: DataFrame) -> None:
    """Drops one table of tablets, once nothing reads it any more."""
    tabs.sparkSession.sql(f"DROP TABLE IF EXISTS {tabs.tablets_table}")
    MADE.remove(tabs.tablets_table)


def tidy(spark: SparkSession) -> None:
    """Drops the tables of tablets made so far; results that still read them must be written before."""
    while MADE:
        spark.sql(f"DROP TABLE IF EXISTS {MADE.pop()}")


def partitions(spark: SparkSession, input_size: int = 0) -> int:
    """As many as the session shuffles by, and one for each 512 MB of the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), input_size >> 29)


def segments(spark: SparkSession, input_size: int = 0) -> int:
    """Log2 of the number of segments: as many as there are partitions, at least."""
    return max(2, (partitions(spark, input_size) - 1).bit_length())


REQUEST = "segment int, tablet long, block binary"
ANSWER = "tablet long, kind int, segment int, answer binary"


def ask(tabs: DataFrame, make: Callable[[Tablet], Iterator[tuple[int, bytes]]], known: DataFrame | None = None) -> DataFrame:
    """Requests of each tablet: make(tablet) or, with answers known, make(tablet, {(kind, segment): answer}) gives (segment, block)."""

    def rows(tablet: int, content: bytes, *args) -> pa.RecordBatch:
        got = list(make(Tablet(content, tablet), *args))
        return pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int32()), pa.array([tablet] * len(got), pa.int64()), pa.array([g[1] for g in got], pa.binary())], names=["segment", "tablet", "block"])

    return _each(tabs, rows, known, REQUEST)


def _each(tabs: DataFrame, rows: Callable, known: DataFrame | None, schema: str) -> DataFrame:
    """rows(tablet, content[, answers]) -> RecordBatch for each tablet, where it lies."""
    tabs = tabs.select("tablet", "content")
    if known is None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for t, c in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    yield rows(t, c.as_py())
                    release()

        return tabs.mapInArrow(run, schema)

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        answers = {(k, s): a.as_py() for k, s, a in zip(right["kind"].to_pylist(), right["segment"].to_pylist(), right["answer"], strict=True)}
        out = pa.Table.from_batches([rows(t, c.as_py(), answers) for t, c in zip(left["tablet"].to_pylist(), left["content"], strict=True)])
        release()
        return out

    return tabs.groupBy("tablet").cogroup(known.groupBy("tablet")).applyInArrow(both, schema)


def answer(requests: DataFrame, reply: Callable[[int, list[bytes]], list[bytes]], kind: int) -> DataFrame:
    """reply(segment, blocks) gives each block's answer."""

    def run(group: pa.Table) -> pa.Table:
        segment = group["segment"][0].as_py()
        got = reply(segment, [x.as_py() for x in group["block"]])
        release()
        n = group.num_rows
        return pa.table({"tablet": group["tablet"], "kind": pa.array([kind] * n, pa.int32()), "segment": group["segment"], "answer": pa.array(got, pa.binary())})

    return requests.groupBy("segment").applyInArrow(run, ANSWER)


# A sketch of counts: cells by the top bits of a row's hash.


def cell_bits(items: int, log_segments: int, per_item: int = 4) -> int:
    """Log2 of a row's cells, per_item for each item at least; a segment has 2**12 at least."""
    return max(log_segments + 12, (max(1, items * per_item) - 1).bit_length())


def row_cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (h if row == 0 else mix(h ^ U64(0xA24BAED4963EE407 * row & (1 << 64) - 1))) >> U64(64 - bits)


def distinct(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and the sum of their weights."""
    if not len(values):
        return values, weights
    order = np.argsort(values)
    v = values[order]
    first = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
    return v[first], np.add.reduceat(weights[order], first)


def _edges(values: np.ndarray, bits: int, log_segments: int) -> np.ndarray:
    """Where each segment of sorted values starts, and the end."""
    return np.append(np.searchsorted(values, np.arange(1 << log_segments).astype(U64) << U64(bits - log_segments)), len(values))


def count_blocks(cells: np.ndarray, counts: np.ndarray, bits: int, log_segments: int, row: int = 0) -> Iterator[tuple[int, bytes]]:
    """(row and segment, block) of sorted distinct cells with their counts, to 255."""
    at = _edges(cells, bits, log_segments)
    for s in range(1 << log_segments):
        a, b = at[s], at[s + 1]
        if a < b:
            own = np.diff(cells[a:b] & U64((1 << (bits - log_segments)) - 1), prepend=U64(0)).astype(np.uint32)
            own = own.astype(np.uint16) if own.max() < 65536 else own
            yield (row << log_segments) + s, join_blocks([bytes([own.itemsize]), squeeze(own), squeeze(np.minimum(counts[a:b], 255).astype(np.uint8))])


def merge_counts(bits: int, log_segments: int, repeated_only: bool) -> Callable[[int, list[bytes]], list[bytes]]:
    """Merges the tablets' sketches of a segment by adding cells up. Answers: whether each asked cell's sum is over 1, as bits, or the sum to 255, as bytes."""

    def reply(segment: int, blocks: list[bytes]) -> list[bytes]:
        total = np.zeros(1 << (bits - log_segments), np.uint8)
        for b in blocks:
            cells, counts = _cells(b)
            total[cells] = np.minimum(total[cells].astype(np.uint16) + counts, 255)
        return [np.packbits(total[_cells(b)[0]] > 1).tobytes() if repeated_only else squeeze(total[_cells(b)[0]]) for b in blocks]

    return reply


def _cells(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    size, cells, counts = cut_blocks(block)
    return np.cumsum(expand(cells, np.uint16 if size[0] == 2 else np.uint32), dtype=np.int64), expand(counts, np.uint8)


def answered_bits(answers: dict, kind: int, sizes: list[tuple[int, int]]) -> np.ndarray:
    """The answers' bits in order. sizes: (segment, number of hashes) as they were asked."""
    out = [np.unpackbits(np.frombuffer(answers[kind, s], np.uint8), count=n) for s, n in sizes]
    return np.concatenate(out).astype(bool) if out else np.zeros(0, bool)


def segment_sizes(cells: np.ndarray, bits: int, log_segments: int, row: int = 0) -> list[tuple[int, int]]:
    at = _edges(cells, bits, log_segments)
    return [((row << log_segments) + s, int(at[s + 1] - at[s])) for s in range(1 << log_segments) if at[s] < at[s + 1]]
