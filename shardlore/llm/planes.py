"""Token ids in bit planes.

A file holds the ids of whole documents. Its ids are cut into blocks of `block` ids; each block is transposed into planes, bit
planes (`bits=1`: plane j holds bit j of every id) or byte planes (`bits=8`), as many as the file's largest id needs, and each
plane is compressed with zstandard. After the blocks come the documents' ids and lengths, the chunk index (where each plane
of each block starts, and how many ids a block has) and a footer. Any range of ids is read by the planes of its blocks alone.

    "BPF2" | planes ... | documents: ids, lengths, 1 for no id | index | footer: 5 little-endian 64-bit integers and "BPF2"

Files are written by Spark's own writer as rows (shard, file_no, n_ids, n_docs, content), so they reach any store Spark
reaches, whole or not at all. Texts are encoded where they lie; their ids, compressed, are range-partitioned by doc_id and row
and sorted, in as many partitions as their number asks for, so (shard, file_no) is ascending doc_id order and rows that share an
id, or have none, are dealt to several shards. Null texts are empty documents of just the end id; null doc_ids come first; rows
that repeat a doc_id are kept, in the order in which they were read. A very long text is one document of one file, which is as
large as it needs. An empty table gives no files and no rows."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_text, settle, unsettle
from .tablets import expand, squeeze
from .tokenise import encoder

MAGIC = b"BPF2"
FOOTER = struct.Struct("<5q4s")
FILES = "shard int, file_no int, n_ids long, n_docs long, content binary"


def planes(ids: np.ndarray, count: int, bits: int) -> list[bytes]:
    """The planes of one block, lowest first."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if bits == 8:
        return [raw[:, j].tobytes() for j in range(count)]
    return [np.packbits((ids >> np.uint32(j)) & np.uint32(1) == 1, bitorder="little").tobytes() for j in range(count)]


def from_planes(parts: list[bytes], n: int, bits: int) -> np.ndarray:
    out = np.zeros(n, np.uint32)
    for j, p in enumerate(parts):
        own = np.frombuffer(p, np.uint8)
        own = own if bits == 8 else np.unpackbits(own, count=n, bitorder="little")
        out |= own[:n].astype(np.uint32) << np.uint32(j * bits)
    return out


def encode_file(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray, block: int = 1 << 15, bits: int = 1, level: int = 1, null: np.ndarray | None = None) -> bytes:
    if bits not in (1, 8):
        raise ValueError("bits must be 1 or 8")
    if block % 8 or block < 8:
        raise ValueError("block must be a multiple of 8")
    top = int(ids.max()) if len(ids) else 0
    count = -(-max(1, top.bit_length()) // bits)
    z, out, at, index = zstandard.ZstdCompressor(level=level), [MAGIC], 4, []
    for a in range(0, len(ids), block):
        own = ids[a : a + block]
        index.append(len(own))
        for p in planes(own, count, bits):
            out.append(z.compress(p))
            index.append(at)
            at += len(out[-1])
    docs = z.compress(np.concatenate((doc_ids, lengths, np.zeros(len(doc_ids)) if null is None else null), dtype="<i8", casting="unsafe").tobytes())
    listed = z.compress(np.array(index, "<i8").tobytes())
    return b"".join([*out, docs, listed, FOOTER.pack(at, at + len(docs), len(doc_ids), count, bits, MAGIC)])


class File:
    """Reads what encode_file made; ids(a, b) touches the blocks of that range alone."""

    def __init__(self, content: bytes):
        if len(content) < 4 + FOOTER.size or content[:4] != MAGIC:
            raise ValueError("not a plane file")
        self.content = memoryview(content)
        docs, index, n, self.count, self.bits, magic = FOOTER.unpack(content[-FOOTER.size :])
        if magic != MAGIC:
            raise ValueError("the footer is damaged")
        self.z = zstandard.ZstdDecompressor()
        both = np.frombuffer(self.z.decompress(content[docs:index]), "<i8")
        self.doc_ids, self.lengths, self.null = both[:n], both[n : 2 * n], both[2 * n :].astype(bool)
        table = np.frombuffer(self.z.decompress(content[index : -FOOTER.size]), "<i8").reshape(-1, self.count + 1)
        self.sizes, self.at = table[:, 0], np.append(table[:, 1:].ravel(), docs)
        self.upto = np.concatenate(([0], np.cumsum(self.sizes)))

    def block(self, k: int) -> np.ndarray:
        parts = [self.z.decompress(self.content[self.at[i] : self.at[i + 1]]) for i in range(k * self.count, (k + 1) * self.count)]
        return from_planes(parts, int(self.sizes[k]), self.bits)

    def ids(self, a: int = 0, b: int | None = None) -> np.ndarray:
        b = int(self.upto[-1]) if b is None else min(b, int(self.upto[-1]))
        if a >= b:
            return np.zeros(0, np.uint32)
        first, last = int(np.searchsorted(self.upto, a, "right")) - 1, int(np.searchsorted(self.upto, b, "left"))
        own = np.concatenate([self.block(k) for k in range(first, last)])
        return own[a - self.upto[first] : b - self.upto[first]]


ENCODED = "doc_id long, n long, ids binary"


def encoded(docs: DataFrame, end_id: int, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n, ids (compressed) of doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(vocabulary) as enc:
            for b in batches:
                for i, j, ids, n in enc.parts(b.column(1), end_id):
                    cells = [squeeze(x) for x in np.split(ids, np.cumsum(n)[:-1])]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n), pa.array(cells, pa.binary())], names=["doc_id", "n", "ids"])

    return docs.mapInArrow(run, ENCODED)


def write_planes(docs: DataFrame, end_id: int = 1, vocabulary: str | None = None, file_ids: int = 1 << 20, block: int = 1 << 15, bits: int = 1, shard_ids: int = 1 << 25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and writes; returns the table of files, read back. A file closes at the first document's end after file_ids ids; there is a shard for each shard_ids ids at least."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, no, held = TaskContext.get().partitionId(), 0, 0
        ids: list[np.ndarray] = []
        own: list[tuple] = []

        def close() -> pa.RecordBatch:
            nonlocal no, held
            flat, doc = np.concatenate(ids), np.array([x[0] for x in own], np.int64)
            n, null = np.array(list(map(len, ids)), np.int64), np.array([x[1] for x in own])
            ids.clear()
            own.clear()
            no, held = no + 1, 0
            cols = [pa.array([shard], pa.int32()), pa.array([no - 1], pa.int32()), pa.array([len(flat)]), pa.array([len(doc)]), pa.array([encode_file(flat, doc, n, block, bits, null=null)], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["shard", "file_no", "n_ids", "n_docs", "content"])

        for b in batches:
            for doc, cell in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids.append(expand(cell.as_py(), np.uint32))
                own.append((doc or 0, doc is None))
                held += len(ids[-1])
                if held >= file_ids:
                    yield close()
        if own:
            yield close()

    coded = settle(encoded(id_text(docs, id_col, text_col), end_id, vocabulary))
    total = coded.agg(F.sum("n")).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // shard_ids), 1)
    ordered = coded.select("doc_id", "ids", F.monotonically_increasing_id().alias("row")).repartitionByRange(parts, "doc_id", "row").sortWithinPartitions("doc_id", "row")
    out = settle(ordered.select("doc_id", "ids").mapInArrow(write, FILES))
    unsettle(coded)
    return out


def read_planes(files: DataFrame) -> DataFrame:
    """A row per document from the files alone: doc_id, start (ids of all documents before it), n_tokens, ids_crc32. Where a file's ids start follows from the files' sizes: a sum over shards, which are as many as partitions, and a running one within each. Contents are decoded where they lie."""
    spark = files.sparkSession
    totals, upto = [], 0
    for r in sorted(files.groupBy("shard").agg(F.sum("n_ids").alias("n")).toLocalIterator(), key=lambda r: r["shard"]):
        totals.append((r["shard"], upto))
        upto += r["n"]
    base = spark.createDataFrame(totals, T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("base", T.LongType())]))
    before = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1))
    at = files.select("shard", "file_no", "n_ids").withColumn("before", F.coalesce(before, F.lit(0))).join(base, "shard").select("shard", "file_no", (F.col("base") + F.col("before")).alias("at"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, no, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                f = File(content.as_py())
                raw = memoryview(f.ids().astype("<u4")).cast("B")
                ends = np.cumsum(f.lengths)
                begin, n = ends - f.lengths, len(ends)
                crc = np.fromiter((zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(begin.tolist(), ends.tolist(), strict=True)), np.int64, n)
                cols = [pa.array(np.full(n, shard, np.int32)), pa.array(np.full(n, no, np.int32)), pa.array(f.doc_ids, mask=f.null), pa.array(begin), pa.array(f.lengths), pa.array(crc)]
                yield pa.RecordBatch.from_arrays(cols, names=["shard", "file_no", "doc_id", "begin", "n_tokens", "ids_crc32"])

    rows = files.select("shard", "file_no", "content").mapInArrow(decode, "shard int, file_no int, doc_id long, begin long, n_tokens long, ids_crc32 long")
    return rows.join(at, ["shard", "file_no"]).select("doc_id", (F.col("at") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def op4(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return read_planes(write_planes(table(spark, sf_dir, "documents")))
