"""Harmonic packing of token sequences.

A sequence holds `capacity` tokens. What a document has beyond whole sequences is its rest. Rests fall into reciprocal-capacity
classes: class k holds rests over capacity / (k + 1) tokens and up to capacity / k, and a bin of class k takes exactly k of them,
uncut. The gap that is left, less than a share of the class, is closed by fillers: the shortest rests, just so many that they
fill the gaps of all others, are cut where a gap ends. So a document is cut only where it is over-long or closes a bin, and
full sequences hold no padding. Every worker fills the bins of its own partition; nothing is shuffled. What is left at a
partition's end, fewer than k rests of each class k and the rest of the fillers, is laid out one after another, cut into
sequences, the last of them by powers of two, whose length needs no padding.

Sequence ids are unique: the partition's number, then a count. They depend on how the input is split. A null or empty text is a
document of just the end id. A null doc_id stays null; repeated rows are packed as often as they occur; of equal lengths the
earlier row is the filler. A very long text is encoded in parts and cut into whole sequences. An empty table gives no rows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import id_text
from .tokenise import encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, class long"
#: Columns of a piece: document, whether it has an id, first token, tokens, tokens of the document, where its ids lie.
DOC, NULL, START, LENGTH, TOKENS, AT = range(6)


def ends_of(n: np.ndarray) -> np.ndarray:
    return np.cumsum(n) - n


@dataclass
class Pieces:
    """rows: one piece each, with the columns above. ids: their tokens."""

    rows: np.ndarray
    ids: np.ndarray

    @staticmethod
    def none() -> Pieces:
        return Pieces(np.zeros((0, 6), np.int64), np.zeros(0, np.uint32))

    def __add__(self, other: Pieces) -> Pieces:
        more = other.rows.copy()
        more[:, AT] += len(self.ids)
        return Pieces(np.concatenate((self.rows, more)), np.concatenate((self.ids, other.ids)))

    def take(self, i: np.ndarray) -> Pieces:
        """Some of the pieces with their own tokens alone."""
        rows = self.rows[i]
        n = rows[:, LENGTH]
        ids = self.ids[np.arange(int(n.sum())) + np.repeat(rows[:, AT] - ends_of(n), n)]
        rows[:, AT] = ends_of(n)
        return Pieces(rows, ids)


def lay(rows: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces one after another, cut at the given places too: (pieces, their place, number of cuts up to it)."""
    upto = np.cumsum(rows[:, LENGTH])
    end = int(upto[-1]) if len(upto) else 0
    at = np.unique(np.concatenate((upto - rows[:, LENGTH], cuts[cuts < end], [end])))[:-1] if end else np.zeros(0, np.int64)
    own = np.searchsorted(upto, at, "right")
    out, inside = rows[own], at - (upto - rows[:, LENGTH])[own]
    out[:, START] += inside
    out[:, AT] += inside
    out[:, LENGTH] = np.diff(np.append(at, end))
    return out, at, np.searchsorted(cuts, at, "right")


class Bins:
    """One partition's bins. Between calls it holds fewer than k rests of each class k, and fillers of some sequences."""

    def __init__(self, capacity: int, partition: int):
        if capacity < 1 or capacity & (capacity - 1):
            raise ValueError("capacity must be a power of two")
        self.capacity, self.base, self.made = capacity, partition << 40, 0
        self.waiting, self.fillers = Pieces.none(), Pieces.none()

    def _placed(self, rows: np.ndarray, ids: np.ndarray, seq: np.ndarray, offset: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
        raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(rows[:, AT].tolist(), rows[:, LENGTH].tolist(), strict=True)]
        cols = [pa.array(rows[:, DOC], mask=rows[:, NULL].astype(bool)), pa.array(rows[:, START]), pa.array(rows[:, LENGTH]), pa.array(crc, pa.int64()), pa.array(rows[:, TOKENS]), pa.array(self.base + seq), pa.array(offset), pa.array(kind)]
        return pa.RecordBatch.from_arrays([c.cast(pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "class"])

    def put(self, docs: np.ndarray, null: np.ndarray, n: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Documents of n tokens each, whose tokens lie in ids."""
        c = self.capacity
        at, whole = ends_of(n), n // c
        of = np.repeat(np.arange(len(n)), whole)
        start = (np.arange(len(of)) - np.repeat(ends_of(whole), whole)) * c
        rows = np.stack([docs[of], null[of], start, np.full(len(of), c), n[of], at[of] + start], axis=1).astype(np.int64)
        if len(rows):
            yield self._placed(rows, ids, self.made + np.arange(len(rows)), np.zeros(len(rows), np.int64), np.ones(len(rows), np.int64))
            self.made += len(rows)
        rest = np.flatnonzero(n % c)
        start = whole[rest] * c
        rows = np.stack([docs[rest], null[rest], start, n[rest] - start, n[rest], at[rest] + start], axis=1).astype(np.int64)
        yield from self._fill(self.waiting + Pieces(rows, ids))

    def _fill(self, pool: Pieces) -> Iterator[pa.RecordBatch]:
        c, length = self.capacity, pool.rows[:, LENGTH]
        order = np.argsort(length, kind="stable")
        k = c // np.maximum(length[order], 1)
        # The fewest of the shortest that fill the gaps of all others.
        gap = c / k - length[order]
        room = len(self.fillers.ids) + np.append(0, np.cumsum(length[order])) - (gap.sum() - np.append(0, np.cumsum(gap)))
        f = int(np.argmax(room >= -1e-6))
        fillers = self.fillers + pool.take(order[:f])
        seats, k = order[f:], k[f:]
        # Classes lie together, as the rests are sorted.
        first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
        place = np.arange(len(k)) - np.repeat(first, np.diff(np.append(first, len(k))))
        size = np.repeat(np.diff(np.append(first, len(k))), np.diff(np.append(first, len(k))))
        full = place < size // np.maximum(k, 1) * k
        self.waiting = pool.take(seats[~full])
        rows, k, place = pool.rows[seats[full]], k[full], place[full]
        opens = place % k == 0 if len(k) else np.zeros(0, bool)
        seq = np.cumsum(opens) - 1
        bins = int(opens.sum())
        used = np.bincount(seq, rows[:, LENGTH], bins).astype(np.int64)
        offset = ends_of(rows[:, LENGTH]) - ends_of(used)[seq]
        # Fillers one after another through the gaps; what is behind the last gap waits.
        gaps = c - used
        edge = np.cumsum(gaps)
        cut, at, own = lay(fillers.rows, edge)
        inside = at < (int(edge[-1]) if bins else 0)
        self.fillers = Pieces(cut, fillers.ids).take(np.flatnonzero(~inside))
        cut, at, own = cut[inside], at[inside], own[inside]
        if bins:
            close = cut.copy()
            close[:, AT] += len(pool.ids)
            both = np.concatenate((rows, close))
            yield self._placed(both, np.concatenate((pool.ids, fillers.ids)), self.made + np.concatenate((seq, own)), np.concatenate((offset, used[own] + at - (edge - gaps)[own])), np.concatenate((k, np.zeros(len(own), np.int64))))
            self.made += bins

    def close(self) -> Iterator[pa.RecordBatch]:
        left = self.waiting + self.fillers
        self.waiting, self.fillers = Pieces.none(), Pieces.none()
        total = len(left.ids)
        if not total:
            return
        ends, at, bit = list(range(self.capacity, total + 1, self.capacity)), total // self.capacity * self.capacity, self.capacity >> 1
        while at < total:
            if total - at >= bit:
                at += bit
                ends.append(at)
            bit >>= 1
        cuts = np.array(ends)
        rows, at, own = lay(left.rows, cuts)
        yield self._placed(rows, left.ids, self.made + own, at - np.append(0, cuts)[own], np.zeros(len(rows), np.int64))
        self.made += len(ends)


def harmonic_pack(docs: DataFrame, capacity: int = 4096, end_id: int = 2, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and class: k for a rest in a bin of k (a whole sequence is alone in its bin, k = 1), 0 for what closes bins."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = Bins(capacity, TaskContext.get().partitionId())
        with encoder(vocabulary) as enc:
            for b in batches:
                own, null = b.column(0).fill_null(0).to_numpy(zero_copy_only=False), b.column(0).is_null().to_numpy(zero_copy_only=False)
                for i, j, ids, n in enc.parts(b.column(1), end_id):
                    yield from bins.put(own[i:j], null[i:j], n, ids)
            yield from bins.close()

    return id_text(docs, id_col, text_col).mapInArrow(pack, SCHEMA)


def op2(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return harmonic_pack(table(spark, sf_dir, "documents"))
