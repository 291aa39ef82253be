"""Substring dedup over windows of words, behind a count-min prefilter.

First pass: every tablet of documents sketches its windows; the sketches of all tablets, split by segments of the cells, are
added up. A window's estimate, the least of its cells' sums over the rows, is never below its count. Second pass: only windows
estimated repeated are grouped, exactly, by 128 bits of two hashes: each tablet sends each such window once, with the smallest doc_id
that has it, and learns whether a smaller doc_id exists elsewhere. Nothing else is sent, and no window is lost. The width of the
sketch grows with the input; it is never gathered in one place.

A word goes if a window over it also starts in a document with a smaller doc_id. Null and empty texts have no words. A null
doc_id is larger than any other; rows that share a doc_id do not remove each other's words. Very long texts are tablets of their
own. An empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, table
from .tablets import Tablet, _each, answer, answered_bits, ask, cell_bits, count_blocks, cut_blocks, distinct, expand, join_blocks, merge_counts, row_cells, segment_sizes, squeeze, tablets
from .textbytes import U64, fold, span_hashes, window_hashes, word_bounds

SKETCH, EXACT, ROWS = 0, 1, 2
REMOVED = "doc_id long, n_words long, n_removed long, kept binary"


#: The second hash of a window starts here.
_SEED = 0x2545F4914F6CDD1D


def least_of(ids: np.ndarray, null: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smallest id, whether all are null) of each run that starts at group."""
    if not len(group):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    return np.minimum.reduceat(np.where(null, np.iinfo(np.int64).max, ids), group), np.logical_and.reduceat(null, group)


def later(ids: np.ndarray, null: np.ndarray, least: np.ndarray, none: np.ndarray) -> np.ndarray:
    """Whether each id is larger than the least of its run; null is larger than any."""
    return np.where(null, ~none, (ids > least) & ~none)


class Windows:
    """A tablet's windows: the distinct ones, sorted by hash, with what is needed to find their places again."""

    def __init__(self, t: Tablet, size: int):
        starts, ends, self.first = word_bounds(t.data, t.off)
        words = span_hashes(t.data, starts, ends)
        h, self.begin, doc = window_hashes(words, self.first, size)
        self.order = np.argsort(h)
        v = h[self.order]
        same = np.flatnonzero(v[1:] == v[:-1]) + 1
        # The second hash, of repeated windows here, of all when they are asked for.
        self.second = lambda i: fold(words, self.begin[i], np.full(len(i), size), _SEED)
        if len(same) and (self.second(self.order[same]) != self.second(self.order[same - 1])).any():
            all_of = self.second(np.arange(len(h)))
            self.order = np.lexsort((all_of, h))
            v, w = h[self.order], all_of[self.order]
            self.new = np.append(True, (v[1:] != v[:-1]) | (w[1:] != w[:-1]))
        else:
            self.new = np.append(True, v[1:] != v[:-1]) if len(v) else np.zeros(0, bool)
        at = np.flatnonzero(self.new)
        self.h, self.ids, self.null = v[at], t.ids[doc[self.order]], t.null[doc[self.order]]
        self.least, self.none = least_of(self.ids, self.null, at)
        group = np.cumsum(self.new) - 1
        self.late = later(self.ids, self.null, self.least[group], self.none[group])
        self.copies = 1 + (np.logical_or.reduceat(self.late, at).astype(np.uint8) if len(at) else np.zeros(0, np.uint8))

    def cells(self, row: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        return distinct(row_cells(self.h, row, bits), self.copies.astype(np.int64))

    def candidates(self, answers: dict, bits: int, log_segments: int) -> np.ndarray:
        """Which distinct windows are estimated repeated."""
        out = np.ones(len(self.h), bool)
        for row in range(ROWS):
            cells = self.cells(row, bits)[0]
            repeated = answered_bits(answers, SKETCH, segment_sizes(cells, bits, log_segments, row))
            out &= repeated[np.searchsorted(cells, row_cells(self.h, row, bits))] if len(cells) else out
        return out


def least_ids(segment: int, blocks: list[bytes]) -> list[bytes]:
    """For each asked window, whether another tablet has it with a smaller id."""
    parts = [cut_blocks(b) for b in blocks]
    h, second, ids = [np.cumsum(expand(p[0], np.uint64), dtype=np.uint64) for p in parts], [expand(p[1], np.uint64) for p in parts], [expand(p[2], np.int64) for p in parts]
    null = [np.unpackbits(np.frombuffer(p[3], np.uint8), count=len(i)).astype(bool) for p, i in zip(parts, ids, strict=True)]
    sizes = [len(x) for x in h]
    h, second, ids, null = (np.concatenate(x) for x in (h, second, ids, null))
    order = np.argsort(h)
    v, w = h[order], second[order]
    if ((v[1:] == v[:-1]) & (w[1:] != w[:-1])).any():
        order = np.lexsort((second, h))
        v, w = h[order], second[order]
    new = np.append(True, (v[1:] != v[:-1]) | (w[1:] != w[:-1])) if len(v) else np.zeros(0, bool)
    least, none = least_of(ids[order], null[order], np.flatnonzero(new))
    group = np.cumsum(new) - 1
    out = np.empty(len(h), bool)
    out[order] = later(ids[order], null[order], least[group], none[group])
    return [np.packbits(x).tobytes() for x in np.split(out, np.cumsum(sizes)[:-1])]


def remove_repeats(docs: DataFrame, size: int = 13, tablet_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (the kept words, joined by single spaces, as UTF-8)."""
    tabs = tablets(docs, tablet_bytes, id_col, text_col)
    log_s = tabs.log_segments
    words = (tabs.agg(F.sum("n_bytes")).first()[0] or 0) // 5
    bits = cell_bits(words, log_s)

    def sketch(t: Tablet) -> Iterator[tuple[int, bytes]]:
        w = Windows(t, size)
        for row in range(ROWS):
            yield from count_blocks(*w.cells(row, bits), bits, log_s, row)

    estimates = settle(answer(ask(tabs, sketch), merge_counts(bits, log_s, repeated_only=True), SKETCH))

    def exact(t: Tablet, answers: dict) -> Iterator[tuple[int, bytes]]:
        w = Windows(t, size)
        chosen = w.candidates(answers, bits, log_s)
        h, ids, none = w.h[chosen], w.least[chosen], w.none[chosen]
        second = w.second(w.order[np.flatnonzero(w.new)[chosen]])
        at = 0
        for s, n in segment_sizes(h, 64, log_s):
            own = slice(at, at + n)
            yield s, join_blocks([squeeze(np.diff(h[own], prepend=U64(0))), squeeze(second[own]), squeeze(ids[own]), np.packbits(none[own]).tobytes()])
            at += n

    grouped = settle(answer(ask(tabs, exact, estimates), least_ids, EXACT))

    def apply(tablet: int, content: bytes, answers: dict) -> pa.RecordBatch:
        t = Tablet(content)
        w = Windows(t, size)
        chosen = w.candidates(answers, bits, log_s)
        elsewhere = np.zeros(len(w.h), bool)
        elsewhere[chosen] = answered_bits(answers, EXACT, segment_sizes(w.h[chosen], 64, log_s))
        group = np.cumsum(w.new) - 1
        gone = w.begin[w.order[elsewhere[group] | w.late]]
        n = int(w.first[-1])
        edge = np.bincount(gone, minlength=n + size + 1) - np.bincount(gone + size, minlength=n + size + 1)
        keep = np.cumsum(edge)[:n] == 0
        counts = np.diff(w.first)
        removed = counts - np.diff(np.append(0, np.cumsum(keep))[w.first])
        kept = []
        for i in range(len(t.ids)):
            own = t.text(i).split()
            kept.append(b" ".join(compress(own, keep[w.first[i] : w.first[i + 1]].tolist()) if removed[i] else own))
        return pa.RecordBatch.from_arrays([t.doc_ids(), pa.array(counts), pa.array(removed), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])

    return _each(tabs, apply, estimates.unionByName(grouped), REMOVED)


def op9(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
least AS (SELECT s, min(doc_id) AS first FROM win GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN least USING (s) WHERE doc_id > first),
lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT pos.doc_id, string_agg(w[pos.p], ' ' ORDER BY pos.p) AS t FROM pos ANTI JOIN gone ON pos.doc_id = gone.doc_id AND pos.p = gone.p GROUP BY pos.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN lists USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
