"""Substring dedup with sharded suffix arrays.

Every string of `length` bytes has an anchor: the k-gram in it whose hash is least, the leftmost of equals. Neighbouring strings
with one anchor make a piece of text. First pass: tablets ask which anchors occur again anywhere; pieces of anchors that don't
hold nothing repeated. Second pass: the other pieces go to shards by their anchor's hash, so equal strings meet in one shard. A
tablet sends equal pieces once, and a shard keeps the earliest of equal pieces. An anchor that occurs often is narrowed first: its
pieces are cut in two, by whether a string reaches far behind the anchor or far before it, and either half goes by the text that
all its strings then hold. Narrowed anchors that still have more than MOST different pieces are narrowed again, to the whole
string at last, so no shard is made large by what many texts share. Each shard builds suffix arrays of its pieces
by induced sorting and their permuted common prefixes; suffixes that share `length` bytes lie side by side, and all but the
earliest of them are repeats. Last pass: tablets remove the bytes that repeats cover.

Earlier means a smaller doc_id, or the same document and an earlier start; rows that share a doc_id stand in the order in which they are
stored. Texts are UTF-8 bytes; null is empty. A null doc_id is larger than any other. A very long text is a tablet of its own. An
empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, table, unsettle
from .sais import permuted_prefixes, suffix_array
from .tablets import ANSWER, Tablet, _each, answer, answered_bits, ask, cell_bits, count_blocks, cut_blocks, distinct, expand, join_blocks, merge_counts, row_cells, segment_sizes, squeeze, tablets
from .textbytes import U64, mix, octets, pair, slices, span_hashes

ANCHORS, REPEATS, NARROW, GRAM = 0, 1, 2, 16
#: Anchors that occur so often, or more, are narrowed, and again while they have more different pieces than MOST.
HOT, MOST = 200, 16384
#: A shard is worked through in so many parts, by further bits of the anchors' hashes.
PART_BITS = 3
PARTS = 1 << PART_BITS
_PIECE = 0xD6E8FEB86659FD93
LOW = U64(0xFFFFFFFF)
CLEANED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours, by doubling."""
    k = 1
    while k * 2 <= w:
        a = np.minimum(a[:-k], a[k:])
        k *= 2
    return np.minimum(a[: len(a) - (w - k)], a[w - k :]) if w > k else a


def _pieces(data: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...] | None:
    n, gram = len(data), min(GRAM, length)
    long = np.flatnonzero(np.diff(off) >= length)
    if not len(long):
        return None
    at = np.arange(n - gram + 1)
    by = octets(data)
    h = pair(mix(by[: len(at)]), by[8 : 8 + len(at)]) if gram == 16 else span_hashes(data, at, at + gram)
    least = sliding_min((h & ~LOW) | at.astype(np.uint64), length - gram + 1)
    edge = np.bincount(off[long], minlength=n + 2) - np.bincount(off[long + 1] - length + 1, minlength=n + 2)
    v = np.flatnonzero(np.cumsum(edge)[: len(least)] > 0)
    anchor = (least[v] & LOW).astype(np.int64)
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (v[1:] != v[:-1] + 1))
    first, last = v[new], v[np.append(new[1:], True)]
    # An anchor's hash is the least of many: only mixed again is it spread evenly over segments and shards.
    return first, last, mix(h[anchor[new]] ^ U64(_PIECE)), anchor[new]


class Pieces:
    """A tablet's pieces: first and last start of their strings, their anchors' hashes and places. Slices of documents are taken one after another, which bounds the memory."""

    def __init__(self, first: np.ndarray, last: np.ndarray, key: np.ndarray, anchor: np.ndarray):
        self.first, self.last, self.key, self.anchor = first, last, key, anchor

    @staticmethod
    def of(t: Tablet, length: int, slice_bytes: int = 1 << 20) -> Pieces:
        parts = [tuple(np.zeros(0, kind) for kind in (np.int64, np.int64, np.uint64, np.int64))]
        for a, b in slices(t.off, slice_bytes):
            lo, hi = int(t.off[a]), int(t.off[b])
            if hi - lo >= length and (got := _pieces(t.data[lo:hi], t.off[a : b + 1] - lo, length)):
                parts.append((got[0] + lo, got[1] + lo, got[2], got[3] + lo))
        return Pieces(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    def packed(self) -> bytes:
        return join_blocks([squeeze(x) for x in (np.diff(self.first, prepend=0).astype(np.uint32), (self.last - self.first).astype(np.uint32), self.key, (self.anchor - self.first).astype(np.uint32))])

    @staticmethod
    def unpacked(t: Tablet) -> Pieces:
        blocks = cut_blocks(t.extra)
        first, wide, anchor = (expand(blocks[i], np.uint32).astype(np.int64) for i in (0, 1, 3))
        first = np.cumsum(first)
        return Pieces(first, first + wide, expand(blocks[2], np.uint64), first + anchor)

    def cells(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        return distinct(row_cells(self.key, 0, bits), np.ones(len(self.key), np.int64))

    def narrowed(self, t: Tablet, length: int, answers: dict, bits: int, log_segments: int, levels: int) -> np.ndarray:
        """Keeps the pieces whose anchor occurs again, and cuts those of frequent anchors, and of what the answers list for each level. Returns which came from the last cut."""
        cells = self.cells(bits)[0]
        got = [expand(answers[ANCHORS, s], np.uint8) for s, _ in segment_sizes(cells, bits, log_segments)]
        count = np.concatenate([np.zeros(0, np.uint8), *got])[np.searchsorted(cells, row_cells(self.key, 0, bits))]
        self._take(count > 1)
        self.left, self.right = np.zeros(len(self.key), np.int64), np.zeros(len(self.key), np.int64)
        live = self._cut(t, length, count[count > 1] >= HOT)
        for level in range(levels):
            live = self._cut(t, length, live & np.isin(self.key, np.frombuffer(answers.get((NARROW, level), b""), "<u8")))
        return live

    def ordered(self, t: Tablet, length: int) -> np.ndarray:
        """Puts pieces in order of key, equal ones together; returns which are the first of their kind here."""
        self.content = self.contents(t, length)
        of = np.searchsorted(t.off, self.first, "right") - 1
        self._take(np.lexsort((self.first, t.ids[of], t.null[of], self.content, self.key)))
        equal = np.append(False, (self.content[1:] == self.content[:-1]) & (self.key[1:] == self.key[:-1]))[: len(self.key)]
        return ~same_text(t.data, self.first, self.last - self.first + length, equal)

    def contents(self, t: Tablet, length: int, i: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Hashes of pieces' texts."""
        return span_hashes(t.data, self.first[i], self.last[i] + length)

    def _take(self, i: np.ndarray) -> None:
        for name in ("first", "last", "key", "anchor", "content", "left", "right"):
            if hasattr(self, name):
                setattr(self, name, getattr(self, name)[i])

    def _cut(self, t: Tablet, length: int, which: np.ndarray) -> np.ndarray:
        """Cuts pieces in two. All strings of a piece hold `left` bytes before the anchor and `right` behind it. Of those with some free
        bytes left, one half reaches half of these farther behind, and the other, which does not, at least as far before. Each
        goes by what its strings hold now, so equal strings still meet. Returns which pieces are halves."""
        gram = min(GRAM, length)
        free = length - gram - self.left - self.right
        cut = np.flatnonzero(which & (free > 0))
        if not len(cut):
            return np.zeros(len(self.key), bool)
        p, first, last, key, left, right = (x[cut] for x in (self.anchor, self.first, self.last, self.key, self.left, self.right))
        half = (free[cut] + 1) // 2
        other = free[cut] - half + 1
        bound = p + gram + right + half - length  # the first start that reaches so far behind
        a, b = last >= bound, first < bound
        after = mix(key[a] ^ span_hashes(t.data, (p + gram + right)[a], (p + gram + right + half)[a]))
        before = mix(key[b] ^ mix(span_hashes(t.data, (p - left - other)[b], (p - left)[b]) ^ U64(_PIECE)))
        begin, end = np.concatenate((np.maximum(first, bound)[a], first[b])), np.concatenate((last[a], np.minimum(last, bound - 1)[b]))
        rest = np.ones(len(self.key), bool)
        rest[cut] = False
        both = lambda kept, x, y: np.concatenate((kept[rest], x, y))
        self.first, self.last = np.concatenate((self.first[rest], begin)), np.concatenate((self.last[rest], end))
        self.key, self.anchor = both(self.key, after, before), both(self.anchor, p[a], p[b])
        self.left, self.right = both(self.left, left[a], (left + other)[b]), both(self.right, (right + half)[a], right[b])
        return np.arange(len(self.key)) >= int(rest.sum())


def gather(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """data[b : b + s] of all b and s, one after another."""
    ends = np.cumsum(size)
    return data[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - size), size)]


def same_text(data: np.ndarray, begin: np.ndarray, size: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """equal, where it says that a span is the one before it, as far as their bytes are the same."""
    i = np.flatnonzero(equal)
    i = i[size[i] == size[i - 1]]
    out = np.zeros(len(begin), bool)
    if len(i):
        differ = gather(data, begin[i], size[i]) != gather(data, begin[i - 1], size[i])
        out[i] = ~np.logical_or.reduceat(differ, np.cumsum(size[i]) - size[i])
    return out


def late_strings(text: np.ndarray, size: np.ndarray, ids: np.ndarray, null: np.ndarray, tab: np.ndarray, pos: np.ndarray, length: int) -> np.ndarray:
    """For each string of each piece, whether an equal one starts earlier. Pieces lie in text one after another."""
    begin = np.cumsum(size) - size
    content = span_hashes(text, begin, begin + size)
    order = np.lexsort((pos, tab, ids, null, content))
    first = order[~same_text(text, begin[order], size[order], np.append(False, content[order][1:] == content[order][:-1]))]
    # One text of the earliest pieces, each with a mark behind it. No byte of UTF-8 reaches 254.
    own = size[first]
    t = np.ones(int(own.sum()) + len(first) + 1, np.uint8)
    t[-1] = 0
    at = np.cumsum(own + 1) - own - 1
    t[np.arange(int(own.sum())) + np.repeat(at - (np.cumsum(own) - own), own)] = gather(text, begin[first], own) + np.uint8(2)
    sa = suffix_array(t.astype(np.int16), 256)
    common = permuted_prefixes(t, sa, length)[sa]
    # Each string's time: its document, then its start.
    _, owner = np.unique(np.stack([null[first], ids[first], tab[first]], axis=1), axis=0, return_inverse=True)
    count = own - length + 1
    where = gather(np.arange(len(t)), at, count)
    when = np.full(len(t), -1, np.int64)
    when[where] = np.repeat((owner.ravel() << 32) + pos[first], count) + (where - np.repeat(at, count))
    group = np.cumsum(common < length)
    held = when[sa] >= 0
    group, p = group[held], sa[held]
    edge = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    least = np.repeat(np.minimum.reduceat(when[p], edge), np.diff(np.append(edge, len(p))))
    late = np.zeros(len(t), bool)
    late[p] = when[p] > least
    # Pieces that aren't the earliest of their kind are repeats all over.
    spans = size - length + 1
    out = np.ones(int(spans.sum()), bool)
    starts = np.cumsum(spans) - spans
    out[np.repeat(starts[first] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))] = late[where]
    return out


def find_repeats(length: int):
    """Answers a shard's blocks, one part of it after another: equal strings share their part, and a part's arrays are small."""

    def reply(segment: int, blocks: list[bytes]) -> list[bytes]:
        parts = [cut_blocks(b) for b in blocks]
        sizes = [expand(p[1], np.uint32).astype(np.int64) for p in parts]
        n = list(map(len, sizes))
        size, ids, pos = np.concatenate(sizes), np.concatenate([expand(p[2], np.int64) for p in parts]), np.concatenate([expand(p[3], np.int64) for p in parts])
        null = np.concatenate([np.unpackbits(np.frombuffer(p[6], np.uint8), count=k).astype(bool) for p, k in zip(parts, n, strict=True)])
        tab, of = np.repeat([int.from_bytes(p[0], "little") for p in parts], n), np.repeat(np.arange(len(parts)), n)
        text = np.concatenate([expand(p[4], np.uint8) for p in parts])
        part = np.concatenate([np.repeat(np.arange(PARTS), expand(p[5], np.uint32)) for p in parts])
        begin, spans = np.cumsum(size) - size, size - length + 1
        out, at = np.zeros(int(spans.sum()), bool), np.cumsum(spans) - spans
        for k in range(PARTS):
            i = np.flatnonzero(part == k)
            if len(i):
                late = late_strings(gather(text, begin[i], size[i]), size[i], ids[i], null[i], tab[i], pos[i], length)
                out[np.arange(len(late)) + np.repeat(at[i] - (np.cumsum(spans[i]) - spans[i]), spans[i])] = late
        cuts = np.cumsum(np.bincount(of, spans, len(parts)).astype(np.int64))[:-1]
        return [np.packbits(x).tobytes() for x in np.split(out, cuts)]

    return reply


def _listed(level: int):
    """Packs a tablet's keys as an answer of a level."""

    def run(group: pa.Table) -> pa.Table:
        keys = np.unique(group["key"].to_numpy().astype("<i8"))
        return pa.table({"tablet": group["tablet"].slice(0, 1), "kind": pa.array([NARROW], pa.int32()), "segment": pa.array([level], pa.int32()), "answer": pa.array([keys.tobytes()], pa.binary())})

    return run


def narrow(tabs: DataFrame, known: DataFrame, length: int, bits: int, log_s: int) -> tuple[DataFrame, int]:
    """(known with the lists of what is to be cut again, by tablet and level; number of these levels). Different pieces are counted exactly, by distinct rows; nothing is gathered by key."""

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if any((expand(x.as_py(), np.uint8) >= HOT).any() for x in b.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32())], names=["hot"])

    levels = 0
    if known.select("answer").mapInArrow(frequent, "hot int").isEmpty():
        return known, levels
    while True:

        def halves(tablet: int, content: bytes, answers: dict, levels=levels) -> pa.RecordBatch:
            t = Tablet(content, tablet)
            x = Pieces.unpacked(t)
            live = np.flatnonzero(x.narrowed(t, length, answers, bits, log_s, levels))
            key, content = x.key[live], x.contents(t, length, live) if len(live) else np.zeros(0, U64)
            order = np.lexsort((content, key))
            key, content = key[order], content[order]
            new = np.append(True, (key[1:] != key[:-1]) | (content[1:] != content[:-1]))[: len(key)]
            key, content = key[new].view(np.int64), content[new].view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), tablet)), pa.array(key), pa.array(content)], names=["tablet", "key", "content"])

        rows = settle(_each(tabs, halves, known, "tablet long, key long, content long"))
        large = settle(rows.select("key", "content").distinct().groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > MOST).select("key"))
        if large.isEmpty():
            unsettle(rows, large)
            return known, levels

        lists = settle(rows.select("tablet", "key").distinct().join(large, "key").groupBy("tablet").applyInArrow(_listed(levels), ANSWER))
        unsettle(rows, large)
        known, levels = known.unionByName(lists), levels + 1


def remove_substrings(docs: DataFrame, length: int = 100, tablet_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes)."""
    # Pieces are found once and lie beside their texts.
    tabs = tablets(docs, tablet_bytes, id_col, text_col, lambda t: Pieces.of(t, length).packed())
    log_s = tabs.log_segments
    log_shards = log_s + 2
    bits = cell_bits((tabs.agg(F.sum("n_bytes")).first()[0] or 0) // 20, log_s, 16)

    def anchors(t: Tablet) -> Iterator[tuple[int, bytes]]:
        yield from count_blocks(*Pieces.unpacked(t).cells(bits), bits, log_s)

    again = settle(answer(ask(tabs, anchors), merge_counts(bits, log_s, repeated_only=False), ANCHORS))
    again, levels = narrow(tabs, again, length, bits, log_s)

    def pieces(t: Tablet, answers: dict) -> Iterator[tuple[int, bytes]]:
        x = Pieces.unpacked(t)
        x.narrowed(t, length, answers, bits, log_s, levels)
        x._take(x.ordered(t, length))
        doc = np.searchsorted(t.off, x.first, "right") - 1
        ids, null = t.ids[doc], t.null[doc]
        size, at = x.last - x.first + length, 0
        for s, n in segment_sizes(x.key, 64, log_shards):
            i = slice(at, at + n)
            of = (x.key[i] >> U64(64 - log_shards - PART_BITS) & U64(PARTS - 1)).astype(np.int64)
            yield s, join_blocks([t.number.to_bytes(8, "little"), squeeze(size[i].astype(np.uint32)), squeeze(ids[i]), squeeze(x.first[i]), squeeze(gather(t.data, x.first[i], size[i])), squeeze(np.bincount(of, minlength=PARTS).astype(np.uint32)), np.packbits(null[i]).tobytes()])
            at += n

    repeats = settle(answer(ask(tabs, pieces, again), find_repeats(length), REPEATS))

    def apply(tablet: int, content: bytes, answers: dict) -> pa.RecordBatch:
        t = Tablet(content, tablet)
        x = Pieces.unpacked(t)
        x.narrowed(t, length, answers, bits, log_s, levels)
        new = x.ordered(t, length)
        count = x.last - x.first + 1
        late = np.ones(int(count.sum()), bool)
        upto = np.append(0, np.cumsum(count[new]))
        at, sizes = 0, []
        for s, n in segment_sizes(x.key[new], 64, log_shards):
            sizes.append((s, int(upto[at + n] - upto[at])))
            at += n
        starts = np.cumsum(count) - count
        late[gather(np.arange(len(late)), starts[new], count[new])] = answered_bits(answers, REPEATS, sizes)
        begin = (np.repeat(x.first - starts, count) + np.arange(len(late)))[late]
        n = len(t.data)
        edge = np.bincount(begin, minlength=n + length + 1) - np.bincount(begin + length, minlength=n + length + 1)
        gone = np.cumsum(edge)[:n] > 0
        opening = gone & ~np.append(False, gone[:-1])[:n]
        inner = t.off[:-1][t.off[:-1] < n]
        opening[inner] = gone[inner]
        of = lambda mask: np.diff(np.append(0, np.cumsum(mask))[t.off])
        removed, keep = of(gone), ~gone
        kept = [t.data[a:b][keep[a:b]].tobytes() if r else t.data[a:b].tobytes() for a, b, r in zip(t.off[:-1].tolist(), t.off[1:].tolist(), removed.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([t.doc_ids(), pa.array(np.diff(t.off)), pa.array(removed), pa.array(of(opening)), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return _each(tabs, apply, again.unionByName(repeats), CLEANED)


def op6(spark, sf_dir: str) -> DataFrame:
    return remove_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
