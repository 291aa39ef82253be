"""Toxicity by multiple-instance learning: a document is a bag of sentences.

A sentence's score is a logistic function of hashed words and word beginnings; a document's is the noisy-or of its sentences,
1 - prod(1 - s). A sentence without a feature that weighs adds nothing, and sentences below one half add up to what BAG of them
would at most, so that length alone makes no document toxic; one sentence of a half or more counts whole, however long the
document. Only documents carry labels. Weights are fitted on the driver to at most `train_limit` labelled documents
(those with the lowest hash of id, then of id and text, equal rows once); they are at most `features` numbers, whatever the corpus. All documents are then
scored where they lie, without a shuffle, and the worst sentence of each is located in the text; of equals the first.

Training never sees a row whose crc32 of the id's decimal digits, modulo 3, is 1. A null or empty text has no sentence and
scores 0. Rows with null ids are scored and never trained on or held out; repeated rows are scored each. Without labels of
both kinds all scores are 0. Very long texts are scored whole; an empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, lowest, settle, table, unsettle
from .textbytes import buffers, lower_ascii, release, slices, span_hashes

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 63]] = True
#: Word beginnings of so many bytes are features beside whole words; a sentence ends here at the latest.
BEGINNINGS, LONGEST, BIAS = (3, 4, 5, 6, 7, 8, 9), 64, -10.0
#: Of a document with more sentences than this, the weak ones count by their mean.
BAG = 1024
#: Texts are worked through in slices of so many bytes, or a document, which bounds the memory.
SLICE = 1 << 20


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, sentence) of each feature, and (document, byte at which it starts) of each sentence."""
    if not len(data):
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    low = lower_ascii(data)
    ink = _LETTER[low]
    new = np.zeros(len(data) + 1, bool)
    new[off] = True
    starts = np.flatnonzero(ink & (~np.append(False, ink[:-1]) | new[:-1]))
    ends = np.flatnonzero(ink & (~np.append(ink[1:], False) | new[1:])) + 1
    stops = np.append(0, np.cumsum(_STOP[data] | new[1:]))
    run = stops[starts]
    # A run of words without a full stop is cut every LONGEST words.
    first = np.searchsorted(run, run, "left")
    place = (np.arange(len(run)) - first) // LONGEST
    fresh = np.ones(len(run), bool)
    fresh[1:] = (run[1:] != run[:-1]) | (place[1:] != place[:-1])
    sentence = np.cumsum(fresh) - 1
    begin = starts[fresh]
    hashes, where = [span_hashes(low, starts, ends)], [sentence]
    for k in BEGINNINGS:
        long = ends - starts > k
        if long.any():
            hashes.append(span_hashes(low, starts[long], starts[long] + k) + np.uint64(k))
            where.append(sentence[long])
    return np.concatenate(hashes), np.concatenate(where), np.searchsorted(off, begin, "right") - 1, begin


def evidence(z: np.ndarray, told: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(minus the log of each document's chance to be clean, share at which each sentence counts). told: sentences with a feature."""
    many = np.maximum(np.bincount(owner, minlength=n), 1)
    share = np.where(z < 0, np.minimum(1, BAG / many)[owner], 1.0) * told
    return np.bincount(owner, np.logaddexp(0, z) * share, n), share


def fit(bags: list[tuple[np.ndarray, np.ndarray, int, int]], size: int, rounds: int = 150, rate: float = 0.3, shrink: float = 2e-4) -> np.ndarray:
    """Weights of the features 0 .. size - 1. bags: (features, their sentences, label, number of sentences) of each document."""
    y = np.array([b[2] for b in bags])
    doc = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
    upto = np.cumsum([0, *(max(1, b[3]) for b in bags)])
    f, s = np.concatenate([b[0] for b in bags]), np.concatenate([b[1] for b in bags]) + upto[doc]
    owner = np.repeat(np.arange(len(bags)), np.diff(upto))
    told = np.bincount(s, minlength=upto[-1]) > 0
    w, power = np.ones(size), np.full(size, 1e-8)
    for _ in range(rounds):
        z = BIAS + np.bincount(s, w[f], upto[-1])
        prob = 1 / (1 + np.exp(-z))
        clean, share = evidence(z, told, owner, len(bags))
        pull = np.where(y == 1, -1 / np.expm1(np.clip(clean, 1e-9, 500)), 1.0)
        g = np.bincount(f, (pull[owner] * prob * share)[s], size) / len(bags) + shrink * np.sign(w) / size + 1e-6 * w
        power = 0.9 * power + 0.1 * g * g
        w = np.clip(w - rate * g / (np.sqrt(power) + 1e-8), 0, 25)
    return w


def matched(h: np.ndarray, sentence: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Sorted distinct sentence * len(names) + feature, of the features in names alone."""
    sieve = np.zeros(1 << 20, bool)
    sieve[names & np.uint64((1 << 20) - 1)] = True
    near = np.flatnonzero(sieve[h & np.uint64((1 << 20) - 1)])
    at = np.minimum(np.searchsorted(names, h[near]), len(names) - 1)
    hit = names[at] == h[near]
    return np.unique(sentence[near[hit]] * len(names) + at[hit])


def score(data: np.ndarray, off: np.ndarray, names: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, byte at which the worst sentence starts or -1, its score) of each document."""
    n = len(off) - 1
    h, sentence, doc, begin = features(data, off)
    if not len(doc) or not len(names):
        return np.zeros(n), np.full(n, -1), np.zeros(n)
    pair = matched(h, sentence, names)
    z = BIAS + np.bincount(pair // len(names), weights[pair % len(names)], len(doc))
    total, _ = evidence(z, z > BIAS, doc, n)
    order = np.lexsort((-begin, z, doc))
    last = np.flatnonzero(np.append(doc[order][1:] != doc[order][:-1], True))
    worst, best = np.full(n, -1), np.zeros(n)
    top = order[last]
    worst[doc[top]], best[doc[top]] = begin[top] - off[doc[top]], 1 / (1 + np.exp(-z[top]))
    return 1 - np.exp(-total), worst, best


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, train_limit: int = 6000, most: int = 1024, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, weights). train_limit bounds the ids that are broadcast and the documents that are read twice: once to
    count in how many documents of either label each feature is, once to take the sentences' chosen features to the driver."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    own = lowest(settle(own.groupBy("doc_id").agg(F.max("y").alias("y"))), F.xxhash64("doc_id"), train_limit).drop("hash")
    labelled = settle(id_text(docs, id_col, text_col).join(F.broadcast(own), "doc_id").select("doc_id", "y", "text"))
    # An id may stand in any number of rows.
    rows = settle(lowest(labelled, F.xxhash64("doc_id", "text"), train_limit).select("y", "text"))
    unsettle(labelled)
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    none = np.zeros(0, np.uint64), np.zeros(0)
    if len(sizes) < 2:
        return none

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = buffers(b.column(1))
            y = b.column(0).to_numpy(zero_copy_only=False).astype(np.int32)
            for i, j in slices(off, SLICE):
                h, s, doc, _ = features(data[off[i] : off[j]], off[i : j + 1] - off[i])
                pair = np.unique(np.stack([doc[s].astype(np.uint64), h], axis=1).view([("d", "u8"), ("h", "u8")]).ravel()) if len(h) else np.zeros(0, [("d", "u8"), ("h", "u8")])
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pair["h"]).view(np.int64)), pa.array(y[i:j][pair["d"].astype(np.int64)])], names=["h", "y"])

    p, q = (F.sum("y") + 0.5) / (sizes[1] + 1), (F.sum(1 - F.col("y")) + 0.5) / (sizes[0] + 1)
    counted = rows.mapInArrow(each, "h long, y int").groupBy("h").agg(F.sum("y").alias("pos"), (F.sum("y") * F.log(p / q)).alias("worth"), (p / q).alias("times"))
    chosen = counted.where((F.col("pos") >= 3) & (F.col("times") > 2)).orderBy(F.desc("worth"), "h").limit(most).select("h").collect()
    if not chosen:
        return none
    names = np.sort(np.array([r["h"] for r in chosen], np.int64).view(np.uint64))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = buffers(b.column(1))
            for i in range(b.num_rows):
                h, s, doc, _ = features(data[off[i] : off[i + 1]], np.array([0, off[i + 1] - off[i]]))
                pair = np.append(matched(h, s, names), len(doc) * len(names)) if len(h) else np.zeros(1, np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([pair.astype(np.int64).tobytes()], pa.binary())], names=["y", "pairs"])

    got = []
    for r in rows.mapInArrow(bags, "y int, pairs binary").toLocalIterator():
        pair = np.frombuffer(r["pairs"], np.int64)  # the last stands for the number of sentences
        got.append((pair[:-1] % len(names), pair[:-1] // len(names), r["y"], int(pair[-1]) // len(names)))
    return names, fit(got, len(names))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, train_limit: int = 6000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose score reaches threshold; all columns as they were."""
    names, weights = train(docs, labels, train_limit, id_col=id_col, text_col=text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = buffers(b.column(at).cast(pa.string()))
            for i, j in slices(off, SLICE):
                total, _, _ = score(data[off[i] : off[j]], off[i : j + 1] - off[i], names, weights)
                yield b.slice(i, j - i).filter(pa.array(total < threshold))
            release()

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, train_limit: int = 6000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, and the worst sentence's first byte and score."""
    d = id_text(docs, id_col, text_col)
    names, weights = train(d, labels, train_limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = buffers(b.column(1))
            for i, j in slices(off, SLICE):
                total, worst, best = score(data[off[i] : off[j]], off[i : j + 1] - off[i], names, weights)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(total), pa.array(worst), pa.array(best)], names=["doc_id", "score", "worst_at", "worst_score"])
            release()

    out = d.mapInArrow(run, "doc_id long, score double, worst_at long, worst_score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "worst_at", "worst_score")


def op8(spark, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
