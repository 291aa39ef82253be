"""Similarity join of word shingles with adaptive multi-match prefixes.

1. Documents with one set of shingles are one representative, the smallest doc_id.
2. Tablets learn in how many representatives each shingle's cell occurs. Shingles are ordered by that count, then by hash. A
   shingle whose cell counts one is in one document, and only takes its place in the order.
3. Two sets of n and m shingles are similar if they share s = ceil(0.75 (n + m) / 1.75) or more. Then, for each l, at least l of
   what they share stands at places up to n - s + l - 1 of the one order and m - s + l - 1 of the other. A document takes the l
   whose estimated cost, the postings that its prefix meets and the candidates that these leave to verify, is least; a pair
   uses the smaller l of its two, and is verified only where it shares l.
4. Stars: the document of a shingle's list that has it earliest in its order, the most typical one, meets the others of the
   list; rows are as many as postings. Verified links make components.
5. What is one component already needs no pair. Lists with documents of several components are joined by (shingle, class of the
   shorter one's size): documents outside a list's largest component with all others, exactly, by places and l. Nothing else is skipped.
6. Pairs are verified on their whole sets, one set travelling to the other's tablet. Links make components.

A text of fewer words than a shingle is one shingle; without words it has none and links with nothing. Null is empty. A null
doc_id takes part and is never a component's name, unless the component has nothing else; rows that share a doc_id are documents
of their own. Of equal sizes the row with the smaller key counts as the shorter one. Very long texts are tablets of their own. An
empty table gives no rows. Shingles are told apart by 64-bit hashes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, table, unsettle
from .components import components
from .tablets import Tablet, _each, answer, ask, cell_bits, count_blocks, discard, distinct, expand, merge_counts, row_cells, segment_sizes, squeeze, tablets
from .textbytes import U64, lower_ascii, mix, release, slices, span_hashes, window_hashes, word_bounds

COUNTS, MEMBERS = 0, 9
#: The largest l, the cost of verifying a shingle against that of a posting, and the growth of a class of sizes.
DEPTHS, VERIFY, CLASS = 4, 0.02, 1.07


class Sets:
    """The distinct shingles of a tablet's documents, or of some of them: hashes sorted within each document. Slices of documents are taken one after another, which bounds the memory."""

    def __init__(self, t: Tablet, size: int, only: np.ndarray | None = None, slice_bytes: int = 1 << 20):
        parts, docs = [np.zeros(0, U64)], [np.zeros(0, np.int32)]
        for a, b in slices(t.off, slice_bytes):
            if only is None or only[a:b].any():
                h, doc = self._slice(t.data[t.off[a] : t.off[b]], t.off[a : b + 1] - t.off[a], size, None if only is None else only[a:b])
                parts.append(h)
                docs.append((doc + a).astype(np.int32))
        self.h, self.doc = np.concatenate(parts), np.concatenate(docs)
        self.n = np.bincount(self.doc, minlength=len(t.ids))
        self.upto = np.append(0, np.cumsum(self.n))

    @staticmethod
    def _slice(data: np.ndarray, off: np.ndarray, size: int, only: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        data = lower_ascii(data)
        starts, ends, first = word_bounds(data, off)
        h, _, doc = window_hashes(span_hashes(data, starts, ends), first, size, short=True)
        if only is not None:
            keep = only[doc]
            h, doc = h[keep], doc[keep]
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])) if len(h) else np.zeros(0, bool)
        return h[new], doc[new]


def _members(answers: dict, n: int) -> np.ndarray:
    """Which documents of the tablet are listed."""
    out = np.zeros(n, bool)
    out[np.frombuffer(answers.get((MEMBERS, 0), b""), "<i8")] = True
    return out


def _listed(rows: DataFrame) -> DataFrame:
    """tablet and place in it, packed as an answer: a tablet's list is bounded by its documents."""

    def run(group: pa.Table) -> pa.Table:
        places = np.unique(group["place"].to_numpy())
        return pa.table({"tablet": group["tablet"].slice(0, 1), "kind": pa.array([MEMBERS], pa.int32()), "segment": pa.array([0], pa.int32()), "answer": pa.array([places.astype("<i8").tobytes()], pa.binary())})

    return rows.select("tablet", "place").groupBy("tablet").applyInArrow(run, "tablet long, kind int, segment int, answer binary")


def depth(n: int, counts: np.ndarray, per_hundred: int) -> int:
    """The cheapest l of a set of n whose shingles, in order, occur so often: postings that a partner of the same size meets, and candidates, at most postings / l, each at the cost of a merge."""
    least, even = n - -(-per_hundred * n // 100), n - -(-2 * per_hundred * n // (100 + per_hundred))
    met = np.cumsum(counts - 1)
    ls = np.arange(1, DEPTHS + 1)
    ls = ls[least + ls <= n]
    return int(ls[np.argmin(met[even + ls - 1] * (1 + VERIFY * n / ls))]) if len(ls) else 1


def similar(docs: DataFrame, size: int = 5, per_hundred: int = 75, tablet_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of the component), key (the row), representative (its key). Similar: 100 * shared >= per_hundred * joined."""
    tabs = tablets(docs, tablet_bytes, id_col, text_col)
    log_s = tabs.log_segments
    bits = cell_bits((tabs.agg(F.sum("n_bytes")).first()[0] or 0) // 5, log_s)

    def describe(tablet: int, content: bytes) -> pa.RecordBatch:
        t = Tablet(content)
        x = Sets(t, size)
        sums = [np.append(U64(0), np.cumsum(v, dtype=np.uint64)) for v in (x.h, mix(x.h ^ U64(0x5851F42D4C957F2D)))]
        a, b = ((s[x.upto[1:]] - s[x.upto[:-1]]).view(np.int64) for s in sums)
        return pa.RecordBatch.from_arrays([t.doc_ids(), pa.array(np.full(len(t.ids), tablet)), pa.array(np.arange(len(t.ids))), pa.array(x.n), pa.array(a), pa.array(b)], names=["doc_id", "tablet", "place", "n", "sig_a", "sig_b"])

    rows = settle(_each(tabs, describe, None, "doc_id long, tablet long, place long, n long, sig_a long, sig_b long"))
    key = F.shiftleft("tablet", 20) + F.col("place")
    # Rows without shingles are kept apart: each is its own component.
    reps = settle(rows.where("n > 0").groupBy("n", "sig_a", "sig_b").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "tablet", "place")).alias("r")).select("n", "sig_a", "sig_b", "r.doc_id", "r.tablet", "r.place"))
    listed = settle(_listed(reps))

    def count(t: Tablet, answers: dict) -> Iterator[tuple[int, bytes]]:
        x = Sets(t, size, _members(answers, len(t.ids)))
        yield from count_blocks(*distinct(row_cells(x.h, 0, bits), np.ones(len(x.h), np.int64)), bits, log_s)

    counts = settle(answer(ask(tabs, count, listed), merge_counts(bits, log_s, repeated_only=False), COUNTS))

    def prefixes(tablet: int, content: bytes, answers: dict) -> pa.RecordBatch:
        t = Tablet(content)
        x = Sets(t, size, _members(answers, len(t.ids)))
        own = row_cells(x.h, 0, bits)
        cells = distinct(own, np.ones(len(own), np.int64))[0]
        got = [expand(answers[COUNTS, s], np.uint8) for s, _ in segment_sizes(cells, bits, log_s)]
        df = np.concatenate([np.zeros(0, np.uint8), *got])[np.searchsorted(cells, own)].astype(np.int64)
        order = np.lexsort((x.h, df, x.doc))
        h, df = x.h[order], df[order]
        out: list[list] = [[], [], [], [], []]
        for i in np.flatnonzero(x.n).tolist():
            a, n = int(x.upto[i]), int(x.n[i])
            base = n - -(-per_hundred * n // 100)
            if df[a + min(n, base + DEPTHS) - 1] < 2:
                continue
            d = df[a : a + n]
            ell = depth(n, d, per_hundred)
            p = np.arange(base + ell)
            p = p[d[p] > 1]
            if len(p):
                for o, v in zip(out, (h[a + p].view(np.int64), np.full(len(p), i), np.full(len(p), n), p, np.full(len(p), ell)), strict=True):
                    o.append(v)
        token, place, n, p, ell = (np.concatenate([np.zeros(0, np.int64), *o]) for o in out)
        return pa.RecordBatch.from_arrays([pa.array(token), pa.array((tablet << 20) + place), pa.array(n.astype(np.int32)), pa.array(p.astype(np.int32)), pa.array(ell.astype(np.int8))], names=["token", "key", "n", "p", "ell"])

    first = settle(_each(tabs, prefixes, counts.unionByName(listed), "token long, key long, n int, p int, ell byte"))

    def least_shared(n: Column, m: Column) -> Column:
        """What sets of n and m shingles must share: a whole number above 75 (n + m) / 175."""
        up = per_hundred * (n.cast("long") + m.cast("long")) + (99 + per_hundred)
        return (up - F.pmod(up, F.lit(100 + per_hundred))) / (100 + per_hundred)

    def near(a: str, b: str) -> Column:
        """Sizes and places allow the rows with these prefixes to be one of the l first that similar sets share."""
        c = lambda s, k: F.col(f"{s}{k}")
        need, ell = least_shared(c(a, "n"), c(b, "n")), F.least(c(a, "ell"), c(b, "ell")) - 1
        return (need <= F.least(c(a, "n"), c(b, "n"))) & (c(a, "p") <= c(a, "n") - need + ell) & (c(b, "p") <= c(b, "n") - need + ell)

    def matched(rows: DataFrame) -> DataFrame:
        """Pairs (a, b) that share l of their prefixes."""
        return rows.groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("l").alias("l")).where("shared >= l").select("a", "b")

    def pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
        return rows.select(F.col(f"{a}key").alias("a"), F.col(f"{b}key").alias("b"), F.least(F.col(f"{a}ell"), F.col(f"{b}ell")).alias("l"))

    def verified(found: DataFrame) -> DataFrame:
        """The pairs that are similar. The set of a travels to the tablet of b."""
        ship = settle(found.select("a", "b", F.shiftright("a", 20).alias("ta"), F.shiftright("b", 20).alias("tb")))

        def sets(tablet: int, content: bytes, answers: dict) -> pa.RecordBatch:
            asked = np.frombuffer(answers.get((MEMBERS, 1), b""), "<i8").reshape(-1, 2)  # (place, tablet to send it to)
            if not len(asked):
                return _packets([], [], [])
            t = Tablet(content)
            only = np.zeros(len(t.ids), bool)
            only[asked[:, 0]] = True
            x = Sets(t, size, only)
            body = {i: squeeze(np.diff(x.h[x.upto[i] : x.upto[i + 1]], prepend=U64(0))) for i in np.unique(asked[:, 0]).tolist()}
            return _packets([int(d) for d in asked[:, 1]], [(tablet << 20) + int(p) for p in asked[:, 0]], [body[int(p)] for p in asked[:, 0]])

        def wanted(group: pa.Table) -> pa.Table:
            both = np.unique(np.stack([group["a"].to_numpy() & ((1 << 20) - 1), group["tb"].to_numpy()], axis=1), axis=0)
            return pa.table({"tablet": group["ta"].slice(0, 1), "kind": pa.array([MEMBERS], pa.int32()), "segment": pa.array([1], pa.int32()), "answer": pa.array([both.astype("<i8").tobytes()], pa.binary())})

        asked = ship.select("ta", "tb", "a").distinct().groupBy("ta").applyInArrow(wanted, "tablet long, kind int, segment int, answer binary")
        sent = _each(tabs, sets, asked, "tablet long, key long, body binary")

        def check(left: pa.Table, right: pa.Table) -> pa.Table:
            body = {k: b for k, b in zip(right["key"].to_pylist(), right["body"], strict=True) if b.is_valid}
            ask_for = right.filter(pa.compute.is_null(right["body"]))
            a, b = ask_for["key"].to_numpy(), ask_for["other"].to_numpy()
            yes = []
            for content in left["content"] if len(a) else []:
                t = Tablet(content.as_py())
                only = np.zeros(len(t.ids), bool)
                only[b & ((1 << 20) - 1)] = True
                x = Sets(t, size, only)
                last = None
                for i in np.lexsort((b, a)).tolist():
                    if a[i] != last:
                        last, mine = a[i], np.cumsum(expand(body[int(a[i])].as_py(), np.uint64), dtype=np.uint64)
                    p = int(b[i]) & ((1 << 20) - 1)
                    theirs = x.h[x.upto[p] : x.upto[p + 1]]
                    at = np.searchsorted(theirs, mine)
                    shared = int((theirs[np.minimum(at, len(theirs) - 1)] == mine).sum())
                    if 100 * shared >= per_hundred * (len(mine) + len(theirs) - shared):
                        yes.append(i)
            release()
            return pa.table({"a": pa.array(a[yes], pa.int64()), "b": pa.array(b[yes], pa.int64())})

        mail = sent.select("tablet", "key", F.lit(None).cast("long").alias("other"), "body").unionByName(ship.select(F.col("tb").alias("tablet"), F.col("a").alias("key"), F.col("b").alias("other"), F.lit(None).cast("binary").alias("body")))
        out = settle(tabs.select("tablet", "content").groupBy("tablet").cogroup(mail.groupBy("tablet")).applyInArrow(check, "a long, b long"))
        unsettle(ship)
        return out

    leads = first.groupBy("token").agg(F.count("*").alias("size"), F.min(F.struct((F.col("p") / F.col("n")).alias("at"), "key", "n", "p", "ell")).alias("lead")).where("size > 1")
    met = first.join(leads.select("token", *(F.col(f"lead.{c}").alias(f"lead_{c}") for c in ("key", "n", "p", "ell"))), "token")
    star = met.select("*", *(F.col(c).alias(f"own_{c}") for c in ("key", "n", "p", "ell"))).where("key <> lead_key").where(near("lead_", "own_"))
    links = verified(matched(pairs(star, "lead_", "own_")))
    named = components(links)

    # The lists that hold several components, and each list's largest one.
    now = settle(first.join(named.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key")))
    sizes = now.groupBy("token", "component").agg(F.count("*").alias("c")).groupBy("token").agg(F.count("*").alias("kinds"), F.max_by("component", F.struct("c", "component")).alias("largest")).where("kinds > 1")
    mixed = settle(now.join(sizes.select("token", "largest"), "token").select("token", "key", "n", "p", "ell", "component", (F.col("component") != F.col("largest")).alias("minor")))
    of_size = lambda n: F.floor(F.ln(n) / math.log(CLASS)).cast("int")
    # As the shorter of two, and as the longer or equal one: the places that can count there.
    n, place = F.col("n"), F.col("p") - F.col("ell") + 1
    shorter = mixed.where(place <= n - least_shared(n, n)).select("token", of_size(n).alias("class"), *(F.col(c).alias(f"s_{c}") for c in ("key", "n", "p", "ell", "component", "minor")))
    lowest = F.ceil(F.lit(per_hundred / 100) * n)
    longer = mixed.select("*", F.explode(F.sequence(of_size(lowest), of_size(n))).alias("class"))
    longer = longer.where(place <= n - least_shared(n, F.greatest(lowest, F.floor(F.pow(F.lit(CLASS), F.col("class"))))))
    longer = longer.select("token", "class", *(F.col(c).alias(f"t_{c}") for c in ("key", "n", "p", "ell", "component", "minor")))
    apart = (F.col("s_component") != F.col("t_component")) & ((F.col("s_n") < F.col("t_n")) | (F.col("s_n") == F.col("t_n")) & (F.col("s_key") < F.col("t_key"))) & near("s_", "t_")
    by = ["token", "class"]
    found = pairs(shorter.where("s_minor").join(longer, by).where(apart), "s_", "t_").withColumn("ship", F.col("a"))
    found = found.unionByName(pairs(shorter.where("not s_minor").join(longer.where("t_minor"), by).where(apart), "s_", "t_").withColumn("ship", F.col("b")))
    # The set outside the largest component travels: those inside may be many for one outside.
    found = found.select(F.col("ship").alias("a"), (F.col("a") + F.col("b") - F.col("ship")).alias("b"), "l")
    more = verified(matched(found))
    c = components(links.unionByName(more))
    discard(tabs)  # what follows reads small tables alone
    unsettle(listed, counts, first, now, mixed, more, links)
    named = reps.withColumn("key", key).join(c.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    names = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(names, "component").select("n", "sig_a", "sig_b", F.col("key").alias("representative"), "component_id")
    keyed = rows.withColumn("key", key)
    out = keyed.where("n > 0").join(named, ["n", "sig_a", "sig_b"]).select("doc_id", "n", "component_id", "key", "representative")
    out = out.unionByName(keyed.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), "key", F.col("key").alias("representative")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "key", "representative")


def _packets(to: list[int], keys: list[int], bodies: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(keys, pa.int64()), pa.array(bodies, pa.binary())], names=["tablet", "key", "body"])


def op10(spark, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
