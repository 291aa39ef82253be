"""Suffix arrays by induced sorting.

A suffix is of type S if it is smaller than the next one, else L; a leftmost S is an LMS suffix. LMS substrings, which are short,
are sorted and named, and their suffixes sorted recursively as a shorter string, until all names differ; from their order all L
and then all S suffixes are induced in one sweep each. Over few characters a sweep takes the buckets of first characters in
order and each bucket's suffixes in waves: a wave's predecessors go to their buckets at once. Over many names, as reduced strings
have, buckets are short, and the sweep takes suffix by suffix, in one linear pass.

The permuted common prefixes are computed at irreducible positions, which are few in repetitive texts, and follow by counting down elsewhere."""

from __future__ import annotations

from array import array

import numpy as np

#: A sweep by waves has costs per bucket: it is used up to so many names, or one for so many places.
MOST_NAMES, SHARE = 512, 2000


def types(t: np.ndarray) -> np.ndarray:
    """True for S. The last suffix is L here, except that callers end t with a unique least character, which is S."""
    n = len(t)
    s = np.zeros(n, bool)
    s[-1] = True
    if n > 1:
        less, more = t[:-1] < t[1:], t[:-1] > t[1:]
        known = np.append(less | more, True)
        # The next place whose character differs from its successor decides.
        nxt = np.where(known, np.arange(n), n)
        nxt = np.minimum.accumulate(nxt[::-1])[::-1]
        s = np.append(less, True)[nxt]
    return s


def _place(sa: np.ndarray, head: np.ndarray, t: np.ndarray, j: np.ndarray, step: int, k: int) -> None:
    """Puts suffixes j, in order, at the heads (step 1) or tails (step -1) of their buckets."""
    c = t[j]
    order = np.argsort(c, kind="stable")
    counts = np.bincount(c, minlength=k)
    rank = np.arange(len(j)) - np.repeat(np.cumsum(counts) - counts, counts)
    sorted_c = c[order]
    sa[head[sorted_c] + step * rank] = j[order]
    head += step * counts


def _induce(t: np.ndarray, s: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """The suffix array that follows from LMS suffixes in the given order."""
    n = len(t)
    counts = np.bincount(t, minlength=k)
    end = np.cumsum(counts)
    start = end - counts
    sa = np.full(n, -1, np.int64)
    seeds = np.bincount(t[lms], minlength=k)
    by = lms[np.argsort(t[lms], kind="stable")]
    seed_end = np.cumsum(seeds)
    head = start.copy()
    lefts = np.bincount(t[~s], minlength=k)
    for c in range(k):
        if not counts[c]:
            continue
        a = start[c]
        while True:  # L suffixes of this bucket, in waves; a wave may add to the bucket
            b = head[c]
            if a == b:
                break
            j = sa[a:b] - 1
            a = b
            j = j[j >= 0]
            j = j[~s[j]]
            if len(j):
                _place(sa, head, t, j, 1, k)
        if seeds[c]:
            j = by[seed_end[c] - seeds[c] : seed_end[c]] - 1
            j = j[j >= 0]
            j = j[~s[j]]
            if len(j):
                _place(sa, head, t, j, 1, k)
    tail = end - 1
    for c in range(k - 1, -1, -1):
        if not counts[c]:
            continue
        b = end[c] - 1
        while True:
            a = tail[c]
            if a == b:
                break
            j = sa[a + 1 : b + 1][::-1] - 1
            b = a
            j = j[j >= 0]
            j = j[s[j]]
            if len(j):
                _place(sa, tail, t, j, -1, k)
        if lefts[c]:
            j = sa[start[c] : start[c] + lefts[c]][::-1] - 1
            j = j[j >= 0]
            j = j[s[j]]
            if len(j):
                _place(sa, tail, t, j, -1, k)
    sa[0] = n - 1  # the unique least character
    return sa


def _ints(a: np.ndarray) -> array:
    out = array("i")
    out.frombytes(np.ascontiguousarray(a, np.int32).tobytes())
    return out


def _induce_each(t: np.ndarray, s: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """As _induce, suffix by suffix: an entry that is read may have been placed by the same sweep."""
    counts = np.bincount(t, minlength=k)
    end = np.cumsum(counts)
    first = np.full(len(t), -1, np.int64)
    _place(first, end - 1, t, lms[::-1], -1, k)
    sa = _ints(first)
    # The bucket of the suffix before each one, if that is of the type of the sweep; sa's -1 finds the last entry.
    before = np.concatenate(([-1], t[:-1], [-1]))
    small = np.concatenate(([False], s[:-1], [False]))
    into, head = _ints(np.where(small, -1, before)), (end - counts).tolist()
    for j in sa:
        c = into[j]
        if c >= 0:
            at = head[c]
            sa[at], head[c] = j - 1, at + 1
    into, tail = _ints(np.where(small, before, -1)), (end - 1).tolist()
    for j in reversed(sa):
        c = into[j]
        if c >= 0:
            at = tail[c]
            sa[at], tail[c] = j - 1, at - 1
    out = np.frombuffer(sa, np.int32).astype(np.int64)
    out[0] = len(t) - 1  # the unique least character
    return out


def _named(t: np.ndarray, s: np.ndarray, lms: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """(rank of each LMS substring among the different ones, their number). Characters go with their types, S above L, so no substring is the beginning of another; as many as fit are compared as one integer, and ties go on behind them."""
    bits = max(1, int(2 * k - 1).bit_length())
    width = 63 // bits
    code = (t << 1) | s
    size = np.append(np.diff(lms) + 1, 1)
    order, group, live, at = np.arange(len(lms)), np.zeros(len(lms), np.int64), np.arange(len(lms)), 0
    while True:
        i = order[live]
        word = np.zeros(len(i), np.int64)
        for d in range(at, at + width):
            inside = size[i] > d
            word = (word << bits) | np.where(inside, code[np.minimum(lms[i] + d, len(t) - 1)], 0)
        by = np.lexsort((word, group[live])) if at else np.argsort(word, kind="stable")
        i, word = i[by], word[by]
        order[live] = i
        held = group[live]
        fresh = np.append(True, (word[1:] != word[:-1]) | (held[1:] != held[:-1]))
        # A group's number is the place of its first member.
        group[live] = live[np.maximum.accumulate(np.where(fresh, np.arange(len(live)), 0))]
        at += width
        alone = fresh & np.append(fresh[1:], True)
        # Equal ones that have ended are one name.
        live = live[~alone & (size[i] > at)]
        if not len(live):
            break
    first = np.append(True, group[1:] != group[:-1])
    names = np.empty(len(lms), np.int64)
    names[order] = np.cumsum(first) - 1
    return names, int(first.sum())


def suffix_array(t: np.ndarray, k: int | None = None) -> np.ndarray:
    """t: integers from 0; its last one is 0 and no other is. k: one more than the largest."""
    n = len(t)
    t = t.astype(np.int64) if t.dtype.kind != "i" else t
    k = int(t.max()) + 1 if k is None else k
    if n < 3:
        return np.arange(n)[::-1].copy()
    s = types(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    names, different = _named(t.astype(np.int64), s, lms, k)
    if different < len(lms):
        order = lms[suffix_array(names, different)]
    else:
        order = np.empty(len(lms), np.int64)
        order[names] = lms
    return (_induce if k <= MOST_NAMES or k <= n // SHARE else _induce_each)(t, s, order, k)


def permuted_prefixes(data: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each position, the length of the common prefix with the suffix before it in the array, to `most` at least where it is longer. data: bytes, one per place of sa's text."""
    n = len(sa)
    phi = np.empty(n, np.int64)
    phi[sa[0]] = -1
    phi[sa[1:]] = sa[:-1]
    i = np.arange(n)
    before = np.where((i > 0) & (phi > 0), data[np.maximum(phi, 1) - 1] == np.concatenate(([0], data[:-1])), False) & (i > 0) & (phi > 0)
    # Reducible where the characters before agree and the neighbour before is the neighbour of the one before.
    before[1:] &= phi[1:] - 1 == phi[:-1]
    start = np.flatnonzero(~before)
    start = start[phi[start] >= 0]
    value = np.zeros(n, np.int64)
    wide = np.concatenate((data, np.zeros(8, np.uint8)))
    words = np.ndarray((n,), "<u8", wide.data, 0, (1,))
    live, got = start, 0
    while len(live):
        x, y = live + got, phi[live] + got
        inside = (x < n) & (y < n)
        live, x, y = live[inside], x[inside], y[inside]
        diff = words[x] ^ words[y]
        same = diff == 0
        rest = diff[~same]
        low = rest & (~rest + np.uint64(1))
        value[live[~same]] = got + np.log2(low.astype(np.float64)).astype(np.int64) // 8
        live = live[same]
        got += 8
        value[live] = got
    # Elsewhere the value is one less than the place before, counted from the last irreducible one.
    last = np.maximum.accumulate(np.where(before, -1, i))
    return np.maximum(value[np.maximum(last, 0)] - (i - last), 0)
