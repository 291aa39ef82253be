"""Plain Python versions of the contracts, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
INK = re.compile(r"[^\x20\x09-\x0D]+")


def substrings(rows, length=100):
    seen, out = set(), {}
    for i, text in sorted(rows):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            if s in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


def windows(rows, size=13):
    words = {i: INK.findall(t or "") for i, t in rows}
    least = {}
    for i, w in words.items():
        for k in range(len(w) - size + 1):
            s = tuple(w[k : k + size])
            least[s] = min(i, least.get(s, i))
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - size + 1):
            if least[tuple(w[k : k + size])] < i:
                gone |= set(range(k, k + size))
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    return out


def shingles(text, size=5):
    w = INK.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def classes(rows, per_hundred=75):
    sets = {i: shingles(t) for i, t in rows}
    inverted = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            inverted[x].append(i)
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in sorted(sets.items()):
        for j, k in Counter(j for x in s for j in inverted[x] if j < i).items():
            if 100 * k >= per_hundred * (len(s) + len(sets[j]) - k):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}
