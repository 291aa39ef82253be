"""Token ids of whole texts with the tokenizers library, each distinct piece of text encoded once per worker.

The pre-tokeniser of the word-end vocabulary drops white space, never joins what white space separates, takes digits one by
one, and ends a run of letters or of marks where the other begins. Cutting there, and leaving white space out, changes no id, so
ids are looked up by piece. Pieces that have been seen are known by 128 bits of two hashes, in sorted arrays."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa

from .textbytes import SPACE, U64, buffers, release, slices, span_hashes

#: Kinds of bytes: other, white space, small letter, capital, digit, mark, apostrophe.
OTHER, WHITE, SMALL, CAPITAL, NUMBER, MARK, APOSTROPHE = range(7)
KIND = np.zeros(256, np.uint8)
KIND[33:127] = MARK
KIND[97:123], KIND[65:91], KIND[48:58], KIND[39] = SMALL, CAPITAL, NUMBER, APOSTROPHE
KIND[SPACE] = WHITE
CUT = np.zeros((8, 8), bool)
CUT[WHITE, :] = True
CUT[WHITE, WHITE] = False
CUT[[[SMALL], [CAPITAL]], [MARK, APOSTROPHE]] = True
CUT[MARK, [SMALL, CAPITAL]] = True
CUT[NUMBER, :] = CUT[:, NUMBER] = True
CUT = CUT.ravel()
RARE = np.zeros(256, bool)
RARE[:32] = RARE[127] = True
RARE[[9, 10, 13]] = False
#: Words of these letters are one piece for the pre-tokeniser; normalisation only lowers them.
_PLAIN = re.compile("[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u0148\u014a-\u017e]+").fullmatch


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()
#: The second hash of a piece starts here.
_SEED = 0x2545F4914F6CDD1D


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """limit: bytes of pieces that are remembered, with their ids; beyond that the memory starts anew, which changes no result. Texts are encoded in slices of slice_bytes, very long ones in parts."""

    def __init__(self, path: str | None = None, limit: int = 32 << 20, slice_bytes: int = 2 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tk, self.limit, self.slice_bytes = Tokenizer.from_file(path or default_vocabulary()), limit, slice_bytes
        self.model = self.tk.model
        self.forget()

    def forget(self) -> None:
        """Sorted hashes of pieces with their second hashes and numbers; where each number's ids start, and the ids."""
        self.keys, self.checks, self.numbers = np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int32)
        self.off, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    @property
    def held(self) -> int:
        return sum(x.nbytes for x in (self.keys, self.checks, self.numbers, self.off, self.ids))

    def _ids_of(self, pieces: list[str]) -> list[list[int]]:
        tokenize, out, rest = self.model.tokenize, [], []
        for i, p in enumerate(pieces):
            if p.isascii() and p.isalpha():
                out.append([t.id for t in tokenize(p)])
            elif _PLAIN(p):
                out.append([t.id for t in tokenize("".join([_LETTERS[b] for b in p.lower().encode()]))])
            else:
                out.append([])
                rest.append(i)
        for i, e in zip(rest, self.tk.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def _numbers(self, pieces: pa.Array) -> np.ndarray:
        """The number of each of some different pieces; new ones are encoded."""
        data, off = buffers(pieces)
        keys, checks = (span_hashes(data, off[:-1], off[1:], seed) for seed in (0, _SEED))
        at = np.searchsorted(self.keys, keys)
        near = np.minimum(at, max(len(self.keys) - 1, 0))
        known = (self.keys[near] == keys) & (self.checks[near] == checks) if len(self.keys) else np.zeros(len(keys), bool)
        out = np.empty(len(keys), np.int64)
        out[known] = self.numbers[near[known]]
        new = np.flatnonzero(~known)
        if len(new):
            lists = self._ids_of(pieces.take(pa.array(new)).to_pylist())
            lens = np.fromiter(map(len, lists), np.int64, len(lists))
            out[new] = len(self.off) - 1 + np.arange(len(new))
            self.ids = np.concatenate((self.ids, np.fromiter(chain.from_iterable(lists), np.uint32, int(lens.sum()))))
            self.off = np.concatenate((self.off, self.off[-1] + np.cumsum(lens)))
            new = new[np.argsort(keys[new], kind="stable")]
            self.keys, self.checks, self.numbers = (np.insert(x, at[new], y[new]) for x, y in ((self.keys, keys), (self.checks, checks), (self.numbers, out)))
        return out

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offset of each text)."""
        got = list(self.parts(col))
        return np.concatenate([np.zeros(0, np.uint32), *(g[2] for g in got)]), np.cumsum(np.concatenate([np.zeros(1, np.int64), *(g[3] for g in got)]))

    def parts(self, col: pa.Array, end_id: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first text, end, ids of these texts, number of each) of slices. end_id follows each text."""
        data, off = buffers(col)
        for a, b in slices(off, self.slice_bytes):
            part, at = data[off[a] : off[b]], off[a : b + 1] - off[a]
            odd = RARE[part]
            odd[:-1] |= (part[:-1] == 60) & (part[1:] == 124)
            if odd.any():  # control characters, or what may be a special token: such texts go to the library whole
                ids, n = self._whole([bytes(part[i:j]).decode() for i, j in zip(at[:-1], at[1:], strict=True)], np.add.reduceat(np.append(odd, False), at[:-1]) > 0, part, at)
            else:
                ids, n = self._long(part) if b == a + 1 and len(part) > 2 * self.slice_bytes else self._slice(part, at)
            if end_id is not None:
                out, ends = np.empty(len(ids) + len(n), np.uint32), np.cumsum(n + 1)
                mine = np.ones(len(out), bool)
                mine[ends - 1] = False
                out[mine], out[ends - 1] = ids, end_id
                ids, n = out, n + 1
            yield a, b, ids, n

    def _long(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A text longer than a slice, cut where a word begins after white space."""
        out, a = [], 0
        while a < len(data):
            b = a + self.slice_bytes
            while b < len(data):
                near = SPACE[data[b - 1 : b + 4095]]
                starts = np.flatnonzero(near[:-1] & ~near[1:])
                if len(starts):
                    b += int(starts[0])
                    break
                b += 4095
            b = min(b, len(data))
            out.append(self._slice(data[a:b], np.array([0, b - a]))[0])
            a = b
        ids = np.concatenate(out)
        return ids, np.array([len(ids)])

    def _whole(self, texts: list[str], odd: np.ndarray, part: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for t, o, i, j in zip(texts, odd, at[:-1], at[1:], strict=True):
            out.append(np.array(self.tk.encode(t, add_special_tokens=False).ids, np.uint32) if o and t else self._slice(part[i:j], np.array([0, j - i]))[0])
        return np.concatenate(out), np.array([len(x) for x in out], np.int64)

    def _slice(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(off) - 1, np.int64)
        kind = KIND[data]
        # An ASCII capital before an ASCII byte or at its text's end, whatever the next text begins with, composes with nothing, so it can be lowered before normalisation.
        capital, alone = kind == CAPITAL, np.append(data[1:] < 128, True)
        alone[off[1:] - 1] = True
        capital &= alone
        data = data | capital.astype(np.uint8) << 5
        # Which pairs of neighbours are cut is a table over both kinds.
        cut = np.empty(len(data), bool)
        cut[1:] = CUT[kind[:-1] * np.uint8(8) + kind[1:]]
        cut[off[:-1][off[:-1] < len(data)]] = True
        cut[0] = True
        starts = np.flatnonzero(cut)
        ink = kind != WHITE
        upto = np.append(0, np.cumsum(ink))[np.append(starts, len(data))].astype(np.int32)
        coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(upto.tobytes()), pa.py_buffer(data[ink].tobytes())).dictionary_encode()
        if self.held > self.limit:
            self.forget()
        at = self._numbers(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
        begin, count = self.off[at], self.off[at + 1] - self.off[at]
        ends = np.cumsum(count)
        total = int(ends[-1])
        ids = self.ids[np.arange(total, dtype=np.int32) + np.repeat((begin - (ends - count)).astype(np.int32), count)]
        return ids, np.diff(np.concatenate(([0], ends))[np.searchsorted(starts, off)])


_ENCODERS: dict[str | None, Encoder] = {}


@contextmanager
def encoder(path: str | None) -> Iterator[Encoder]:
    """This worker's encoder, which outlives a task; its memory is bounded by its limit and a slice's new pieces."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    enc = _ENCODERS[path]
    try:
        yield enc
    finally:
        release()
