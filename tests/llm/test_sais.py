import random

import numpy as np
import pytest

from shardlore.llm.sais import permuted_prefixes, suffix_array, types


def brute(t):
    b = list(t)
    return sorted(range(len(b)), key=lambda i: b[i:])


@pytest.mark.parametrize("alphabet,n,seed", [(2, 200, 1), (3, 500, 2), (5, 2000, 3), (60, 3000, 4), (1, 300, 5), (4, 1, 6), (4, 2, 7), (900, 4000, 8)])
def test_suffix_array(alphabet, n, seed):
    r = random.Random(seed)
    t = np.array([r.randint(1, alphabet) for _ in range(n)] + [0])
    assert suffix_array(t).tolist() == brute(t)


def test_repetitive():
    t = np.array(([1, 2, 3, 2] * 200 + [1, 2, 2] * 100 + [4] * 150) * 3 + [0])
    assert suffix_array(t).tolist() == brute(t)


def test_types():
    assert types(np.array([2, 1, 1, 3, 0])).tolist() == [False, True, True, False, True]


@pytest.mark.parametrize("seed", range(6))
def test_prefixes(seed):
    r = random.Random(seed)
    part = [r.randint(1, 3) for _ in range(60)]
    t = np.array(part + [r.randint(1, 3) for _ in range(300)] + part + part + [0], np.uint8)
    sa = suffix_array(t)
    got = permuted_prefixes(t, sa, 100)
    for a, b in zip(sa[:-1], sa[1:]):
        n = 0
        while max(a, b) + n < len(t) and t[a + n] == t[b + n]:
            n += 1
        assert got[b] == n, (a, b)
