"""Word shingles and SuperMinHash signatures of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

_M64 = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0 to n - 1, modulo 2^64."""
    if len(_powers[0]) < n:
        for k, b in enumerate((BASE, INVERSE)):
            x = np.full(n, b, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: list[bytes], limit: int = 1 << 20):
    """Ranges of texts of about ``limit`` bytes; a longer text is alone."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if texts:
        yield at, len(texts)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its k-word shingles: A-Z lower-cased, words parted by
    ASCII white space. A text of fewer words is one shingle; one without words has none."""
    out: list[np.ndarray] = []
    for a, b in chunks(texts):
        out += _sets(texts[a:b], k)
    return out


def _sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    raw = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    gap = _SPACE[raw]
    starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    ends = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    up, down = powers(len(raw))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * up)])
    words = mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, 1 + np.cumsum([0, *(len(t) + 1 for t in texts)]))
    n = np.diff(first)
    out = []
    run = words
    for j in range(1, k):
        run = mixed(run[:-1] * np.uint64(BASE) + words[j:]) if len(words) > j else np.zeros(0, np.uint64)
    for d, count in enumerate(n):
        i = first[d]
        if count >= k:
            s = np.sort(run[i : i + count - k + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif count:
            x = words[i : i + 1]
            for j in range(1, count):
                x = mixed(x * np.uint64(BASE) + words[i + j : i + j + 1])
            out.append(mixed(x + np.uint64(count)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that together name each set."""
    a = np.array([int(mixed(s).sum(dtype=np.uint64)) for s in sets], np.uint64)
    b = np.array([int(mixed(s * np.uint64(INVERSE) + np.uint64(1)).sum(dtype=np.uint64)) for s in sets], np.uint64)
    return a, b


def super_minhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures (Ertl 2017), a row for each set, as 32-bit values.

    Each element draws, for ranks j = 0, 1, ..., a fraction r and the j-th place of its own random permutation of the
    registers; a register keeps the least j + r it is offered. Ranks of an element's registers are thus a permutation and not
    independent, which lowers the variance; and once all of a set's registers hold less than j + 1, no later rank can change
    them, so the set stops."""
    n = np.array([len(s) for s in sets])
    best = np.full((len(sets), m), np.iinfo(np.uint64).max, np.uint64)
    at = 0
    while at < len(sets):  # as many sets as make about 32k elements
        upto = at + max(1, int(np.searchsorted(np.cumsum(n[at:]), 1 << 15)))
        _sketch(sets[at:upto], best[at:upto], m)
        at = upto
    return ((best >> np.uint64(32)).astype(np.uint32) << np.uint32(25)) | (best & np.uint64(0xFFFFFFFF)).astype(np.uint32) >> np.uint32(7)


def _sketch(sets: list[np.ndarray], best: np.ndarray, m: int) -> None:
    element = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    perm = None
    flat = best.reshape(-1)
    for j in range(m):
        if not len(element):
            return
        draw = mixed(element + np.uint64((j + 1) * BASE & _M64))
        k = j + (((draw & np.uint64(0xFFFFFFFF)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64)
        value = np.uint64(j << 32) | (draw >> np.uint64(32))
        if perm is None:
            place = k
        else:
            rows = np.arange(len(element))
            place = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, j]
            perm[:, j] = place
        np.minimum.at(flat, owner * m + place, value)
        going = (best.max(axis=1) >= np.uint64((j + 1) << 32))[owner]
        if perm is None:
            element, owner, k = element[going], owner[going], k[going]
            perm = np.tile(np.arange(m, dtype=np.uint8), (len(element), 1))
            perm[np.arange(len(element)), k] = 0
            perm[:, 0] = k
        elif not going.all():
            element, owner, perm = element[going], owner[going], perm[going]


def beyond(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What a has and b hasn't; both sorted and distinct."""
    if not len(a) or not len(b):
        return a
    i = np.searchsorted(b, a)
    return a[b[np.minimum(i, len(b) - 1)] != a]
