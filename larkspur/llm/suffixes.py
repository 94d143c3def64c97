"""Sparse suffixes: anchors chosen by content, front-coded sorted runs, and their merge by a loser tree.

Of every 200-byte window one anchor is chosen by its content alone: the place of the least hash among its 100-byte strings. Equal
windows choose the same anchor, about one place in fifty is an anchor, and a window is its anchor's left context and right
context. So sorting the anchors' contexts decides every window.
"""

from __future__ import annotations

import numpy as np
import zstandard

from larkspur.llm.shingles import mixed, powers

LENGTH, GRAM = 200, 100
SPREAD = LENGTH - GRAM + 1  # anchors are chosen among so many places
LEFT, RIGHT, TIE = GRAM, LENGTH, 4
KEY = RIGHT + LEFT + TIE
PAD = 0xFF  # no byte of UTF-8; windows never hold it, as they lie inside their document
_POS = np.uint64((1 << 24) - 1)
PIECE = 1 << 20


def pieces(texts: list[bytes], limit: int = 1 << 19):
    """Lists of (document, offset, bytes) of about ``limit`` bytes; a long text is cut into pieces that share LENGTH - 1 bytes,
    so each window is in one piece, and all its pieces are in one list."""
    held, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - LENGTH + 1), PIECE):
            part = t[at : at + PIECE + LENGTH - 1]
            if len(part) >= LENGTH:
                held.append((i, at, part))
                size += len(part)
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def anchors(held: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    """(document, place, least d, greatest d, hash of the 100 bytes there): the windows that start d bytes before the place have it
    as anchor."""
    if sum(len(p) for _, _, p in held) > 2 * PIECE and len(held) > 1:  # places must stay below 2^24
        return tuple(np.concatenate(x) for x in zip(*(anchors([p]) for p in held)))
    raw = np.frombuffer(b"".join(p for _, _, p in held), np.uint8)
    sizes = np.array([len(p) for _, _, p in held])
    ends = np.cumsum(sizes)
    up, down = powers(len(raw) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1])])
    gram = mixed((total[GRAM:] - total[:-GRAM]) * down[: len(raw) - GRAM + 1])
    least = (gram & ~_POS) | np.arange(len(gram), dtype=np.uint64)
    step = 1
    while 2 * step <= SPREAD:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    rest = SPREAD - step
    least = np.minimum(least[: len(least) - rest], least[rest:])
    place = (least & _POS).astype(np.int64)
    owner = np.repeat(np.arange(len(held)), sizes)[: len(place)]
    at = np.flatnonzero(ends[owner] - np.arange(len(place)) >= LENGTH)
    a, o = place[at], owner[at]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (o[1:] != o[:-1])]))
    last = np.concatenate([new[1:], [len(at)]]) - 1
    base = (ends - sizes)[o[new]]
    docs, offsets = np.array([h[0] for h in held]), np.array([h[1] for h in held])
    return docs[o[new]], a[new] - base + offsets[o[new]], a[new] - at[last], a[new] - at[new], gram[a[new]]


def whole(doc, place, low, high, gram) -> tuple[np.ndarray, ...]:
    """Anchors whose windows lie in two pieces of a long text, as one anchor each."""
    order = np.lexsort((place, doc))
    doc, place, low, high, gram = (x[order] for x in (doc, place, low, high, gram))
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])]))[: len(doc)]
    if not len(doc):
        return doc, place, low, high, gram
    return doc[new], place[new], np.minimum.reduceat(low, new), np.maximum.reduceat(high, new), gram[new]


def contexts(text: bytes, places: np.ndarray) -> np.ndarray:
    """A row for each place: the RIGHT bytes from it, then the LEFT bytes before it, nearest first; padded beyond the text."""
    padded = np.full(len(text) + LEFT + RIGHT, PAD, np.uint8)
    padded[LEFT : LEFT + len(text)] = np.frombuffer(text, np.uint8)
    views = np.lib.stride_tricks.sliding_window_view(padded, LEFT + RIGHT)
    both = views[places]
    return np.concatenate([both[:, LEFT:], both[:, :LEFT][:, ::-1]], axis=1)


def swapped(rows: np.ndarray) -> np.ndarray:
    """Left context first instead of right context first, and back is ``swapped_back``."""
    return np.concatenate([rows[:, RIGHT : RIGHT + LEFT], rows[:, :RIGHT], rows[:, RIGHT + LEFT :]], axis=1)


def swapped_back(rows: np.ndarray) -> np.ndarray:
    return np.concatenate([rows[:, LEFT : LEFT + RIGHT], rows[:, :LEFT], rows[:, LEFT + RIGHT :]], axis=1)


def prefixes(rows: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the one before it; 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    for at in range(1, len(rows), 4096):
        b = rows[at : at + 4096]
        differs = rows[at - 1 : at - 1 + len(b)] != b
        out[at : at + len(b)] = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
    return out


def sort_run(rows: np.ndarray) -> np.ndarray:
    """The order that sorts the rows."""
    return np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").reshape(-1), kind="stable")


def encode_block(rows: np.ndarray, meta: np.ndarray) -> bytes:
    """A sorted block, front-coded and compressed: the common prefixes, the meta rows (int64) and the remaining bytes."""
    lcp = prefixes(rows)
    keep = np.arange(rows.shape[1]) >= lcp[:, None]
    return zstandard.compress(lcp.astype("<u2").tobytes() + meta.astype("<i8").tobytes() + rows[keep].tobytes(), 1)


def decode_block(n: int, payload: bytes, fields: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows and meta rows of a block."""
    stream, keys = Stream([(n, payload)], fields, width), []
    while stream.advance():
        keys.append(stream.key)
    return np.frombuffer(b"".join(keys), np.uint8).reshape(n, width), stream.meta


class Stream:
    """Blocks of one run in order, decoded one key at a time."""

    def __init__(self, blocks: list[tuple[int, bytes]], fields: int, width: int = KEY):
        self.blocks, self.fields, self.width = iter(blocks), fields, width
        self.n = self.i = 0
        self.key, self.lcp, self.last = b"", 0, b""
        self.row = 0

    def advance(self) -> bool:
        """Move to the next key; ``lcp`` is its common prefix with the one before it in this run."""
        if self.i == self.n:
            got = next(self.blocks, None)
            if got is None:
                return False
            self.n, raw = got[0], zstandard.decompress(got[1])
            self.i, self.at = 0, self.n * (2 + 8 * self.fields)
            self.lcps = np.frombuffer(raw, "<u2", self.n).tolist()
            self.meta = np.frombuffer(raw, "<i8", self.n * self.fields, 2 * self.n).reshape(self.n, self.fields)
            self.raw = raw
        lcp = self.lcps[self.i]
        before = self.key
        self.key = before[:lcp] + self.raw[self.at : self.at + self.width - lcp]
        self.at += self.width - lcp
        if self.i == 0 and before:  # blocks start afresh: the prefix with the block before isn't stored
            lcp = common(before, self.key, 0)
        self.lcp, self.row = lcp, self.i
        self.i += 1
        return True


def common(a: bytes, b: bytes, at: int) -> int:
    """Common prefix of a and b, of which ``at`` bytes are known."""
    n = len(a)
    if a[at:] == b[at:]:
        return n
    step = 32
    while a[at : at + step] == b[at : at + step]:
        at += step
    while step > 1:
        step //= 2
        if a[at : at + step] == b[at : at + step]:
            at += step
    return at


class LoserTree:
    """Merges sorted runs. Each run's head carries its common prefix with the last key given out: a longer one is the smaller key,
    and only equal ones are compared, from that prefix on. Known prefixes are never compared again."""

    def __init__(self, streams: list[Stream]):
        self.streams = [s for s in streams if s.advance()]
        k = len(self.streams)
        self.size = 1 << max(0, k - 1).bit_length()
        self.lcp = [0] * k
        self.loser: list[int] = [-1] * (2 * self.size)
        win = [i if i < k else -1 for i in range(self.size)]
        level = self.size
        while level > 1:
            level //= 2
            nxt = []
            for i in range(level):
                w, loser = self._play(win[2 * i], win[2 * i + 1])
                self.loser[level + i] = loser
                nxt.append(w)
            win = nxt
        self.top = win[0] if k else -1

    def _play(self, a: int, b: int) -> tuple[int, int]:
        if a < 0:
            return b, a
        if b < 0:
            return a, b
        la, lb = self.lcp[a], self.lcp[b]
        if la != lb:
            return (a, b) if la > lb else (b, a)
        x, y = self.streams[a].key, self.streams[b].key
        h = common(x, y, la)
        if h == len(x) or x[h] < y[h]:
            self.lcp[b] = h
            return a, b
        self.lcp[a] = h
        return b, a

    def __iter__(self):
        """(key, common prefix with the key before, stream) in order."""
        while self.top >= 0:
            w = self.top
            s = self.streams[w]
            yield s.key, self.lcp[w], s
            cur = w if s.advance() else -1
            if cur >= 0:
                self.lcp[w] = s.lcp
            at = (self.size + w) // 2
            while at:
                cur, self.loser[at] = self._play(cur, self.loser[at])
                at //= 2
            self.top = cur


def names(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts the rows, and the common prefixes in that order."""
    order = sort_run(rows)
    return order, prefixes(rows[order])


def repeated(primary: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray, left_first: bool) -> np.ndarray:
    """Which windows stand twice: a row for each context (in sorted order, primary: common prefixes), a column for each d.

    A window d is the d nearest left bytes and the first LENGTH - d right ones. Contexts that agree in the sorted part to the depth
    needed are one range of the order; those that agree in the other part have one name there."""
    out = np.zeros((len(rows), LEFT + 1), bool)
    depth = (lambda d: d) if left_first else (lambda d: LENGTH - d)
    other = (lambda d: LENGTH - d) if left_first else (lambda d: d)
    order, common_ = names(np.ascontiguousarray(rows[:, LEFT : LEFT + RIGHT] if left_first else rows[:, RIGHT : RIGHT + LEFT]))
    rank = np.empty(len(rows), np.int64)
    for d in range(LEFT + 1):
        at = np.flatnonzero((low <= d) & (d <= high))
        if len(at) < 2:
            continue
        group = np.cumsum(primary < depth(d))
        rank[order] = np.cumsum(common_ < other(d))
        code = group[at] * (len(rows) + 1) + rank[at]
        by = np.argsort(code, kind="stable")
        same = code[by][1:] == code[by][:-1]
        twice = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        out[at[by], d] = twice
    return out


def window_names(rows: np.ndarray, i: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the window d of context i, for each of them; rows: right context first."""
    out = []
    text = np.concatenate([rows[:, RIGHT : RIGHT + LEFT][:, ::-1], rows[:, :RIGHT]], axis=1).astype(np.uint64) + np.uint64(1)
    up, down = powers(LEFT + RIGHT + 1)
    for twist in (np.uint64(0), np.uint64(0x5851F42D4C957F2D)):
        total = np.concatenate([np.zeros((len(rows), 1), np.uint64), np.cumsum(mixed(text + twist) * up[:-1], axis=1)], axis=1)
        start = LEFT - d
        out.append(mixed((total[i, start + LENGTH] - total[i, start]) * down[start]).view(np.int64))
    return out[0], out[1]
