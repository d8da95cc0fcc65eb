"""Blockwise suffix sorting over a difference cover, in memory.

The suffixes to be sorted are cut into buckets by their first bytes and sorted one bucket at a time: by their first
32 bytes, and where these tie, by ranks that were computed before for the positions of a difference cover. Any two
suffixes have an offset below COVER at which both stand on cover positions, so one comparison of ranks settles a tie,
however long. Memory is that of the sample's ranks (6 of 31 positions) and of one bucket.

The order is that of the texts' bytes, a text that ends first being smaller. Equality is read off neighbours in
the order, byte by byte; no hash is involved.
"""

from __future__ import annotations


import numpy as np

#: A perfect difference set: every residue modulo COVER is the difference of two marks.
COVER = 31
MARKS = np.array([0, 1, 3, 8, 12, 18])
_WORD, _HEAD = 8, 32
#: Suffixes of one bucket.
BUCKET = 1 << 18

_SLOT_OF = np.full(COVER, -1)
_SLOT_OF[MARKS] = np.arange(len(MARKS))
#: For residues a and b: the least offset that brings both onto marks.
_SHIFT = np.array([[next(d for d in range(COVER) if _SLOT_OF[(a + d) % COVER] >= 0 and _SLOT_OF[(b + d) % COVER] >= 0) for b in range(COVER)] for a in range(COVER)])


class Texts:
    """Texts one after another, each beginning at a multiple of COVER and followed by zeros."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.chunks = (sizes + _HEAD + _WORD) // COVER + 1
        self.begins = np.concatenate([[0], np.cumsum(self.chunks)[:-1]]) * COVER if len(texts) else np.zeros(0, np.int64)
        self.ends = self.begins + sizes
        self.longest = int(sizes.max(initial=0))
        room = bytearray(int(self.chunks.sum()) * COVER + _HEAD + _WORD)
        for b, t in zip(self.begins.tolist(), texts):
            room[b : b + len(t)] = t
        self.data = bytes(room)
        self._words = np.ndarray(len(room) - _WORD + 1, ">u8", self.data, 0, (1,))

    def words(self, at: np.ndarray) -> np.ndarray:
        """Eight bytes from each position, as numbers in their order."""
        return self._words[at].astype(np.uint64)


def _dense(values: np.ndarray) -> np.ndarray:
    """Numbers in the order of values, equal for equal ones."""
    order = np.argsort(values)
    s = values[order]
    out = np.empty(len(values), np.int64)
    out[order] = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]]))
    return out


def _refine(rank: np.ndarray, live: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Split ties of rank (how many are smaller) by values of the live elements; who still ties."""
    if not len(live):
        return live
    old = rank[live]
    key = _dense(values)
    if old[0] != old[-1] or (old != old[0]).any():
        key += _dense(old) * np.int64(len(live))
    order = np.argsort(key)
    s, old = key[order], old[order]
    first = np.concatenate([[True], s[1:] != s[:-1]])
    begins = np.flatnonzero(first)
    group = np.concatenate([[0], np.flatnonzero(old[1:] != old[:-1]) + 1])
    inside = begins - group[np.searchsorted(group, begins, "right") - 1]
    sizes = np.diff(np.append(begins, len(s)))
    rank[live[order]] = np.repeat(old[begins] + inside, sizes)
    return live[order[np.repeat(sizes > 1, sizes)]]


def _cover_ranks(texts: Texts) -> np.ndarray:
    """The rank of each cover position's suffix, at chunk * marks + mark's number."""
    k = len(MARKS)
    count = int(texts.chunks.sum())
    at = (np.arange(count)[:, None] * COVER + MARKS).ravel()
    left = np.maximum(np.repeat(texts.ends, texts.chunks * k) - at, 0)
    rank, live = np.zeros(len(at), np.int64), np.arange(len(at))
    for off in range(0, _HEAD, _WORD):
        live = _refine(rank, live, texts.words(at[live] + off))
    live = _refine(rank, live, np.minimum(left[live], _HEAD))
    step = 1
    while step * COVER <= texts.longest and len(live):
        inside = left[live] > step * COVER
        ahead = np.where(inside, live + k * step, 0)
        live = _refine(rank, live, np.where(inside, rank[ahead] + 1, 0))
        step *= 2
    return rank


def _merge_ties(rank: np.ndarray, order: np.ndarray, at: np.ndarray, cover: np.ndarray) -> np.ndarray:
    """order sorted further where rank ties: merge sort by cover ranks, all ties at a time."""
    r = rank[order]
    begin = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
    size = np.diff(np.append(begin, len(r)))
    residue = at % COVER

    def not_after(a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        shift = _SHIFT[residue[a], residue[b]]
        x, y = at[a] + shift, at[b] + shift
        x, y = (cover[p // COVER * len(MARKS) + _SLOT_OF[p % COVER]] for p in (x, y))
        return (x < y) | (or_equal & (x == y))

    width = 1
    while True:
        big = size > width
        begin, size = begin[big], size[big]
        if not len(begin):
            return order
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)  # within the tie
        base, full = np.repeat(begin, size), np.repeat(size, size)
        run = place // width
        other = (run ^ 1) * width
        right = run % 2 == 1  # of equal elements, those of the left run come first
        low, high = np.minimum(other, full), np.minimum(other + width, full)
        start = low.copy()
        mine = order[base + place]
        seek = np.flatnonzero(low < high)
        while len(seek):
            mid = (low[seek] + high[seek]) // 2
            less = not_after(order[base[seek] + mid], mine[seek], right[seek])
            low[seek] = np.where(less, mid + 1, low[seek])
            high[seek] = np.where(less, high[seek], mid)
            seek = seek[low[seek] < high[seek]]
        target = base + np.minimum(run, run ^ 1) * width + (place - run * width) + (low - start)
        order = order.copy()
        order[target] = mine
        width *= 2


def sorted_buckets(texts: Texts, at: np.ndarray):
    """Positions in the order of their suffixes, one bucket after another, with whether each has the same first
    32 bytes as the one before it. From each position to its text's end must be COVER bytes at least."""
    if not len(at):
        return
    cover = None
    by_head = np.argsort(head := texts.words(at))
    s = head[by_head]
    del head
    edges = np.concatenate([np.flatnonzero(s[1:] != s[:-1]) + 1, [len(s)]])
    done = 0
    while done < len(at):
        stop = int(edges[min(np.searchsorted(edges, done + BUCKET), len(edges) - 1)])
        mine = at[by_head[done:stop]]
        done = stop
        rank, live = np.zeros(len(mine), np.int64), np.arange(len(mine))
        for off in range(0, _HEAD, _WORD):
            live = _refine(rank, live, texts.words(mine[live] + off))
        order = np.argsort(rank)
        if len(live):
            cover = _cover_ranks(texts) if cover is None else cover
            order = _merge_ties(rank, order, mine, cover)
        r = rank[order]
        yield mine[order], np.concatenate([[False], r[1:] == r[:-1]])


def repeated(texts: Texts, at: np.ndarray, length: int) -> np.ndarray:
    """Which of the positions begin a string of length bytes that begins at another of them too, ascending."""
    found = []
    for order, tied in sorted_buckets(texts, at):
        pair = np.flatnonzero(tied)
        for off in [*range(_HEAD, length - _WORD, _WORD), length - _WORD]:
            pair = pair[texts.words(order[pair] + off) == texts.words(order[pair - 1] + off)]
        found.append(np.unique(order[np.concatenate([pair, pair - 1])]))
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def suffix_order(texts: list[bytes], least: int = COVER) -> list[tuple[int, int]]:
    """(text, offset) of all suffixes of least bytes or more, in order: what tests hold against sorted()."""
    t = Texts(texts)
    at = np.concatenate([np.arange(b, max(b, e - least + 1)) for b, e in zip(t.begins, t.ends)]) if texts else np.zeros(0, np.int64)
    out = []
    for order, _ in sorted_buckets(t, at):
        number = np.searchsorted(t.begins, order, "right") - 1
        out += zip(number.tolist(), (order - t.begins[number]).tolist())
    return out


