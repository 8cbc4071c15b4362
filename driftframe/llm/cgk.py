"""CGK random-walk embedding of word sequences, and bit-sampling keys over it, for all windows of a batch of texts at once.

The embedding of a sequence x walks i = 0, 1, ... over it: at step j it writes x[i] and moves on by one if the random bit
r(j, x[i]) is set. Two sequences within a small edit distance write equal symbols at most steps, as the walks fall into step
again after an edit, so edit distance turns into Hamming distance. A repetition has its own random bits and samples a few steps of
the walk; the written symbols there are its key. Symbols are ids of the query items' words; all other words are 0, which no
key holds, so a window is given up at the first sampled step whose symbols no item has.

Windows are sized as the items are: an anchor of an item is walked over what remains of the item, in one of WINDOWS sizes (a longer
rest counts as the longest), and the steps that a repetition samples are spread over that size or over its first part. Of a walk of
c steps all symbols lie in the first c words, so windows in texts need not know the item.
"""

from __future__ import annotations

import numpy as np

#: Repetitions: enough for the target recall, which tests assert by item length and kind of edit.
REPEATS = 8
#: The second sampled step of each repetition (the first is the anchor itself), and the part of the window over which the others spread.
SECOND = (1, 2, 3, 1, 4, 2, 1, 3)
SPREAD = (1.0, 0.25, 0.5, 0.25, 1.0, 0.25, 0.5, 0.35)
#: Sampled steps at most, and sizes of windows in words.
STEPS = 4
WINDOWS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64)
#: Distance between an item's anchors in words; items shorter than DENSE have one at every word.
ANCHOR_GAP = 4
DENSE = 25
_TABLE_BITS = 20


def least_window(length: int) -> int:
    """Smallest window with which an item of so many words has anchors: near its end the rest is too short to tell it."""
    return min(length, 2 if length <= 8 else 3 if length < 16 else 6 if length < DENSE else 8)


def least_places(size: int) -> int:
    """Words from which the symbols of a key of such a window come at least."""
    return 1 if size == 1 else 2 if size < 6 else 3


def sampled(repetition: int, size: int) -> tuple[int, ...]:
    """Steps of a window of a size that a repetition samples, none twice; empty if its second step lies outside."""
    second = SECOND[repetition % len(SECOND)]
    if size == 1:
        return (0,)
    if second >= size:
        return ()
    last = max(second, min(size - 1, max(int(size * SPREAD[repetition % len(SPREAD)]), 2 * STEPS)))
    shift = (repetition * 5 + 3) % 7 / 7
    rest = {second + int((last - second) * (k + shift) / (STEPS - 2)) for k in range(STEPS - 2)} | {last}
    return tuple(sorted({0, second, *sorted(rest)[-(STEPS - 2) :]}))


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two integers."""
    h = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) + np.uint64(0x7F4A7C15))
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def anchors(length: int) -> np.ndarray:
    """Offsets of an item's anchors."""
    return np.arange(0, max(1, length - least_window(length) + 1), 1 if length < DENSE else ANCHOR_GAP)


def _slot(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)


def _among(key: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are among known ones, which are in order: compact, for the few windows that are left."""
    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
    return known[at] == key


class Repetition:
    """One random walk, and the keys of all items' anchors under it."""

    def __init__(self, items: list[np.ndarray], n_symbols: int, number: int, seed: int):
        self.bits = np.random.default_rng(seed).integers(0, 1 << 62, n_symbols + 1, dtype=np.int64)
        words = np.concatenate([*items, np.zeros(WINDOWS[-1] + 1, np.int64)])
        at = [anchors(len(i)) for i in items]
        many = np.array([len(x) for x in at], np.int64)
        length = np.array([len(i) for i in items], np.int64)
        self.owner, self.offset = np.repeat(np.arange(len(items)), many), np.concatenate([*at, np.zeros(0, np.int64)])
        begin = np.repeat(np.cumsum(length) - length, many) + self.offset
        size = np.array(WINDOWS)[np.searchsorted(WINDOWS, np.repeat(length, many) - self.offset, "right") - 1]
        self.second = SECOND[number % len(SECOND)]
        #: For what the first two sampled steps hash to, a bit for each window size that has such an anchor.
        self.paired = np.zeros(1 << _TABLE_BITS, np.uint16)
        self.sizes = []
        for nth, c in enumerate(WINDOWS):
            steps, of = sampled(number, c), np.flatnonzero(size == c)
            if not steps or not len(of):
                continue
            trail, where, step = [], begin[of], 0
            for j in steps:
                where, step = self._walk(words, where, step, j)
                trail.append(where)
            # a walk that hardly moved tells little: its anchor is left to other repetitions
            moved = (np.diff(trail, axis=0) > 0).sum(0) + 1 >= least_places(c)
            of, trail = of[moved], [w[moved] for w in trail]
            if not len(of):
                continue
            prefixes, key = [], np.zeros(len(of), np.uint64)
            for w in trail:
                key = _mix(key, words[w])
                prefixes.append(np.unique(key))
            if c > 1:
                self.paired[_slot(prefixes[1])] |= np.uint16(1 << nth)
            order = np.argsort(key, kind="stable")
            self.sizes.append((np.uint16(1 << nth), steps, prefixes, key[order], of[order]))

    def _walk(self, words: np.ndarray, where: np.ndarray, step: int, to: int) -> tuple[np.ndarray, int]:
        while step < to:
            where = np.minimum(where + (self.bits[words[where]] >> (step % 62) & 1), len(words) - 1)
            step += 1
        return where, step

    def candidates(self, words: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position of an anchor's match in words, anchor) for every window at positions that shares an anchor's key."""
        hits, found = [], []

        def meet(key: np.ndarray, at: np.ndarray, keys: np.ndarray, owners: np.ndarray) -> None:
            low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            n = high - low
            hits.append(np.repeat(at, n))
            run = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found.append(owners[np.repeat(low, n) + run])

        first = _mix(np.zeros(1, np.uint64), words[positions]) if len(positions) else np.zeros(0, np.uint64)
        # the walk to the second step is the same for all sizes
        where, step = self._walk(words, positions, 0, self.second)
        second = _mix(first, words[where]) if len(positions) else first
        bits = self.paired[_slot(second)]
        alive = np.flatnonzero(bits)
        at, where, second, bits = positions[alive], where[alive], second[alive], bits[alive]
        for bit, steps, prefixes, keys, owners in self.sizes:
            if len(steps) == 1:
                meet(first, positions, keys, owners)
                continue
            going = np.flatnonzero(bits & bit)
            a, w, key, done = at[going], where[going], second[going], step
            for known, j in zip(prefixes[2:], steps[2:], strict=True):
                w, done = self._walk(words, w, done, j)
                key = _mix(key, words[w])
                going = _among(key, known)
                a, w, key = a[going], w[going], key[going]
            meet(key, a, keys, owners)
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(hits), np.concatenate(found)


def edit_distances(item: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Least edit distance between the item and any part of each window (rows of symbols; -1 matches nothing)."""
    k, w = windows.shape
    steps = np.arange(w + 1, dtype=np.int32)
    row = np.zeros((k, w + 1), np.int32)
    for i, symbol in enumerate(item, 1):
        up = row + 1
        up[:, 1:] = np.minimum(up[:, 1:], row[:, :-1] + (windows != symbol))
        up[:, 0] = i
        row = np.minimum.accumulate(up - steps, axis=1) + steps
    return row.min(axis=1)
