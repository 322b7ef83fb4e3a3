"""Suffix order and common prefixes of a shard of byte strings by external induced sorting.

Sorting starts from the suffixes at left-most smaller (LMS) places. Their substrings are sorted by
one induction, named, and the string of names is sorted by prefix doubling, as deep as the common
prefixes that matter. Then a second induction carries tuples (place, common prefix with the tuple
before) from the LMS suffixes to all others: ascending for larger-type suffixes, descending for
smaller-type ones. What a tuple induces waits in a queue for its first character; as tuples arrive
in the order of what they induce, such a queue is first in, first out, and its priority is its
character. Queues hold arrays and move them to unnamed scratch files beyond a memory limit.

The common prefix of two induced neighbours is one more than the smallest common prefix between the
tuples that induced them; a running minimum for each character carries it along.
"""

from __future__ import annotations

import tempfile
from collections import deque
from collections.abc import Iterator

import numpy as np

from .textarrays import prefix_hash, span_hash

_FAR = np.int32(1 << 30)


class Memory:
    def __init__(self, limit: int):
        self.limit, self.used = limit, 0


class DiskQueue:
    """Tuples (place, common prefix) in order of arrival; segments go to disk beyond the limit."""

    def __init__(self, memory: Memory):
        self.memory, self.segments, self.file = memory, deque(), None

    def append(self, place: np.ndarray, lcp: np.ndarray) -> None:
        size = 12 * len(place)
        if self.memory.used + size <= self.memory.limit:
            self.memory.used += size
            self.segments.append((place, lcp))
            return
        self.file = self.file or tempfile.TemporaryFile()
        at = self.file.seek(0, 2)
        self.file.write(place.astype(np.int64).tobytes() + lcp.astype(np.int32).tobytes())
        self.segments.append((at, len(place)))

    def _load(self, segment) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(segment[0], np.ndarray):
            return segment
        self.file.seek(segment[0])
        n = segment[1]
        return np.frombuffer(self.file.read(8 * n), np.int64), np.frombuffer(self.file.read(4 * n), np.int32)

    def pop(self, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """The first segments, together about `most` tuples; they leave the queue."""
        parts, n = [], 0
        while self.segments and (not n or n < most):
            segment = self.segments.popleft()
            parts.append(self._load(segment))
            n += len(parts[-1][0])
            if isinstance(segment[0], np.ndarray):
                self.memory.used -= 12 * len(segment[0])
        return parts[0] if len(parts) == 1 else (np.concatenate([p for p, _ in parts]), np.concatenate([x for _, x in parts]))

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for s in self.segments:
            yield self._load(s)

    def backwards(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Reversed tuples, each with the common prefix to the one after it (the one before in this order)."""
        carried = _FAR
        for s in reversed(self.segments):
            place, lcp = self._load(s)
            yield place[::-1], np.concatenate([[carried], lcp[:0:-1]]).astype(np.int32)
            carried = lcp[0]


class Induction:
    """Both passes over the string t, whose last value is a unique smallest one."""

    def __init__(self, t: np.ndarray, memory: Memory):
        n = len(t)
        self.t, self.n, self.memory = t, n, memory
        ends = np.append(np.flatnonzero(t[1:] != t[:-1]), n - 1)
        last = ends[np.searchsorted(ends, np.arange(n))]  # the last place of the run that a place is in
        self.run = (last - np.arange(n) + 1).astype(np.int32)
        after = t[np.minimum(last + 1, n - 1)]
        self.smaller = t < after
        self.smaller[n - 1] = True
        self.lms = np.flatnonzero(self.smaller[1:] & ~self.smaller[:-1]) + 1
        self.size = int(t.max()) + 1

    def _push(self, queues: list[DiskQueue], carry: np.ndarray, place: np.ndarray, lcp: np.ndarray, smaller: bool) -> None:
        low = int(lcp.min())
        q = place - 1
        ok = np.flatnonzero((q >= 0) & (self.smaller[q] == smaller) & (self.t[q] <= self.t[place] if smaller else self.t[q] >= self.t[place]))
        kept = carry.copy()
        np.minimum(carry, low, out=carry)
        if not len(ok):
            return
        c = self.t[q[ok]]
        order = np.argsort(c, kind="stable")
        for idx in np.split(ok[order], np.flatnonzero(np.diff(c[order])) + 1):
            ch, end = int(self.t[q[idx[0]]]), int(idx[-1]) + 1
            least = np.minimum.reduceat(lcp[:end], np.concatenate([[0], idx[:-1] + 1]))
            least[0] = min(least[0], kept[ch])
            queues[ch].append(q[idx], np.minimum(least, _FAR - 1) + 1)
            carry[ch] = lcp[end:].min() if end < len(lcp) else _FAR

    def larger(self, starts: dict[int, tuple[np.ndarray, np.ndarray]]) -> list[DiskQueue]:
        """Larger-type suffixes by first character, from sorted (place, lcp) of LMS suffixes by theirs."""
        queues, out = ([DiskQueue(self.memory) for _ in range(self.size)] for _ in range(2))
        carry = np.zeros(self.size, np.int32)
        for c in range(self.size):
            first, final = True, None
            while queues[c].segments:
                place, lcp = queues[c].pop()
                if first:
                    lcp = np.concatenate([[0], lcp[1:]]).astype(np.int32)
                first, final = False, place[-1]
                out[c].append(place, lcp)
                self._push(queues, carry, place, lcp, False)
            if c in starts:
                place, lcp = starts[c]
                edge = 0 if final is None else min(self.run[final], self.run[place[0]])
                self._push(queues, carry, place, np.concatenate([[edge], lcp[1:]]).astype(np.int32), False)
        return out

    def smaller_ones(self, larger: list[DiskQueue]) -> list[DiskQueue]:
        """Smaller-type suffixes by first character, in descending order."""
        queues, out = ([DiskQueue(self.memory) for _ in range(self.size)] for _ in range(2))
        carry = np.zeros(self.size, np.int32)
        queues[0].append(np.array([self.n - 1]), np.zeros(1, np.int32))
        for c in range(self.size - 1, -1, -1):
            first, final = True, None
            while queues[c].segments:
                place, lcp = queues[c].pop()
                if first:
                    lcp = np.concatenate([[0], lcp[1:]]).astype(np.int32)
                first, final = False, place[-1]
                out[c].append(place, lcp)
                self._push(queues, carry, place, lcp, True)
            for k, (place, lcp) in enumerate(larger[c].backwards()):
                if not k:
                    lcp[0] = 0 if final is None else min(self.run[final], self.run[place[0]])
                self._push(queues, carry, place, lcp, True)
        return out


def _by_first(t: np.ndarray, place: np.ndarray, lcp: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    cuts = np.flatnonzero(np.diff(t[place])) + 1
    return {int(t[p[0]]): (p, x) for p, x in zip(np.split(place, cuts), np.split(lcp, cuts), strict=True) if len(p)}


def _sort_names(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of names by their first `depth` names at least (ties by place)."""
    rank, n, step = names.astype(np.int64), len(names), 1
    order = np.argsort(rank, kind="stable")
    while step < depth:
        follow = np.zeros(n, np.int64)
        follow[: max(n - step, 0)] = rank[step:] + 1
        key = rank * (int(rank.max(initial=0)) + 3) + follow
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        step *= 2
        if new[-1] == n - 1:
            break
    return order


def _common(hashes: np.ndarray, n: int, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix lengths of suffix pairs, up to cap."""
    lo, hi = np.zeros(len(a), np.int64), np.minimum(cap, n - np.maximum(a, b))
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_] + 1) // 2
        same = span_hash(hashes, a[open_], a[open_] + mid) == span_hash(hashes, b[open_], b[open_] + mid)
        lo[open_[same]] = mid[same]
        hi[open_[~same]] = mid[~same] - 1
    return lo.astype(np.int32)


def sorted_suffixes(t: np.ndarray, cap: int, memory_bytes: int = 256 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, common prefix with the place before), ascending in pieces; exact up to cap, at least cap beyond.

    t: small non-negative integers, the last one a unique 0. Suffixes with equal first cap values may be in any order.
    """
    memory = Memory(memory_bytes)
    ind = Induction(t, memory)
    lms, n = ind.lms, len(t)
    if not len(lms):
        lms = np.array([n - 1])
    hashes = prefix_hash(t)
    if len(lms) > 1:
        rough = lms[np.argsort(t[lms], kind="stable")]
        larger = ind.larger(_by_first(t, rough, np.zeros(len(rough), np.int32)))
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        parts = []
        for q in ind.smaller_ones(larger):
            found = [p[is_lms[p]] for p, _ in q]
            parts.append(np.concatenate(found)[::-1] if found else np.zeros(0, np.int64))
        order = np.concatenate(parts)
        number = np.searchsorted(lms, order)
        end = np.append(lms[1:] + 1, n)[number]  # an LMS substring reaches to the next LMS place, included
        h = span_hash(hashes, order, end)
        name = np.concatenate([[0], np.cumsum(h[1:] != h[:-1])])
        names = np.empty(len(lms), np.int64)
        names[number] = name
        lms = lms[_sort_names(names, cap // 2 + 2)]
        memory.used = 0
    lcp = np.concatenate([[0], _common(hashes, n, lms[1:], lms[:-1], cap)]).astype(np.int32)
    larger = ind.larger(_by_first(t, lms, lcp))
    for c, (big, small) in enumerate(zip(larger, ind.smaller_ones(larger), strict=True)):
        final = None
        for place, x in big:
            final = place[-1]
            yield place, x
        for place, x in small.backwards():
            x[0] = x[0] if x[0] < _FAR else (0 if final is None else min(ind.run[final], ind.run[place[0]]))
            final = place[-1]
            yield place, x


def repeated_starts(blocks: list[bytes], length: int, memory_bytes: int = 256 << 20) -> list[np.ndarray]:
    """For each block, which of its strings of `length` bytes also start elsewhere in the blocks."""
    sizes = np.array([len(b) + 1 for b in blocks])
    first = np.concatenate([[0], np.cumsum(sizes)])
    t = np.zeros(first[-1] + 1, np.uint16)
    for b, at in zip(blocks, first, strict=False):
        t[at : at + len(b)] = np.frombuffer(b, np.uint8)
        t[at : at + len(b)] += 2
        t[at + len(b)] = 1
    hit, before = np.zeros(len(t), bool), None
    for place, lcp in sorted_suffixes(t, length, memory_bytes):
        long = np.flatnonzero(lcp >= length)
        if len(long):
            hit[place[long]] = True
            hit[place[long[long > 0] - 1]] = True
            if long[0] == 0:
                hit[before] = True
        before = place[-1]
    return [hit[a : a + max(len(b) - length + 1, 0)] for b, a in zip(blocks, first, strict=False)]


def repeated_names(blocks: list[np.ndarray], length: int) -> list[np.ndarray]:
    """The same for blocks of 64-bit names: there may be too many for a queue each, so prefix doubling sorts them as deep as `length`."""
    sizes = np.array([len(b) + 1 for b in blocks])
    first = np.concatenate([[0], np.cumsum(sizes)])
    t = np.zeros(first[-1], np.int64)
    inside = np.ones(len(t), bool)
    inside[first[1:] - 1] = False
    t[inside] = np.unique(np.concatenate(blocks), return_inverse=True)[1] + 1  # 0 ends a block, and no string holds it
    starts = np.concatenate([np.arange(a, a + max(len(b) - length + 1, 0)) for b, a in zip(blocks, first, strict=False)])
    whole = np.zeros(len(t), bool)
    whole[starts] = True
    order = _sort_names(t, length)
    order = order[whole[order]]
    h = span_hash(prefix_hash(t), order, order + length)
    same, hit = h[1:] == h[:-1], np.zeros(len(t), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    return [hit[a : a + max(len(b) - length + 1, 0)] for b, a in zip(blocks, first, strict=False)]
