"""Lattices of vocabulary pieces over many short strings at once, in numpy.

Strings of one length form a matrix of code points. For each piece length k, a rolling hash finds
the piece (if any) that covers characters s..s+k-1 of each string, by two cuckoo tables. The forward
recursion then runs over end positions, for all strings of the matrix together. A single character
without a piece falls back to its UTF-8 bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

from .textarrays import mix

_U = np.uint64
SPACE = 0x2581
_ROLL = 0xD6E8FEB86659FD93


class Pieces:
    """A SentencePiece vocabulary: ids by content, and log weights from its scores.

    The scores of a merge-order vocabulary are negative ranks; a piece of rank r weighs
    1 / (r + offset), the shape that unigram frequencies have. `log_weights` replaces them.
    """

    def __init__(self, model_path: str, offset: float = 10.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.byte_id = np.zeros(256, np.int32)
        plain, score = [], np.array([sp.get_score(i) for i in range(n)])
        for i in range(n):
            if sp.is_byte(i):
                self.byte_id[int(self.text[i][3:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                plain.append(i)
        self.size, self.plain = n, np.array(plain)
        self.longest = max(len(self.text[i]) for i in plain)
        self.chars = np.ones(n)
        self.chars[self.plain] = [len(self.text[i]) for i in plain]
        order = np.argsort(-score[self.plain], kind="stable")
        w = np.full(n, np.nan)
        w[self.plain[order]] = 1.0 / (np.arange(len(plain)) + offset)
        rest = float(np.nanmin(w))
        w[self.byte_id] = rest
        w = np.where(np.isnan(w), 0, w)
        with np.errstate(divide="ignore"):
            self.log_weights = np.log(w / w.sum())
        self._build()

    def _build(self) -> None:
        bits = 17
        self.shift = _U(64 - bits)
        keys = {}
        for i in self.plain.tolist():
            h = 0
            for c in self.text[i]:
                h = (h * _ROLL + ord(c) + 1) & (1 << 64) - 1
            keys[h] = i
        m = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
        table = [[0] * (1 << bits) for _ in m]
        ids = [[-1] * (1 << bits) for _ in m]
        for h, i in keys.items():
            side = 0
            for _ in range(500):
                at = ((h * m[side]) & (1 << 64) - 1) >> (64 - bits)
                h, table[side][at] = table[side][at], h
                i, ids[side][at] = ids[side][at], i
                if i < 0:
                    break
                side = 1 - side
            else:
                raise ValueError("the vocabulary does not fit its table")
        for t, own in zip(table, ids, strict=True):  # an empty place holds what is never looked for there: 0 is at 0 only
            t[0] = t[0] if own[0] >= 0 else 1
        self.mults = tuple(map(_U, m))
        self.keys, self.ids = [np.array(t, _U) for t in table], [np.array(t, np.int32) for t in ids]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece ids of rolling hashes, -1 without one."""
        out, flat = np.full(h.size, -1, np.int32), h.ravel()
        for m, keys, ids in zip(self.mults, self.keys, self.ids, strict=True):
            at = flat * m
            at >>= self.shift
            at = at.view(np.int64)
            hit = np.flatnonzero(keys.take(at) == flat)
            out[hit] = ids.take(at.take(hit))
        return out.reshape(h.shape)

    def edges(self, chars: np.ndarray) -> list[np.ndarray]:
        """For k = 1.. the ids (n, L - k + 1) of pieces covering s..s+k-1; single characters always have an edge (id or -2 - character)."""
        length = chars.shape[1]
        c = chars.astype(_U) + _U(1)
        out, h = [], None
        for k in range(1, min(length, self.longest) + 1):
            h = c if h is None else h[:, :-1] * _U(_ROLL) + c[:, k - 1 :]
            out.append(self.find(h))
        single = out[0]
        missing = single < 0
        single[missing] = -2 - chars[missing].astype(np.int32)
        return out

    def edge_log_weights(self, edges: list[np.ndarray], log_weights: np.ndarray) -> list[np.ndarray]:
        out = []
        for k, ids in enumerate(edges, 1):
            w = np.where(ids >= 0, log_weights[np.maximum(ids, 0)], -np.inf)
            if k == 1 and (back := ids < -1).any():
                cp = -2 - ids[back]
                n_bytes = 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000)
                w[back] = n_bytes * log_weights[self.byte_id[0]]
            out.append(w)
        return out


def forward_log(weights: list[np.ndarray], n: int, length: int) -> np.ndarray:
    """Log marginals (n, L + 1) of all ways to reach each position, by log-sum-exp over last pieces."""
    a = np.full((n, length + 1), -np.inf)
    a[:, 0] = 0
    for e in range(1, length + 1):
        terms = np.stack([a[:, e - k] + weights[k - 1][:, e - k] for k in range(1, min(e, len(weights)) + 1)])
        top = terms.max(0)
        a[:, e] = top + np.log(np.exp(terms - top).sum(0))
    return a


def backward_log(weights: list[np.ndarray], n: int, length: int) -> np.ndarray:
    """Log marginals (n, L + 1) of all ways from each position to the end."""
    b = np.full((n, length + 1), -np.inf)
    b[:, length] = 0
    for s in range(length - 1, -1, -1):
        terms = np.stack([b[:, s + k] + weights[k - 1][:, s] for k in range(1, min(length - s, len(weights)) + 1)])
        top = terms.max(0)
        b[:, s] = top + np.log(np.exp(terms - top).sum(0))
    return b


def by_length(points: np.ndarray, start: np.ndarray, end: np.ndarray, prefix: int | None = None, cells: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which spans, matrix of their characters) for spans of one length at a time, a bounded number of cells each."""
    length = end - start
    order = np.argsort(length, kind="stable")
    cuts = np.flatnonzero(np.diff(length[order])) + 1
    for group in np.split(order, cuts) if len(order) else []:
        n = int(length[group[0]])
        step = max(1, cells // max(1, n + 1))
        for i in range(0, len(group), step):
            part = group[i : i + step]
            chars = points[start[part][:, None] + np.arange(n)]
            if prefix is not None:
                chars = np.concatenate([np.full((len(part), 1), prefix, points.dtype), chars], 1)
            yield part, chars


class Linear:
    """Weights of several models beside one another, for the same recursions without logarithms.

    A piece of k characters weighs exp(log weight + k * RISE), so the marginals of ordinary words stay
    far from underflow; what comes out too small, or is longer than LONGEST, goes through forward_log.
    """

    RISE, LONGEST, LEAST = 2.5, 40, 1e-200

    def __init__(self, pieces: Pieces, log_weights: np.ndarray):
        """log_weights: (models, pieces)"""
        self.pieces, self.log_weights = pieces, np.atleast_2d(log_weights)
        with np.errstate(under="ignore"):
            w = np.exp(self.log_weights + self.RISE * pieces.chars)
            self.back = np.exp(np.arange(5)[:, None] * self.log_weights[:, pieces.byte_id[0]] + self.RISE)
        w[:, pieces.byte_id] = 0
        self.table = np.ascontiguousarray(np.concatenate([w, np.zeros((len(w), 1))], 1).T)  # the last row: no piece

    def weights(self, edges: list[np.ndarray]) -> list[np.ndarray]:
        """(starts, strings, models) for each piece length."""
        out = []
        for k, ids in enumerate(edges, 1):
            at = ids.T
            w = self.table[at]
            if k == 1 and (spelled := at < -1).any():
                cp = -2 - at[spelled]
                w[spelled] = self.back[1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000)]
            out.append(w)
        return out

    def forward(self, w: list[np.ndarray]) -> np.ndarray:
        length = len(w[0])
        a = np.zeros((length + 1, *w[0].shape[1:]))
        a[0] = 1
        for e in range(1, length + 1):
            for k in range(1, min(e, len(w)) + 1):
                a[e] += a[e - k] * w[k - 1][e - k]
        return a

    def marginals(self, chars: np.ndarray) -> np.ndarray:
        """(models, strings): the log of the summed probability of all segmentations."""
        n, length = chars.shape
        edges = self.pieces.edges(chars)
        if length > self.LONGEST:
            return self._slow(edges, n, length)
        total = self.forward(self.weights(edges))[-1].T
        with np.errstate(divide="ignore"):
            out = np.log(total) - self.RISE * length
        low = np.flatnonzero((total < self.LEAST).any(0))
        if len(low):
            out[:, low] = self._slow([x[low] for x in edges], len(low), length)
        return out

    def _slow(self, edges: list[np.ndarray], n: int, length: int) -> np.ndarray:
        return np.stack([forward_log(self.pieces.edge_log_weights(edges, x), n, length)[:, -1] for x in self.log_weights])

    def expect(self, chars: np.ndarray, out: np.ndarray, edges: list[np.ndarray] | None = None) -> None:
        """Add the expected use of each piece over all segmentations of each string to out; one model. edges: those of chars, if known."""
        n, length = chars.shape
        if length > self.LONGEST:
            expected_counts(self.pieces, self.log_weights[0], chars, out)
            return
        edges = self.pieces.edges(chars) if edges is None else edges
        w = [x[:, :, 0] for x in self.weights(edges)]
        a = self.forward(w)
        if (low := a[-1] < self.LEAST).any():
            expected_counts(self.pieces, self.log_weights[0], chars[low], out)
            chars, edges, w, a = chars[~low], [x[~low] for x in edges], [x[:, ~low] for x in w], a[:, ~low]
            if not len(chars):
                return
        b = np.zeros_like(a)
        b[length] = 1 / a[-1]
        for s in range(length - 1, -1, -1):
            for k in range(1, min(length - s, len(w)) + 1):
                b[s] += b[s + k] * w[k - 1][s]
        which, often = [], []
        for k, (ids, x) in enumerate(zip(edges, w, strict=True), 1):
            ids, post = ids.T, a[: length - k + 1] * x * b[k:]
            hit = ids >= 0
            which.append(ids[hit])
            often.append(post[hit])
            if k == 1:
                out[self.pieces.byte_id] += float(post[ids < -1].sum()) / 256
        out += np.bincount(np.concatenate(which), np.concatenate(often), len(out))  # once, since out is as long as the vocabulary


def expected_counts(pieces: Pieces, log_weights: np.ndarray, chars: np.ndarray, out: np.ndarray) -> None:
    """Add the expected use of each piece over all segmentations of each string to out."""
    n, length = chars.shape
    edges = pieces.edges(chars)
    w = pieces.edge_log_weights(edges, log_weights)
    a, b = forward_log(w, n, length), backward_log(w, n, length)
    total = a[:, -1:]
    for k, (ids, lw) in enumerate(zip(edges, w, strict=True), 1):
        post = a[:, : length - k + 1] + lw + b[:, k:] - total
        hit = ids >= 0
        out += np.bincount(ids[hit], np.exp(post[hit]), len(out))
        if k == 1:
            back = ids < -1
            out[pieces.byte_id] += float(np.exp(post[back]).sum()) / 256


def normalised(pieces: Pieces, counts: np.ndarray, smooth: float = 0.05) -> np.ndarray:
    """Log weights from expected counts; every piece and byte keeps a little."""
    c = np.zeros(pieces.size)
    c[pieces.plain] = counts[pieces.plain] + smooth
    c[pieces.byte_id] = counts[pieces.byte_id] + smooth
    with np.errstate(divide="ignore"):
        return np.log(c / c.sum())


def scramble(seed: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Uniform doubles in [0, 1) from (seed, step) pairs: the same pair gives the same number."""
    return (mix(seed + mix(step + _U(0x632BE59BD9B4E019))) >> _U(11)).astype(np.float64) * math.ldexp(1, -53)
