"""Harmonic packing of tokenised documents into fixed-length sequences.

Lengths fall into reciprocal-capacity classes: class j holds pieces of (C/(j+1), C/j] tokens, and j
of them fill a bin. A document is cut into full sequences and a rest; while the rest lies in a low
class j, a piece of exactly C/(j+1) tokens is cut off (the top of class j+1, of which j+1 fill a bin
without a gap to speak of) and what is left is classed anew. So only small pieces, of high classes,
keep their odd lengths. Each input partition fills its own bins, independently of the others; bins
that its classes leave open are emptied and their pieces laid end to end, cut at the capacity, with
the last tokens in sequences of powers of two, which need no padding.

Sequence ids carry the partition's number in their high bits and a count in the low 40; a retried
task reads the same rows and gives the same ids.

Edge cases: an empty or null text has the end token only; the result has no row for an input
without rows; a document of any length is cut, never shortened; equal ids are packed as two
documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare
from .textarrays import code_points, prefix_hash, span_hash
from .workers import cache, lean, slices

SEQ_BITS = 40


_SPACE, _LETTER, _DIGIT, _MARK, _ODD = range(5)
#: Kinds of the first 256 characters; all others are odd: they need the tokenizer itself.
_KIND = np.full(257, _ODD, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[33:127] = _MARK
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[0xC0:0xD7] = _KIND[0xD8:0xF7] = _KIND[0xF8:0x100] = _LETTER


def runs(points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, odd) of what the tokenizer's own pattern takes for one piece, on lowered text.

    Letters go together, digits alone, marks together, and an apostrophe with s, t, m, d, re, ve or ll
    after it. A run without white space that holds an odd character is one odd run.
    """
    n = len(points)
    kind = _KIND[np.minimum(points, 256)]
    kind[:-1][(points[:-1] == 60) & (points[1:] == 124)] = _ODD  # how special tokens begin
    first = np.zeros(n + 1, bool)
    first[bounds[bounds < n]] = True
    start = first[:n] | (kind == _DIGIT)
    start[1:] |= kind[1:] != kind[:-1]
    quote = np.flatnonzero((points == 39) & start)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == _LETTER) & ~first[quote + 1]]
    if len(quote):
        a = points[quote + 1]
        one = (a == 115) | (a == 116) | (a == 109) | (a == 100)
        at = np.minimum(quote + 2, n - 1)
        b = np.where((quote + 2 < n) & ~first[at], points[at], 0)
        two = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)
        start[quote[one | two] + 1] = False
        after = np.concatenate([quote[one] + 2, quote[two] + 3])
        start[after[after < n]] = True
    if (kind == _ODD).any():
        solid = kind != _SPACE
        chunk = solid & (first[:n] | np.append(True, ~solid[:-1]))
        number = np.cumsum(chunk)
        odd_chunk = np.zeros(int(number[-1]) + 1, bool)
        odd_chunk[number[kind == _ODD]] = True
        odd = odd_chunk[number] & solid
        start = np.where(odd, chunk, start)
        start[1:] |= solid[1:] & odd[:-1] & ~odd[1:]
    else:
        odd = np.zeros(n, bool)
    begins = np.flatnonzero(start)
    ends = np.append(begins[1:], n)
    solid = kind[begins] != _SPACE
    begins, ends = begins[solid], ends[solid]
    return begins, ends, odd[begins]


class PieceTokenizer:
    """Ids of a lower-casing tokenizer that never merges beyond a run of letters or a run of marks.

    Runs are told apart by a 64-bit hash; the ids of each are kept in a bounded table of flat arrays.
    """

    def __init__(self, path: str, room: int = 2_000_000):
        from tokenizers import Tokenizer

        self.tok, self.room = Tokenizer.from_file(path), room
        self.ends = np.zeros(self.tok.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tok.get_vocab().items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known, self.first, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(1 << 16, "<u4"), 0

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        points, bounds = code_points(texts)
        if not len(points):
            return [b""] * len(texts)
        capital = (points >= 65) & (points <= 90) | (points >= 0xC0) & (points <= 0xDE) & (points != 0xD7)
        lowered = points + (capital.astype(np.uint32) << np.uint32(5))
        start, end, odd = runs(lowered, bounds)
        h, example, inverse = np.unique(span_hash(prefix_hash(lowered), start, end), return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, h)
        fresh = np.ones(len(h), bool)
        inside = at < len(self.known)
        fresh[inside] = self.known[at[inside]] != h[inside]
        if fresh.any():
            if len(self.known) + int(fresh.sum()) > self.room:
                self.forget()
                fresh[:], at = True, np.zeros(len(h), np.int64)
            pick = example[fresh]
            self._learn(h[fresh], at[fresh], self._ids(points, lowered, start[pick], end[pick], odd[pick]))
            at = np.searchsorted(self.known, h)
        row = at[inverse]
        n = self.count[row].astype(np.int64)
        begin = np.cumsum(n) - n
        ids = self.flat[np.repeat(self.first[row] - begin, n) + np.arange(int(n.sum()))].tobytes()
        cut = 4 * np.append(begin, n.sum())[np.searchsorted(start, bounds)]
        return [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    def _learn(self, h: np.ndarray, at: np.ndarray, found: tuple[np.ndarray, np.ndarray]) -> None:
        ids, n = found
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), "<u4")])
        self.flat[self.used : self.used + len(ids)] = ids
        self.known = np.insert(self.known, at, h)
        self.first = np.insert(self.first, at, self.used + np.cumsum(n) - n)
        self.count = np.insert(self.count, at, n.astype(np.int32))
        self.used += len(ids)

    def _ids(self, points: np.ndarray, lowered: np.ndarray, start: np.ndarray, end: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some runs end to end, and how many each has. Plain ones together in one call, which costs less than one each."""
        size = end - start + 1
        plain = np.flatnonzero(~odd)
        off = np.cumsum(size[plain]) - size[plain]
        joined = np.full(int(size[plain].sum()), 32, np.uint32)
        body = np.repeat(start[plain] - off, size[plain]) + np.arange(len(joined))
        solid = np.ones(len(joined), bool)
        solid[off + size[plain] - 1] = False
        joined[solid] = lowered[body[solid]]
        ids = np.array(self.tok.encode_batch_fast([joined.tobytes().decode("utf-32-le")], add_special_tokens=False)[0].ids, "<u4") if len(plain) else np.zeros(0, "<u4")
        cut = np.append(0, np.flatnonzero(self.ends[ids]) + 1)
        if len(cut) == len(plain) + 1 and cut[-1] == len(ids) and not odd.any():
            return ids, np.diff(cut)
        parts: list = [None] * len(start)
        if len(cut) == len(plain) + 1 and cut[-1] == len(ids):
            for i, a, b in zip(plain.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                parts[i] = ids[a:b]
        left = [i for i, x in enumerate(parts) if x is None]
        texts = [points[start[i] : end[i]].tobytes().decode("utf-32-le") for i in left]
        for i, e in zip(left, self.tok.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            parts[i] = np.array(e.ids, "<u4")
        return np.concatenate(parts), np.array([len(x) for x in parts])


def tokenizer(path: str) -> PieceTokenizer:
    """One for each worker process while it packs, so that its cache outlives a task."""
    kept = cache("packing")
    return kept.get(path) or kept.setdefault(path, PieceTokenizer(path))


def cut_lengths(n: int, capacity: int, low_classes: int = 16) -> list[int]:
    """The pieces of a document of n tokens: full sequences, then tops of classes, then the rest."""
    full, rest = divmod(n, capacity)
    out = [capacity] * full
    while rest:
        j = capacity // rest
        if j >= low_classes or rest == capacity // j:
            out.append(rest)
            break
        out.append(capacity // (j + 1))
        rest -= out[-1]
    return out


class HarmonicPacker:
    """Places pieces; emits (piece, sequence, offset) as bins fill."""

    def __init__(self, capacity: int, first_sequence: int = 0):
        self.capacity, self.next = capacity, first_sequence
        self.open: dict[int, list] = {}

    def add(self, piece, length: int) -> list[tuple]:
        j = self.capacity // length
        bin_ = self.open.setdefault(j, [])
        bin_.append((piece, length))
        return self._close(self.open.pop(j)) if len(bin_) == j else []

    def _close(self, pieces: list) -> list[tuple]:
        out, at = [], 0
        for piece, length in pieces:
            out.append((piece, self.next, at, 0, length))
            at += length
        self.next += 1
        return out

    def flush(self) -> list[tuple]:
        """What the open bins hold, end to end: (piece, sequence, offset, start in the piece, length)."""
        left = [x for j in sorted(self.open) for x in self.open[j]]
        self.open = {}
        total, out = sum(n for _, n in left), []
        sizes = [self.capacity] * (total // self.capacity)
        rest = total % self.capacity
        sizes += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        it, at, room = iter(sizes), 0, 0
        for piece, n in left:
            start = 0
            while start < n:
                if not room:
                    room, at = next(it), 0
                    self.next += 1
                take = min(room, n - start)
                out.append((piece, self.next - 1, at, start, take))
                start, at, room = start + take, at + take, room - take
        return out


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and token_ids).

    Only one task's open bins, fewer than capacity * classes tokens, are held in memory.
    """
    prepare(docs.sparkSession)
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_path)
        packer = HarmonicPacker(capacity, TaskContext.get().partitionId() << SEQ_BITS)
        end = np.array([end_id], "<u4").tobytes()

        def batch(found: list[tuple]) -> pa.RecordBatch:
            rows = []
            for (ident, begin, ids, total), seq, at, start, n in found:
                part = ids[4 * start : 4 * (start + n)]
                rows.append((ident, begin + start, n, zlib.crc32(part), total, seq, at, part))
            cols = list(zip(*rows, strict=True))
            arrays = [pa.array(c, pa.int64()) for c in cols[:7]]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in cols[7]], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names=[*names, *["token_ids"] * with_ids])

        done: list[tuple] = []
        for idents, texts in slices(batches, 500_000):
            for ident, ids in zip(idents, tok(texts), strict=True):
                ids += end
                n, at = len(ids) // 4, 0
                for length in cut_lengths(n, capacity):
                    done += packer.add((ident, at, ids[4 * at : 4 * (at + length)], n), length)
                    at += length
                if len(done) > 20_000:
                    yield batch(done)
                    done = []
        done += packer.flush()
        if done:
            yield batch(done)

    schema = ", ".join(f"`{n}` long" for n in names) + ", token_ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")).mapInArrow(lean("packing", run), schema)
