"""Sampled SentencePiece segmentations by forward filtering and backward sampling.

No piece of the vocabulary crosses the start of a run of spaces or a line feed, so the lattice of a
text is a chain of small lattices, one per segment. Each distinct segment of a batch is filtered
forward once; then each occurrence draws its last piece, the piece before, and so on. The random
numbers are a hash of the row's key and the place in the text, so a row's segmentation depends on
nothing but its key, its text and the parameters, on whatever machine and in whatever batch it runs.

Decoding gives back the text exactly: spaces are the vocabulary's space mark, a literal mark and any
character without a piece are spelled in UTF-8 bytes, and nothing is normalised.

Edge cases: null text counts as empty and has no pieces; a null key draws as 0; lone surrogates can't occur in Spark's
strings. Texts are worked in slices of about a million characters, cut before a space or line feed
(a run of more than that without either is cut as it is).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lattice import SPACE, Pieces, by_length, forward_log, scramble
from .common import prepare
from .textarrays import code_points, mix, prefix_hash, span_hash
from .workers import cache, lean

#: Stands for a space mark that is in the text itself; beyond Unicode, so no piece has it.
_LITERAL = 0x110000


class PieceSampler:
    def __init__(self, model_path: str, temperature: float = 1.0, slice_chars: int = 1 << 20):
        self.pieces = p = Pieces(model_path)
        mark = chr(SPACE)
        if any(mark in p.text[i].lstrip(mark) or "\n" in p.text[i] for i in p.plain):
            raise ValueError("a piece crosses a space or line feed")
        self.log_weights = p.log_weights / temperature
        self.slice_chars = slice_chars
        self.bytes = [t.replace(mark, " ").encode() for t in p.text]
        for b, i in enumerate(p.byte_id):
            self.bytes[i] = bytes([b])

    def encode(self, texts: list[str], keys: np.ndarray, first: np.ndarray | None = None) -> list[np.ndarray]:
        """Piece ids of each text; keys: a 64-bit seed for each; first: the place of each text in its row."""
        points, bounds = code_points(texts)
        if not len(points):
            return [np.zeros(0, np.int32) for _ in texts]
        x = np.where(points == 32, SPACE, np.where(points == SPACE, _LITERAL, points)).astype(np.uint32)
        alone = (x == 10) | (x == _LITERAL)
        starts = alone | (x == SPACE)
        starts[1:] &= alone[1:] | (x[:-1] != SPACE)
        starts[1:] |= alone[:-1]
        starts[bounds[:-1][bounds[:-1] < len(x)]] = True
        start = np.flatnonzero(starts)
        end = np.append(start[1:], len(x))
        doc = np.searchsorted(bounds, start, "right") - 1
        place = start - bounds[doc] + (0 if first is None else first[doc])
        _, example, inverse = np.unique(span_hash(prefix_hash(x), start, end), return_index=True, return_inverse=True)
        rank = np.empty(len(example), np.int64)
        rank[np.argsort((end - start)[example], kind="stable")] = np.arange(len(example))
        by_rank = np.argsort(rank[inverse], kind="stable")
        cut = np.concatenate([[0], np.cumsum(np.bincount(rank[inverse], minlength=len(example)))])
        seed = mix(keys.astype(np.uint64))[doc]
        ids_at = np.full(len(x), -1, np.int32)
        done = 0
        for part, chars in by_length(x, start[example], end[example], cells=1 << 16):
            lo, hi = cut[done], cut[done + len(part)]
            done += len(part)
            occ = by_rank[lo:hi]
            self._sample(chars, rank[inverse[occ]] - rank[part[0]], start[occ], seed[occ], place[occ], ids_at)
        return self._spell(ids_at, bounds)

    def _sample(self, chars: np.ndarray, word: np.ndarray, start: np.ndarray, seed: np.ndarray, place: np.ndarray, ids_at: np.ndarray) -> None:
        n, length = chars.shape
        edges = self.pieces.edges(chars)
        weights = self.pieces.edge_log_weights(edges, self.log_weights)
        if length == 1:
            ids_at[start] = edges[0][word, 0]
            return
        a = forward_log(weights, n, length)
        width = len(edges)
        cum, piece = np.zeros((n, length, width), np.float32), np.full((n, length, width), -1, np.int32)
        for k in range(1, width + 1):
            cum[:, k - 1 :, k - 1] = np.exp(a[:, : length - k + 1] + weights[k - 1] - a[:, k:])
            piece[:, k - 1 :, k - 1] = edges[k - 1]
        most = width - 1 - (cum[:, :, ::-1] > 0).argmax(2)
        np.cumsum(cum, axis=2, out=cum)
        at = np.full(len(word), length)
        while len(word):
            u = scramble(seed, (place + at).astype(np.uint64)).astype(np.float32)
            k = np.minimum((cum[word, at - 1] <= u[:, None]).sum(1), most[word, at - 1])
            ids_at[start + at - k - 1] = piece[word, at - 1, k]
            at = at - k - 1
            on = at > 0
            word, start, seed, place, at = word[on], start[on], seed[on], place[on], at[on]

    def _spell(self, ids_at: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        """Characters without a piece become byte pieces; then one array for each text."""
        where = np.flatnonzero(ids_at != -1)
        ids = ids_at[where]
        back = np.flatnonzero(ids < -1)
        if len(back):
            kinds, which = np.unique(-2 - ids[back], return_inverse=True)
            spelled = [self.pieces.byte_id[list(chr(SPACE if c == _LITERAL else c).encode("utf-8", "surrogatepass"))] for c in kinds.tolist()]
            times = np.ones(len(ids), np.int64)
            times[back] = np.array([len(s) for s in spelled])[which]
            first = np.concatenate([[0], np.cumsum(times)])[:-1]
            ids, where = np.repeat(ids, times), np.repeat(where, times)
            for i, s in enumerate(spelled):
                at = first[back[which == i]]
                for j, b in enumerate(s):
                    ids[at + j] = b
        return np.split(ids, np.searchsorted(where, bounds[1:-1]))

    def slices(self, text: str) -> Iterator[tuple[int, str]]:
        at = 0
        while len(text) - at > self.slice_chars:
            stop = at + self.slice_chars
            cut = max(text.rfind("\n", at + 1, stop), text.rfind(" ", at + 1, stop))
            while cut > at and text[cut] == " " and text[cut - 1] == " ":  # to the start of the run of spaces
                cut -= 1
            cut = cut if cut > at else stop
            yield at, text[at:cut]
            at = cut
        yield at, text[at:]

    def decode(self, ids: Iterable[int]) -> str:
        table = self.bytes
        return b"".join([table[i] for i in ids]).decode("utf-8", "surrogatepass")


def sample_pieces(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", temperature: float = 1.0, seed: int = 0, with_ids: bool = False, batch_chars: int = 2_000_000) -> DataFrame:
    """id, n_chars, n_pieces, ids_crc32, decoded_sha256, lossless (and piece_ids) for each row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = f"{model_path}|{temperature}"
        kept = cache("pieces")
        sampler = kept.get(key) or kept.setdefault(key, PieceSampler(model_path, temperature))

        def finish(rows: list[tuple[int, str]]) -> pa.RecordBatch:
            cut = [(r, at, s) for r, (_, text) in enumerate(rows) for at, s in sampler.slices(text)]
            keys = np.array([rows[r][0] or 0 for r, _, _ in cut], np.int64).astype(np.uint64) ^ mix(np.array([seed], np.uint64))
            found = sampler.encode([s for _, _, s in cut], keys, np.array([at for _, at, _ in cut], np.int64))
            parts: list[list[np.ndarray]] = [[] for _ in rows]
            for (r, _, _), ids in zip(cut, found, strict=True):
                parts[r].append(ids)
            out = []
            for (ident, text), p in zip(rows, parts, strict=True):
                ids = np.concatenate(p)
                plain = sampler.decode(ids.tolist())
                out.append((ident, len(text), len(ids), zlib.crc32(ids.astype("<u4").tobytes()), hashlib.sha256(plain.encode()).hexdigest(), plain == text, ids))
            cols = list(zip(*out, strict=True))
            arrays = [pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.string(), pa.bool_()], strict=False)]
            if with_ids:
                arrays.append(pa.array(list(cols[6]), pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names=names)

        rows, size = [], 0
        for b in batches:
            for ident, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows.append((ident, text.as_py() or ""))
                size += len(rows[-1][1]) + 100
                if size > batch_chars:
                    yield finish(rows)
                    rows, size = [], 0
        if rows:
            yield finish(rows)

    prepare(docs.sparkSession)
    names = [id_col, "n_chars", "n_pieces", "ids_crc32", "decoded_sha256", "lossless", *["piece_ids"] * with_ids]
    schema = f"`{id_col}` long, n_chars long, n_pieces long, ids_crc32 long, decoded_sha256 string, lossless boolean" + ", piece_ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")).mapInArrow(lean("pieces", run), schema)
