"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word is a time step; a run of over 40 characters without white space (text of a script that sets
none, joined words) is cut into overlapping pieces of 40, a time step each. A step's input joins a word
embedding with a character embedding, the sum over its character 3- to 5-grams (with word boundaries)
by the root of their number. A window of words runs through a gated recurrent
network in both directions; attention weighs the states, and their sum gives the window's logit.
Every overlapping window of a text is scored, and the text's score is that of its highest window.

Training: labels belong to texts, not windows, so each round picks the windows that now score
highest in each training text and takes gradient steps (Adam, backpropagation through time) on
those. The first round picks by the words' and grams' log odds, which also start one coordinate of
their embeddings. The sample of labelled rows is bounded (`max_rows`, a third of it toxic at most, both
parts in order of a hash of the id; of these, texts of `max_bytes` together, and none of over a
sixteenth of that); scoring has no bound: whole texts, all windows, a bounded number of them at a time.

Edge cases: null text counts as empty; a text without words has one empty window and gets the
network's score for it; labels that are null or neither 0 nor 1 are not learned from; several labels
of a row count as toxic if one is; without toxic or without other rows to learn from, every score is
the share of toxic rows (0 without labels).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare
from .textarrays import ascii_lower_points, code_points, prefix_hash, span_hash, words
from .workers import lean

GRAMS = (3, 4, 5)
_LONG, _STEP = 40, 32  # longer runs are cut into pieces, each overlapping the next by more than a gram
_EDGE = 0x110001  # a word's boundary among code points


@dataclass
class Settings:
    window: int = 48
    stride: int = 32
    hidden: int = 8
    width: int = 16
    vocabulary: int = 20_000
    max_rows: int = 2_400
    max_bytes: int = 32 << 20
    rounds: int = 4
    passes: int = 2
    least_steps: int = 300
    rate: float = 0.01
    seed: int = 11


class Words:
    """The distinct words of some texts: their hashes, their grams' hashes, and each text's word numbers."""

    def __init__(self, texts: list[str]):
        points, bounds = code_points(texts)
        points = ascii_lower_points(points)
        start, end, doc = words(points, bounds)
        parts = np.maximum(1, -(-(end - start - (_LONG - _STEP)) // _STEP))
        inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start = np.repeat(start, parts) + inner * _STEP
        end, doc = np.minimum(start + _LONG, np.repeat(end, parts)), np.repeat(doc, parts)
        h = span_hash(prefix_hash(points), start, end)
        self.hash, first, self.seq = np.unique(h, return_index=True, return_inverse=True)
        self.cut = np.searchsorted(doc, np.arange(len(texts) + 1))
        # Each distinct word once more, with a boundary on either side.
        s, e = start[first], end[first]
        size = e - s + 2
        off = np.concatenate([[0], np.cumsum(size)])
        flat = np.full(off[-1], _EDGE, np.uint32)
        inner = np.arange(off[-1]) - np.repeat(off[:-1], size)
        body = (inner > 0) & (inner < np.repeat(size, size) - 1)
        flat[body] = points[(np.repeat(s, size) + inner - 1)[body]]
        ph = prefix_hash(flat)
        owner, grams = [], []
        for n in GRAMS:
            count = np.maximum(size - n + 1, 0)
            w = np.repeat(np.arange(len(size)), count)
            at = off[w] + np.arange(len(w)) - np.repeat(np.cumsum(count) - count, count)
            owner.append(w)
            grams.append(span_hash(ph, at, at + n))
        self.owner, self.grams = np.concatenate(owner), np.concatenate(grams)


def find(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """1 + place of each hash in the sorted keys, 0 if it isn't there."""
    if not len(keys):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, at + 1, 0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Network:
    """Parameters in one dict; forward, and gradients by backpropagation through time."""

    def __init__(self, settings: Settings, word_keys: np.ndarray, gram_keys: np.ndarray, word_odds: np.ndarray, gram_odds: np.ndarray):
        s, rng = settings, np.random.default_rng(settings.seed)
        self.s, self.word_keys, self.gram_keys = s, word_keys, gram_keys
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        p = self.p = {"word": draw(len(word_keys) + 1, s.width) * 0, "gram": draw(len(gram_keys) + 1, s.width) * 0}
        p["word"] += 0.05 * rng.standard_normal(p["word"].shape).astype(np.float32)
        p["gram"] += 0.05 * rng.standard_normal(p["gram"].shape).astype(np.float32)
        p["word"][0] = p["gram"][0] = 0
        p["word"][1:, 0], p["gram"][1:, 0] = word_odds, gram_odds
        for d in "fb":
            p["W" + d], p["U" + d], p["c" + d] = draw(2 * s.width, 3 * s.hidden), draw(s.hidden, 3 * s.hidden), np.zeros(3 * s.hidden, np.float32)
        p["A"], p["a"], p["v"] = draw(2 * s.hidden, s.hidden), np.zeros(s.hidden, np.float32), draw(s.hidden)
        p["o"], p["ob"] = draw(2 * s.hidden), np.zeros(1, np.float32)

    def rows(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Embedding rows of distinct words: the word's, and its known grams' with their owners and weights."""
        g = find(self.gram_keys, w.grams)
        known = g > 0
        owner, g = w.owner[known], g[known]
        share = 1 / np.sqrt(np.maximum(np.bincount(owner, minlength=len(w.hash)), 1)).astype(np.float32)
        return find(self.word_keys, w.hash), owner, g, share

    def inputs(self, rows: tuple) -> np.ndarray:
        """(words + 1, 2 * width); the last row, zeros, pads."""
        word, owner, gram, share = rows
        width = self.s.width
        x = np.zeros((len(word) + 1, 2 * width), np.float32)
        x[:-1, :width] = self.p["word"][word]
        if len(owner):
            order = np.argsort(owner, kind="stable")
            o = owner[order]
            first = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
            x[o[first], width:] = np.add.reduceat(self.p["gram"][gram[order]], first, axis=0)
        x[:-1, width:] *= share[:, None]
        return x

    def forward(self, x: np.ndarray, seq: np.ndarray, keep: bool = False):
        """Logits of windows; seq (windows, steps) of rows of x, its last row where there is no word."""
        p, hid, (n, steps) = self.p, self.s.hidden, seq.shape
        mask = (seq != len(x) - 1).astype(np.float32)
        states, trace = np.empty((n, steps, 2 * hid), np.float32), {}
        for k, d in enumerate("fb"):
            proj = x @ p["W" + d] + p["c" + d]
            h, u, log = np.zeros((n, hid), np.float32), p["U" + d], []
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                g = proj[seq[:, t]]
                hu = h @ u
                zr = sigmoid(g[:, : 2 * hid] + hu[:, : 2 * hid])
                z, r = zr[:, :hid], zr[:, hid:]
                c = np.tanh(g[:, 2 * hid :] + r * hu[:, 2 * hid :])
                m = mask[:, t : t + 1]
                new = h + m * (1 - z) * (c - h)
                if keep:
                    log.append((t, h, z, r, c, hu[:, 2 * hid :]))
                h = new
                states[:, t, k * hid : (k + 1) * hid] = h
            trace[d] = log
        s = np.tanh(states @ p["A"] + p["a"])
        e = s @ p["v"] + (mask - 1) * 1e4
        a = np.exp(e - e.max(1, keepdims=True))
        a /= a.sum(1, keepdims=True)
        pooled = (a[:, :, None] * states).sum(1)
        logit = pooled @ p["o"] + p["ob"][0]
        return (logit, mask, states, trace, s, a, pooled) if keep else logit

    def gradients(self, rows: tuple, seq: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, hid, width = self.p, self.s.hidden, self.s.width
        x = self.inputs(rows)
        logit, mask, states, trace, s, a, pooled = self.forward(x, seq, True)
        dl = ((sigmoid(logit) - y) / len(y)).astype(np.float32)
        g = {"o": pooled.T @ dl, "ob": np.array([dl.sum()], np.float32)}
        dp = dl[:, None] * p["o"]
        dstates = a[:, :, None] * dp[:, None, :]
        da = (states * dp[:, None, :]).sum(2)
        de = a * (da - (a * da).sum(1, keepdims=True))
        g["v"] = np.einsum("nt,nth->h", de, s)
        ds = de[:, :, None] * p["v"] * (1 - s * s)
        g["A"], g["a"] = np.einsum("nti,ntj->ij", states, ds), ds.sum((0, 1))
        dstates += ds @ p["A"].T
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            u = p["U" + d]
            gu, gates = np.zeros_like(u), np.empty((*seq.shape, 3 * hid), np.float32)
            dh = np.zeros((len(seq), hid), np.float32)
            for t, h, z, r, c, hn in reversed(trace[d]):
                dh = dh + dstates[:, t, k * hid : (k + 1) * hid]
                m = mask[:, t : t + 1]
                dnew = dh * m
                dc = dnew * (1 - z) * (1 - c * c)
                dz = dnew * (h - c) * z * (1 - z)
                dr = dc * hn * r * (1 - r)
                back = np.concatenate([dz, dr, dc * r], 1)
                gu += h.T @ back
                gates[:, t] = np.concatenate([dz, dr, dc], 1)
                dh = dh * (1 - m) + dnew * z + back @ u.T
            gproj = _sums(seq.ravel(), gates.reshape(-1, 3 * hid), len(x))
            g["U" + d], g["W" + d], g["c" + d] = gu, x.T @ gproj, gproj.sum(0)
            dx += gproj @ p["W" + d].T
        word, owner, gram, share = rows
        g["word"] = _sums(word, dx[:-1, :width], len(p["word"]))
        g["gram"] = _sums(gram, (dx[:-1, width:] * share[:, None])[owner], len(p["gram"]))
        g["word"][0] = g["gram"][0] = 0
        return g


def _sums(at: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Row sums of x by place."""
    out = np.zeros((n, x.shape[1]), np.float32)
    if len(at):
        order = np.argsort(at, kind="stable")
        k = at[order]
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        out[k[first]] = np.add.reduceat(x[order], first, axis=0)
    return out


def windows(w: Words, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(windows, steps) of word numbers, len(w.hash) as padding, and each window's text."""
    n = np.diff(w.cut)
    count = np.maximum(1, -(-(n - (s.window - s.stride)) // s.stride))
    doc = np.repeat(np.arange(len(n)), count)
    begin = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * s.stride
    at = begin[:, None] + np.arange(s.window)
    inside = at < n[doc][:, None]
    pad = np.append(w.seq, len(w.hash))
    return pad[np.where(inside, np.minimum(w.cut[doc][:, None] + at, len(pad) - 1), len(pad) - 1)], doc


def _odds(t: np.ndarray, c: np.ndarray, n_toxic: int, n_clean: int, keep: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of hashes in t toxic and c other texts the `keep` that differ most by label, in order, and their clipped log odds."""
    odds = np.log((t + 0.5) / (n_toxic + 1)) - np.log((c + 0.5) / (n_clean + 1))
    weight = np.where(t + c >= least, np.abs(odds) * np.sqrt(t + c), -1)
    pick = np.sort(np.argsort(-weight, kind="stable")[: min(keep, int((weight > 0).sum()))])
    return pick, np.clip(odds[pick], -3, 3).astype(np.float32)


def _gram_counts(w: Words, word: np.ndarray, doc: np.ndarray, y: np.ndarray, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram hashes, toxic texts, other texts with each) from (word, text) pairs in order of texts, about `most` grams at a time."""
    kinds, number = np.unique(w.grams, return_inverse=True)
    by_word = np.argsort(w.owner, kind="stable")
    number, cut = number[by_word], np.searchsorted(w.owner[by_word], np.arange(len(w.hash) + 1))
    size = np.diff(cut)
    total, toxic = np.zeros(len(kinds)), np.zeros(len(kinds))
    work = np.cumsum(size[word])
    lo = 0
    while lo < len(word):
        hi = int(np.searchsorted(work, (work[lo - 1] if lo else 0) + most)) + 1
        hi = int(np.searchsorted(doc, doc[min(hi, len(doc)) - 1], "right"))  # to the end of a text
        n = size[word[lo:hi]]
        at = np.repeat(cut[word[lo:hi]] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        once = np.unique((np.repeat(doc[lo:hi], n) - doc[lo]) * len(kinds) + number[at])
        gram = once % len(kinds)
        total += np.bincount(gram, minlength=len(kinds))
        toxic += np.bincount(gram, y[once // len(kinds) + doc[lo]], len(kinds))
        lo = hi
    return kinds, toxic, total - toxic


def train(texts: list[str], y: np.ndarray, settings: Settings) -> Network:
    w, s = Words(texts), settings
    n = np.diff(w.cut)
    of = np.repeat(np.arange(len(texts)), n)
    pairs = np.unique(of * len(w.hash) + w.seq)  # each word once a text, in order of texts
    doc, word = pairs // len(w.hash), pairs % len(w.hash)
    n_toxic = int(y.sum())
    toxic = np.bincount(word, y[doc], len(w.hash))
    pick, word_odds = _odds(toxic, np.bincount(word, minlength=len(w.hash)) - toxic, n_toxic, len(y) - n_toxic, s.vocabulary, 3)
    word_keys = w.hash[pick]
    kinds, toxic, clean = _gram_counts(w, word, doc, y)
    pick, gram_odds = _odds(toxic, clean, n_toxic, len(y) - n_toxic, s.vocabulary, 5)
    gram_keys = kinds[pick]
    del pairs, doc, word, kinds, toxic, clean
    net = Network(s, word_keys, gram_keys, word_odds, gram_odds)
    rows = net.rows(w)
    seq, doc = windows(w, s)
    odds = np.append(np.append(0, word_odds)[rows[0]], 0)
    score = np.sort(np.maximum(odds[seq], 0), axis=1)[:, -3:].sum(1)
    x = net.inputs(rows)
    gram_best = np.append(np.zeros(len(w.hash)), 0)
    np.maximum.at(gram_best, rows[1], np.append(0, gram_odds)[rows[2]])
    score = score + np.sort(gram_best[seq], axis=1)[:, -3:].sum(1) * 0.5
    rng, m, v, step = np.random.default_rng(s.seed), {}, {}, 0
    for turn in range(s.rounds):
        if turn:
            x = net.inputs(rows)
            score = np.concatenate([net.forward(x, seq[i : i + 2048]) for i in range(0, len(seq), 2048)])
        order = np.lexsort((-score, doc))
        first = np.searchsorted(doc[order], np.arange(len(texts)))
        rank = np.arange(len(order)) - first[doc[order]]
        take = order[(rank < 2) & (y[doc[order]] == 0) | (rank == 0)]
        extra = np.flatnonzero(y[doc] == 0)
        take = np.concatenate([take, rng.choice(extra, min(len(extra), len(texts)), replace=False)])
        size = min(256, max(32, len(take) // 24))
        for _ in range(max(s.passes, -(-s.least_steps // s.rounds // -(-len(take) // size)))):
            take = rng.permutation(take)
            for i in range(0, len(take), size):
                part = take[i : i + size]
                g = net.gradients(_subset(rows, seq[part]), _renumber(seq[part]), y[doc[part]].astype(np.float32))
                step += 1
                for k, grad in g.items():
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * grad
                    v[k] = 0.99 * v.get(k, 0) + 0.01 * grad * grad
                    net.p[k] -= s.rate / (1 + turn) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
    return net


def _renumber(seq: np.ndarray) -> np.ndarray:
    """The same windows by the numbers of the words among them; the largest is the padding."""
    return np.unique(seq, return_inverse=True)[1].reshape(seq.shape)


def _subset(rows: tuple, seq: np.ndarray) -> tuple:
    word, owner, gram, share = rows
    some = np.unique(seq)
    some = some[some < len(word)]
    number = np.full(len(word), -1)
    number[some] = np.arange(len(some))
    on = number[owner] >= 0
    return word[some], number[owner[on]], gram[on], share[some]


def score_texts(net: Network, texts: list[str], chars: int = 500_000) -> np.ndarray:
    """The highest window's probability for each whole text."""
    out, lo, size = [], 0, 0
    for i in range(len(texts) + 1):
        if i == len(texts) or size >= chars:
            if i > lo:
                w = Words(texts[lo:i])
                x = net.inputs(net.rows(w))
                seq, doc = windows(w, net.s)
                logit = np.concatenate([net.forward(x, seq[j : j + 1024]) for j in range(0, len(seq), 1024)])
                out.append(np.maximum.reduceat(logit, np.searchsorted(doc, np.arange(i - lo))))
            lo, size = i, 0
        if i < len(texts):
            size += len(texts[i])
    return sigmoid(np.concatenate(out).astype(np.float64)) if out else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", settings: Settings | None = None) -> Network | float:
    """A network from at most max_rows labelled rows, or a constant where there is nothing to tell apart.

    The bounded sample is trained on in one task, so the driver only holds the network.
    """
    s = settings or Settings()
    prepare(docs.sparkSession)
    known = labels.filter(F.col(label_col).isin(0, 1) & may_learn).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("double").alias("_y"))
    order = [F.xxhash64("_id"), F.col("_id")]
    sample = known.filter("_y = 1").orderBy(*order).limit(s.max_rows // 3).unionByName(known.filter("_y = 0").orderBy(*order).limit(s.max_rows - s.max_rows // 3))
    text = F.coalesce(F.col(text_col), F.lit(""))
    short = docs.select(F.col(id_col).alias("_key"), text.alias("t")).filter(F.octet_length("t") <= s.max_bytes // 16)
    found = short.join(F.broadcast(sample), F.col("_key") == F.col("_id")).select(F.col("_id").cast("long").alias("_id"), "t", "_y")  # max_rows ids at most
    # The one window of all rows has max_rows ids.
    held = F.sum(F.octet_length("t") + 1).over(Window.orderBy(F.xxhash64("_id"), "_id", "t").rowsBetween(Window.unboundedPreceding, 0))
    found = found.withColumn("_held", held).filter(F.col("_held") <= s.max_bytes).drop("_held")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
        y = np.array([r[2] for r in rows], float)
        net = train([r[1] for r in rows], y, s) if len(y) and y.min() != y.max() else float(y.mean()) if len(y) else 0.0
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], names=["net"])

    got = found.coalesce(1).mapInArrow(lean("toxicity", run), "net binary").collect()
    return pickle.loads(got[0]["net"]) if got else 0.0


def _scores(model: Network | float, texts: pa.Array) -> np.ndarray:
    if isinstance(model, float):
        return np.full(len(texts), model)
    out, part, size = [np.zeros(0)], [], 0
    for t in texts:
        part.append(t.as_py() or "")
        size += len(part[-1]) + 50
        if size > 500_000:
            out.append(score_texts(model, part))
            part, size = [], 0
    return np.concatenate([*out, score_texts(model, part)])


def score(docs: DataFrame, net: Network | float, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1) of each row."""
    held = prepare(docs.sparkSession).sparkContext.broadcast(net)  # bounded by the settings

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_scores(model, b.column(1)), pa.float64())], names=[id_col, "score"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")).mapInArrow(lean("toxicity", run), f"`{id_col}` long, score double")


def keep_clean(docs: DataFrame, net: Network | float, reject_from: float, *, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that score below reject_from; no shuffle."""
    held = prepare(docs.sparkSession).sparkContext.broadcast(net)
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for b in batches:
            yield b.filter(pa.array(_scores(model, b.column(at)) < reject_from))

    return docs.mapInArrow(lean("toxicity", run), docs.schema)
