"""Language-model scoring by the marginal probability of subword lattices.

The model is a unigram model over symbols: the words seen in training (with absolute discounting),
the pieces of an existing vocabulary, and an end symbol. A text's probability sums over all ways to
write each of its tokens: as one known word, or as any sequence of pieces that spells it (a forward
recursion in log space over the token's lattice). Piece weights start from the vocabulary's scores
and are re-estimated from the training words by expectation steps within blocks, whose expected
counts are added up over all blocks.

Texts are dealt into blocks by a hash of the id. A block's distinct words travel as 64-bit hashes:
training counts are summed per word over blocks, and come back to each block that has the word.
So nothing that grows with the corpus is broadcast or collected; the piece weights (one number per
piece of the vocabulary and class) and a few totals are.

Training rows may name a class (a language, say). Words and pieces are then also counted by class,
and a text's probability is the mixture over classes, each weighed by its share of the training
tokens; the class of the scored text itself is never read, nor that of any held-out row. In each class
the masses of all words, of the end symbol and of all pieces sum to one: what discounting takes from
the words is what the pieces share. A class beyond the `max_classes` - 1 with most training rows shares
one component with the others and with rows of no class; its rows all count, and without such rows
there is no such component.

Edge cases: null text counts as empty; an empty text has the end token only; without training rows
the base model has N = 0 and V = 0 and the model spells every token. Words may be of any length. Rows
without an id, and repeated ids, are dealt by their texts; the order of rows is no input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks_for, even_keys, prepare, written
from .lattice import SPACE, Linear, Pieces, by_length, normalised
from .textarrays import ascii_lower_points, code_points, prefix_hash, span_hash, words
from .workers import cache, lean_group


def _pieces(path: str) -> Pieces:
    kept = cache("lm")
    return kept.get(path) or kept.setdefault(path, Pieces(path))


def _ordered(t: pa.Table, id_col: str) -> pa.Table:
    """Rows by id and text, so that a shuffle's order is no input."""
    return t.sort_by([(id_col, "ascending"), ("text", "ascending")])


def _chunks(texts: list[str], chars: int = 500_000) -> Iterator[tuple[int, int]]:
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lowered code points and each token's (start, end, text number, hash)."""
    points, bounds = code_points(texts)
    points = ascii_lower_points(points)
    start, end, doc = words(points, bounds)
    return points, start, end, doc, span_hash(prefix_hash(points), start, end).view(np.int64)


class _Seen:
    """Sorted hashes with a value each."""

    def __init__(self):
        self.h, self.v = np.zeros(0, np.int64), np.zeros(0)

    def new(self, h: np.ndarray) -> np.ndarray:
        if not len(self.h):
            return np.ones(len(h), bool)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return self.h[at] != h

    def add(self, h: np.ndarray, v: np.ndarray) -> None:
        h, v = np.concatenate([self.h, h]), np.concatenate([self.v, v])
        order = np.argsort(h, kind="stable")
        self.h, self.v = h[order], v[order]

    def get(self, h: np.ndarray, default: float = 0.0) -> np.ndarray:
        if not len(self.h):
            return np.full(len(h), default)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[at] == h, self.v[at], default)


def _count_block(model_path: str, classes: int, id_col: str):
    """Rows of kind 0: words with training counts by class; 1: texts (end symbols); 2: types; 3: expected uses of a piece."""

    def run(t: pa.Table) -> pa.Table:
        pieces = _pieces(model_path)
        t = _ordered(t, id_col)
        block, texts = t["block"][0].as_py(), t["text"].to_pylist()
        cls = t["cls"].to_numpy()  # -1: not for training
        seen, found = [_Seen() for _ in range(classes)], []
        expected, types = np.zeros((classes, pieces.size)), np.zeros(classes, np.int64)
        local = [pieces.log_weights] * classes
        for lo, hi in _chunks(texts):
            points, start, end, doc, h = _tokens(texts[lo:hi])
            if not len(h):
                continue
            u, example, inverse = np.unique(h, return_index=True, return_inverse=True)
            z = cls[lo:hi][doc]
            n = np.stack([np.bincount(inverse[z == k], minlength=len(u)) for k in range(classes)], 1)
            found.append((u, n))
            for k in range(classes):
                fresh = (n[:, k] > 0) & seen[k].new(u)
                pick = example[fresh]
                if not len(pick):
                    continue
                rounds = 1 if types[k] else 4  # a class's first words also set the weights it starts with
                words_ = (chars for _, chars in by_length(points, start[pick], end[pick], SPACE, cells=1 << 15))
                # Pieces are looked up once for all rounds.
                looked = [(chars, pieces.edges(chars) if chars.shape[1] <= Linear.LONGEST else None) for chars in words_] if rounds > 1 else ((chars, None) for chars in words_)
                for _ in range(rounds):
                    add, model = np.zeros(pieces.size), Linear(pieces, local[k])
                    for chars, edges in looked:
                        model.expect(chars, add, edges)
                    local[k] = normalised(pieces, expected[k] + add)
                expected[k] += add
                types[k] += len(pick)
                seen[k].add(u[fresh], np.zeros(len(pick)))
        u, n = np.zeros(0, np.int64), np.zeros((0, classes), np.int64)
        if found:
            u, inverse = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
            every = np.concatenate([x for _, x in found])
            n = np.stack([np.bincount(inverse, every[:, k], len(u)) for k in range(classes)], 1).astype(np.int64)
        some = np.flatnonzero((expected > 0).any(0))
        ends = np.bincount(cls[cls >= 0], minlength=classes)[:classes]
        kinds = np.concatenate([np.zeros(len(u)), [1, 2], np.full(len(some), 3)]).astype(np.int32)
        keys = np.concatenate([u, [0, 0], some])
        values = np.concatenate([n, [ends], [types], expected[:, some].T]).astype(np.float64)
        cols = {"block": pa.array(np.full(len(kinds), block), pa.int64()), "kind": pa.array(kinds), "h": pa.array(keys, pa.int64())}
        return pa.table(cols | {f"n{k}": pa.array(values[:, k]) for k in range(classes)})

    return run


def masses(totals: dict, by_class: float) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Discount of a word's count; by class the share of tokens written in pieces, pieces of such a token, symbols a token.

    A class's words sum to (1 - spelled) / symbols and its pieces to spelled * per_word / symbols.
    """
    one, two, n = totals["n1"], totals["n2"], np.array(totals["by_n"], float)
    discount = min(max(one / (one + 2 * two) if one else 0.5, 0.05), 0.95)
    own = np.where(n > 0, np.array(totals["part"], float) / np.maximum(n, 1), 1 / discount)  # a class without words is all spelled
    rest = totals["v"] / totals["n"] if totals["n"] else 1 / discount
    spelled = np.clip(discount * (by_class * own + (1 - by_class) * rest), 1e-9, 1)
    per_word = np.maximum(np.array(totals["pieces_per_word"], float), 1)
    return discount, spelled, per_word, 1 - spelled + spelled * per_word


def _score_block(model_path: str, weights: list[np.ndarray], totals: dict, id_col: str, by_class: float):
    """Scores of a block's texts, given the training counts of its words by class."""
    classes, ends = len(weights), np.array(totals["ends"], float)
    big_n, big_v, by_n = totals["n"], totals["v"], np.array(totals["by_n"], float)
    discount, spelled, per_word, symbols = masses(totals, by_class)
    log_piece = np.log(spelled * per_word / symbols)
    base_den = big_n + 0.5 * (big_v + 1)
    share = (by_n + 0.5) / (by_n + 0.5).sum()

    def log_token(c: np.ndarray, lattice: np.ndarray, k: int, keep: float = 0.0) -> np.ndarray:
        """Natural log of the token's probability in class k; c (words, classes)."""
        total = c.sum(1)
        left = np.where(total > 0, np.maximum(total - discount, keep) / np.maximum(total, 1), 0)  # what discounting leaves of a word's count
        whole = by_class * c[:, k] / max(by_n[k], 1) + (1 - by_class) * total / max(big_n, 1)
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log(whole * left / symbols[k]), lattice)

    def run(docs: pa.Table, counts: pa.Table) -> pa.Table:
        model, docs = Linear(_pieces(model_path), np.stack(weights) + log_piece[:, None]), _ordered(docs, id_col)
        order = np.argsort(counts["h"].to_numpy(), kind="stable")
        known = counts["h"].to_numpy()[order]
        table = np.stack([counts[f"n{k}"].to_numpy()[order] for k in range(classes)], 1)
        lattice = [_Seen() for _ in range(classes)]
        ids, texts, held = docs[id_col], docs["text"].to_pylist(), docs["held_out"]
        cols: list[list[np.ndarray]] = [[] for _ in range(3 + classes)]
        for lo, hi in _chunks(texts):
            points, start, end, doc, h = _tokens(texts[lo:hi])
            u, example, inverse = np.unique(h, return_index=True, return_inverse=True)
            new = lattice[0].new(u)
            pick = example[new]
            value = np.empty((classes, len(pick)))
            for part, chars in by_length(points, start[pick], end[pick], SPACE, cells=1 << 15):
                value[:, part] = model.marginals(chars)
            for k in range(classes):
                lattice[k].add(u[new], value[k])
            at = np.minimum(np.searchsorted(known, u), max(len(known) - 1, 0))
            c = np.where((known[at] == u)[:, None], table[at], 0) if len(known) else np.zeros((len(u), classes))
            total = c.sum(1)
            base = np.log10((total + 0.5) / base_den)
            per = [np.ones(len(u)), total > 0, base, *(log_token(c, lattice[k].get(u), k) for k in range(classes))]
            for out, x in zip(cols, per, strict=True):
                out.append(np.bincount(doc, x[inverse], hi - lo) if len(u) else np.zeros(hi - lo))
        n, known_n, base, *by = (np.concatenate(c) for c in cols)
        e = ends[None, :]
        stop = [log_token(np.maximum(e, 0.5 / classes), np.array([-np.inf]), k, 0.5)[0] for k in range(classes)]
        joint = np.stack([x + stop[k] + math.log(share[k]) for k, x in enumerate(by)])
        top = joint.max(0)
        score = (top + np.log(np.exp(joint - top).sum(0))) / math.log(10)
        return pa.table({
            id_col: ids, "held_out": held, "n_tokens": pa.array((n + 1).astype(np.int64)), "n_known": pa.array((known_n + (ends.sum() > 0)).astype(np.int64)),
            "train_tokens": pa.array(np.full(len(n), int(big_n)), pa.int64()), "base_score": pa.array(base + math.log10((ends.sum() + 0.5) / base_den)), "score": pa.array(score),
        })

    return run


def _trimmed(run):
    def inner(docs: pa.Table, counts: pa.Table) -> pa.Table:
        return lean_group("lm", lambda t: run(t, counts))(docs)

    return inner


def score_texts(docs: DataFrame, held_out: Column, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", class_col: str | None = None, max_classes: int = 16, by_class: float = 0.9, block_bytes: int = 16 << 20) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of each whole text.

    class_col: the training rows' class; beyond the most frequent max_classes - 1, classes are one.
    by_class: the weight of a class's own word counts beside those of all classes.
    """
    prepare(docs.sparkSession)
    blocks = blocks_for(docs, text_col, block_bytes)
    names = [None]
    if class_col:
        top = docs.filter(~F.coalesce(held_out, F.lit(False))).groupBy(class_col).count().orderBy(F.desc("count"), class_col).limit(max_classes).collect()
        named = [r[0] for r in top if r[0] is not None][: max_classes - 1]
        names = named if named and len(named) == len(top) else [*named, None]  # the last takes rows of no other class, if there are any
    cls = F.lit(len(names) - 1)
    for k, name in enumerate(names):
        cls = cls if name is None else F.when(F.col(class_col) == name, k).otherwise(cls)
    sums = [f"n{k}" for k in range(len(names))]
    base = docs.select(
        F.col(id_col).cast("long").alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"), held_out.alias("held_out"),
        F.when(held_out, -1).otherwise(cls).cast("int").alias("cls"),
        even_keys(docs.sparkSession, blocks, F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))).alias("block"),
    )
    dealt = base.repartition(min(blocks, 20_000), "block")
    found = written(dealt.groupBy("block").applyInArrow(lean_group("lm", _count_block(model_path, len(names), id_col)), "block long, kind int, h long, " + ", ".join(f"{n} double" for n in sums)), "lm")
    one_word = Window.partitionBy("h")
    by_word = written(found.filter("kind = 0").select("block", "h", *(F.sum(n).over(one_word).alias(n) for n in sums), (F.min("block").over(one_word) == F.col("block")).alias("first")), "lm")
    c = sum((F.col(n) for n in sums), F.lit(0.0))
    t = by_word.filter("first").agg(F.count(F.when(c > 0, 1)).alias("v"), F.count(F.when(c == 1, 1)).alias("ones"), F.count(F.when(c == 2, 1)).alias("twos"), *(F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in sums)).first()
    parts = by_word.filter("first").filter(c > 0).agg(*(F.coalesce(F.sum(F.col(n) / c), F.lit(0.0)).alias(n) for n in sums)).first()
    s = {r["kind"]: [r[n] for n in sums] for r in found.filter("kind in (1, 2)").groupBy("kind").agg(*(F.sum(n).alias(n) for n in sums)).collect()}
    ends, types = (s.get(kind, [0.0] * len(names)) for kind in (1, 2))
    pieces = _pieces(model_path)
    counts = np.zeros((len(names), pieces.size))
    for r in found.filter("kind = 3").groupBy("h").agg(*(F.sum(n).alias(n) for n in sums)).collect():  # at most one row per piece of the vocabulary
        counts[:, r["h"]] = [r[n] for n in sums]
    by_n = [t[n] + e for n, e in zip(sums, ends, strict=True)]
    totals = {"n": sum(by_n), "by_n": by_n, "v": t["v"] + (sum(ends) > 0), "n1": t["ones"], "n2": t["twos"], "ends": ends}
    totals |= {"part": [parts[n] + (e / sum(ends) if sum(ends) else 0) for n, e in zip(sums, ends, strict=True)]}
    totals |= {"pieces_per_word": [float(own.sum()) / max(k, 1) for own, k in zip(counts, types, strict=True)]}
    weights = [normalised(pieces, 0.98 * own + 0.02 * counts.sum(0) / len(names)) for own in counts]
    schema = f"`{id_col}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    words_of = by_word.filter(c > 0).select("block", "h", *sums).repartition(min(blocks, 20_000), "block")
    return dealt.groupBy("block").cogroup(words_of.groupBy("block")).applyInArrow(_trimmed(_score_block(model_path, weights, totals, id_col, by_class)), schema)
