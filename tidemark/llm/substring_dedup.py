"""Removal of repeated substrings: every byte covered by a string of `length` bytes that also starts elsewhere.

The suffixes are dealt into shards by content. Each string of `length` bytes has an anchor: its
smallest k-gram by hash (the leftmost of equals), so equal strings have equal anchors and meet in
one shard. Neighbouring strings of a text that share an anchor form one block. Blocks whose anchor
occurs once in the corpus hold no repeat. Blocks that are equal as a whole are one with a count; an
anchor whose blocks are all equal needs no comparison. The distinct blocks of the other anchors are
sorted by suffix in their shard, by external induced sorting (induced_sort.py), and neighbours with
a common prefix of `length` or more are repeats. All counts combine before they shuffle, so a
passage in a third of all texts is a few rows for each task.

Where asked for, runs of `words` words that also start elsewhere go too, whatever white space is between
their words. They are found in the same way, over the words' hashes in place of bytes; as those are names
already, a shard's blocks are sorted by prefix doubling alone.

Edge cases: null text counts as empty; texts shorter than `length` keep all bytes; rows with equal
ids are told apart by their texts, and repeated rows are copies of each other. Long texts are read
in slices, so memory goes by the slice; matches never cross rows. Where a cut text is needed, it
keeps each character that has a kept byte.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, release, written
from .induced_sort import repeated_names, repeated_starts
from .textarrays import mix, prefix_hash, span_hash, words
from .workers import lean

_PLACE = np.uint64((1 << 24) - 1)
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours, by block-wise prefix and suffix minima."""
    n = len(x) - w + 1
    padded = np.concatenate([x, np.full(-len(x) % w, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def blocks(values: np.ndarray, bounds: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(row, start, strings, offset of the anchor, anchor hash, block hash) of each block of some texts in one array of bytes."""
    none = (np.zeros(0, np.int64),) * 6
    if len(values) < length:
        return none
    prefix = prefix_hash(values)
    at = np.arange(len(values) - k + 1)
    gram = span_hash(prefix, at, at + k)
    key = (mix(gram) & ~_PLACE) | at.astype(np.uint64)
    anchor = (sliding_least(key, length - k + 1) & _PLACE).astype(np.int64)
    start = np.arange(len(anchor))
    row = np.searchsorted(bounds, start, "right") - 1
    whole = start + length <= bounds[row + 1]
    start, anchor, row = start[whole], anchor[whole], row[whole]
    if not len(start):
        return none
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]))
    count = np.diff(np.append(first, len(start)))
    s, p, r = start[first], anchor[first], row[first]
    body = span_hash(prefix, s, s + count + length - 1) ^ mix((p - s).astype(np.uint64))
    return r, s, count, p - s, gram[p].view(np.int64), body.view(np.int64)


def _slices(texts: list[bytes], length: int, size: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, bounds, text numbers, places of the pieces): whole short texts together, long ones in overlapping pieces."""
    parts: list[tuple[int, int, bytes]] = []
    held = 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), size):
            piece = t[at : at + size + length - 1]
            parts.append((i, at, piece))
            held += len(piece)
            if held >= size:
                yield _joined(parts)
                parts, held = [], 0
    if parts:
        yield _joined(parts)


def _joined(parts: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sizes = [len(b) for _, _, b in parts]
    return np.frombuffer(b"".join(b for _, _, b in parts), np.uint8), np.concatenate([[0], np.cumsum(sizes)]), np.array([i for i, _, _ in parts]), np.array([a for _, a, _ in parts])


def word_places(texts: list[bytes], size: int = 1 << 19) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, hash, start, end, bounds) of the words of some whole texts; start and end in their text, bounds in words."""
    at = 0
    while at < len(texts):
        to, held = at, 0
        while to < len(texts) and (to == at or held + len(texts[to]) <= size):
            held += len(texts[to])
            to += 1
        found, cut = [], 0
        if to - at > 1 or held <= size:
            values, bounds = np.frombuffer(b"".join(texts[at:to]), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts[at:to]])])
            start, end, number = words(values, bounds)
            found.append((span_hash(prefix_hash(values), start, end), start - bounds[number], end - bounds[number]))
            count = np.bincount(number, minlength=to - at)
        else:  # a long text, between white space
            while cut < held:
                space = _SPACE.search(texts[at], cut + size)
                stop = space.start() if space else held
                values = np.frombuffer(texts[at][cut:stop], np.uint8)
                start, end, _ = words(values, np.array([0, len(values)]))
                found.append((span_hash(prefix_hash(values), start, end), start + cut, end + cut))
                cut = stop
            count = [sum(len(h) for h, _, _ in found)]
        h, start, end = (np.concatenate(x) for x in zip(*found, strict=True))
        yield at, h, start, end, np.concatenate([[0], np.cumsum(count)])
        at = to


def _word_slices(texts: list[bytes], length: int, size: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """As _slices, of words."""
    for first, h, _, _, bounds in word_places(texts):
        if len(bounds) > 2:
            yield h, bounds, np.arange(first, first + len(bounds) - 1), np.zeros(len(bounds) - 1, np.int64)
            continue
        for at in range(0, max(1, len(h) - length + 1), size):
            piece = h[at : at + size + length - 1]
            yield piece, np.array([0, len(piece)]), np.array([first]), np.array([at])


def _anchor_pass(length: int, k: int, slices: Callable):
    names = ["anchor", "block", "row", "start", "strings"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(0).to_numpy()
            for values, bounds, number, place in slices([x.as_py() for x in b.column(1)], length):
                r, s, count, _, anchor, body = blocks(values, bounds, length, k)
                if len(r):
                    cols = (anchor, body, rows[number[r]], s - bounds[r] + place[r], count)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    return run


def _merge_spans(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return b"".join(kept)


def _whole_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans drawn in to whole characters."""
    out = []
    for a, b in spans:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if b > a:
            out.append((a, b))
    return out


_DONE = "row long, id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"


def _in_bytes(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as spans of bytes."""
    if not runs:
        return []
    _, _, start, end, _ = next(word_places([text]))
    return [(int(start[a]), int(end[b - 1])) for a, b in runs]


def _finished(rows: list[tuple], with_text: bool) -> pa.RecordBatch:
    """rows: (row, id, text, spans)"""
    out = []
    for row, ident, text, spans in rows:
        merged = _merge_spans(spans)
        kept = _cut(text, _whole_characters(text, merged)).decode("utf-8", "ignore") if with_text else None
        out.append((row, ident, len(text), sum(b - a for a, b in merged), len(merged), hashlib.sha256(_cut(text, merged)).hexdigest(), kept))
    cols = list(zip(*out, strict=True)) or [()] * 7
    kinds = [pa.int64()] * 5 + [pa.string()] * 2
    names = ["row", "id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)


def _payloads(length: int, worded: bool):
    """Each open block's bytes (of its words' hashes, if worded), once a task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in batches:
            out = []
            for text, found in zip(b.column("text").to_pylist(), b.column("found").to_pylist(), strict=True):
                if worded:
                    text = next(word_places([text]))[1]
                for x in found:
                    key = (x["anchor"], x["block"])
                    if key not in seen:
                        if len(seen) < 2_000_000:
                            seen.add(key)
                        out.append((*key, bytes(text[x["start"] : x["start"] + x["strings"] + length - 1])))
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], names=["anchor", "block", "payload"])

    return run


def _sort_shard(length: int, memory: int, worded: bool, part: int = 3 << 17):
    """A shard's distinct blocks to the runs of their repeated strings."""
    span = pa.struct([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], bytes] = {}
        for b in batches:
            found.update(zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True), b.column(2).to_pylist(), strict=True))
        if not found:
            return
        order, at = sorted(found), 0
        while at < len(order):
            # Strings of different anchors never meet, so anchors are sorted some 400 kB at a time, whole ones always.
            size, to = 0, at
            while to < len(order) and (size < part or order[to][0] == order[to - 1][0]):
                size += len(found[order[to]])
                to += 1
            keys, runs = [], []
            held = [found.pop(k) for k in order[at:to]]
            hits = repeated_names([np.frombuffer(x, np.uint64) for x in held], length) if worded else repeated_starts(held, length, memory)
            for key, hit in zip(order[at:to], hits, strict=True):
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
                if len(edge):
                    keys.append(key)
                    runs.append([{"a": int(a), "b": int(c) + length - 1} for a, c in edge.reshape(-1, 2)])
            cols = list(zip(*keys, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(runs, pa.list_(span))], names=["anchor", "block", "runs"])
            at = to

    return run


def _repeat_spans(base: DataFrame, length: int, k: int, sort_memory: int, owner: str, worded: bool = False) -> DataFrame:
    """row, s: the spans of strings of `length` bytes (words) that also start elsewhere."""
    least_bytes, slices = (2 * length - 1, _word_slices) if worded else (length, _slices)
    each = written(base.filter(F.octet_length("text") >= least_bytes).select("row", "text").mapInArrow(lean("repeats", _anchor_pass(length, k, slices)), "anchor long, block long, row long, start long, strings long"), f"{owner}-blocks")
    again = each.groupBy("anchor").agg(F.count("*").alias("n"), F.min("block").alias("lo"), F.max("block").alias("hi")).filter("n > 1").select("anchor", "n", (F.col("lo") != F.col("hi")).alias("mixed"))
    # An anchor of a passage in very many texts would be one task's; at most 2,000 anchors have a 2,000th of all blocks.
    least = -(-each.count() // 2000)
    hot = F.broadcast(again.filter(F.col("n") >= max(least, 100)).drop("n"))
    cold = each.join(hot, "anchor", "left_anti").join(again.filter(F.col("n") < max(least, 100)).drop("n"), "anchor")
    hits = written(each.join(hot, "anchor").unionByName(cold).withColumnRenamed("mixed", "open"), owner)
    release(base.sparkSession, f"{owner}-blocks")
    # Whole blocks that occur more than once, counted where they are; then the shards' own comparisons.
    open_ = hits.filter("open")
    whole = open_.groupBy("anchor", "block").agg(F.count("*").alias("n")).filter("n > 1")
    wanted = open_.groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.struct("anchor", "block", "start", "strings")).alias("found"))  # a text's own blocks
    # All joins of the texts take the same columns, so that one shuffle of them serves all.
    payloads = base.join(wanted, base["row"] == wanted["_row"]).select("row", "id", "text", "found").mapInArrow(lean("repeats", _payloads(length, worded)), "anchor long, block long, payload binary")
    runs = payloads.repartition("anchor").mapInArrow(lean("repeats", _sort_shard(length, sort_memory, worded)), "anchor long, block long, runs array<struct<a:long,b:long>>")
    judged = whole.withColumnRenamed("n", "_n").join(runs, ["anchor", "block"], "full")
    whole_span = F.array(F.struct(F.lit(0).cast("long").alias("a"), (F.col("strings") + length - 1).alias("b")))
    span = F.when(F.col("_n") > 1, whole_span).otherwise(F.col("runs"))
    moved = F.transform(span, lambda s: F.struct((s["a"] + F.col("start")).alias("a"), (s["b"] + F.col("start")).alias("b")))
    judged = open_.join(judged, ["anchor", "block"]).select("row", moved.alias("s"))
    settled = hits.filter("not open").select("row", F.array(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("strings") + length - 1).alias("b"))).alias("s"))
    return settled.unionByName(judged)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 400, k: int | None = None, words: int | None = None, with_text: bool = False, sort_memory: int = 256 << 20, owner: str = "repeats") -> DataFrame:
    """row (a hash of id and text), id, n_bytes, n_removed, n_spans, kept_sha256, kept_text (null unless with_text) of each row.

    words: runs of so many words that also start elsewhere are removed too.
    """
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    ident = F.col(id_col).cast("long")
    base = docs.select(F.xxhash64(ident, text).alias("row"), ident.alias("id"), text.cast("binary").alias("text"))
    each = _repeat_spans(base, length, k or length // 2, sort_memory, owner)
    names = ["s"]
    if words:
        each = each.unionByName(_repeat_spans(base, words, max(1, words // 2), sort_memory, owner, True).withColumnRenamed("s", "w"), allowMissingColumns=True)
        names.append("w")
    spans = each.groupBy(F.col("row").alias("_row")).agg(*(F.flatten(F.collect_list(c)).alias(c) for c in names))

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(c.to_pylist() for c in b.columns), strict=True)
            pairs = lambda spans: [(x["a"], x["b"]) for x in spans or []]
            yield _finished([(row, i, t, pairs(s) + _in_bytes(t, pairs(w[0]) if w else [])) for row, i, t, s, *w in rows], with_text)

    return base.join(spans, base["row"] == spans["_row"], "left").select("row", "id", "text", *names).mapInArrow(lean("repeats", finish), _DONE)
