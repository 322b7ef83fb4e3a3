"""Exact duplicates by Patricia-trie owners.

Texts go to partitions by length and content hash. In a partition, whole byte strings are inserted
into a compressed radix trie; the terminal node of a string holds its owner (the smallest or largest
identifier) and how many rows share it. Equality is thus decided on the full bytes, never by hash.
Each input partition first builds such tries of its own, so a text shuffles at most once for each
input task, however many copies it has. A trie that outgrows its limit spills its largest subtree to
an unnamed scratch file of the task and works it off afterwards.

Edge cases: null text counts as empty, empty texts equal one another; a null id owns a text only where no
row with an id has it; rows with equal ids and equal texts count separately in the group size, label_copies
calls each of them kept, and drop_copies keeps one of them; rows with equal ids and other texts are other
groups; columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, keep_owners, prepare
from .workers import lean

#: identifier, rows, rows with that identifier
Owner = tuple[int, int, int]


class PatriciaTrie:
    """A compressed radix trie over byte strings that all start with `prefix`, with spill by subtree.

    A node is [label, children by first byte or None, owner or None]. Results come from drain(),
    which also works off what was spilled.
    """

    def __init__(self, limit_bytes: int = 96 << 20, keep=min, prefix: bytes = b""):
        self.root: list = [b"", None, None]
        self.held, self.limit, self.keep, self.prefix = 0, limit_bytes, keep, prefix
        self.spilled: dict[int, tempfile.TemporaryFile] = {}

    def insert(self, key: bytes, owner: Owner) -> None:
        node, at = self.root, len(self.prefix)
        if self.spilled and len(key) > at and (f := self.spilled.get(key[at])):
            self._append(f, key, owner)
            return
        while True:
            if at == len(key):
                old = node[2]
                node[2] = owner if old is None else self._both(old, owner)
                return
            kids = node[1]
            if kids is None:
                kids = node[1] = {}
            child = kids.get(key[at])
            if child is None:
                kids[key[at]] = [key[at:], None, owner]
                self.held += len(key) - at + 200
                break
            label = child[0]
            if not key.startswith(label, at):
                same = _common(label, key, at)
                top = [label[:same], {label[same]: child}, None]
                child[0] = label[same:]
                kids[key[at]] = child = top
                self.held += 200
                label = top[0]
            node, at = child, at + len(label)
        if self.held > self.limit:
            self._spill()

    def _both(self, a: Owner, b: Owner) -> Owner:
        first = self.keep(a[0], b[0])
        return first, a[1] + b[1], sum(x[2] for x in (a, b) if x[0] == first)

    @staticmethod
    def _append(f, key: bytes, owner: Owner) -> None:
        f.write(struct.pack("<qqqq", len(key), *owner))
        f.write(key)

    @staticmethod
    def _read(f) -> Iterator[tuple[bytes, Owner]]:
        f.seek(0)
        while head := f.read(32):
            n, *owner = struct.unpack("<qqqq", head)
            yield f.read(n), tuple(owner)

    @staticmethod
    def _walk(node: list, path: bytes) -> Iterator[tuple[bytes, Owner]]:
        stack = [(node, path)]
        while stack:
            n, p = stack.pop()
            if n[2] is not None:
                yield p, n[2]
            if n[1]:
                stack += [(c, p + c[0]) for c in n[1].values()]

    @staticmethod
    def _weight(node: list) -> int:
        total, stack = 0, [node]
        while stack:
            n = stack.pop()
            total += len(n[0]) + 200
            stack += (n[1] or {}).values()
        return total

    def _spill(self) -> None:
        kids = self.root[1]
        first, weight = max(((b, self._weight(n)) for b, n in kids.items()), key=lambda x: x[1])
        child = kids.pop(first)
        f = self.spilled[first] = tempfile.TemporaryFile()
        for key, owner in self._walk(child, self.prefix + child[0]):
            self._append(f, key, owner)
        self.held -= weight

    def drain(self) -> Iterator[tuple[bytes, Owner]]:
        yield from self._walk(self.root, self.prefix)
        self.root, self.held = [b"", None, None], 0
        while self.spilled:
            _, f = self.spilled.popitem()
            shared = None
            for key, _ in self._read(f):
                shared = key if shared is None else shared[: _common(shared, key, 0)]
            # Below what all its keys share the file's trie branches, so that each spill is of a part.
            sub = PatriciaTrie(self.limit, self.keep, shared)
            for key, owner in self._read(f):
                sub.insert(key, owner)
            f.close()
            yield from sub.drain()


def _common(label: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of label and key[at:], by halving."""
    lo, hi = 0, min(len(label), len(key) - at)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if label[lo:mid] == key[at + lo : at + mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _trie_pass(keep, limit: int, final: bool):
    """Arrow batches of (text, id, rows, ties) to unique ones; the last pass leaves out the texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(limit, keep)
        for b in batches:
            for text, *held in zip(b.column(0), *(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                trie.insert(text.as_py(), tuple(held))
        out, size = [], 0
        for text, held in trie.drain():
            out.append((None if final else text, *held, len(text), hashlib.sha256(text).hexdigest()))
            size += 200 if final else len(text) + 200
            if size > 8 << 20:
                yield _batch(out, final)
                out, size = [], 0
        if out:
            yield _batch(out, final)

    return run


def _batch(rows: list, final: bool) -> pa.RecordBatch:
    text, *counts, sha = zip(*rows, strict=True)
    cols = [*(pa.array(x, pa.int64()) for x in counts), pa.array(sha, pa.string())]
    names = ["id", "rows", "ties", "n_bytes", "sha"]
    return pa.RecordBatch.from_arrays(cols if final else [pa.array(text, pa.binary()), *cols], names=names if final else ["text", *names])


def owners(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", trie_bytes: int = 96 << 20) -> DataFrame:
    """One row for each distinct normalised text (A-Z lowered): sha, n_bytes, id (its owner), rows, ties (rows with that id)."""
    prepare(docs.sparkSession)
    pick = {"min": min, "max": max}[keep]
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).cast("binary")
    last = (1 << 63) - 1 if keep == "min" else -(1 << 63)  # stands for a null id
    base = docs.select(text.alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(last)).alias("id"), F.lit(1).cast("long").alias("rows"), F.lit(1).cast("long").alias("ties"))
    local = base.mapInArrow(lean("exact", _trie_pass(pick, trie_bytes, False)), "text binary, id long, rows long, ties long, n_bytes long, sha string")
    dealt = local.repartition(F.col("n_bytes"), F.col("sha")).select("text", "id", "rows", "ties")
    return dealt.mapInArrow(lean("exact", _trie_pass(pick, trie_bytes, True)), "id long, rows long, ties long, n_bytes long, sha string").withColumn("id", F.nullif(F.col("id"), F.lit(last)))


def label_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """Each row's id with keep_id, group_size, kept and text_sha256 (of the normalised UTF-8 text).

    Groups of one are not joined: a row without a group is its own owner.
    """
    groups = owners(docs, id_col=id_col, text_col=text_col, keep=keep).filter("rows > 1").select(F.col("sha").alias("text_sha256"), F.col("id").alias("_owner"), F.col("rows").alias("_rows"))
    rows = docs.select(F.col(id_col), F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).cast("binary"), 256).alias("text_sha256"))
    owner = F.when(F.col("_rows").isNull(), F.col(id_col)).otherwise(F.col("_owner"))
    return rows.join(groups, "text_sha256", "left").select(
        id_col, owner.alias("keep_id"), F.coalesce(F.col("_rows"), F.lit(1)).cast("long").alias("group_size"), owner.eqNullSafe(F.col(id_col)).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", owner: str = "exact") -> DataFrame:
    """The rows of docs, all columns, but of equal texts only the one that owns them (of several such rows any one)."""
    groups = owners(docs, id_col=id_col, text_col=text_col, keep=keep).filter("rows > 1")
    named = groups.select(F.col("sha").alias("__tm_key"), F.col("sha").alias("__tm_root"), F.col("id").alias("__tm_low"), F.col("ties").alias("__tm_ties"))
    sha = F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).cast("binary"), 256)
    return keep_owners(docs, named, sha, id_col, owner)
