"""N-gram Jaccard join by vertical partitioning.

Each text is the set of hashes of its n-word shingles; equal sets are one, known by a 64-bit digest.
Three exact steps lead to the pairs worth counting:

1. To link with anything, a set needs most of its shingles elsewhere, so in any part of it that is
   larger than the share it may miss, some must be shared. A sample of each set by hash shows which
   sets can link at all; only those go on, whole.
2. All shingles of these have one global order, rare before frequent: chunks of sets ask, by a shuffle
   of one row a shingle and chunk, how many sets have each of theirs. Sets that link share a shingle of their prefixes in that
   order (as many as a link can't all miss); a prefix shingle of a single set is of no use.
3. Sets that share a prefix shingle, directly or through others, are one cell.

Cells are then cut vertically: the shingles fall into fragments, ranges of their hash order, as many as
the cell is heavy, and one task has one fragment of a cell, or several cells that are light enough for
one. So each shingle moves once, however large its cell. A light cell's overlaps are whole in its task,
which gives a spanning forest of its links. The fragments of a heavy cell count the partial overlaps of
the pairs asked for, and these are summed per pair by a shuffle.

Pairs are asked for in two rounds. First each set with one other set of each of its prefix shingles
and sizes; what links becomes components, and a large group of close copies mostly one. Then all pairs
of sets that share a prefix shingle, are of similar size and not yet in one component: for each
shingle, the sets outside its most frequent component meet all. Which two sets link within a component
doesn't matter any more, so a group of m close copies costs about m pairs; sets that share prefixes but
don't link cost a row a pair, in heavy cells alone.

Edge cases: null text counts as empty; a text without words has an empty set and no link; with fewer
than n words the whole sequence is its only shingle. The result has one row for each row, repeated and
null ids included: rows are told apart by their texts, and a component without any id has none.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, keep_owners, prepare, release, written
from .components import components
from .textarrays import ascii_lower_points, code_points, mix, prefix_hash, span_hash, words
from .workers import lean, lean_group, slices

_M = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: list[str], n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (signed) of each text."""
    points, bounds = code_points(texts)
    points = ascii_lower_points(points)
    start, end, doc = words(points, bounds)
    h = span_hash(prefix_hash(points), start, end)
    cut = np.searchsorted(doc, np.arange(len(texts) + 1))
    size = np.diff(cut)
    short = (size > 0) & (size < n)
    if len(h) >= n:
        s = np.zeros(len(h) - n + 1, np.uint64)
        for i in range(n):
            s = mix(s * _M + h[i : len(h) - n + 1 + i])
        s = s.view(np.int64)
    else:
        s = np.zeros(0, np.int64)
    out = []
    for i in range(len(texts)):
        a, b = cut[i], cut[i + 1]
        if short[i]:
            x = np.zeros(1, np.uint64)
            for w in h[a:b]:
                x = mix(x * _M + w)
            out.append(x.view(np.int64) ^ np.int64(b - a))
        else:
            out.append(np.unique(s[a : b - n + 1]) if b - a >= n else np.zeros(0, np.int64))
    return out


def _digest(x: np.ndarray) -> int:
    if not len(x):
        return 0
    return int(mix(np.array([np.bitwise_xor.reduce(mix(x.view(np.uint64)))], np.uint64) + mix(np.array([len(x)], np.uint64))).view(np.int64)[0])


def _lists(arrays: list[np.ndarray], null: list[bool] | None = None) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    mask = pa.array(null, pa.bool_()) if null is not None else None
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64), pa.int64()), mask=mask)


def _arrays(col: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a list column, without Python objects."""
    sizes = np.concatenate([np.diff(c.offsets.to_numpy()) for c in col.chunks]) if col.num_chunks else np.zeros(0, np.int64)
    values = np.concatenate([c.flatten().to_numpy() for c in col.chunks]) if col.num_chunks else np.zeros(0, np.int64)
    return np.concatenate([[0], np.cumsum(sizes)]), values


#: Of a set's sample the share that any set it links with must have in its own: one in so many of the set.
MORE = 20


def sample_size(size: int, num: int, den: int) -> int:
    """How many of a set's smallest hashes are compared first: what it may miss and 1 / MORE of it, at least one."""
    return size * (den - num) // den + max(1, -(-size // MORE))


def _sets_pass(n: int, num: int, den: int, whole: bool, most: int = 1 << 20):
    """(id, key, text) to (id, key, size, digest, set or its smallest hashes); a set that the task has shown already is null."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for at, texts in slices(_joined_ids(batches), 1 << 19):
            sets = shingles(texts, n)
            digests = [_digest(x) for x in sets]
            some, null = [], []
            for d, x in zip(digests, sets, strict=True):
                null.append(d in seen or not len(x))
                if len(seen) < most:
                    seen.add(d)
                some.append(x[:0] if null[-1] else x if whole else x[: sample_size(len(x), num, den)])
            cols = [pa.array([r["id"] for r in at], pa.int64()), pa.array([r["key"] for r in at], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array(digests, pa.int64()), _lists(some, null)]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "key", "size", "digest", "set"])

    return run


_SETS = "id long, key long, size long, digest long, set array<long>"


def _joined_ids(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([b.column(0), b.column(1)], ["id", "key"]), b.column(2)], names=["at", "text"])


def _pack(t: pa.Table) -> pa.Table:
    """A chunk's sets in one row: digest and size of each, and their hashes end to end."""
    t = t.sort_by("digest")
    cut, hashes = _arrays(t["set"])
    cols = (t["digest"].to_numpy(), t["size"].to_numpy(), np.diff(cut), hashes)
    return pa.table({"chunk": t["chunk"][:1], **{c: _lists([x]) for c, x in zip(("digests", "sizes", "counts", "hashes"), cols, strict=True)}})


_PACKED = "chunk long, digests array<long>, sizes array<long>, counts array<long>, hashes array<long>"


def _packed(sets: DataFrame, chunks: int) -> DataFrame:
    """Distinct sets by chunk; copies go before the grouping, in a sort that may spill."""
    dealt = sets.filter(F.col("set").isNotNull()).select(F.pmod("digest", F.lit(chunks)).alias("chunk"), "digest", "size", "set").repartition(min(chunks, 20_000), "chunk")
    return dealt.dropDuplicates(["chunk", "digest"]).groupBy("chunk").applyInArrow(lean_group("ngram", _pack), _PACKED)


def _ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A chunk's distinct hashes, each with the chunk's number and how many of its sets have it (255: or more)."""
    for b in batches:
        for chunk, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            h, own = np.unique(x.values.to_numpy(), return_counts=True)
            for i in range(0, len(h), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(h[i : i + (1 << 18)], pa.int64()), pa.array(chunk << 8 | np.minimum(own[i : i + (1 << 18)], 255), pa.int64())], names=["h", "at"])


def _frequencies(t: pa.Table, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A packed chunk's digests, sizes, counts and hashes, and how many sets have each hash (1 where there is no answer)."""
    digests, sizes, counts, hashes = (t[c][0].values.to_numpy().astype(np.int64) for c in ("digests", "sizes", "counts", "hashes"))
    known, often = answers["h"].to_numpy(), answers["often"].to_numpy()
    if not len(known):
        return digests, sizes, counts, hashes, np.ones(len(hashes), np.int64)
    order = np.argsort(known, kind="stable")
    known, often = known[order], often[order]
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return digests, sizes, counts, hashes, np.where(known[at] == hashes, often[at], 1)


def _able(num: int, den: int):
    """Digests of sets that share enough of their sample to link with some other set."""

    def run(t: pa.Table, answers: pa.Table) -> pa.Table:
        digests, sizes, counts, _, often = _frequencies(t, answers)
        has = np.bincount(np.repeat(np.arange(len(digests)), counts), often > 1, len(digests))
        keep = has >= np.maximum(1, sizes * num // den // MORE)
        return pa.table({"digest": pa.array(digests[keep], pa.int64()), "size": pa.array(sizes[keep], pa.int64())})

    return run


def _prefixes(num: int, den: int):
    """Each set's first shingles in the global order (rare first, then by hash) that other sets have too, with their places."""

    def run(t: pa.Table, answers: pa.Table) -> pa.Table:
        digests, sizes, counts, hashes, often = _frequencies(t, answers)
        owner = np.repeat(np.arange(len(digests)), counts)
        order = np.lexsort((hashes, often, owner))
        place = np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts)
        pick = (place < (sizes * (den - num) // den + 1)[owner]) & (often[order] > 1)
        at = order[pick]
        cols = (hashes[at], digests[owner[at]], sizes[owner[at]], place[pick])
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("h", "d", "size", "place"), cols, strict=True)})

    return run


def _with_answers(packed: DataFrame, run, schema: str) -> DataFrame:
    """run(a chunk's sets, how often their shared hashes occur): one row a hash and chunk is shuffled, and back if it is shared."""
    asked = packed.select("chunk", "hashes").mapInArrow(lean("ngram", _ask), "h long, at long")
    total = F.sum(F.col("at").bitwiseAND(F.lit(255))).over(Window.partitionBy("h"))  # a hash has one row a chunk
    answers = asked.withColumn("often", total).filter("often > 1").select(F.shiftright("at", 8).alias("chunk"), "h", F.least("often", F.lit(255)).alias("often"))
    return packed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_two(run), schema)


def _segments(t: pa.Table, m: pa.Table) -> pa.Table:
    """A chunk's members cut into their cells' fragments."""
    out = []
    at, members = {}, m.to_pylist()
    for j in range(t.num_rows):
        row = [t[c][j].values.to_numpy().astype(np.int64) for c in ("digests", "counts", "hashes")]
        cut = np.concatenate([[0], np.cumsum(row[1])])
        at |= {d: row[2][a:b] for d, a, b in zip(row[0].tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True)}
    for x in members:
        h = at[x["d"]]  # sorted
        bounds = np.linspace(-(2.0**63), 2.0**63, x["fragments"] + 1)[1:-1].astype(np.int64)
        for f, part in enumerate(np.split(h, np.searchsorted(h, bounds))):
            if len(part):
                out.append((x["cell"], x["root"], f, x["d"], part))
    cols = list(zip(*out, strict=True)) or [()] * 5
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64())
    return pa.table([*(pa.array(c, k) for c, k in zip(cols, kinds, strict=False)), _lists(list(cols[4]))], names=["cell", "root", "f", "d", "part"])


def _forest(a: np.ndarray, b: np.ndarray, parent: list[int]) -> list[tuple[int, int]]:
    """Those of the edges that join two trees of the forest so far."""

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = top(x), top(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def overlaps(sets: list[np.ndarray], lo: int, hi: int, end: int, budget: int = 1 << 21) -> np.ndarray:
    """Overlaps of sets lo..hi with sets lo..end: shingle by shingle, the order cut into fragments of bounded work."""
    number = np.unique(np.concatenate(sets[lo:end]), return_inverse=True)[1]
    owner = np.repeat(np.arange(end - lo), [len(x) for x in sets[lo:end]])
    order = np.argsort(number, kind="stable")  # owners ascend within a shingle
    number, owner = number[order], owner[order]
    start = np.searchsorted(number, np.arange(int(number[-1]) + 2))
    left = np.flatnonzero(owner < hi - lo)  # each with all that have its shingle
    n = np.diff(start)[number[left]]
    left, n = left[n > 1], n[n > 1]
    total, work, at = np.zeros((hi - lo) * (end - lo), np.int64), np.cumsum(n), 0
    while at < len(left):
        to = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + budget)))
        m = n[at:to]
        right = np.repeat(start[number[left[at:to]]] - np.cumsum(m) + m, m) + np.arange(int(m.sum()))
        total += np.bincount(np.repeat(owner[left[at:to]], m) * (end - lo) + owner[right], minlength=len(total))
        at = to
    return total.reshape(hi - lo, end - lo)


def _light(num: int, den: int, cells: int = 1 << 21):
    """Cells that are in one fragment as a whole, to a spanning forest of each cell's links; a block of rows of the overlaps at a time."""

    def run(t: pa.Table) -> pa.Table:
        root, d, (cut, flat) = t["root"].to_numpy(), t["d"].to_numpy(), _arrays(t["part"])
        size = np.diff(cut)
        order = np.lexsort((d, size, root))
        edges = []
        for group in np.split(order, np.flatnonzero(np.diff(root[order])) + 1):
            sets, s = [flat[cut[i] : cut[i + 1]] for i in group], size[group]
            parent, lo = list(range(len(group))), 0
            while lo < len(group) - 1:
                hi = min(len(group), lo + max(1, cells // (len(group) - lo)))
                end = int(np.searchsorted(s, s[hi - 1] * den // num, "right"))  # larger ones can't link
                x, y = np.nonzero(overlaps(sets, lo, hi, end) * (num + den) >= num * (s[lo:hi, None] + s[None, lo:end]))
                edges += [(d[group[a]], d[group[b]]) for a, b in _forest(x[x < y] + lo, y[x < y] + lo, parent)]
                lo = hi
        return pa.table([pa.array([int(e[k]) for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _partial(t: pa.Table, pairs: pa.Table) -> pa.Table:
    """Partial overlaps of the pairs asked for in one fragment of a cell."""
    d, (cut, h) = t["d"].to_numpy(), _arrays(t["part"])
    order = np.argsort(d, kind="stable")
    known, size = d[order], np.diff(cut)
    a, b = pairs["a"].to_numpy(), pairs["b"].to_numpy()
    if not len(known) or not len(a):
        return pa.table([pa.array([], pa.int64())] * 3, names=["a", "b", "c"])
    find = lambda x: np.where(known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x, order[np.minimum(np.searchsorted(known, x), len(known) - 1)], -1)
    i, j = find(a), find(b)
    both = (i >= 0) & (j >= 0)  # else one has nothing in this fragment
    a, b, i, j = a[both], b[both], i[both], j[both]
    swap = size[i] > size[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    kinds, number = np.unique(h, return_inverse=True)
    times = np.bincount(number)
    keep = times[number] > 1
    flat, owner = number[keep], np.repeat(np.arange(len(size)), size)[keep]
    start = np.searchsorted(owner, np.arange(len(size) + 1))
    every = owner * len(kinds) + flat  # sorted: parts are, and owners ascend
    n, total = np.diff(start)[i], np.zeros(len(a), np.int64)
    work, lo = np.cumsum(n), 0
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(work, (work[lo - 1] if lo else 0) + (1 << 20))))
        m = n[lo:hi]
        pos = np.repeat(start[i[lo:hi]] - np.cumsum(m) + m, m) + np.arange(int(m.sum()))
        pair = np.repeat(np.arange(hi - lo), m)
        key = j[lo:hi][pair] * len(kinds) + flat[pos]
        at = np.minimum(np.searchsorted(every, key), max(len(every) - 1, 0))
        total[lo:hi] = np.bincount(pair, every[at] == key, hi - lo) if len(every) else 0
        lo = hi
    some = total > 0
    return pa.table([pa.array(x[some], pa.int64()) for x in (a, b, total)], names=["a", "b", "c"])


def groups_of(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100, chunk_bytes: int = 4 << 20, fragment: int = 1 << 20, owner: str = "ngram") -> tuple[DataFrame, DataFrame]:
    """(rows, groups): id, key (of the text), size, digest of each row; digest and root of each set that links, root being a digest."""
    spark = prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    raw = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    rows = written(raw.mapInArrow(lean("ngram", _sets_pass(n, num, den, False)), _SETS), owner)
    chunks = max(1, -(-int(rows.agg(F.sum(F.size("set"))).first()[0] or 0) * 8 // chunk_bytes))
    packed = written(_packed(rows, chunks), f"{owner}-some")
    able = written(_with_answers(packed, _able(num, den), "digest long, size long"), owner)
    release(spark, f"{owner}-some")
    total = able.agg(F.count("*").alias("n"), F.sum("size").alias("s")).first()
    keys = rows.groupBy("digest").agg(F.min("key").alias("_key")).join(able.select("digest"), "digest", "left_semi").select("_key")
    texts = raw.join(bounded(written(keys, owner), total["n"]), F.col("key") == F.col("_key"), "left_semi")
    chunks = max(1, -(-int(total["s"] or 0) * 8 // chunk_bytes))
    packed = written(_packed(texts.mapInArrow(lean("ngram", _sets_pass(n, num, den, True)), _SETS), chunks), owner)
    posts = written(_with_answers(packed, _prefixes(num, den), "h long, d long, size long, place long"), owner)
    # Cells: sets that share prefix shingles. An edge to the least set of each shingle tells.
    least = posts.groupBy("h").agg(F.min("d").alias("b"), F.max("d").alias("c")).filter("b <> c").select("h", "b")
    cells = written(components(posts.join(least, "h").select(F.col("d").alias("a"), "b"), owner), owner)
    sized = written(cells.join(posts.select("d", "size").distinct(), F.col("node") == F.col("d")).select("d", "size", F.col("root")), owner)
    weight = sized.groupBy("root").agg(F.sum("size").alias("w"))
    light = weight.filter(F.col("w") <= fragment).agg(F.sum("w").alias("w")).first()["w"] or 0
    bins = max(1, -(-int(light) // fragment))
    # A heavy cell has a number of its own and several fragments; light ones share a number and have one.
    small = F.col("w") <= fragment
    cell = F.when(small, -1 - F.pmod(F.xxhash64("root"), F.lit(bins))).otherwise(F.xxhash64("root").bitwiseAND(F.lit((1 << 62) - 1)))
    placed = sized.join(weight, "root").select("d", "size", "root", cell.alias("cell"), F.when(small, 1).otherwise(F.ceil(F.col("w") / fragment)).cast("int").alias("fragments"))
    placed = written(placed, owner)
    members = placed.select("cell", "root", "d", "fragments", F.pmod("d", F.lit(chunks)).alias("chunk"))
    parts = written(packed.groupBy("chunk").cogroup(members.groupBy("chunk")).applyInArrow(_two(_segments), "cell long, root long, f int, d long, part array<long>"), owner)
    links = written(parts.filter("cell < 0").groupBy("cell").applyInArrow(lean_group("ngram", _light(num, den)), "a long, b long"), owner)
    heavy = placed.filter("cell >= 0").select("d")
    if heavy.limit(1).count():
        links = links.unionByName(_heavy_links(placed, parts.filter("cell >= 0"), posts.join(heavy, "d", "left_semi"), num, den, owner))
    return rows.drop("set"), components(links, owner).select(F.col("node").alias("digest"), "root")


def _heavy_links(placed: DataFrame, parts: DataFrame, posts: DataFrame, num: int, den: int, owner: str) -> DataFrame:
    """Links (enough for the components) within cells of several fragments, by partial overlaps summed per pair."""

    def linked(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b, sa, sb) those that link."""
        at = placed.select(F.col("d").alias("a"), "cell", "fragments")
        asked = pairs.join(at, "a").select("a", "b", "cell", F.explode(F.sequence(F.lit(0), F.col("fragments") - 1)).alias("f"))
        partial = parts.groupBy("cell", "f").cogroup(asked.groupBy("cell", "f")).applyInArrow(_two(_partial), "a long, b long, c long")
        whole = partial.groupBy("a", "b").agg(F.sum("c").alias("c"))
        return written(whole.join(pairs, ["a", "b"]).filter(F.col("c") * (num + den) >= num * (F.col("sa") + F.col("sb"))).select("a", "b"), owner)

    def possible(a: str, b: str) -> Column:
        """Similar sizes, and after this shingle enough left for a link (of the first shared one in the order this holds)."""
        x, y = F.col(f"{a}.size"), F.col(f"{b}.size")
        left = F.least(x - F.col(f"{a}.place"), y - F.col(f"{b}.place"))
        return (F.least(x, y) * den >= F.greatest(x, y) * num) & (left * (num + den) >= num * (x + y))

    def pair(a: str, b: str) -> list[Column]:
        low = F.col(f"{a}.d") < F.col(f"{b}.d")
        pick = lambda c: (F.when(low, F.col(f"{a}.{c}")).otherwise(F.col(f"{b}.{c}")), F.when(low, F.col(f"{b}.{c}")).otherwise(F.col(f"{a}.{c}")))
        return [x.alias(name) for x, name in zip((*pick("d"), *pick("size")), ("a", "b", "sa", "sb"), strict=True)]

    step = math.log(den / num) / 2 if num < den else 1e-9
    banded = posts.withColumn("band", F.floor(F.log(F.col("size").cast("double")) / step))
    pivot = banded.groupBy("h", "band").agg(F.min(F.struct("d", "size", "place")).alias("p"))
    hubs = pivot.select("h", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"), "p.*")
    first = written(banded.alias("x").join(hubs.alias("y"), ["h", "band"]).filter((F.col("x.d") != F.col("y.d")) & possible("x", "y")).select(*pair("x", "y")).distinct(), owner)
    links = linked(first)
    joined = components(links, owner)
    comp = posts.join(joined, F.col("d") == F.col("node"), "left").select("h", "d", "size", "place", F.coalesce("root", "d").alias("comp"))
    shared = comp.groupBy("h", "comp").agg(F.count("*").alias("n")).groupBy("h").agg(F.max(F.struct("n", "comp")).alias("top"), F.count("*").alias("k")).filter("k > 1").select("h", F.col("top.comp").alias("main"))
    comp = written(comp.join(shared, "h"), owner)
    strays = comp.filter("comp <> main")
    both = (F.col("x.comp") != F.col("y.comp")) & ((F.col("y.comp") == F.col("y.main")) | (F.col("x.d") < F.col("y.d")))
    second = strays.alias("x").join(comp.alias("y"), "h").filter(both & possible("x", "y")).select(*pair("x", "y")).distinct()
    return links.unionByName(linked(written(second.join(first.select("a", "b"), ["a", "b"], "left_anti"), owner)))


def _two(run):
    def inner(t: pa.Table, m: pa.Table) -> pa.Table:
        return lean_group("ngram", lambda x: run(x, m))(t)

    return inner


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", owner: str = "ngram", **options) -> DataFrame:
    """id, n_shingles, component_id of each row; sets link at a Jaccard similarity of num / den or more."""
    rows, groups = groups_of(docs, id_col=id_col, owner=owner, **options)
    named = component_ids(rows, groups, owner)
    side = bounded(named.select("digest", F.col("low").alias("component_id")), named.count())
    out = F.when(F.col("component_id").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return rows.join(side, "digest", "left").select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), out.alias("component_id"))


def component_ids(rows: DataFrame, groups: DataFrame, owner: str) -> DataFrame:
    """digest, low (the smallest id of its component), rows and least-id rows of it, for components of several rows."""
    each = rows.filter("size > 0").groupBy("digest", "id").agg(F.count("*").alias("n")).groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "n")).alias("m"), F.sum("n").alias("n"))
    each = each.join(groups, "digest", "left").select("digest", F.coalesce("root", "digest").alias("root"), "m", "n")
    per = each.groupBy("root").agg(F.min(F.struct("m.none", "m.id")).alias("low"), F.sum("n").alias("rows")).filter("rows > 1")
    ties = each.join(per, "root").filter(F.col("m.id").eqNullSafe(F.col("low.id"))).groupBy("root").agg(F.sum("m.n").alias("ties"))
    return written(each.select("digest", "root").join(per, "root").join(ties, "root").select("digest", "root", F.col("low.id").alias("low"), "rows", "ties"), owner)


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner: str = "ngram", **options) -> DataFrame:
    """The rows of docs, all columns, but of each component only the one with the smallest id (of several such rows any one)."""
    rows, groups = groups_of(docs, id_col=id_col, text_col=text_col, owner=owner, **options)
    named = component_ids(rows, groups, owner)
    keys = rows.join(bounded(named, named.count()), "digest").select(F.col("key").alias("__tm_key"), F.col("root").alias("__tm_root"), F.col("low").alias("__tm_low"), F.col("ties").alias("__tm_ties"))
    return keep_owners(docs, keys.dropDuplicates(["__tm_key"]), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), id_col, owner)
