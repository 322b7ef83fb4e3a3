"""Source divergence audit: how far each source's use of words is from its language's other sources.

Integer-dictionary encoding. Documents are counted in tasks (occurrences and documents per language, source
and term), the counts summed by Spark. The terms that a language keeps (in at least `least_docs` of its
documents) are range-partitioned in order of their UTF-8 bytes and cut into dictionary chunks: a sorted array
of terms, whose places are their ids, found by searchsorted. One bincount per source turns a chunk's counts
into a dense vector, so a chunk is a small matrix (sources x terms) from which the smoothed shares, the
distances of every two sources and the terms that a source has in excess follow directly; ids are in byte
order, so ties go by id. No dictionary is ever whole in one place: a chunk holds at most `cells` numbers.

All arithmetic is exact: shares are integers per thousand million, by long division in 64 bits.

Edge cases: null text, lang or source count as ''; a source without terms still is a group, with count 0 of
each kept term; a language that keeps no term has distances of 0 and no term rows; a language with one source
has no pair rows; repeated rows count each; empty tables give no rows; texts of any length are read whole, a
megabyte at a time; columns other than the three are never read.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, prepare, release, written
from .workers import lean

#: A-Z lowered; letters and all bytes beyond ASCII kept; the rest is space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SLICE = 1 << 20
SCALE = 10**9
PRIOR = 5
OWNER = "divergence"


def terms_of(text: bytes, step: int = _SLICE):
    """Lists of the terms of a text, in order, about `step` bytes of it at a time."""
    lo = 0
    while lo < len(text):
        hi = min(len(text), lo + step)
        part = text[lo:hi].translate(_FOLD)
        while hi < len(text) and part[-1:] != b" ":  # a term goes on: to its end
            more = text[hi : hi + step].translate(_FOLD)
            cut = more.find(b" ")
            part, hi = (part + more, hi + len(more)) if cut < 0 else (part + more[: cut + 1], hi + cut + 1)
        yield part.split()
        lo = hi


def _count(most: int):
    """Documents (lang, source, text) to (lang, source, term, n, docs), summed over up to `most` entries."""

    def flush(uses, docs):
        for (lang, source), c in uses.items():
            d = docs[lang, source]
            k = len(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64()), pa.array([d[t] for t in c], pa.int64())], names=["lang", "source", "term", "n", "docs"]
            )

    def run(batches):
        uses, docs = defaultdict(Counter), defaultdict(Counter)
        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                seen = set()
                for terms in terms_of(text.as_py()):
                    uses[lang, source].update(terms)
                    seen.update(terms)
                if seen:
                    docs[lang, source].update(seen)
            if sum(map(len, uses.values())) > most:
                yield from flush(uses, docs)
                uses.clear()
                docs.clear()
        yield from flush(uses, docs)

    return run


def counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", most: int = 200_000) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each source of each language."""
    text_or = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    slim = docs.select(text_or(lang).alias("lang"), text_or(source).alias("source"), text_or(text).cast("binary").alias("text"))
    parts = slim.mapInArrow(lean(OWNER, _count(most)), "lang string, source string, term binary, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _encode(most_terms: int):
    """Kept counts in order of (lang, term) to chunks: their sorted terms, and a dense vector for each source."""

    def chunk(lang, terms, at, sources, n):
        dictionary = np.array(terms, object)
        ids = np.searchsorted(dictionary, np.array(at, object))
        names = sorted(set(sources), key=str.encode)
        of = {s: k for k, s in enumerate(names)}
        who, n, v = np.array([of[s] for s in sources]), np.array(n, np.int64), len(terms)
        rows = []
        for k in range(len(names)):
            # Two halves of 31 bits: bincount adds in doubles, which are exact up to 53 bits.
            mine = who == k
            hi, lo = (np.bincount(ids[mine], h[mine].astype(float), v).astype(np.int64) for h in (n >> 31, n & (2**31 - 1)))
            rows.append((hi << 31) + lo)
        return {"lang": lang, "terms": terms, "sources": names, "uses": [int(r.sum()) for r in rows], "vectors": np.concatenate(rows).tolist()}

    def run(batches):
        schema = pa.schema([("lang", pa.string()), ("terms", pa.list_(pa.binary())), ("sources", pa.list_(pa.string())), ("uses", pa.list_(pa.int64())), ("vectors", pa.list_(pa.int64()))])
        lang, terms, at, sources, n = None, [], [], [], []
        for b in batches:
            for g, t, s, m in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                if terms and (g != lang or t != terms[-1] and len(terms) == most_terms):
                    yield pa.RecordBatch.from_pylist([chunk(lang, terms, at, sources, n)], schema)
                    terms, at, sources, n = [], [], [], []
                if not terms or t != terms[-1]:
                    terms.append(t)
                lang = g
                at.append(t)
                sources.append(s)
                n.append(m)
        if terms:
            yield pa.RecordBatch.from_pylist([chunk(lang, terms, at, sources, n)], schema)

    return run


def shares(n: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * terms)), exact: three decimals of the quotient at a time."""
    d = total + PRIOR * terms
    if d >= 2**63 // 1000:
        raise OverflowError(f"{d} occurrences are beyond 64-bit division")
    q, r = np.divmod(n + PRIOR, d)
    for _ in range(3):
        q, r = q * 1000 + r * 1000 // d, r * 1000 % d
    return q + 1


def _compare(top: int):
    """Chunks with their language's groups to distances ('pair') and best terms ('term'), summed over a task's chunks of each language."""
    most_cells = 1 << 22

    def flush(lang, groups, far, best):
        out = [(s, "pair", o.encode(), int(far[i, j])) for i, (s, _) in enumerate(groups) for j, (o, _) in enumerate(groups) if i != j]
        out += [(s, "term", t, -v) for (s, _), own in zip(groups, best, strict=True) for v, t in sorted(own)[:top]]
        cols = list(zip(*out, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(out), pa.string()), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.int64())], names=["lang", "source", "part", "item", "value"])

    def run(batches):
        held = {}
        for b in batches:
            for c in b.to_pylist():
                if c["lang"] not in held:
                    if sum(far.size for _, far, _ in held.values()) > most_cells:
                        yield from (flush(lang, *found) for lang, found in held.items())
                        held.clear()
                    groups = sorted(((g["source"], g["uses"]) for g in c["groups"]), key=lambda g: g[0].encode())
                    held[c["lang"]] = groups, np.zeros((len(groups), len(groups)), np.int64), [[] for _ in groups]
                groups, far, best = held[c["lang"]]
                v, total = len(c["terms"]), c["total_terms"]
                there = dict(zip(c["sources"], np.array(c["vectors"], np.int64).reshape(-1, v), strict=True))
                none = np.zeros(v, np.int64)
                n = np.stack([there.get(s, none) for s, _ in groups])
                p = np.stack([shares(row, uses, total) for row, (_, uses) in zip(n, groups, strict=True)])
                q = shares(n.sum(0), sum(uses for _, uses in groups), total)
                for k in range(len(groups)):
                    gap = np.abs(p[k + 1 :] - p[k]).sum(1)
                    far[k, k + 1 :] += gap
                    far[k + 1 :, k] += gap
                    over = np.flatnonzero((n[k] > 0) & (p[k] > q))
                    over = over[np.lexsort((over, -(p[k] - q)[over]))[:top]]
                    best[k] = sorted(best[k] + [(-int(p[k][i] - q[i]), c["terms"][i]) for i in over])[:top]
        yield from (flush(lang, *found) for lang, found in held.items())

    return run


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 30, top: int = 50, cells: int = 1 << 21) -> DataFrame:
    """lang, source, part, item, value, rank: distances to the other sources ('pair'), terms in excess ('term', `top` of them).

    cells: sources times terms of a dictionary chunk.
    """
    spark = prepare(docs.sparkSession)
    release(spark, OWNER)
    text_or = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    found = docs.select(text_or(lang).alias("lang"), text_or(source).alias("source")).distinct()
    # A kept term's rows are one a source; the sum over its sources is its language's.
    per_term = counts(docs, text, lang, source).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("by"))
    kept = written(per_term.filter(F.col("docs") >= least_docs).select("lang", "term", F.explode("by").alias("s")).select("lang", "term", "s.source", "s.n"), OWNER)
    found = written(found, OWNER)
    widest = found.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    ordered = kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    most_terms = max(64, min(1 << 16, cells // widest))
    chunks = written(ordered.mapInArrow(lean(OWNER, _encode(most_terms)), "lang string, terms array<binary>, sources array<string>, uses array<long>, vectors array<long>"), OWNER)
    uses = chunks.select("lang", F.explode(F.arrays_zip("sources", "uses")).alias("s")).groupBy("lang", F.col("s.sources").alias("source")).agg(F.sum("s.uses").alias("uses"))
    sizes = chunks.groupBy("lang").agg(F.sum(F.size("terms")).alias("total_terms"))
    by_lang = found.join(uses, ["lang", "source"], "left").groupBy("lang").agg(F.collect_list(F.struct("source", F.coalesce("uses", F.lit(0)).alias("uses"))).alias("groups")).join(sizes, "lang")
    compared = chunks.join(bounded(by_lang, found.count()), "lang").mapInArrow(lean(OWNER, _compare(top)), "lang string, source string, part string, item binary, value long")
    bare = found.join(sizes, "lang", "left_anti")
    pairs = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").filter("source <> item")
    nothing = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("item").cast("binary").alias("item"), F.lit(0).cast("long").alias("value"))
    summed = compared.filter("part = 'pair'").unionByName(nothing).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = lambda df: df.select("lang", "source", "part", F.col("item").cast("string").alias("item"), "value", rank.alias("rank"))
    return ranked(summed).unionByName(ranked(compared.filter("part = 'term'")).filter(F.col("rank") <= top))
