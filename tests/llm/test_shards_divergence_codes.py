"""Sharding, source divergence and vector codes against plain Python, with nulls, ties, repeats and empty tables."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import heap_lloyd, label_shards, source_divergence

DOCS = "doc_id long, text string, lang string, source string, row long, g string, n int, term string, at int, before int, value string, label int"


def corpus(seed: int, n: int) -> list[tuple]:
    r = random.Random(seed)
    words = "Alpha beta ALPHA über naïve x2y gamma-delta 語彙 o'mega".split()
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randrange(0, 30))), r.choice(["en", "de", None]), r.choice(["a", "b", "ä", "Z", None]), 1, "g", 1, "t", 1, 1, "v", 1) for i in range(n)]
    odd = [(None, None, None, None), (5, "", "en", "empty"), (5, "", "en", "empty"), (6, "rare words only here", "fr", "a"), (7, None, "fr", "b")]
    return rows + [(*o, *rows[0][4:]) for o in odd]


def audited(rows: list[tuple], least: int, top: int) -> list[tuple]:
    """The audit by counting in dictionaries."""
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        n[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, c in docs[lang].items() if c >= least]
        mine = [s for g, s in groups if g == lang]
        every = sum((n[lang, s] for s in mine), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for t in kept}
        p, q = {s: share(n[lang, s]) for s in mine}, share(every)
        for s in mine:
            far = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in mine if o != s)
            out += [(lang, s, "pair", o.decode(), -v, k + 1) for k, (v, o) in enumerate(far)]
            over = sorted((q[t] - p[s][t], t.encode()) for t in kept if n[lang, s][t] and p[s][t] > q[t])
            out += [(lang, s, "term", t.decode(), -v, k + 1) for k, (v, t) in enumerate(over[:top])]
    return sorted(out)


@pytest.mark.parametrize("cells", [1 << 21, 1])
def test_divergence_is_that_of_plain_counting(spark, cells):
    rows = corpus(1, 200)
    out = source_divergence.audit(spark.createDataFrame(rows, DOCS), least_docs=20, top=3, cells=cells)
    assert sorted(map(tuple, out.collect())) == audited(rows, 20, 3)


def test_divergence_over_several_chunks_and_none(spark):
    rows = [(i, " ".join(f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(i % 3, 150)), "en", f"s{i % 3}", *corpus(1, 1)[0][4:]) for i in range(60)]
    out = source_divergence.audit(spark.createDataFrame(rows, DOCS), cells=1)  # chunks of 64 terms
    assert sorted(map(tuple, out.collect())) == audited(rows, 30, 50)
    assert source_divergence.audit(spark.createDataFrame([], DOCS)).count() == 0
    bare = source_divergence.audit(spark.createDataFrame(rows[:5], DOCS))  # too few documents for any term
    assert sorted(map(tuple, bare.collect())) == audited(rows[:5], 30, 50) and bare.count() == 6


def test_terms_are_the_same_in_slices():
    text = ("Ünder_score ABC123def " * 5 + "x" * 90 + " é").encode()
    want = re.findall(rb"[a-z\x80-\xff]+", text.lower())
    for step in (1, 7, 64, 1 << 20):
        assert [t for part in source_divergence.terms_of(text, step) for t in part] == want
    big = source_divergence.shares(np.array([0, 7, 10**13]), 9 * 10**15 - 5, 1)
    assert big.tolist() == [1 + 10**9 * (c + 5) // (9 * 10**15) for c in (0, 7, 10**13)]
    with pytest.raises(OverflowError):
        source_divergence.shares(np.array([1]), 2**63 // 1000, 1)


def lloyd(x: np.ndarray, parts: int, entries: int, rounds: int):
    """Plain rounds, every part against every entry."""
    w = x.shape[1] // parts
    codes, error, books = [], 0, []
    for p in range(parts):
        y = x[:, p * w : (p + 1) * w]
        book = y[:entries].copy()
        for k in range(rounds + 1):
            d = ((y[:, None] - book[None]) ** 2).sum(2)
            a = d.argmin(1)
            if k < rounds:
                book = np.array([y[a == j].sum(0) // (a == j).sum() if (a == j).any() else book[j] for j in range(len(book))])
        codes.append(a)
        error = error + d.min(1)
        books.append(book)
    return np.array(codes).T, error, np.array(books)


VECTORS = "vec_id long, embedding array<float>, label int, ids string, x string, codes int, at int"


def test_codes_are_those_of_plain_lloyd(spark):
    rng = np.random.default_rng(3)
    x = np.float32(np.round(rng.standard_normal((900, 16)), 2))
    x[300:400] = x[5]  # copies: their entries tie
    x[400:420] = -0.001
    rows = [(i, v.tolist(), int(i % 4) if i % 5 else None, "i", "x", 1, 1) for i, v in enumerate(x)]
    odd = [(-1, None, 1), (-2, [], 1), (-3, [1.0] * 15 + [None], 1), (-4, [1.0] * 15 + [float("nan")], 2), (-5, [float("inf")] * 16, 2), (-6, [1.0] * 32, 2)]
    df = spark.createDataFrame([(*o, "i", "x", 1, 1) for o in odd] + rows[::-1], VECTORS).repartition(5)
    coded, books, scanned = heap_lloyd.fit_encode(df, parts=4, entries=20, rounds=3, block=100)
    want, error, want_books = lloyd(np.floor(256 * x.astype(float)).astype(np.int64), 4, 20, 3)
    got = {r.vec_id: r for r in coded.collect()}
    assert (books == want_books).all() and set(got) == set(range(900))
    assert all(got[i].code == bytes(want[i].tolist()).hex() and got[i].error == error[i] for i in range(900))
    assert scanned[0] == 3600 and scanned[2] < scanned[1] < 3600  # the heaps spare parts, the more the less entries move
    out = heap_lloyd.encode(df, parts=4, entries=20, rounds=3, block=100).collect()
    sums = Counter()
    for i, r in enumerate(rows):
        sums[r[2]] += int(error[i])
    assert len(out) == 900 and all(r.label_error == sums[rows[r.vec_id][2]] for r in out)
    assert {r.codebooks_sha256 for r in out} == {heap_lloyd.digest(want_books)}


def test_codes_of_few_repeated_and_no_vectors(spark):
    few = spark.createDataFrame([(1, [0.5] * 16, None, "i", "x", 1, 1), (1, [0.25] * 16, None, "i", "x", 1, 1), (None, [-0.5] * 16, None, "i", "x", 1, 1)], VECTORS)
    out = heap_lloyd.encode(few).orderBy("code").collect()
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in out] == [(1, "00" * 16, 0, 0), (1, "01" * 16, 0, 0), (None, "02" * 16, 0, 0)]
    assert heap_lloyd.encode(few.limit(0)).count() == 0
    one = heap_lloyd.encode(few.filter("vec_id is null").union(few.filter("vec_id is null"))).collect()
    assert [(r.code, r.error) for r in one] == [("00" * 16, 0), ("01" * 16, 0)] or [(r.code, r.error) for r in one] == [("00" * 16, 0)] * 2
    with pytest.raises(ValueError):
        heap_lloyd.encode(spark.createDataFrame([(1, [1.0] * 15, 1, "i", "x", 1, 1)], VECTORS))
    with pytest.raises(Exception, match="2\\^17"):
        heap_lloyd.encode(spark.createDataFrame([(1, [2.0e5] * 16, 1, "i", "x", 1, 1)], VECTORS)).collect()


def placed(rows, out, shards):
    """The shards' row counts, after what holds for every result was checked."""
    want = sorted((r[0] is None, r[0] or 0, len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"], r.text_crc32) for r in out) == want
    at = defaultdict(list)
    for r in out:
        at[r.shard].append(r.slot)
    assert set(at) <= set(range(shards)) and all(sorted(s) == list(range(len(s))) for s in at.values())
    n = [len(at[k]) for k in range(shards)]
    assert max(n) - min(n) <= 1
    here = Counter((r.shard, r.text_crc32) for r in out)
    assert all(r.mates == here[r.shard, r.text_crc32] - 1 for r in out)
    assert all(r.group_size == c for c, r in ((Counter(r.text_crc32 for r in out)[r.text_crc32], r) for r in out))
    return n


def test_shards_hold_copies_together(spark):
    r = random.Random(5)
    base = corpus(2, 1)[0]
    texts = ["hot"] * 200 + [f"pair {k // 2}" for k in range(120)] + [f"three {k // 3}" for k in range(90)] + [f"alone {k}" for k in range(150)] + [None, "", ""]
    r.shuffle(texts)
    rows = [(None if i % 50 == 7 else i // 2, t, *base[2:]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    out = label_shards.shard(docs, 8).collect()
    placed(rows, out, 8)
    small = [x for x in out if 1 < x.group_size < 10]
    assert sum(x.mates for x in small) >= 0.98 * sum(x.group_size - 1 for x in small)
    hot = Counter(x.shard for x in out if x.group_size == 200)
    assert sum(sorted(hot.values())[-3:]) >= 150  # 71 rows a shard: three at least
    full = [(i, f"t{i // 4}", *base[2:]) for i in range(96)]  # no row without links: every move needs one back
    out = label_shards.shard(spark.createDataFrame(full, DOCS), 8).collect()
    placed(full, out, 8)
    assert sum(x.mates for x in out) >= 0.6 * 96 * 3
    assert label_shards.shard(docs.limit(0)).count() == 0
    placed(rows[:3], label_shards.shard(spark.createDataFrame(rows[:3], DOCS), 8).collect(), 8)


def test_links_between_texts_pull_them_together(spark):
    base = corpus(2, 1)[0]
    rows = [(i, f"text {i}", *base[2:]) for i in range(400)]
    links = [(i, i // 5 * 5) for i in range(200)] + [(3, 99999), (None, 1)]  # stars of five
    docs = spark.createDataFrame(rows, DOCS)
    out = label_shards.shard(docs, 8, spark.createDataFrame(links, "a long, b long"), rounds=10).collect()
    placed(rows, out, 8)
    shard = {x.doc_id: x.shard for x in out}
    cut = sum(shard[a] != shard[b] for a, b in links[:200])
    assert cut <= 40  # of 160 links; seven in eight would be cut by chance


def test_grants_keep_quotas():
    wanted = {(0, 1): 5, (1, 0): 3, (2, 1): 4, (0, 2): 1}
    may = label_shards.grants(wanted, [0, 2, 0])
    assert may[1, 0] == 3 and may[0, 1] >= 3 and may[0, 1] + may[2, 1] - 3 <= 2 and may[0, 2] == 0
