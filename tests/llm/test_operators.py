"""Each operator on small tables: brute force, round trips, and rows with nulls, repeats, ties and clashing names."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import adaptive_scan, common, exact_dedup, harmonic_packing, induced_sort, lattice, lattice_lm, ngram_join, piece_sampling, substring_dedup, toxicity, url_reputation, wrapper_induction
from tidemark.llm.queries import RULES, tokenizer_path

PIECES, WORDS = tokenizer_path("piece_bpe_32k.model"), tokenizer_path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, _gone int, row string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice("alpha beta gamma delta über naïve kappa lambda sigma omega".split()) + str(r.randrange(40)) for _ in range(n))


def odd_docs(spark):
    base = prose(1, 150)
    near = base.split()
    near[70] = "changed"
    rows = [(1, base), (2, base.upper()), (3, " ".join(near)), (4, None), (5, ""), (6, "x"), (6, "x"), (7, prose(2, 300)), (8, "▁  two\n\nspaces \U0001f600"), (None, "no id"), (9, "y" * 5000)]
    return spark.createDataFrame([(i, t, "en", 1, "r") for i, t in rows], DOCS), rows


def test_exact_dedup(spark):
    docs, rows = odd_docs(spark)
    low = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    groups = Counter(low(t) for _, t in rows)
    for keep, pick in (("max", max), ("min", min)):
        out = exact_dedup.label_copies(docs, keep=keep).collect()
        assert len(out) == len(rows)
        best = {}
        for i, t in rows:
            if i is not None:
                best[low(t)] = pick(best.get(low(t), i), i)
        text = {hashlib.sha256(low(t).encode()).hexdigest(): low(t) for _, t in rows}
        for r in out:
            t = text[r.text_sha256]
            assert r.group_size == groups[t] and r.keep_id == best.get(t) and r.kept == (r.doc_id == best.get(t))
    assert exact_dedup.drop_copies(docs).columns == docs.columns
    assert exact_dedup.label_copies(docs.limit(0)).count() == 0
    assert exact_dedup.drop_copies(docs.limit(0)).count() == 0


TWICE = [(1, "alpha"), (2, "ALPHA"), (2, "a wholly different text"), (3, "x"), (3, "x"), (None, "q"), (None, "Q"), (4, "w v u t s r"), (5, "w v u t s r"), (5, "w v u t s r")]


def test_copies_go_by_row(spark):
    docs = spark.createDataFrame(TWICE, "doc_id long, text string")
    left = lambda df: sorted((r.doc_id or 0, r.text.lower()) for r in df.collect())
    want = sorted({(i or 0, t.lower()) for i, t in TWICE} - {(2, "alpha"), (5, "w v u t s r")})
    assert left(exact_dedup.drop_copies(docs)) == want
    assert left(ngram_join.drop_near_copies(docs)) == want
    assert left(exact_dedup.drop_copies(docs.filter("doc_id = 5"))) == [(5, "w v u t s r")]


def test_trie_spills_and_keeps_all():
    rng = random.Random(0)
    keys = [bytes(rng.choices(b"ab", k=rng.randrange(0, 12))) for _ in range(2000)]
    trie = exact_dedup.PatriciaTrie(3000, max)
    for i, k in enumerate(keys):
        trie.insert(k, (i, 1, 1))
    assert trie.spilled
    want = {k: (max(i for i, x in enumerate(keys) if x == k), n, 1) for k, n in Counter(keys).items()}
    assert dict(trie.drain()) == want


def test_packing(spark):
    from tokenizers import Tokenizer

    docs, rows = odd_docs(spark)
    tok = Tokenizer.from_file(WORDS)
    pieces = harmonic_packing.pack(docs, WORDS, with_ids=True, capacity=256).collect()
    got = Counter()
    for r in pieces:
        got[r.doc_id] += r.length
        assert r.length == len(r.token_ids) and r.offset + r.length <= 256
    want = Counter()
    for i, t in rows:
        want[i] += len(tok.encode(t or "", add_special_tokens=False).ids) + 1
    assert got == want
    whole = sorted((r.start, tuple(r.token_ids)) for r in pieces if r.doc_id == 7)
    assert [x for _, ids in whole for x in ids] == [*tok.encode(rows[7][1], add_special_tokens=False).ids, 2]
    for seq in {r.sequence_id for r in pieces}:
        at = 0
        for r in sorted((r for r in pieces if r.sequence_id == seq), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
    assert harmonic_packing.pack(docs.limit(0), WORDS).count() == 0


def test_runs_tokenize_like_the_whole():
    t = harmonic_packing.PieceTokenizer(WORDS, room=500)
    texts = ["It's DON'T l'été <|endoftext|> a\x1cb", "A-B c_d 12ab ﬁ İstanbul straße!!", "x\xa0y　z", "", "''s !'s 'sun they're we'll I'd 'l", "日本語 text。ok, 它's", "É e\u0301x ½ a²b"]
    r = random.Random(1)
    texts += ["".join(r.choice("abstmdrevl'S !.<|12 \n\t É日\u0301") for _ in range(r.randrange(40))) for _ in range(400)]
    want = [np.array(t.tok.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert t(texts) == want and [t([x])[0] for x in texts] == want


def test_url_reputation(spark):
    urls = ["http://a.example.org/x", "https://B.Example.org/es/1?q", "http://example.org/en/15", "http://c.com/fr/1", "http://com/de/#x", "http://q.net", "bare", None, "http://q.net/2"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    labels = spark.createDataFrame([(5, 1), (8, 1), (0, 0), (3, None)], "page_id long, bad int")
    out = {r.page_id: r for r in url_reputation.filter_urls(pages, labels, id_col="page_id", url_col="url", rules=RULES).collect()}
    assert [out[i].rule for i in range(9)] == ["org/", "example.org/es/", "example.org/en/1", "com/fr/", "com/de/", None, None, None, None]
    assert [out[i].verdict for i in range(5)] == ["allow", "block", "block", "allow", "block"]
    assert (out[1].host, out[1].path) == ("b.example.org", "/es/1") and (out[6].host, out[6].path) == ("", "") and out[7].host == ""
    assert out[5].bad_rate > out[0].bad_rate
    assert url_reputation.filter_urls(pages.limit(0), labels, id_col="page_id", url_col="url", rules=RULES).count() == 0


def test_beta_tail_is_the_binomial_sum(spark):
    pairs = [(a, b) for a in (1, 2, 7, 40) for b in (1, 3, 12, 55)]
    got = spark.createDataFrame([(float(a), float(b)) for a, b in pairs], "a double, b double").select("a", "b", url_reputation.beta_tail(F.col("a"), F.col("b"), 0.3).alias("t")).collect()
    for r in got:
        n, a = int(r.a + r.b) - 1, int(r.a)
        assert r.t == pytest.approx(sum(math.comb(n, k) * 0.3**k * 0.7 ** (n - k) for k in range(a)), abs=1e-9)


def test_reputation_blocks_by_the_posterior(spark):
    """Without a rule: a host of blocked outcomes, its sister without any, and a clean one; tails by numerical sums."""
    rows = [("bad.evil.co.uk", 1)] * 60 + [("worse.evil.co.uk", 1)] * 40 + [("new.evil.co.uk", None)] * 3 + [("good.com", 0)] * 80 + [("fine.com", 0)] * 50 + [("10.0.0.1", None)]
    pages = spark.createDataFrame([(i, f"http://{h}/p") for i, (h, _) in enumerate(rows)], "page_id long, url string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "page_id long, bad int")
    out = url_reputation.filter_urls(pages, labels, id_col="page_id", url_col="url", rules=[]).collect()
    verdict = {r.host: r.verdict for r in out}
    assert verdict["bad.evil.co.uk"] == verdict["worse.evil.co.uk"] == verdict["new.evil.co.uk"] == "block"
    assert verdict["good.com"] == verdict["fine.com"] == verdict["10.0.0.1"] == "allow"
    counts = spark.createDataFrame([(h, y) for h, y in rows], "host string, bad int")
    for r in url_reputation.reputation(counts).collect():
        assert r.n == sum(h == r.host and y is not None for h, y in rows) and r.bad == sum(h == r.host and y == 1 for h, y in rows)
    ruled = url_reputation.filter_urls(pages, id_col="page_id", url_col="url", rules=[("evil.co.uk", "/p", "block")]).collect()
    assert all(r.host_labelled == (r.rule is not None) * sum(h == r.host for h, _ in rows) for r in ruled)


def test_domains_and_suffixes(spark):
    hosts = {"a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "uk"), "x.example.org": ("example.org", "org"), "org": ("org", "org"), "10.0.0.1": ("10.0.0.1", "10.0.0.1"), "u@h.com:80": ("h.com", "com"), "": ("", "")}
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    assert {r.h: (r.d, r.s) for r in df.select("h", url_reputation.registered_domain(F.col("h")).alias("d"), url_reputation.suffix(F.col("h")).alias("s")).collect()} == hosts


def test_piece_sampling(spark):
    docs, rows = odd_docs(spark)
    out = piece_sampling.sample_pieces(docs, PIECES, with_ids=True).collect()
    assert len(out) == len(rows) and all(r.lossless for r in out)
    again = piece_sampling.sample_pieces(docs.repartition(3), PIECES).collect()
    assert sorted((r.doc_id or 0, r.ids_crc32) for r in out) == sorted((r.doc_id or 0, r.ids_crc32) for r in again)
    s = piece_sampling.PieceSampler(PIECES)
    ids = s.encode(["thinking"] * 4000, np.arange(4000))
    words = Counter(tuple(x.tolist()) for x in ids)
    p = s.pieces
    prob = lambda seg: np.exp(sum(s.log_weights[i] for i in seg))
    chars = np.array([[ord(c) for c in "thinking"]], np.uint32)
    total = np.exp(lattice.forward_log(p.edge_log_weights(p.edges(chars), s.log_weights), 1, 8)[0, -1])
    top = words.most_common(1)[0]
    assert abs(top[1] / 4000 - prob(top[0]) / total) < 0.04


def test_lattice_sums_all_segmentations():
    p = lattice.Pieces(PIECES)
    word = "▁there"
    index = {p.text[i]: i for i in p.plain}

    def brute(w):
        return 1.0 if not w else sum(np.exp(p.log_weights[index[w[:k]]]) * brute(w[k:]) for k in range(1, len(w) + 1) if w[:k] in index)

    chars = np.array([[ord(c) for c in word]], np.uint32)
    edges = p.edges(chars)
    w = p.edge_log_weights(edges, p.log_weights)
    n = len(word)
    assert np.exp(lattice.forward_log(w, 1, n)[0, -1]) == pytest.approx(brute(word))
    assert lattice.backward_log(w, 1, n)[0, 0] == pytest.approx(lattice.forward_log(w, 1, n)[0, -1])


def test_linear_recursion_equals_the_log_one():
    p = lattice.Pieces(PIECES)
    rng = np.random.default_rng(0)
    for length in (1, 4, 11, 45):
        chars = rng.integers(97, 123, (50, length)).astype(np.uint32)
        chars[0], chars[1, 0] = 0x1F600, 0x65E5
        w = p.edge_log_weights(p.edges(chars), p.log_weights)
        got = lattice.Linear(p, np.stack([p.log_weights, p.log_weights - 1])).marginals(chars)
        assert np.allclose(got[0], lattice.forward_log(w, 50, length)[:, -1], atol=1e-9) and (got[1] < got[0]).all()
        one, two = np.zeros(p.size), np.zeros(p.size)
        lattice.Linear(p, p.log_weights).expect(chars, one)
        lattice.expected_counts(p, p.log_weights, chars, two)
        assert np.allclose(one, two, atol=1e-8)


def lm_by_hand(rows, held, pieces):
    """Scores by plain counting and forward_log, with the piece weights estimated in one block."""
    tokens = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "").split()
    train = [t for (_, t), h in zip(rows, held, strict=True) if not h]
    c = Counter(w for t in train for w in [*tokens(t), None])
    n, v = sum(c.values()), len(c)
    words = [w for w in c if w is not None]
    counts, weights = np.zeros(pieces.size), pieces.log_weights
    span = lambda w: np.array([[lattice.SPACE, *map(ord, w)]], np.uint32)
    for _ in range(4):
        counts = np.zeros(pieces.size)
        for w in words:
            lattice.expected_counts(pieces, weights, span(w), counts)
        weights = lattice.normalised(pieces, counts)
    weights = lattice.normalised(pieces, counts)
    once, twice = (sum(c[w] == k for w in words) for k in (1, 2))
    discount = min(max(once / (once + 2 * twice) if once else 0.5, 0.05), 0.95)
    spelled, per_word = discount * v / n, max(counts.sum() / len(words), 1)
    symbols = 1 - spelled + spelled * per_word

    def log_token(w):
        spell = -math.inf
        if w is not None:
            x = pieces.edge_log_weights(pieces.edges(span(w)), weights + math.log(spelled * per_word / symbols))
            spell = lattice.forward_log(x, 1, len(w) + 1)[0, -1]
        return np.logaddexp(math.log((c[w] - discount) / n / symbols) if c[w] else -math.inf, spell)

    mass = sum((k - discount) / n / symbols for k in c.values()) + np.exp(weights).sum() * spelled * per_word / symbols
    return [sum(log_token(w) for w in [*tokens(t), None]) / math.log(10) for _, t in rows], mass


def test_lattice_lm_equals_counting_by_hand(spark):
    rows = [(i, prose(i, 30 + i)) for i in range(12)] + [(50, "unseen wörds here 字"), (51, ""), (52, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, mass = lm_by_hand(rows, [i % 4 == 2 for i, _ in rows], lattice.Pieces(PIECES))
    assert mass == pytest.approx(1, abs=1e-9)
    for part in (docs, docs.orderBy(F.desc("doc_id")).repartition(5)):
        got = {r.doc_id: r.score for r in lattice_lm.score_texts(part, F.col("doc_id") % 4 == 2, PIECES).collect()}
        assert [got[i] for i, _ in rows] == pytest.approx(want, abs=1e-6)


def test_lattice_lm_never_reads_held_out_classes(spark):
    score = lambda lang: sorted((r.doc_id, round(r.score, 9)) for r in lattice_lm.score_texts(spark.createDataFrame([(i, prose(i, 40), "en" if i % 2 else lang if i % 5 == 1 else "fr") for i in range(20)], "doc_id long, text string, lang string"), F.col("doc_id") % 5 == 1, PIECES, class_col="lang").collect())
    assert score("de") == score("fr")


def test_lattice_lm_masses_sum_to_one():
    totals = {"n": 1000, "by_n": [900, 100], "v": 300, "n1": 150, "n2": 50, "part": [210.0, 90.0], "pieces_per_word": [2.5, 3.0]}
    discount, spelled, per_word, symbols = lattice_lm.masses(totals, 0.9)
    for k in range(2):
        words = 0.9 * (1 - discount * totals["part"][k] / totals["by_n"][k]) + 0.1 * (1 - discount * totals["v"] / totals["n"])
        assert words / symbols[k] + spelled[k] * per_word[k] / symbols[k] == pytest.approx(1)


def test_lattice_lm(spark):
    docs, rows = odd_docs(spark)
    held = F.coalesce(F.col("doc_id") == 7, F.lit(False))
    out = lattice_lm.score_texts(docs, held, PIECES, class_col="lang").collect()
    tokens = lambda t: ("".join(c.lower() if c.isascii() else c for c in t or "")).split()
    c = Counter(w for i, t in rows if i != 7 for w in [*tokens(t), None])
    n, v = sum(c.values()), len(c)
    assert len(out) == len(rows)
    for r in out:
        assert r.train_tokens == n and np.isfinite(r.score)
    r = next(r for r in out if r.doc_id == 7)
    want = sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*tokens(rows[7][1]), None])
    assert r.held_out and r.base_score == pytest.approx(want) and r.n_tokens == 301
    assert lattice_lm.score_texts(docs.limit(0), held, PIECES).count() == 0


def test_induced_sort_equals_plain_sort():
    rng = np.random.default_rng(0)
    for trial in range(60):
        t = np.append(rng.integers(1, rng.integers(2, 5), rng.integers(0, 50)), 0).astype(np.uint16)
        got = [(p, x) for ps, xs in induced_sort.sorted_suffixes(t, 1000, 0 if trial % 2 else 1 << 20) for p, x in zip(ps.tolist(), xs.tolist(), strict=True)]
        order = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        assert [p for p, _ in got] == order
        for (a, _), (b, x) in zip(got, got[1:], strict=False):
            n = 0
            while a + n < len(t) and b + n < len(t) and t[a + n] == t[b + n]:
                n += 1
            assert x == n


def test_substring_dedup(spark):
    docs, rows = odd_docs(spark)
    k = 60
    c = Counter(b[i : i + k] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - k + 1))
    want = Counter()
    for i, t in rows:
        b = (t or "").encode()
        hit = np.zeros(len(b), bool)
        for s in range(len(b) - k + 1):
            if c[b[s : s + k]] > 1:
                hit[s : s + k] = True
        want[(i, len(b), int(hit.sum()), int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~hit])).hexdigest())] += 1
    out = substring_dedup.remove_repeats(docs, length=k, with_text=True).collect()
    assert Counter((r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == want
    assert substring_dedup.remove_repeats(docs.limit(0), length=k).count() == 0


def test_substring_dedup_by_words(spark):
    docs, rows = odd_docs(spark)
    extra = [(20, prose(1, 30).replace(" ", " \n")), (21, "é " * 40 + prose(11, 12)), (22, prose(11, 12)), (23, prose(12, 11)), (24, prose(12, 11) + " end"), (25, prose(13, 20) + " X " + prose(13, 20))]
    rows, docs = rows + extra, docs.unionByName(spark.createDataFrame([(i, t, "en", 1, "r") for i, t in extra], DOCS))
    n, k = 12, 200
    c, d = Counter(), Counter()
    split = lambda b: [(m.group(), m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0d]+", b)]
    for _, t in rows:
        b = (t or "").encode()
        d.update(b[i : i + k] for i in range(len(b) - k + 1))
        w = split(b)
        c.update(tuple(x[0] for x in w[i : i + n]) for i in range(len(w) - n + 1))
    want = Counter()
    for i, t in rows:
        b = (t or "").encode()
        hit, w = np.zeros(len(b), bool), split(b)
        for s in range(len(b) - k + 1):
            if d[b[s : s + k]] > 1:
                hit[s : s + k] = True
        for s in range(len(w) - n + 1):
            if c[tuple(x[0] for x in w[s : s + n])] > 1:
                hit[w[s][1] : w[s + n - 1][2]] = True
        want[(i, len(b), int(hit.sum()), int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~hit])).hexdigest())] += 1
    out = substring_dedup.remove_repeats(docs, length=k, words=n, with_text=True).collect()
    assert Counter((r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == want
    assert substring_dedup.remove_repeats(docs.limit(0), length=k, words=n).count() == 0


def test_words_of_long_texts_are_read_in_slices():
    texts = [prose(3, 400).encode(), b"", b"a" * 900 + b" b", prose(4, 3).encode()]
    for size in (50, 300, 1 << 19):
        got = {}
        for first, h, start, end, bounds in substring_dedup.word_places(texts, size):
            for j in range(len(bounds) - 1):
                got[first + j] = [(int(x), int(a), int(b)) for x, a, b in zip(*(v[bounds[j] : bounds[j + 1]] for v in (h, start, end)), strict=True)]
        assert [[t[a:b] for _, a, b in got[i]] for i, t in enumerate(texts)] == [t.split() for t in texts]
        assert len({x for v in got.values() for x, _, _ in v}) == len({w for t in texts for w in t.split()})
        for part in (20, 1 << 17):
            held = [(number[i], place[i], h[bounds[i] : bounds[i + 1]]) for h, bounds, number, place in substring_dedup._word_slices(texts, 5, part) for i in range(len(number))]
            for i, t in enumerate(texts):
                assert sorted({int(p) + s for n, p, h in held if n == i for s in range(len(h) - 4)}) == list(range(max(0, len(t.split()) - 4)))


def test_substring_dedup_writes_and_shuffles_texts_once_at_most(spark):
    docs = spark.createDataFrame([(i, prose(i, 60) + prose(i % 7 + 100, 60) + prose(i, 60)) for i in range(40)], "doc_id long, text string")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = substring_dedup.remove_repeats(docs, length=100, with_text=True, owner="once")
        assert sum(r.n_removed > 0 for r in out.collect()) == 40
        plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    # Scratch tables hold numbers alone; what is read a second time comes from the same shuffle.
    assert all(f.dataType.typeName() == "long" or f.name == "open" for p in common._SCRATCH["once"] for f in spark.read.parquet(p).schema.fields)
    assert "once-blocks" not in common._SCRATCH
    assert "ReusedExchange" in plan


@pytest.mark.parametrize("fragment", [1 << 20, 200])
def test_ngram_join(spark, fragment):
    r = random.Random(3)
    base = prose(5, 120).split()
    rows = [(i, " ".join(w if r.random() > 0.02 else f"w{r.randrange(99)}" for w in base)) for i in range(20)] + [(30, None), (31, ""), (32, "one two"), (33, "ONE two"), (34, prose(9, 80))]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, set int")
    sets = {i: frozenset(zip(*[(t or "").lower().split()[k:] for k in range(4)], strict=False)) or frozenset([tuple((t or "").lower().split())] if (t or "").split() else []) for i, t in rows}
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    out = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.near_duplicates(docs, n=4, num=85, fragment=fragment).collect()}
    assert out == {i: (len(sets[i]), root[i]) for i in sets}


def test_ngram_join_has_a_row_for_each_row(spark):
    docs = spark.createDataFrame([*TWICE, (9, None), (None, "")], "doc_id long, text string")
    out = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs, n=4, num=85).collect())
    want = [(1, 1, 1), (2, 1, 1), (2, 1, 2), (3, 1, 3), (3, 1, 3), (None, 1, None), (None, 1, None), (4, 3, 4), (5, 3, 4), (5, 3, 4), (9, 0, 9), (None, 0, None)]
    assert out == Counter(want)
    assert ngram_join.near_duplicates(docs.limit(0)).count() == 0


def test_adaptive_scan_recall_as_registered(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = adaptive_scan.search(df, F.col("vec_id") % 50 == 0).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 3000, 50):
        s = u @ u[q]
        s[q] = -9
        hit += len({r.vec_id for r in out if r.query_id == q} & set(np.argsort(-s)[:5].tolist()))
    assert hit / 300 >= 0.9


def test_adaptive_scan(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 16)).astype(np.float32)
    x[10:20] = x[0]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(400, None, 0), (401, [0.0] * 16, 0), (402, [float("nan")] * 16, 0), (403, [None] * 16, 0), (404, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v int")
    out = adaptive_scan.search(df, F.col("vec_id") % 50 == 0, lists=8, probe_share=1.0, cell=50).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    for q in range(0, 300, 50):
        s = np.round(u @ u[q], 12)
        s[q] = -9
        assert [r.vec_id for r in sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)] == np.lexsort((np.arange(300), -s))[:5].tolist()
    assert {r.query_id for r in out} == set(range(0, 300, 50))
    assert adaptive_scan.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_wrapper_induction(spark):
    page = lambda i, body: f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li>Home</li><li>N{i}</li></ul></nav><div class='sidebar'>side {i}</div><div id=main><h1>Head {i}</h1>{body}<div class='comments'><p>me too {i}</p></div></div><p>Fixed line</p><footer>&copy; {i}</footer></body>"
    rows = [(i, "http://h/", page(i, f"<p>One &amp; {i}<br>two<p>para <b>bold</b>  {i}")) for i in range(8)] + [(90, "http://h/", None), (91, "http://h/", ""), (92, None, "<article><p>only</article>"), (93, "http://other/", "<p>cut <a href='")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, template string")
    out = {r.page_id: r.text for r in wrapper_induction.extract(pages, url_reputation.url_host(F.col("url"))).collect()}
    for i in range(8):
        assert out[i] == f"Head {i}\n\nOne & {i} two\n\npara bold {i}"
    assert out[90] == out[91] == "" and out[92] == "only" and len(out) == 12
    assert wrapper_induction.extract(pages.limit(0), url_reputation.url_host(F.col("url"))).count() == 0


def extracted(spark, bodies):
    pages = spark.createDataFrame([(i, "http://h/", b) for i, b in enumerate(bodies)], "page_id long, url string, html string").repartition(3)
    return {r.page_id: r.text for r in wrapper_induction.extract(pages, url_reputation.url_host(F.col("url"))).collect()}


def test_wrapper_of_copies(spark):
    out = extracted(spark, [f"<nav>n{i}</nav><div><p>Same text</p><p>again</p></div><footer>{i}</footer>" for i in range(8)])
    assert set(out.values()) == {"Same text\n\nagain"}


def test_wrapper_of_several_layouts(spark):
    out = extracted(spark, [f"<nav>n{i}</nav><div class=a><p>Text {i}</p></div>" for i in range(8)] + ["<nav>x</nav><article><p>" + "Other layout " * 20 + "</p></article>"])
    assert all(out[i] == f"Text {i}" for i in range(8)) and out[8].startswith("Other layout")
    out = extracted(spark, [f"<nav>n{i}</nav><article id=post-{i} class='post post-{i}'><p>{'Text ' * (i + 1)}</p></article>" for i in range(8)])
    assert all(out[i] == ("Text " * (i + 1)).strip() for i in range(8))
    out = extracted(spark, [f"<nav>n{i}</nav><section id=the-{'abcdefgh'[i]}-story><p>{'Text ' * (i + 1)}</p></section>" for i in range(8)])
    assert all(out.values())


def test_wrapper_aligns_long_lists():
    kid = lambda label: (label, (), [])
    xs, ys = [kid("hr")] * 1100 + [kid("article")], [kid(f"p .{'ab'[k % 2]}") for k in range(1100)] + [kid("article")]
    assert wrapper_induction.aligned(xs, ys, {}) == [(1100, 1100, 1)]


def test_toxicity(spark):
    r = random.Random(0)
    rows, labels = [], []
    for i in range(240):
        words = prose(100 + i, 60).split()
        if i % 4 == 0:
            words[r.randrange(60)] = r.choice(["vilestem" + s for s in ("a", "ing", "ed")])
        rows.append((i, " ".join(words), 1))
        labels.append((i, int(i % 4 == 0)))
    docs = spark.createDataFrame([*rows, (900, None, 1), (901, "", 1), (None, "vilestemx", 1)], "doc_id long, text string, _id int")
    truth = spark.createDataFrame([*labels, (5, None), (7, 9), (None, 1)], "doc_id long, toxic int")
    net = toxicity.fit(docs, truth, F.col("doc_id") % 5 != 1)
    out = {x.doc_id: x.score for x in toxicity.score(docs, net).collect()}
    held = [i for i in range(240) if i % 5 == 1]
    assert sum((out[i] >= 0.3) == (i % 4 == 0) for i in held) >= 0.9 * len(held)
    assert len(out) == 243 and 0 <= out[900] <= 1 and out[900] == out[901]
    clean = toxicity.keep_clean(docs, net, 0.5)
    assert clean.columns == docs.columns and clean.filter("doc_id = 900").count() == 1
    assert toxicity.fit(docs, truth.limit(0), F.lit(True)) == 0.0
    assert toxicity.score(docs.limit(0), net).count() == 0


def test_toxicity_reads_long_runs_to_their_end():
    run = lambda i: "_".join(prose(i, 60).split()) + "_vilestem" * (i % 4 == 0) + "_" + "_".join(prose(1000 + i, 10).split())
    texts = [run(i) for i in range(240)]
    net = toxicity.train(texts, np.array([float(i % 4 == 0) for i in range(240)]), toxicity.Settings())
    score = toxicity.score_texts(net, [run(i) for i in range(400, 480)])
    assert np.mean((score >= 0.5) == [i % 4 == 0 for i in range(400, 480)]) >= 0.9
    long, word = toxicity.Words(["字" * 400 + "vilestem" + "文" * 400]), toxicity.Words(["vilestem"])
    inner = np.intersect1d(toxicity.Words(["qqqvilestemqqq"]).grams, word.grams)
    assert len(inner) == 6 + 5 + 4 and np.isin(inner, long.grams).all()
    assert len(long.seq) == 25 and (toxicity.Words(["a" * 40]).seq == [0]).all()


def test_gradients_are_right():
    s = toxicity.Settings(window=5, stride=3, hidden=3, width=4)
    w = toxicity.Words(["one two three four five six seven", "two six ten"])
    keys = np.unique(w.hash)
    grams = np.unique(w.grams)
    net = toxicity.Network(s, keys, grams, np.zeros(len(keys)), np.zeros(len(grams)))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rows = net.rows(w)
    seq, doc = toxicity.windows(w, s)
    y = (doc == 0).astype(np.float32)
    g = net.gradients(rows, seq, y)

    def loss():
        z = net.forward(net.inputs(rows), seq).astype(float)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    for name in ("Uf", "Wb", "A", "v", "o", "word", "gram"):
        at = tuple(int(n) // 2 for n in net.p[name].shape)
        old = net.p[name][at]
        net.p[name][at] = old + 1e-3
        up = loss()
        net.p[name][at] = old - 1e-3
        down = loss()
        net.p[name][at] = old
        assert (up - down) / 2e-3 == pytest.approx(float(g[name][at]), abs=2e-3), name
