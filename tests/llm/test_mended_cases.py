"""Cases that pages and vectors met in review: article text beside and inside the main slot, extreme and repeated vectors."""

import math
import random

import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import adaptive_scan, url_reputation, wrapper_induction


def extracted(spark, bodies):
    pages = spark.createDataFrame([(i, f"http://h{host}/", b) for i, (host, b) in enumerate(bodies)], "page_id long, url string, html string").repartition(3)
    return {r.page_id: r.text for r in wrapper_induction.extract(pages, url_reputation.url_host(F.col("url"))).collect()}


def test_what_all_articles_of_a_host_have_stays(spark):
    page = lambda i: f"<nav>Home</nav><div>Our shop</div><article><h1>Cake {i}</h1><h2>Ingredients</h2><p>{i} eggs</p><h2>Method</h2><details><summary>More</summary><p>bake {i}</p></details></article><p>Fixed line</p>"
    out = extracted(spark, [(0, page(i)) for i in range(8)])
    assert all(out[i] == f"Cake {i}\n\nIngredients\n\n{i} eggs\n\nMethod\n\nMore\n\nbake {i}" for i in range(8))


def test_headings_and_paragraphs_beside_the_main_block_stay(spark):
    long = "word " * 200
    one = f"<h1>My title</h1><div>{long}</div><p>Last paragraph.</p>"
    out = extracted(spark, [(1, one)] + [(2, f"<div class=menu>Menu</div><h1>Title {i}</h1><div>{long}{i}</div><p>End {i}.</p><div class=small>All rights</div>") for i in range(6)])
    assert out[0] == f"My title\n\n{long.strip()}\n\nLast paragraph."
    assert all(out[1 + i] == f"Title {i}\n\n{long}{i}\n\nEnd {i}." for i in range(6))


def test_inline_adverts_end_at_their_own_end_tag(spark):
    out = extracted(spark, [(3, "<article><p>a <span class='ad'><span>buy</span> now <span>cheap</span>ly</span> b</p><p>c <span class='ad'>open</p></article>")])
    assert out[0].split("\n\n")[0] == "a b"


def test_search_of_extreme_and_repeated_vectors(spark):
    rows = [(0, [1e200, 1.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, [1e-200, 2e-200]), (0, [1e200, 1.0]), (4, [-1e308, 1e308])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = adaptive_scan.search(df, F.col("vec_id") == 0, probe_share=1.0).orderBy("rank", "vec_id").collect()
    assert len(out) == 10 and sorted(r.rank for r in out) == sorted([1, 2, 3, 4, 5] * 2)
    want = [(0, 1.0), (1, 1.0), (2, math.sqrt(0.5)), (3, 1 / math.sqrt(5)), (4, -math.sqrt(0.5))]
    for k, (v, s) in enumerate(want, 1):
        assert all(r.vec_id == v and abs(r.score - s) < 1e-15 for r in out if r.rank == k)


def test_long_child_lists_align_as_short_ones_do():
    rng = random.Random(1)
    tree = lambda deep: (rng.choice("abcd"), tuple(tree(deep - 1) for _ in range(rng.randrange(3))) if deep else (), [])
    for _ in range(60):
        xs, ys = ([tree(2) for _ in range(rng.randrange(1, 40))] for _ in range(2))
        assert wrapper_induction._aligned_in_blocks(xs, ys) == wrapper_induction.aligned(xs, ys, {})
    # Over a million cells; a label that is there once is first on one side and last on the other.
    leaf = lambda c: (c, (), [])
    some = [leaf(c) for c in "ab" * 510]
    found = wrapper_induction.aligned([leaf("once"), *some], [*some, leaf("once")], {})
    assert found == [(k + 1, k, 1) for k in range(1020)]


def test_first_words_look_their_pieces_up_once(monkeypatch):
    from tidemark.llm import lattice, lattice_lm, queries

    path, asked = queries.tokenizer_path("piece_bpe_32k.model"), []
    edges = lattice.Pieces.edges
    monkeypatch.setattr(lattice.Pieces, "edges", lambda self, chars: asked.append(len(chars)) or edges(self, chars))
    text = "some plain words and a few others, é and 中 too"
    t = pa.table({"doc_id": [1], "text": [text], "block": [0], "cls": pa.array([0], pa.int32())})
    lattice_lm._count_block(path, 1, "doc_id")(t)
    assert sum(asked) == len(set(text.split()))
