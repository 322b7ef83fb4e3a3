"""The registered queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    net = fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return score(docs, net).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_reputation import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"), id_col="page_id", url_col="url", rules=RULES)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats

    cut = remove_repeats(table(spark, sf_dir, "documents"), with_text=True)
    return cut.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"), (F.col("n_removed") > 0).alias("cut"), F.col("kept_text"))


def op5_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_reputation import url_host
    from .wrapper_induction import extract

    return extract(table(spark, sf_dir, "pages"), url_host(F.col("url")))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), n=4, num=85)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import label_copies

    return label_copies(table(spark, sf_dir, "documents"), keep="max")


def op8_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .adaptive_scan import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .harmonic_packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .piece_sampling import sample_pieces

    return sample_pieces(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op3_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lattice_lm import score_texts

    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1
    return score_texts(table(spark, sf_dir, "documents"), held_out, tokenizer_path("piece_bpe_32k.model"), class_col="lang")


def op11_label_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .label_shards import shard

    placed = shard(table(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"), "group_size", "mates")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .source_divergence import audit

    return audit(table(spark, sf_dir, "documents"))


def op13_heap_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .heap_lloyd import encode

    return encode(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_url_reputation, op3_lattice_lm, op4_substring_dedup, op5_wrapper_induction, op6_ngram_join, op7_exact_dedup, op8_adaptive_scan, op9_harmonic_packing, op10_piece_sampling, op11_label_shards, op12_source_divergence, op13_heap_lloyd)}

ORACLES = {
    "op7_exact_dedup": """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)""",
    "op12_source_divergence": """
WITH d AS (SELECT row_number() OVER () AS r, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
c AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0)::HUGEINT AS n FROM g JOIN k USING (lang) LEFT JOIN n USING (lang, source, term)),
p AS (SELECT c.*, sum(n) OVER (PARTITION BY lang, source) AS total, sum(n) OVER (PARTITION BY lang, term) AS all_n, sum(n) OVER (PARTITION BY lang) AS all_total FROM c),
s AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v) AS p, 1 + (1000000000::HUGEINT * (all_n + 5)) // (all_total + 5 * v) AS q FROM p JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM s WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM o QUALIFY part = 'pair' OR rank <= 50""",
}



def _lloyd_sql() -> str:
    """Two rounds of plain Lloyd on integer parts, each a full comparison."""
    head = """WITH e AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT r, p, list_transform(embedding[p * (len(embedding) // 16) + 1 : (p + 1) * (len(embedding) // 16)], lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM e, range(16) t(p)),
b0 AS (SELECT p, r - 1 AS j, x AS b FROM x WHERE r <= 64)"""
    step = """,
a{k} AS (SELECT r, p, arg_min(j, (d, j)) AS j, min(d) AS d FROM (SELECT x.r, x.p, b.j, list_sum(list_transform(list_zip(x.x, b.b), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x JOIN b{k} b USING (p)) GROUP BY r, p)"""
    move = """,
m{k} AS (SELECT p, j, w, (sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS v FROM (SELECT a.p, a.j, unnest(range(len(x.x))) AS w, unnest(x.x) AS v FROM a{k} a JOIN x USING (r, p)) GROUP BY p, j, w),
b{n} AS (SELECT b.p, b.j, coalesce(m.b, b.b) AS b FROM b{k} b LEFT JOIN (SELECT p, j, list(v::BIGINT ORDER BY w) AS b FROM m{k} GROUP BY p, j) m USING (p, j))"""
    tail = """,
c AS (SELECT r, string_agg(format('{:02x}', j), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY r)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(b, ','), ',' ORDER BY p, j)) FROM b2) AS codebooks_sha256 FROM c JOIN e USING (r)"""
    return head + step.format(k=0) + move.format(k=0, n=1) + step.format(k=1) + move.format(k=1, n=2) + step.format(k=2) + tail


ORACLES["op13_heap_lloyd"] = _lloyd_sql()
