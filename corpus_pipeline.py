"""From documents to packed training sequences: toxicity, exact copies, near copies, repeated substrings, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. What a stage returns is written as Parquet and read again as the next one's docs.

Edge cases follow the operators': null texts count as empty, and one such row stays; of rows that are
equal in id and text one stays, rows with equal ids and other texts are other documents; extra columns
pass through the filtering stages; empty input gives empty output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import prepare, release, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Documents whose highest window reaches this are rejected.
REJECT_FROM = 0.5
#: Passages of so many words are removed where they occur again, beside the operator's 400-byte strings.
PASSAGE_WORDS = 51
SCRATCH = "pipeline"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the network calls toxic; it learns from all labels of them."""
    from tidemark.llm.toxicity import fit, keep_clean

    prepare(spark)
    release(spark, SCRATCH)
    net = fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return keep_clean(docs, net, REJECT_FROM)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (A-Z lowered) the one with the smallest doc_id stays."""
    from tidemark.llm.exact_dedup import drop_copies

    prepare(spark)
    release(spark, SCRATCH)
    return drop_copies(docs, keep="min", owner=SCRATCH)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similarity (five words, 0.8) the one with the smallest doc_id stays."""
    from tidemark.llm.ngram_join import drop_near_copies

    prepare(spark)
    release(spark, SCRATCH)
    return drop_near_copies(docs, owner=SCRATCH)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove each byte of a 400-byte string, or of a passage of over 50 words, that also starts elsewhere; documents stay, shorter."""
    from tidemark.llm.substring_dedup import remove_repeats

    prepare(spark)
    release(spark, SCRATCH)
    cut = remove_repeats(docs, words=PASSAGE_WORDS, with_text=True, owner=SCRATCH).filter("n_removed > 0").select(F.col("row").alias("__tm_row"), F.col("kept_text").alias("__tm_kept")).dropDuplicates(["__tm_row"])
    keyed = docs.withColumn("__tm_key", F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))))
    text = F.when(F.col("__tm_kept").isNotNull(), F.col("__tm_kept")).otherwise(F.col("text"))
    joined = keyed.join(cut, F.col("__tm_key") == F.col("__tm_row"), "left")
    out = [text.alias(c) if c == "text" else F.length(text).cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return joined.select(*out)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens."""
    from tidemark.llm.harmonic_packing import pack
    from tidemark.llm.queries import tokenizer_path

    prepare(spark)
    release(spark, SCRATCH)
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [("toxicity", toxicity), ("exact dedup", exact_copies), ("n-gram Jaccard join", near_copies), ("suffix-array dedup", repeated_passages), ("packing", packing)]

#: A trained network and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "pipeline-stages")
    return docs
