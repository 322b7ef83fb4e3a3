"""The pipeline's stages on a small corpus with odd rows and clashing column names."""

import corpus_pipeline
from tests_llm_helpers import prose  # noqa: I001


def test_stages(spark, tmp_path):
    docs = [(i, prose(i, 90), "en", "s", 1) for i in range(30)]
    docs += [(100, docs[0][1], "en", "s", 1), (101, docs[1][1] + " more", "en", "s", 1), (102, None, None, None, None), (103, "", "en", "s", 0)]
    cols = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, cols).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    counts = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, df, str(tmp_path))
        if k < 4:
            assert out.columns == df.columns
            out.write.parquet(f"{tmp_path}/{k}")
            df = spark.read.parquet(f"{tmp_path}/{k}")
            counts[name] = sorted(r.doc_id for r in df.collect())
        else:
            assert {r.doc_id for r in out.collect()} == set(counts["suffix-array dedup"])
    assert counts["toxicity"] == sorted(d[0] for d in docs)
    assert set(counts["toxicity"]) - set(counts["exact dedup"]) == {100, 103}
    assert set(counts["exact dedup"]) - set(counts["n-gram Jaccard join"]) == {101}


def test_passages_of_over_50_words_go_though_shorter_than_400_bytes(spark, tmp_path):
    passage = prose(500, 60)
    passage = " ".join(w[:4] for w in passage.split())  # 299 bytes
    assert len(passage) < 400
    short = prose(501, 50)[:380]
    own = [prose(i, 80) for i in range(8)]
    texts = [f"{own[0]} {passage} {own[1]}", f"{own[2]}\n{passage.replace(' ', chr(10))}\n{own[3]}", f"{own[4]} {short} {own[5]}", f"{own[6]} {short} {own[7]}", own[0][:200] + " é", None]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["suffix-array dedup"](spark, docs, str(tmp_path)).collect()}
    assert got == dict(enumerate(texts)) | {0: f"{own[0]}  {own[1]}", 1: f"{own[2]}\n\n{own[3]}"}
