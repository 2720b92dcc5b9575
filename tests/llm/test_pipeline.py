"""The pipeline's stages one after the other: what each keeps is part of what it got. Their operators are tested against brute force elsewhere."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    before = None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, data)
        if name != "byte_bpe":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids and (before is None or ids <= before)
        if name == "ngram_jaccard":
            from corpusloom.llm.ngram_join import jaccard_classes

            assert jaccard_classes(docs).where("doc_id <> component_id").count() == 0
        before = ids


def test_empty(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, data).count() == 0, name
