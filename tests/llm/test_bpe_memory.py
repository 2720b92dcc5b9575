"""What an idle worker holds of the encoder, and what a batch of texts holds in Spark."""

import pyarrow as pa

from corpusloom.llm import bpe
from corpusloom.llm.common import short_batches


def test_encoder_goes_with_its_task(spark):
    docs = spark.createDataFrame([(k, "one two three") for k in range(40)], "doc_id long, text string").repartition(8)
    got = bpe.bpe(docs, {bytes([b]): b for b in range(256)}, r"\S+|\s+", mode="ids").collect()
    assert {tuple(r.ids) for r in got} == {tuple(b"one two three")}

    def held(batches):
        for _ in batches:
            pass
        yield pa.record_batch([pa.array([len(bpe._BUILT)])], names=["n"])

    assert {r.n for r in spark.range(0, 80, 1, 8).mapInArrow(held, "n long").collect()} == {0}


def test_parquet_batches_of_texts_are_short(spark):
    key = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "4096")
        short_batches(spark)
        assert int(spark.conf.get(key)) <= 1024
    finally:
        spark.conf.set(key, before)
