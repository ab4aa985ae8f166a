"""Joins with a hot key, and what a worker holds at once."""

import tracemalloc
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import functions as F

from punctual.llm import common, decontaminate


def test_left_join_hot(spark, monkeypatch):
    rows = spark.createDataFrame([(k, "hot" if k % 3 else f"h{k}") for k in range(60)] + [(None, None)], "id long, key string")
    side = spark.createDataFrame([("hot", 1), ("h3", 2), ("gone", 3)], "key string, x int")
    want = sorted(map(str, rows.join(side, "key", "left").select("id", "key", "x").collect()))
    for most in (common.BROADCAST_ROWS, 0):
        monkeypatch.setattr(common, "BROADCAST_ROWS", most)
        assert sorted(map(str, common.left_join_hot(rows, side, "key", "id").select("id", "key", "x").collect())) == want


def test_batches_of_long_texts_are_bounded_in_the_pipeline(spark):
    import corpus_pipeline

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    docs = spark.range(1000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 2000).alias("text"), F.lit("en").alias("lang"), F.lit("x").alias("source"), F.lit(22_000).cast("long").alias("n_chars"))
    keys = ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    for name in ("decontamination", "tokens"):
        for key in keys:
            spark.conf.unset(key)
        dict(corpus_pipeline.STAGES)[name](spark, docs, "/root/testdata/sf0.001")
        sent = [x.n for x in docs.select("text").mapInArrow(sizes, "n long").collect()]
        assert max(sent) <= common.BATCH_BYTES + 30_000 and sum(sent) >= 22_000_000
        assert int(spark.conf.get(keys[1])) == common.READ_ROWS
    for key in keys:
        spark.conf.unset(key)


def test_a_decontamination_shard_holds_no_words_of_clean_texts():
    """900,000 words of one shard that stand in no phrase, and one text that does."""
    phrase = " ".join(f"p{k}" for k in range(13))
    part = SimpleNamespace(value=decontaminate.Phrases([("a", phrase)], 13))

    def batches():
        for first in range(0, 300, 10):
            texts = [" ".join(f"w{k}" for k in range(3000)) for _ in range(10)]
            texts[0] = f"x {phrase} y" if first == 290 else texts[0]
            yield pa.RecordBatch.from_arrays([pa.array(range(first, first + 10)), pa.array([0] * 10), pa.array(texts)], ["id", "h", "text"])

    tracemalloc.start()
    rows = [x for batch in decontaminate._search([part])(batches()) for x in batch.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(x["id"], x["n_words"], x["spans"], x["items"]) for x in rows if x["spans"]] == [(290, 15, [[1, 14]], ["a"])]
    assert len(rows) == 300 and peak < 10_000_000
