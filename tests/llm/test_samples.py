"""Training samples hold distinct rows, so a repeated one can't fill them."""

import numpy as np
from pyspark.sql import functions as F

from tidewater.llm import quality, url_filter


def test_hot_url(spark):
    rows = spark.range(40).select(F.format_string("h%s.org", "id").alias("host"), F.lit("/x").alias("path"))
    first = rows.orderBy(F.xxhash64("host", "path")).first().host
    ruled = rows.withColumn("ruled", F.when(F.col("host") == first, "block").otherwise("allow"))
    hot = ruled.where(F.col("host") == first).crossJoin(spark.range(50).select(F.lit(0).alias("n"))).drop("n")
    got, want = (url_filter.fit(x, 20) for x in (ruled.unionByName(hot), ruled))
    assert np.any(want.weights) and np.array_equal(got.weights, want.weights) and got.bias == want.bias


def test_repeated_labels(spark, monkeypatch):
    monkeypatch.setattr(quality, "train", lambda x, y: sorted(y.tolist()))
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.format_string("some words of text %s.", "id").alias("text"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    usable = docs.where(fold != 0).select("doc_id")
    first = usable.orderBy(F.xxhash64("doc_id")).first().doc_id
    labels = usable.withColumn("quality", F.when(F.col("doc_id") == first, 1).otherwise(0))
    hot = spark.range(50).select(F.lit(first).alias("doc_id"), F.lit(1).alias("quality"))
    assert quality.fit(docs, labels.unionByName(hot), 20) == [0.0] * 19 + [1.0]
