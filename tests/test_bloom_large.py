from pyspark.sql import functions as F

from tidewater.operators import aggregates
from tidewater.plans import edges


def test_query_beyond_one_array(spark):
    n = 4_400_000  # 1.1 million members, 8.8 million bits
    got = edges.bloom_false_hits(lambda _: spark.range(n).withColumnRenamed("id", "l_orderkey")).collect()
    assert [tuple(r) for r in got] == [(n // 4, n - n // 4, True)]


def test_segments(spark):
    bits, x = 3 * aggregates.BLOOM_BITS + 1, F.col("x")
    part = lambda a, b: aggregates.bloom_words(spark.range(a, b).select(x_or_null.alias("x")), x, 3, bits)
    x_or_null = F.when(F.col("id") > 5, F.col("id") - 3000)
    words = aggregates.bloom_merge(part(0, 2000), part(2000, 5000))
    df = spark.range(-4000, 9000).select(F.when(F.col("id") > -3990, F.col("id")).alias("x"), (F.col("id") % 7).alias("segment"), F.lit("w").alias("words"))
    rows = aggregates.bloom_hits(df, words, x, 3, bits).collect()
    assert len(rows) == 13_000 and rows[0].__fields__ == ["x", "segment", "words", "hit"]
    assert sum(r.hit is None for r in rows) == 11 and all(r.hit is None for r in rows if r.x is None)
    member = lambda v: v is not None and 5 - 3000 < v < 2000
    assert all(r.hit for r in rows if member(r.x))
    assert sum(bool(r.hit) for r in rows if not member(r.x)) < 40
    none = aggregates.bloom_words(spark.range(0).select(F.col("id").alias("x")), x, 3, bits)
    assert aggregates.bloom_hits(df, none, x, 3, bits).where("hit").count() == 0
    size = aggregates._bloom_size(bits)
    assert words.agg(F.max("word")).first()[0] < size // 64
