import numpy as np
import pytest
from tests.llm.test_bloom_lm import brute, corpus

from tidewater.llm import bloom_lm
from tidewater.llm.bloom_lm import edges, merged, score_texts


def test_rows_between_chunks_and_buckets(spark, monkeypatch):
    """Many chunks and many buckets: what passes between them is not their product."""
    made, keep = {}, bloom_lm.materialise

    def spy(df, tag):
        out = keep(df, tag)
        made[tag] = out.count()
        return out

    monkeypatch.setattr(bloom_lm, "materialise", spy)
    rows = corpus()
    want = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(48)
    for most in (1 << 30, 500):
        got = score_texts(df, most_bytes=most, chunk=2000, bucket=4).collect()
        assert made["segments"] > 500 and made["chunks"] > 40
        assert made["totals"] <= 64 * made["chunks"] and made.get("answers", 0) <= 64 * made["chunks"]
        for r in got:
            w = want[r.doc_id]
            assert tuple(r)[1:5] == w[:4] and r.base_score == pytest.approx(w[4])
            assert w[5] - 1e-9 <= r.score <= w[5] + 0.06 * r.n_tokens


def test_several_cuts_give_the_same(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(4)
    one, many = (sorted(map(tuple, score_texts(df, chunk=9000, bucket=100, **how).collect())) for how in ({}, {"merge": 300, "fan": 2}))
    assert one == many


def test_merged_and_edges():
    keys, counts = merged(np.array([5, 9, 5, 1], np.uint64), np.array([1, 2, 3, 4], np.uint64))
    assert keys.tolist() == [1, 5, 9] and counts.tolist() == [4, 4, 2]
    assert [len(x) for x in merged(keys[:0], counts[:0])] == [0, 0]
    assert edges(keys, 4, 2) == [(0, 0, 1), (1, 1, 2), (2, 2, 3)] and edges(keys, 4, 0) == [(0, 0, 3)] and edges(keys[:0], 4, 2) == []
