import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_jaccard_join import brute as components
from tests.llm.test_pii import brute as base_spans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def test_stages(spark, docs):
    """Each stage's rows against a plain version of its rule, on the smallest tables."""
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = P.good_quality(spark, docs, SF)
    assert kept.schema == docs.schema
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {r.doc_id for r in kept.collect()}
    judged = [i for i, _ in rows if i in labels]
    assert sum((i in left) == (labels[i] == 1) for i in judged) >= 0.97 * len(judged)

    some = docs.orderBy(F.length("text")).limit(120).cache()
    rows = [(r.doc_id, r.text) for r in some.collect()]
    want = {i for i, _, c in components(rows, 5, 80, 100) if i == c}
    assert {r.doc_id for r in P.one_of_each_group(spark, some, SF).collect()} == want and len(want) < len(rows)

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    every = [(r.doc_id, r.text) for r in docs.collect()]
    bad = {d for d, _, _ in leaks(every, items)}
    assert bad and {r.doc_id for r in P.without_test_items(spark, docs, SF).collect()} == {i for i, _ in every} - bad

    masked = P.without_personal_data(spark, docs, SF)
    assert masked.columns == docs.columns
    before = dict(every)
    for r in masked.collect():
        assert base_spans(r.text) == "" and r.n_chars == len(r.text)
        assert (r.text == before[r.doc_id]) or base_spans(before[r.doc_id]) or "<" in r.text


def test_run_and_edges(spark, docs):
    out = P.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 50
    none = docs.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, none, SF).count() == 0
    odd = spark.createDataFrame([(None, None, "en", "s", None), (1, "", None, None, 0), (1, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13), (2, "A B C D E F G", "en", "x", 13)], docs.schema)
    assert sorted(str(r.doc_id) for r in P.one_of_each_group(spark, odd, SF).collect()) == ["1", "None"]
    assert P.without_personal_data(spark, odd, SF).count() == P.without_test_items(spark, odd, SF).count() == 5
