"""Stages of the pipeline decide per row where rows share a doc_id or have none."""

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string"


def text(tag, n=30):
    return " ".join(f"{tag}{i}" for i in range(n))


def kept(stage, spark, rows):
    return sorted((str(r.doc_id), r.text) for r in stage(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), SF).collect())


def test_rows_that_share_a_doc_id_are_judged_alone(spark):
    rows = [(1, text("a"), "s"), (5, text("a"), "s"), (5, text("b"), "s"), (5, text("c", 20), "s"), (5, text("b", 29), "s"), (5, text("b"), "s"), (5, " ", "s")]
    rows += [(7, text("c", 20).upper(), "s"), (8, text("d"), "s"), (9, "", "s"), (9, " ", "s"), (None, text("a"), "s"), (None, text("a"), "s")]
    want = [("1", text("a")), ("5", text("b")), ("5", text("c", 20)), ("8", text("d")), ("9", " "), ("None", text("a")), ("None", text("a"))]
    assert kept(P.one_of_each_group, spark, rows) == want


def test_test_items_in_rows_without_an_id_of_their_own(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 60").orderBy("item_id").first().text
    leak = f"{text('x')} {item} {text('y')}"
    rows = [(None, leak, "s"), (None, text("a"), "s"), (1, text("a"), "s"), (2, leak, "s"), (3, leak, "s"), (3, text("b"), "s"), (None, None, "s")]
    want = [("1", text("a")), ("3", text("b")), ("None", text("a"))]
    got = [(str(r.doc_id), r.text) for r in P.without_test_items(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), SF).collect()]
    assert sorted(x for x in got if x[1]) == want and len(got) == 4
