from tidewater.plans import registry

SF = "/root/testdata/sf0.001"


def test_lines_that_are_no_members_are_tested(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    rows = registry._bloom_probe(lambda t: spark.read.parquet(f"{SF}/{t}.parquet")).collect()
    others = [r.hit for r in rows if not r.member]
    assert len(rows) == lines and others and sum(others) < 0.1 * len(others)
    assert all(r.hit for r in rows if r.member)
