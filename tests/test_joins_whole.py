"""Every row of both sides takes part in the joins over whole tables."""

import pytest

from tidewater.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def one(spark):
    return lambda name: registry.queries()[name](spark, SF).collect()[0]


def test_every_line_and_order_takes_part(spark, one):
    lines, orders = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("lineitem", "orders"))
    bare = orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left_anti").count()
    assert one("join_whole_inner_merge") == one("join_whole_inner_hash")
    assert one("join_whole_inner_hash").n == one("join_whole_left").n == lines.count()
    assert bare and one("join_whole_right").n == lines.count() + bare
    semi, anti = one("join_whole_semi"), one("join_whole_anti")
    assert semi.n and anti.n and semi.n + anti.n == lines.count()
    assert one("join_whole_full").n > lines.count() + bare
