import numpy as np
import pytest

from tidewater.llm.voronoi_knn import Vectors, quantised, top_k
from tests.llm.test_voronoi_knn import rows_of

import pyarrow as pa


def brute(rows, every=20, k=20, scale=64):
    """With Python integers; components that one vector lacks count as 0."""
    ok = [(i, [int(np.floor(scale * np.float64(x))) for x in v]) for i, v in rows]
    out = []
    for q, a in ok:
        if q % every == 0:
            hits = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(hits)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)


def test_huge_components_take_part(spark):
    rows = [(i, [float(x) for x in v]) for i, v in rows_of(np.random.default_rng(3), 120, 4)]
    rows += [(200, [1e7, 0.0, 1.0, 0.25]), (201, [1.0, 0.0, 0.0, 0.0]), (202, [-2e7, 1.0, 0.0, 0.0]), (220, [-3e6, 2e6, 0.015625, 0.0]), (240, [2.0**26, -1.0, 0.0, 0.0])]
    got = sorted(map(tuple, top_k(frame(spark, rows)).collect()))
    assert got == brute(rows) and len({q for q, *_ in got}) == 9


def test_sums_beyond_53_bits_are_exact():
    rows = [[2.0**26, 1.0, 3.0], [2.0**25 + 0.015625, -1.0, 2.0], [0.5, 0.0, 0.0], [2.0**24, 2.0**24 + 0.015625, 1.0]]
    v = Vectors(*quantised(pa.array(rows), 64))
    ints = [[int(np.floor(64 * x)) for x in r] for r in rows]
    assert v.exact(v).tolist() == [[sum(x * y for x, y in zip(a, b)) for b in ints] for a in ints]


def test_unequal_lengths(spark):
    rnd = np.random.default_rng(5)
    rows = [(i, rnd.normal(size=rnd.choice([1, 3, 8])).tolist()) for i in range(150)]
    rows += [(400, rnd.normal(size=20_000).tolist())]  # a very long vector
    assert sorted(map(tuple, top_k(frame(spark, rows)).collect())) == brute(rows)


@pytest.mark.parametrize("x, why", [(1e308, "does not fit a double"), (2.0**31, "does not fit 64 bits")])
def test_results_that_no_long_holds_fail(spark, x, why):
    with pytest.raises(Exception, match=why):
        top_k(frame(spark, [(0, [x, 2.0]), (1, [x, 0.0])])).collect()
