import numpy as np

from tidewater.llm import voronoi_knn
from tidewater.llm.voronoi_knn import top_k


def brute(rows, every, k, scale=64):
    ok = [(i, np.floor(scale * np.array(v, np.float64)).astype(np.int64)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % every == 0:
            hits = sorted((-int(a @ b), i) for i, b in ok if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(hits)]
    return sorted(out)


def rows_of(rnd, n, d):
    centres = rnd.normal(size=(6, d))
    rows = [(i, (centres[i % 6] + 0.2 * rnd.normal(size=d)).astype(np.float32).tolist()) for i in range(n)]
    same = rows[3][1]
    return [(i, same) if i % 3 == 0 else (i, v) for i, v in rows]


def test_against_brute_force(spark, monkeypatch):
    rnd = np.random.default_rng(0)
    rows = rows_of(rnd, 700, 8)
    rows += [(700, None), (720, [1.0] * 7 + [None]), (740, [float("nan")] * 8), (760, [float("inf")] + [0.0] * 7), (-20, [0.5] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    want = brute(rows, 20, 20)
    assert sorted(map(tuple, top_k(df).collect())) == want
    monkeypatch.setattr(voronoi_knn, "BLOCK", 16)
    assert sorted(map(tuple, top_k(df).collect())) == want


def test_few_vectors_and_edges(spark):
    schema = "vec_id long, embedding array<float>, cell long, score string"
    assert top_k(spark.createDataFrame([], schema)).count() == 0
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.0]), (20, [0.0, 0.0]), (0, [1.0, 2.0]), (None, [9.0, 9.0]), (40, []), (60, None)]
    df = spark.createDataFrame([(*r, None, "x") for r in rows], schema)
    kept = [r for r in dict.fromkeys((i, tuple(v)) for i, v in rows if i is not None and v)]
    assert sorted(map(tuple, top_k(df).collect())) == brute(kept, 20, 20)
