import random
import zlib

import numpy as np

from tidewater.llm.packing import pack, plan
from tests.llm.test_sstable import plain


def best_fit_decreasing(hist, size):
    bins = np.zeros(size + 1, np.int64)
    n = 0
    for a in range(size, 0, -1):
        for _ in range(int(hist[a])):
            free = next((r for r in range(a, size + 1) if bins[r]), None)
            if free is None:
                n, free = n + 1, size
            else:
                bins[free] -= 1
            bins[free - a] += 1
    return n


def held(groups, size):
    got = np.zeros(size + 1, np.int64)
    for k, parts in groups:
        assert k > 0 and sum(a * m for a, m in parts) <= size
        for a, m in parts:
            got[a] += k * m
    return got


def test_plan():
    rnd = np.random.default_rng(1)
    for size, n, draw in [(64, 500, lambda n: rnd.integers(1, 65, n)), (256, 3000, lambda n: np.minimum(256, rnd.lognormal(3.5, 1, n).astype(int) + 1)), (256, 300, lambda n: np.full(n, 100)), (256, 4000, lambda n: np.ones(n, int)), (64, 1, lambda n: np.array([64])), (64, 0, lambda n: np.zeros(0, int))]:
        hist = np.bincount(draw(n), minlength=size + 1)
        groups = plan(hist, size)
        assert (held(groups, size) == hist).all()
        total, least = sum(k for k, _ in groups), -(-int(hist @ np.arange(size + 1)) // size)
        assert least <= total <= max(best_fit_decreasing(hist, size) * 1.005 + 1, least)


def test_pack(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(["alpha", "Beta", "c", "12", "é"]) for _ in range(rnd.choice([0, 1, 5, 40, 200])))) for i in range(300)] + [(None, None), (7, "again"), (8, "")]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 64).collect()
    pieces = {}
    for doc, text in rows:
        ids = np.array(plain(text), "<u4")
        first = (len(ids) - 1) % 64 + 1
        cuts = [0, *range(first, len(ids) + 1, 64)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            key = (doc, p, a, b - a, zlib.crc32(ids[a:b].tobytes()))
            pieces[key] = pieces.get(key, 0) + 1
    seen, sequences = {}, {}
    for r in got:
        key = tuple(r)[:5]
        seen[key] = seen.get(key, 0) + 1
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == pieces
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) <= -(-sum(r.length for r in got) // 64) * 1.03 + 1


def test_edges(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string, length string, task long")).count() == 0
    got = pack(spark.createDataFrame([(1, None, "x", None), (1, None, None, 2)], "doc_id long, text string, length string, task long")).collect()
    assert sorted((r.doc_id, r.length, r.sequence_id, r.offset) for r in got) == [(1, 1, 0, 0), (1, 1, 0, 1)]
