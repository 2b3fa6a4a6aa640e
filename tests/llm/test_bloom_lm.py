import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidewater.llm import bloom_lm
from tidewater.llm.bloom_lm import Filter, ascended, ascending, packed, score_texts, segment, unpacked


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def brute(rows):
    """Everything but ``score`` exactly, and a score from exact quantised counts."""
    uni, two, starts = Counter(), Counter(), 0
    for i, t in rows:
        if not held(i):
            w = tokens(t)
            uni.update(w)
            two.update(zip(["<s>", *w], w))
            starts += 1
    n, v = sum(uni.values()), len(uni)
    out = {}
    for i, t in rows:
        w = tokens(t)
        p = [(uni[x] + 1) / (n + v + 1) for x in w]
        score = 0.0
        for b, x, px in zip(["<s>", *w], w, p):
            c = starts if b == "<s>" else uni[b]
            k = two[b, x]
            k = (3 * 2 ** int(math.log2(k)) - 1) / 2 if k else 0
            score += math.log10((min(k, c) + bloom_lm.MU * px) / (c + bloom_lm.MU))
        out[i] = (held(i), len(w), sum(uni[x] > 0 for x in w), n, sum(map(math.log10, p)), score)
    return out


def corpus():
    rnd = random.Random(6)
    vocab = [f"w{int(rnd.paretovariate(0.7)) % 900}" for _ in range(4000)] + ["É", "The", "the"]
    rows = [(i, rnd.choice([" ", "\n"]).join(rnd.choice(vocab) for _ in range(rnd.choice([0, 1, 20, 300])))) for i in range(200)]
    return rows + [(200, None), (201, "")]


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows)
    for most in (1 << 30, 2000):  # one pass, and several
        got = score_texts(df, most_bytes=most, chunk=20_000, bucket=500).collect()
        assert len(got) == len(rows)
        for r in got:
            w = want[r.doc_id]
            assert tuple(r)[1:5] == w[:4] and r.base_score == pytest.approx(w[4])
            assert w[5] - 1e-9 <= r.score <= w[5] + 0.06 * r.n_tokens  # false positives only raise counts


def test_filter():
    rnd = np.random.default_rng(0)
    keys = np.unique(rnd.integers(0, 1 << 52, 20000).astype(np.uint64))
    counts = np.maximum(1, rnd.pareto(1, len(keys)).astype(int))
    raw = segment(keys, counts)
    f = Filter(0, [(0, len(raw))], raw)
    got, exact = f.counts(keys), (3 * 2.0 ** np.floor(np.log2(counts)) - 1) / 2
    assert (got >= exact).all() and (got == exact).mean() > 0.97
    assert (f.counts(rnd.integers(0, 1 << 52, 20000).astype(np.uint64)) > 0).mean() < 0.03


def test_codecs():
    x = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64))
    assert (ascended(ascending(x)) == x).all() and (unpacked(packed(x), np.uint64) == x).all()
    assert len(ascended(ascending(x[:0]))) == 0


def test_edges(spark):
    schema = "doc_id long, text string, score string, chunk long"
    assert score_texts(spark.createDataFrame([], schema)).count() == 0
    i = next(i for i in range(9) if not held(i))
    got = score_texts(spark.createDataFrame([(None, "a b", "", 1), (i, "a", None, None), (i, "a", "x", 0)], schema)).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got) == [(str(i), False, 2, 2, 4), (str(i), False, 2, 2, 4), ("None", False, 3, 2, 4)]
