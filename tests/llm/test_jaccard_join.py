import random
import re

from tidewater.llm.jaccard_join import divide_skip, jaccard_components
from tidewater.llm.kernels import U

import numpy as np
import pyarrow as pa

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, width):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    if len(w) < width:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def brute(rows, width, num, den):
    sets = [(i, shingle_set(t, width)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for x in range(len(sets)):
        for y in range(x):
            (i, a), (j, b) = sets[x], sets[y]
            if a and b and den * len(a & b) >= num * len(a | b):
                p, q = root(i), root(j)
                up[max(p, q)] = min(p, q)
    return sorted((i, len(s), root(i)) for i, s in sets)


def corpus(seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["Été", "ÄB", "the"]
    passage = [rnd.choice(vocab) for _ in range(40)]
    rows, n = [], 0
    for _ in range(60):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([1, 2, 3, 8, 12, 30, 60, 150]))]
        if rnd.random() < 0.4:
            base = passage + base
        for _ in range(rnd.choice([1, 1, 2, 5])):
            copy = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4])):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            rows.append((n, rnd.choice([" ", "\n", "  "]).join(copy).title() if rnd.random() < 0.3 else " ".join(copy)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "one"), (n + 4, "ONE")]
    rnd.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    for seed, (width, num, den) in enumerate([(3, 90, 100), (5, 80, 100)]):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = sorted(map(tuple, jaccard_components(df, width, num, den).collect()))
        assert got == brute(rows, width, num, den)


def test_edges(spark):
    schema = "doc_id long, text string, node long, sig string"
    assert jaccard_components(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d", 1, ""), (3, "a b c d", None, None), (3, "a b c d", 5, "x"), (4, "A B C D", 0, ""), (9, None, 0, "")]
    got = sorted(map(tuple, jaccard_components(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == [(3, 2, 3), (3, 2, 3), (4, 2, 3), (9, 0, 9), (None, 2, None)]


def test_divide_skip_finds_all_links():
    rnd = random.Random(5)
    sets = []
    for _ in range(12):
        base = set(rnd.sample(range(2000), rnd.choice([9, 20, 80])))
        for _ in range(6):
            s = set(base)
            for _ in range(rnd.choice([0, 1, 3, 6])):
                s ^= {rnd.randrange(2000)}
            sets.append(np.array(sorted(s), U))
    want = {(i, j) for j in range(len(sets)) for i in range(j) if 10 * len(set(sets[i]) & set(sets[j])) >= 9 * len(set(sets[i]) | set(sets[j]))}
    assert set(divide_skip(sets, 9, 10, joined=False)) == want


def test_large_clusters(spark, monkeypatch):
    """With tiny chunks every path of large blocks and clusters runs."""
    import tidewater.llm.jaccard_join as J

    monkeypatch.setattr(J, "CHUNK", 3)
    monkeypatch.setattr(J, "SIEVE_CHUNK", 4)
    rnd = random.Random(11)
    base, rows = [f"w{i}" for i in range(60)], []
    for n in range(120):
        copy = list(base)
        for _ in range(rnd.choice([1, 2, 3, 4])):
            copy[rnd.randrange(60)] = f"x{rnd.randrange(9)}"
        rows.append((n, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_components(df, 3, 80, 100).collect())) == brute(rows, 3, 80, 100)
    assert sorted(map(tuple, jaccard_components(df, 3, 90, 100).collect())) == brute(rows, 3, 90, 100)


def test_leads_across_batches():
    from tidewater.llm.jaccard_join import _leads

    rnd = random.Random(1)
    for _ in range(500):
        rows = sorted((rnd.randrange(1, 6), rnd.randrange(1, 7)) for _ in range(rnd.randrange(1, 25)))
        want = set()
        for sig in {s for s, _ in rows}:
            nodes = sorted({n for s, n in rows if s == sig})
            want |= {(nodes[0], nodes[1], n) for n in nodes[1:]}
        batches, at = [], 0
        while at < len(rows):
            some = rows[at : at + rnd.randrange(1, 6)]
            at += len(some)
            batches.append(pa.record_batch([pa.array(c, pa.int64()) for c in zip(*some)], ["sig", "node"]))
        assert {row for b in _leads(iter(batches)) for row in zip(*b.to_pydict().values())} == want
