import random
import re

from tidewater.llm.decontaminate import contained_items

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute(docs, items, width=5, num=80, den=100):
    out = []
    for i, item in items:
        n = len(WORD.findall(item or ""))
        if not n:
            continue
        s = shingles(item, min(width, n))
        out += [(d, i, len(s & shingles(t, min(width, n))) / len(s)) for d, t in docs if den * len(s & shingles(t, min(width, n))) >= num * len(s)]
    return sorted(out)


def test_against_brute_force(spark):
    rnd = random.Random(1)
    vocab = [f"w{i}" for i in range(200)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([2, 6, 14, 30, 60, 200])))) for i in range(40)]
    docs = []
    for d in range(150):
        text = [rnd.choice(vocab) for _ in range(rnd.choice([0, 5, 50, 2000]))]
        if d % 3 == 0:
            passage = rnd.choice(items)[1].split()
            for _ in range(rnd.choice([0, 0, 1, 3])):
                passage[rnd.randrange(len(passage))] = "x"
            at = rnd.randrange(len(text) + 1)
            text[at:at] = [w.upper() for w in passage]
        docs.append((d, " ".join(text)))
    items += [(90, None), (91, "  "), (92, "solo")]
    docs += [(900, None), (901, ""), (902, "Solo")]
    a = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert len(want) > 30
    assert sorted(map(tuple, contained_items(a, b).collect())) == want
    assert sorted(map(tuple, contained_items(a, b, block=7).collect())) == want


def test_edges(spark):
    s1, s2 = "doc_id long, text string, item_id string", "item_id long, text string, doc_id string"
    docs, items = spark.createDataFrame([], s1), spark.createDataFrame([], s2)
    some = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (None, "a b c d e f", "")], s1)
    item = spark.createDataFrame([(7, "A b c d e f", "x"), (None, "a b c d e f", "x"), (8, None, None)], s2)
    assert contained_items(docs, item).count() == 0
    assert contained_items(some, items).count() == 0
    assert [tuple(r) for r in contained_items(some, item).collect()] == [(1, 7, 1.0)]
