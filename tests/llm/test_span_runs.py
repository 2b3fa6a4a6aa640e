"""The query's spans: every run that holds enough words, as given by ``least``."""

import random
import re

import pytest

from tests.llm.test_span_dedup import sentences
from tidewater.llm import queries
from tidewater.llm.span_dedup import span_dedup


def brute(rows, least):
    low = lambda w: re.sub("[A-Z]", lambda m: m[0].lower(), w)
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: r[0]):
        ss, gone = sentences(text), set()
        for i in range(len(ss)):
            for k, bound in enumerate(least, 1):
                if i + k > len(ss) or sum(map(len, ss[i : i + k])) < bound:
                    continue
                key = tuple(low(w) for s in ss[i : i + k] for _, w in s)
                if key in seen:
                    gone |= set(range(i, i + k))
                seen.add(key)
        out.append((doc, sorted(gone)))
    return out


@pytest.mark.parametrize("least", [(40, 40, 0), (40, 20, 0), (0,), (1 << 40, 30, 8, 0)])
def test_against_brute_force(spark, least):
    rnd = random.Random(5)
    pool = [" ".join(rnd.choice("aé bb Cc ddd e".split()) + str(rnd.randrange(30)) for _ in range(rnd.choice([1, 3, 8, 20, 45]))) + rnd.choice([".", "!", "?", ""]) for _ in range(60)]
    rows = [(500, None), (501, ""), (502, " \n ")]
    for n in range(120):
        text = ""
        for _ in range(rnd.randrange(12)):
            i = rnd.randrange(58)
            for s in pool[i : i + rnd.choice([1, 2, 3])]:
                text += s + rnd.choice([" ", "\n", "  "])
        rows.append((n, text))
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted((r.doc_id, r.removed) for r in span_dedup(df, least=least).collect()) == brute(rows, least)


def removed(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return {r.doc_id: r.removed for r in queries.op3_sentence_span_dedup(spark, str(tmp_path)).collect()}


def passage(tag, *sizes):
    return " ".join(" ".join(f"{tag}{i}w{j}" for j in range(n)) + "." for i, n in enumerate(sizes))


def test_tail_of_a_repeated_passage_goes(spark, tmp_path):
    p = passage("p", 45, 20, 15)
    rows = [(1, p + " First own end."), (2, p + " Other text here."), (3, p)]
    assert removed(spark, tmp_path, rows) == {1: [], 2: [0, 1, 2], 3: [0, 1, 2]}


def test_two_whole_sentences_of_a_cut_passage_go(spark, tmp_path):
    a, b, c, d = passage("q", 30, 9, 9, 30).split(". ")
    cut = lambda n, m: " ".join(a.split()[-n:]) + f". {b}. {c}. " + " ".join(d.split()[:m])
    rows = [(1, f"{a}. {b}. {c}. {d}"), (2, "Before it " + cut(24, 25) + " and after it."), (3, f"Short one. Two here. {passage('z', 8, 9)}")]
    rows.append((4, f"Then. {passage('z', 8, 9)}"))
    assert removed(spark, tmp_path, rows) == {1: [], 2: [1, 2], 3: [], 4: []}
