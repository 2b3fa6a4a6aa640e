import random
import re

from tidewater.llm.span_dedup import span_dedup


def sentences(text):
    """(start, words) of each sentence, read plainly."""
    out, now, start = [], [], None
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text or ""):
        if now and (now[-1][1][-1] in ".!?" or re.search(r"[\n\r]", text[now[-1][0] + len(now[-1][1]) : m.start()])):
            out.append(now)
            now = []
        now.append((m.start(), m[0]))
    return out + [now] if now else out


def brute(rows, run, long_words):
    low = lambda w: re.sub("[A-Z]", lambda m: m[0].lower(), w)
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: r[0]):
        ss = sentences(text)
        gone = set()
        for i in range(len(ss)):
            k = next((k for k in range(1, run) if i + k <= len(ss) and sum(map(len, ss[i : i + k])) >= long_words), run)
            if i + k > len(ss):
                continue
            key = tuple(low(w) for s in ss[i : i + k] for _, w in s)
            if key in seen:
                gone |= set(range(i, i + k))
            seen.add(key)
        starts = [s[0][0] for s in ss] + [len(text or "")]
        kept = "".join(text[starts[i] : starts[i + 1]] for i in range(len(ss)) if i not in gone)
        if ss:
            kept = text[: starts[0]] + kept
            if len(ss) - 1 in gone:
                kept = kept.rstrip()
        out.append((doc, kept if gone else text, len(ss), len(gone), sorted(gone)))
    return out


def test_against_brute_force(spark):
    rnd = random.Random(3)
    pool = [" ".join(rnd.choice("aé bb Cc ddd e".split()) + str(rnd.randrange(30)) for _ in range(rnd.choice([1, 3, 8, 45]))) + rnd.choice([".", "!", "?", ""]) for _ in range(60)]
    rows = []
    for n in range(120):
        text = ""
        for _ in range(rnd.randrange(12)):
            i = rnd.randrange(58)
            for s in pool[i : i + rnd.choice([1, 1, 3])]:
                text += s + rnd.choice([" ", "\n", "  "])
        rows.append((n, text))
    rows += [(500, None), (501, ""), (502, " \n ")]
    rnd.shuffle(rows)
    got = span_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 3, 40).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[0]) == brute(rows, 3, 40)


def test_edges(spark):
    schema = "doc_id long, text string, covers string, pos long, tag long"
    assert span_dedup(spark.createDataFrame([], schema)).count() == 0
    p = "One two. Three four. Five six."
    rows = [(2, p, "", 1, 1), (2, p, "", 1, 1), (3, p + " Own end.", None, None, None), (None, p, "", 0, 0)]
    got = sorted(((r.doc_id, r.text, r.n_removed) for r in span_dedup(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == [(2, p, 0), (2, p, 0), (3, "Own end.", 3), (None, p, 0)]
