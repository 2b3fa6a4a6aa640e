import random

import numpy as np
import pyarrow as pa
import pytest

from tidewater.llm.common import text_buffers
from tidewater.llm.quality import FEATURES, classify, fit, measure, score, train


def prose(rnd):
    return " ".join(" ".join(rnd.choice("on the river a boat went slowly past old stone houses".split()) for _ in range(rnd.randrange(4, 12))).capitalize() + "." for _ in range(rnd.randrange(2, 9)))


def junk(rnd):
    words = [rnd.choice("river boat went slowly past".split()) for _ in range(rnd.randrange(20, 60))]
    return rnd.choice([" | ".join(words), " ".join(w.upper() + "!!" for w in words), " ".join([words[0]] * 40), " ".join(w + "###" for w in words)])


def test_held_out_accuracy(spark):
    rnd = random.Random(0)
    rows = [(i, prose(rnd), 1) if rnd.random() < 0.6 else (i, junk(rnd), 0) for i in range(1500)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(9001, None), (9002, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in classify(docs, labels).collect()}
    truth = {i: q for i, _, q in rows}
    held = [i for i in truth if got[i].held_out]
    assert 200 < len(held) < 400
    assert sum((got[i].score >= 0.5) == truth[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_interactions_are_learnt():
    rnd = np.random.default_rng(1)
    x = np.zeros((4000, len(FEATURES)))
    x[:, :2] = rnd.random((4000, 2))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    p = train(x[:3000], y[:3000]).score(x[3000:])
    assert ((p > 0.5) == y[3000:]).mean() > 0.9


def test_measure_reads_each_text_alone():
    rnd = random.Random(4)
    texts = [prose(rnd) if i % 2 else junk(rnd) for i in range(30)] + ["", " ", "é", "A!"]
    both = measure(*text_buffers(pa.array(texts)))
    for i, t in enumerate(texts):
        assert both[i] == pytest.approx(measure(*text_buffers(pa.array([t])))[0])
    assert (both[30:32] == 0).all()


def test_edges(spark):
    docs = spark.createDataFrame([(None, None, "x", 0.5), (1, "", None, None), (1, "A b.", "", 1.0)], "doc_id long, text string, quality string, quality_score double")
    none = spark.createDataFrame([], "doc_id long, quality int, text string")
    assert [(r.doc_id, r.score) for r in classify(docs, none).collect()] == [(None, 0.5), (1, 0.5), (1, 0.5)]
    assert classify(docs.limit(0), none).count() == 0
    out = score(docs, fit(docs, none))
    assert out.columns == ["doc_id", "text", "quality", "quality_score", "quality_kept"] and out.count() == 3
