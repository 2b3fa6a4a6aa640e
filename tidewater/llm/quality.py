"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted cyclically, one feature at a time, on binned features; each tree only adds
to that feature's lookup table.  Then small two-way trees are boosted on the pairs of features that
most reduce what is left.  A score is the sum of one table entry per feature and pair, so
scoring is a few vectorised additions.  Training sees a bounded sample of labelled rows
(``SAMPLE``, chosen by a hash of the id); features are of whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewater.llm.common import bounded_batches, hash_sample, only, slices, text_buffers, texts
from tidewater.llm.kernels import Words

#: Most labelled rows that training uses.
SAMPLE = 20_000
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 150, 60, 10, 0.15

FEATURES = (
    "log_words", "word_chars", "word_chars_dev", "capital_share", "capital_words", "digit_share", "symbol_share", "symbol_words",
    "pipe_share", "bang_share", "repeat_next", "distinct_share", "top_gap", "sentence_words", "closed_lines", "line_words", "distinct_sentences", "non_ascii", "short_words", "long_words",
)


def measure(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of FEATURES per text; an empty text has zeros throughout."""
    words = Words(data, offs)
    docs, of = len(offs) - 1, words.of
    n = np.diff(of).astype(float)
    chars = np.diff(offs).astype(float)
    doc = np.repeat(np.arange(docs), np.diff(of))

    def share(mask: np.ndarray) -> np.ndarray:
        """Share of a document's words that the mask holds for."""
        return np.bincount(doc, mask, docs) / np.maximum(1, n)

    def bytes_where(mask: np.ndarray) -> np.ndarray:
        cum = np.concatenate([[0], np.cumsum(mask)])
        return (cum[offs[1:]] - cum[offs[:-1]]) / np.maximum(1, chars)

    size = (words.end - words.start).astype(float)
    mean = share(size)
    upper = (data >= 65) & (data <= 90)
    letter = upper | ((data >= 97) & (data <= 122)) | (data >= 128)
    digit = (data >= 48) & (data <= 57)
    odd = np.isin(data, np.frombuffer(b"#$%&*|<>{}[]=^~\\/@_+", np.uint8))
    cums = {k: np.concatenate([[0], np.cumsum(m)]) for k, m in (("upper", upper), ("odd", odd), ("low", (data >= 97) & (data <= 122)))}
    in_word = {k: c[words.end] - c[words.start] for k, c in cums.items()}
    again = np.zeros(len(doc), bool)
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((words.hash, doc))
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (words.hash[order][1:] != words.hash[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    runs = np.diff(np.append(np.flatnonzero(fresh), len(doc)))
    top = np.zeros(docs)
    np.maximum.at(top, doc[order][fresh], runs)
    a, b, s_of = words.sentences()
    s_doc = np.repeat(np.arange(docs), np.diff(s_of))
    sentences = np.maximum(1, np.diff(s_of))
    last = words.data[words.end[b - 1] - 1] if len(b) else np.zeros(0, np.uint8)
    closed = np.isin(last, np.frombuffer(b".!?", np.uint8))
    s_key = np.add.reduceat(words.hash, a) if len(a) else words.hash
    s_order = np.lexsort((s_key, s_doc))
    s_fresh = np.ones(len(s_doc), bool)
    s_fresh[1:] = (s_key[s_order][1:] != s_key[s_order][:-1]) | (s_doc[s_order][1:] != s_doc[s_order][:-1])
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    n_lines = lines[offs[1:]] - lines[offs[:-1]] + 1
    return np.column_stack([
        np.log1p(n), mean, np.sqrt(np.maximum(0, share(size**2) - mean**2)), bytes_where(upper) / np.maximum(1e-9, bytes_where(letter)),
        share((in_word["upper"] > 1) & (in_word["low"] == 0)), bytes_where(digit), bytes_where(odd), share(in_word["odd"] > 0),
        bytes_where(data == 124), bytes_where(data == 33), share(again), np.bincount(doc[order], fresh, docs) / np.maximum(1, n), top / np.maximum(1, n),
        n / sentences, np.bincount(s_doc, closed, docs) / sentences, n / n_lines, np.bincount(s_doc[s_order], s_fresh, docs) / sentences,
        bytes_where(data >= 128), share(size <= 3), share(size >= 14),
    ]) * (n > 0)[:, None]


class Model(NamedTuple):
    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of label 1 of each row of features."""
        f = np.full(len(x), self.base)
        for j, (edge, table) in enumerate(zip(self.edges, self.tables)):
            f += table[np.searchsorted(edge, x[:, j], "right")]
        coarse = {j: np.searchsorted(self.pair_edges[j], x[:, j], "right") for pair in self.pairs for j in pair}
        for (i, j), table in zip(self.pairs, self.pair_tables):
            f += table[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def _split(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Leaf value per bin of a shallow tree that splits the bins in order."""
    total = -g.sum() / (h.sum() + 1.0)
    if depth == 0 or len(g) < 2:
        return np.full(len(g), total)
    cg, ch = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = cg**2 / (ch + 1) + (g.sum() - cg) ** 2 / (h.sum() - ch + 1)
    at = int(np.argmax(gain)) + 1
    if gain[at - 1] <= g.sum() ** 2 / (h.sum() + 1) + 1e-9:
        return np.full(len(g), total)
    return np.concatenate([_split(g[:at], h[:at], depth - 1), _split(g[at:], h[at:], depth - 1)])


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """Boosts the tables; without rows of both labels every score is the smoothed share of label 1."""
    k = len(FEATURES)
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    edges, pair_edges = [_edges(x[:, j], BINS) for j in range(k)], [_edges(x[:, j], PAIR_BINS) for j in range(k)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    if len(y) == 0 or y.min() == y.max():
        return Model(base, edges, tables, [], pair_edges, [])
    bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]
    f = np.full(len(y), base)
    for _ in range(ROUNDS):
        for j in range(k):
            p = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
            m = len(tables[j])
            step = RATE * _split(np.bincount(bins[j], p - y, m), np.bincount(bins[j], p * (1 - p), m), 2)
            tables[j] += step
            f += step[bins[j]]
    coarse = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(pair_edges)]
    size = [len(e) + 1 for e in pair_edges]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        cell = coarse[i] * size[j] + coarse[j]
        return cell, np.bincount(cell, p - y, size[i] * size[j]), np.bincount(cell, p * (1 - p), size[i] * size[j])

    def worth(i: int, j: int) -> float:
        _, g, h = grid(i, j)
        return float((g**2 / (h + 1)).sum())

    pairs = sorted(((i, j) for j in range(k) for i in range(j)), key=lambda p: -worth(*p))[:PAIRS]
    pair_tables = [np.zeros((size[i], size[j])) for i, j in pairs]
    for _ in range(PAIR_ROUNDS):
        for t, (i, j) in enumerate(pairs):
            cell, g, h = grid(i, j)
            g, h = g.reshape(size[i], size[j]), h.reshape(size[i], size[j])
            # A two-way tree: a split of the rows, then of the columns within each side.
            rows = _split(g.sum(axis=1), h.sum(axis=1), 1)
            step = np.zeros_like(g)
            for v in np.unique(rows):
                side = rows == v
                step[side] = _split(g[side].sum(axis=0), h[side].sum(axis=0), 1)
            pair_tables[t] += RATE * step
            f += RATE * step.ravel()[cell]
    return Model(base, edges, tables, pairs, pair_edges, pair_tables)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    only("powers")
    for batch in batches:
        for part in slices(batch, "text"):
            x = measure(*text_buffers(part.column("text")))
            yield pa.record_batch([part.column("doc_id"), part.column("quality"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "quality", "x"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns ``quality`` (0 or 1) from at most ``sample`` labelled documents outside the held-out fold; repeated labels count once."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & (fold != 0))
    some = hash_sample(labels, ["doc_id", "quality"], ["doc_id"], sample)
    docs = texts(docs)
    # At most ``sample`` rows of 12 bytes, whatever the input's size.
    rows = docs.join(F.broadcast(some), "doc_id").mapInArrow(_measured, "doc_id long, quality int, x array<double>")
    # Of rows that repeat a doc_id one counts, the one with the smallest features, so at most ``sample`` rows come back.
    got = rows.groupBy("doc_id", "quality").agg(F.min("x").alias("x")).orderBy("doc_id", "quality").collect()
    x = np.array([r.x for r in got]).reshape(-1, len(FEATURES))
    return train(x, np.array([r.quality for r in got], float))


def _scored(model: Model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("powers")
        for batch in batches:
            for part in slices(batch, "text"):
                score = model.score(measure(*text_buffers(part.column("text"))))
                yield part.append_column("quality_score", pa.array(score)).append_column("quality_kept", pa.array(score >= threshold))

    return run


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``docs`` with quality_score (0 to 1, higher is better) and quality_kept (score >= threshold).

    Columns of these names are replaced.  A null or empty text is scored like any other, on zeros.
    Needs a ``text`` column only; every other column and every row stays.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.drop("quality_score", "quality_kept").withColumn("text", F.col("text").cast("string"))
    schema = StructType(list(docs.schema.fields)).add("quality_score", "double").add("quality_kept", "boolean")
    return docs.mapInArrow(_scored(model, threshold), schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted.  A null doc_id is in no fold, so held_out is false."""
    out = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels), threshold)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    return out.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_kept").cast("int").alias("predicted"))
