"""URL filter: rules by host and path, then logistic regression on hashed character n-grams.

Rules are few and compared in the plan.  The regression reads the n-grams of host and path, hashed to
``2**BITS`` weights, and is trained from a small labelled table; by default that is a bounded sample of the
urls that the rules judge, so the model carries the rules' taste to hosts they don't name.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import hash_sample, text_buffers
from tidewater.llm.kernels import BYTES, U, mix, range_hash

BITS = 16
GRAMS = (3, 4, 5)
#: Most labelled urls that training uses.
SAMPLE = 5_000
EPOCHS, RATE, RIDGE = 30, 0.5, 1e-6


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): between the first :// and /, ?, # or the end, A-Z lower-cased; then up to ?, # or the end."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judged(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Adds host, path, rule (the longest that fits, else null) and ruled (its verdict, else null)."""
    host, path = parts(F.col("url"))
    out = pages.withColumn("host", host).withColumn("path", path)
    hit = text = None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        hit = F.when(fits, r.verdict) if hit is None else hit.when(fits, r.verdict)
        text = F.when(fits, r.text) if text is None else text.when(fits, r.text)
    null = F.lit(None).cast("string")
    return out.withColumn("rule", null if text is None else text).withColumn("ruled", null if hit is None else hit)


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Weight numbers of all n-grams of all texts and the number of the text of each."""
    data, offs = text_buffers(texts)
    wide = data.astype(U) + U(1)
    at, of = [], []
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    left = offs[1:][doc] - np.arange(len(data))
    for n in GRAMS:
        start = np.flatnonzero(left >= n)
        at.append(range_hash(wide, start, start + n, BYTES))
        of.append(doc[start])
    # Host and path are told apart by a byte between them, so no n-gram mistakes one for the other.
    return (mix(np.concatenate(at)) >> U(64 - BITS)).astype(np.int64), np.concatenate(of)


class Model(NamedTuple):
    weights: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        at, of = grams(texts)
        n = np.maximum(1, np.bincount(of, minlength=len(texts)))
        return self.bias + np.bincount(of, self.weights[at], len(texts)) / np.sqrt(n)


def train(texts: Sequence[str], labels: Sequence[int]) -> Model:
    """Adagrad on all rows at once; label 1 is block.  Without both labels the bias alone decides."""
    y = np.array(labels, float)
    w, bias = np.zeros(1 << BITS), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    if len(y) and y.min() < y.max():
        at, of = grams(pa.array(texts, pa.string()))
        scale = 1 / np.sqrt(np.maximum(1, np.bincount(of, minlength=len(y))))
        past, past_bias = np.full(len(w), 1e-8), 1e-8
        for _ in range(EPOCHS):
            z = bias + np.bincount(of, w[at], len(y)) * scale
            r = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
            g = np.bincount(at, (r * scale)[of], len(w)) + RIDGE * w
            past += g * g
            w -= RATE * g / np.sqrt(past)
            past_bias += r.sum() ** 2
            bias -= RATE * r.sum() / past_bias**0.5
    return Model(w, bias)


def fit(pages: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from at most ``sample`` of the distinct judged rows (host, path, ruled), chosen by a hash of the url."""
    rows = hash_sample(pages.where("ruled is not null"), ["host", "path", "ruled"], ["host", "path"], sample).collect()
    return train([f"{r.host}\x00{r.path}" for r in rows], [int(r.ruled == "block") for r in rows])


def _verdicts(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            host, path, ruled = (batch.column(c).to_pylist() for c in ("host", "path", "ruled"))
            z = model.score(pa.array([f"{h}\x00{p}" for h, p in zip(host, path)]))
            verdict = [r or ("block" if s > 0 else "allow") for r, s in zip(ruled, z.tolist())]
            yield pa.record_batch([batch.column("page_id"), batch.column("host"), batch.column("path"), batch.column("rule"), pa.array(verdict, pa.string()), pa.array(z)], ["page_id", "host", "path", "rule", "verdict", "log_odds"])

    return run


def url_filter(pages: DataFrame, rules: Sequence[Rule], model: Model | None = None, labelled: DataFrame | None = None) -> DataFrame:
    """Per row of ``pages`` (page_id, url; other columns are ignored): page_id, host, path, rule, verdict, log_odds.

    ``labelled`` is a small table of url and ruled (allow or block); without it and without a model,
    the rows of ``pages`` that a rule judges serve.  A null url, or one without ``://``, has an empty host and
    path and is judged like any other; null and repeated page_ids are kept.
    """
    rows = judged(pages.select("page_id", F.col("url").cast("string").alias("url")), rules)
    if model is None and labelled is not None:
        host, path = parts(F.col("url").cast("string"))
        model = fit(labelled.select(host.alias("host"), path.alias("path"), "ruled"))
    model = model or fit(rows)
    kind = dict(rows.dtypes)["page_id"]
    return rows.drop("url").mapInArrow(_verdicts(model), f"page_id {kind}, host string, path string, rule string, verdict string, log_odds double")
