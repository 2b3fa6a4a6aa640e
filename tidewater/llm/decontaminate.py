"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Test items are short and documents long, so the containment threshold becomes a Jaccard threshold
only between sets of like size.  The items are therefore partitioned by size (intervals that
double); for an interval with items of at most ``u`` shingles a document is read as overlapping
windows of ``2u`` shingles that start every ``u``, so an occurrence of an item lies in one window.
Each window's and item's MinHash values are compared one by one (bands of one row), which finds
a pair of Jaccard similarity j with probability ``1 - (1 - j)**hashes``; at the lowest similarity
that the interval allows that is over 0.9999.  Candidate pairs are then checked by the exact share
of the item's shingles that the whole document holds.

Items are read to the driver in blocks of at most ``block`` items and ``BLOCK_BYTES`` of text; each block's sketches go
to the workers and its pairs are written before the next block is read.  So one block is alive at a
time however long the table of items is, and each takes one scan of the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import ids_of, materialise, only, slices, text_buffers, texts
from tidewater.llm.kernels import U, Words, mix

#: MinHash functions.
HASHES = 48
#: Items whose sketches are sent to the workers at a time.
BLOCK = 20_000
#: Bytes of item text in a block (a longer item goes alone).
BLOCK_BYTES = 32 << 20


class Index:
    """MinHash values and shingle sets of a block of items, by size interval and shingle width."""

    def __init__(self, items: list[tuple[int, str | None]], width: int, hashes: int, num: int, den: int):
        self.width, self.num, self.den = width, num, den
        self.seeds = mix(np.arange(1, hashes + 1, dtype=U) * U(0x9E3779B97F4A7C15))
        self.ids = [i for i, _ in items]
        self.sets: list[np.ndarray] = []
        self.widths: list[int] = []
        self.parts: dict[tuple[int, int], list[int]] = {}
        for k, (_, text) in enumerate(items):
            words = Words(*text_buffers(pa.array([text or ""])))
            n = len(words.hash)
            # An item of fewer words than the width is sought as one run of just its words.
            w = min(width, n)
            s = np.unique(words.shingles(w)[0]) if n else np.zeros(0, U)
            self.sets.append(s)
            self.widths.append(w)
            if n:
                self.parts.setdefault((w, max(2, 1 << (len(s) - 1).bit_length())), []).append(k)
        self.tables = {}
        for key, members in self.parts.items():
            per_hash = []
            for seed in self.seeds:
                low = np.array([mix(self.sets[k] ^ seed).min() for k in members], U)
                order = np.argsort(low, kind="stable")
                per_hash.append((low[order], np.array(members)[order]))
            self.tables[key] = per_hash

    def matches(self, words: Words) -> list[tuple[int, int, float]]:
        """(document of the slice, item, containment) of every verified pair."""
        found: set[tuple[int, int]] = set()
        flats = {w: words.shingles(w) for w in {w for w, _ in self.tables}}
        for (w, u), table in self.tables.items():
            flat, offs = flats[w]
            if not len(flat):
                continue
            size = np.diff(offs)
            blocks = -(-size // u)
            doc = np.repeat(np.arange(len(size)), blocks)
            first = np.concatenate([[0], np.cumsum(blocks)])
            start = offs[:-1][doc] + (np.arange(first[-1]) - first[:-1][doc]) * u
            last = np.ones(len(doc), bool)
            last[:-1] = doc[1:] != doc[:-1]
            for seed, (low, members) in zip(self.seeds, table):
                m = np.minimum.reduceat(mix(flat ^ seed), start)
                pair = m.copy()
                pair[:-1] = np.where(last[:-1], m[:-1], np.minimum(m[:-1], m[1:]))
                at = np.searchsorted(low, pair)
                hit = np.flatnonzero(low[np.minimum(at, len(low) - 1)] == pair)
                for x in hit.tolist():
                    p = int(at[x])
                    while p < len(low) and low[p] == pair[x]:
                        found.add((int(doc[x]), int(members[p])))
                        p += 1
        out, sets = [], {}
        for d, k in sorted(found):
            item = self.sets[k]
            w = self.widths[k]
            if (d, w) not in sets:
                flat, offs = flats[w]
                sets[d, w] = np.unique(flat[offs[d] : offs[d + 1]])
            share = int(np.isin(item, sets[d, w], assume_unique=True).sum())
            if self.den * share >= self.num * len(item):
                out.append((d, k, share / len(item)))
        return out


def _search(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("powers")
        for batch in batches:
            for part in slices(batch, "text"):
                ids, ok = ids_of(part.column("doc_id"))
                got = [x for x in index.matches(Words(*text_buffers(part.column("text")))) if ok[x[0]]]
                yield pa.record_batch(
                    [pa.array([int(ids[d]) for d, _, _ in got], pa.int64()), pa.array([index.ids[k] for _, k, _ in got], pa.int64()), pa.array([c for _, _, c in got], pa.float64())],
                    ["doc_id", "item_id", "containment"],
                )

    return run


def contained_items(docs: DataFrame, items: DataFrame, width: int = 5, num: int = 80, den: int = 100, hashes: int = HASHES, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, containment) for every item of which a document holds num/den or more of the shingles.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are ignored.  An item of
    fewer than ``width`` words is sought as a run of just those words; null or wordless items and
    texts match nothing, and a null doc_id or item_id takes no part.  Repeated rows give one pair
    (the larger containment).  Words are compared with A-Z lower-cased.
    """
    docs = texts(docs)
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    schema = "doc_id long, item_id long, containment double"
    found = None
    for some in _blocks(items.toLocalIterator(), block):
        # Written at once, so the next block's index replaces this one's in the driver and the workers.
        got = materialise(docs.mapInArrow(_search(Index(some, width, hashes, num, den)), schema), "matches")
        found = got if found is None else found.union(got)
    if found is None:
        return docs.sparkSession.createDataFrame([], schema)
    return found.groupBy("doc_id", "item_id").agg(F.max("containment").alias("containment"))


def _blocks(rows: Iterator, most: int) -> Iterator[list[tuple[int, str]]]:
    some, size = [], 0
    for r in rows:
        if some and (len(some) >= most or size + len(r.text) > BLOCK_BYTES):
            yield some
            some, size = [], 0
        some.append((r.item_id, r.text))
        size += len(r.text)
    if some:
        yield some
