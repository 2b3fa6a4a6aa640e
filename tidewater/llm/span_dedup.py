"""Substring dedup by sliding sentence spans.

From every sentence every run of 1, 2, .. sentences that holds as many words as ``least`` asks of its
length is hashed to 128 bits: the query takes every run of three, and two or one once they are long, so a
long passage without full stops is also a span.  Spans meet globally by hash; the first occurrence
(smallest doc_id, then position) stays, and every sentence that a later occurrence covers is removed.

A task keeps only its first occurrence of a span for the global comparison, since its later ones
are known not to be first; so a span that a third of all documents hold reaches its reducer once
per task.  Later ones travel under a spread-out key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import ids_of, only, slices, text_buffers, texts
from tidewater.llm.kernels import U, Words, mix, range_hash

_R1, _R2 = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB  # odd multipliers of the two span hashes
#: Words that a run of 1, 2, 3 sentences holds at least to be a span of the query.
LEAST = (40, 18, 0)
#: Spans a task holds before it passes them on.
HELD = 1 << 20


def spans_of(words: Words, run: int, long_words: int, least: Sequence[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first sentence, sentences, hash, hash) of every span of a slice's documents."""
    start, end, of = words.sentences()
    doc = np.repeat(np.arange(len(of) - 1), np.diff(of))
    first = np.arange(len(start))
    last = of[1:][doc] if len(doc) else first
    if least is None:
        size = np.full(len(start), run)
        for k in range(run - 1, 0, -1):
            to = np.minimum(first + k, last)
            size[end[to - 1] - start >= long_words] = k
        good = first + size <= last
        first, size, doc = first[good], size[good], doc[good]
    else:
        found = []
        for k, bound in enumerate(least, 1):
            at = np.flatnonzero(first + k <= last)
            found.append(at[end[at + k - 1] - start[at] >= bound])
        size = np.repeat(np.arange(1, len(found) + 1), [len(at) for at in found])
        first = np.concatenate(found)
        doc = doc[first]
    a, b = start[first], end[first + size - 1]
    return doc, first - of[:-1][doc], size, range_hash(words.hash, a, b, _R1), range_hash(words.hash, a, b, _R2)


def _spans(run: int, long_words: int, least: Sequence[int] | None):
    names = ["key", "h1", "h2", "doc_id", "pos", "size", "later"]

    def flush(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        h1, h2, doc, pos, size = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.lexsort((pos, doc, h2, h1))
        h1, h2, doc, pos, size = (x[order] for x in (h1, h2, doc, pos, size))
        later = np.zeros(len(h1), bool)
        later[1:] = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
        # Rows equal in all are one document's row given twice.
        same = later.copy()
        same[1:] &= (doc[1:] == doc[:-1]) & (pos[1:] == pos[:-1])
        later &= ~same
        key = np.where(later, mix(doc.view(U) ^ mix(pos.view(U))), h1).view(np.int64)
        cols = [key, h1.view(np.int64), h2.view(np.int64), doc, pos, size.astype(np.int32), later]
        out = pa.record_batch([pa.array(c[~same]) for c in cols], names)
        # The JVM holds a batch as a whole, so it gets small ones.
        for at in range(0, out.num_rows, 1 << 15):
            yield out.slice(at, 1 << 15)

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("powers")
        held, n = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(*text_buffers(part.column("text")))
                doc, first, size, h1, h2 = spans_of(words, run, long_words, least)
                ids, ok = ids_of(part.column("doc_id"))
                tag = np.asarray(part.column("tag"))
                good = ok[doc]
                doc, first, size, h1, h2 = (x[good] for x in (doc, first, size, h1, h2))
                held.append((h1, h2, ids[doc], tag[doc] + first, size))
                n += len(first)
                if n > HELD:
                    yield from flush(held)
                    n = 0
        if n:
            yield from flush(held)

    return run_


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From spans sorted by (key, h1, h2, later, doc_id, pos): those that aren't first."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc, pos, later = (np.asarray(batch.column(c)) for c in ("h1", "h2", "doc_id", "pos", "later"))
        out = later.copy()
        equal = np.zeros(len(h1), bool)
        equal[1:] = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
        whole = equal.copy()
        whole[1:] &= (doc[1:] == doc[:-1]) & (pos[1:] == pos[:-1])
        # A span's first occurrence given again, by a repeated row, is still the first.
        lead = np.flatnonzero(~equal)
        if last is not None and not later[0] and (h1[0], h2[0]) == last[:2]:
            equal[0] = True
        head = np.maximum.accumulate(np.where(equal, 0, np.arange(len(h1))))
        first_doc, first_pos = doc[head], pos[head]
        if equal[0]:
            stop = lead[1] if len(lead) > 1 else len(h1)
            first_doc, first_pos = first_doc.copy(), first_pos.copy()
            first_doc[:stop], first_pos[:stop] = last[2], last[3]
        out |= equal & ((doc != first_doc) | (pos != first_pos))
        if not later[-1]:
            last = (h1[-1], h2[-1], first_doc[-1], first_pos[-1])
        picked = np.flatnonzero(out)
        yield batch.select(["doc_id", "pos", "size"]).take(pa.array(picked))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    only("powers")
    for batch in batches:
        for part in slices(batch, "text"):
            words = Words(*text_buffers(part.column("text")))
            start, end, of = words.sentences()
            data, offs = text_buffers(part.column("text"))
            covers, tags = part.column("covers").to_pylist(), part.column("tag").to_pylist()
            texts, count, gone, at = part.column("text").to_pylist(), [], [], []
            for i in range(part.num_rows):
                n = int(of[i + 1] - of[i])
                cover = np.zeros(n + 1, np.int64)
                for c in covers[i] or ():
                    p = c["pos"] - tags[i]
                    if 0 <= p < n:  # else it is of another text with this doc_id
                        cover[p] += 1
                        cover[min(n, p + c["size"])] -= 1
                drop = np.cumsum(cover[:n]) > 0
                count.append(n)
                gone.append(int(drop.sum()))
                at.append(np.flatnonzero(drop).tolist())
                if drop.any():
                    a = words.start[start[of[i] : of[i + 1]]].tolist()
                    ends = [*a[1:], int(offs[i + 1])]
                    raw = data[offs[i] : a[0]].tobytes() + b"".join(data[x:y].tobytes() for x, y, d in zip(a, ends, drop) if not d)
                    texts[i] = raw.decode().rstrip() if drop[-1] else raw.decode()
            yield pa.record_batch(
                [part.column("doc_id"), pa.array(texts, pa.string()), pa.array(count, pa.int64()), pa.array(gone, pa.int64()), pa.array(at, pa.list_(pa.int64()))],
                ["doc_id", "text", "n_sentences", "n_removed", "removed"],
            )


def span_dedup(docs: DataFrame, run: int = 3, long_words: int = 40, least: Sequence[int] | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, text without the
    removed sentences, n_sentences before, n_removed, and removed, the numbers of those sentences from 0.

    ``least`` gives the least words of runs of 1, 2, .. sentences; every run that holds them is a span.  Without
    it each sentence begins one span only: the shortest run that holds ``long_words`` words, else
    ``run`` sentences; what follows such a shorter run in a repeated passage may then stay.

    A null or empty text has no sentences and stays as it is.  A null doc_id takes no part and its
    text stays.  Texts that share a doc_id are ordered by a hash of the text; rows equal in both
    are one document and are all treated alike.  A document of which everything is removed stays
    as a row with an empty text.
    """
    docs = texts(docs)
    # Positions of different texts with one doc_id don't meet: the upper bits come from the text.
    docs = docs.withColumn("tag", F.shiftleft(F.xxhash64("text").bitwiseAND(F.lit(0x3FFFFFFF)), 32))
    spans = docs.mapInArrow(_spans(run, long_words, least), "key long, h1 long, h2 long, doc_id long, pos long, size int, later boolean")
    dealt = spans.repartition("key").sortWithinPartitions("key", "h1", "h2", "later", "doc_id", "pos")
    later = dealt.mapInArrow(_later, "doc_id long, pos long, size int")
    covers = later.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "size")).alias("covers"))
    return docs.join(covers, "doc_id", "left").mapInArrow(_cut, "doc_id long, text string, n_sentences long, n_removed long, removed array<long>")
