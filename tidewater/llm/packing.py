"""Best-fit packing by patterns: non-negative least squares on the length histogram.

Texts become pieces of at most ``size`` tokens.  Only the histogram of piece lengths (at most
``size`` numbers) reaches the driver.  There, patterns of one to three lengths that fill a sequence
exactly are enumerated, non-negative repeat counts are fitted to the histogram by accelerated
projected gradient descent, rounded, and applied largest first; what remains is packed best-fit
decreasing, whole groups of equal sequences at a time.  The plan lists runs of equal slots, so its
size depends on ``size`` and not on the corpus.  Pieces find their slots by rank among pieces
of their length: rank within the task that made them, plus the counts of the tasks before it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import ids_of, materialise, only, slices, text_buffers, texts
from tidewater.llm.tokens import SLICE, default_path, encoder

#: Third-length choices tried for each first length.
PARTNERS = 12
STEPS = 400


def patterns(hist: np.ndarray, size: int, partners: int = PARTNERS) -> np.ndarray:
    """Rows of three lengths (0: none) that add up to ``size``, each length present in the histogram."""
    have = np.flatnonzero(hist[:size])
    have = have[have > 0]
    out = {(0, 0, size)} if hist[size] else set()
    here = set(have.tolist())
    out |= {(0, a, size - a) for a in here if a <= size - a and size - a in here}
    for a in have.tolist():
        rest = have[(have >= a) & (have <= (size - a) // 2)]
        fits = rest[np.isin(size - a - rest, have)]
        if len(fits):
            take = np.unique(np.linspace(0, len(fits) - 1, min(partners, len(fits))).round().astype(int))
            out |= {(a, b, size - a - b) for b in fits[take].tolist()}
    return np.array(sorted(out), np.int64).reshape(-1, 3)


def fit(hist: np.ndarray, pats: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the squared difference of the patterns' lengths from the histogram."""
    h = hist.astype(float).copy()
    h[0] = 0
    flat = pats.ravel()

    def made(x: np.ndarray) -> np.ndarray:
        y = np.bincount(flat, np.repeat(x, 3), len(h))
        y[0] = 0
        return y

    def back(r: np.ndarray) -> np.ndarray:
        r[0] = 0
        return r[pats].sum(axis=1)

    v = np.ones(len(pats))
    for _ in range(20):  # the largest eigenvalue gives the step
        v = back(made(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(pats))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(made(y) - h) / (1.05 * top))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        x, y, t = new, new + (t - 1) / t2 * (new - x), t2
    return x


def plan(hist: np.ndarray, size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(sequences, [(length, times)]) groups that hold every piece of the histogram once."""
    left = hist.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[int, list[tuple[int, int]]]] = []
    if len(pats := patterns(left, size)):
        x = fit(left, pats)
        for i in np.argsort(-x, kind="stable").tolist():
            parts: dict[int, int] = {}
            for a in pats[i].tolist():
                if a:
                    parts[a] = parts.get(a, 0) + 1
            k = min(int(x[i] + 0.5), *(int(left[a]) // m for a, m in parts.items()))
            if k <= 0:
                continue
            for a, m in parts.items():
                left[a] -= k * m
            out.append((k, list(parts.items())))
    # Residuals: best fit, decreasing; groups of sequences that are filled alike, by room left.
    room: list[list] = [[] for _ in range(size + 1)]
    some = np.zeros(size + 1, bool)

    def put(k: int, parts: list, free: int) -> None:
        if k:
            room[free].append((k, parts))
            some[free] = True

    for a in range(size, 0, -1):
        c = int(left[a])
        while c:
            free = a + int(np.argmax(some[a:]))
            if some[free]:
                g, parts = room[free].pop()
                some[free] = bool(room[free])
            else:
                g, parts, free = -(-c // (size // a)), [], size
            each = min(free // a, c)
            k = min(g, c // each)
            put(g - k, parts, free) if parts else None
            put(k, [*parts, (a, each)], free - each * a)
            c -= k * each
    for groups in room:
        out += groups
    return out


def slots(groups: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, times in a sequence, first sequence, offset), by length and rank."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for k, parts in groups:
        offset = 0
        for a, m in parts:
            rows.append((a, used.get(a, 0), m, sequence, offset))
            used[a] = used.get(a, 0) + k * m
            offset += a * m
        sequence += k
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _pieces(tokenizer: str, size: int):
    names = ["task", "doc_id", "piece", "start", "length", "ids_crc32", "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("tokens", "powers")
        from pyspark import TaskContext

        task, counts, start = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64), 0
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids, ok = ids_of(part.column("doc_id"))
                flat, offs = encoder(tokenizer).encode(*text_buffers(part.column("text")))
                rows = []
                for doc, good, a, b in zip(ids.tolist(), ok.tolist(), offs.tolist(), offs[1:].tolist()):
                    first = (b - a - 1) % size + 1  # the first piece is the one that may be shorter
                    at = a
                    for piece, to in enumerate(range(a + first, b + 1, size)):
                        n = to - at
                        rows.append((doc if good else None, piece, at - a, n, zlib.crc32(flat[at:to].tobytes()), int(counts[n])))
                        counts[n] += 1
                        at = to
                cols = list(zip(*rows))
                yield pa.record_batch([pa.array([task] * len(rows), pa.int64()), *(pa.array(c, pa.int64()) for c in cols)], names)

    return run


def _place(runs: np.ndarray):
    step = int(runs[:, 1].max()) + 2 if len(runs) else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("tokens", "powers")
        key = runs[:, 0].astype(object) * step + runs[:, 1] if step > 1 << 50 else runs[:, 0] * step + runs[:, 1]
        for batch in batches:
            length, rank = np.asarray(batch.column("length")), np.asarray(batch.column("rank")) + np.asarray(batch.column("before"))
            # A rank beyond the last run's first one belongs to that run.
            r = runs[np.searchsorted(key, length * step + np.minimum(rank, step - 1), "right") - 1] if len(length) else np.zeros((0, 5), np.int64)
            k = rank - r[:, 1]
            yield pa.record_batch(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(r[:, 3] + k // np.maximum(1, r[:, 2])), pa.array(r[:, 4] + k % np.maximum(1, r[:, 2]) * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, size: int = 2048, tokenizer: str | None = None) -> DataFrame:
    """A row per piece of every row of ``docs`` (doc_id, text; other columns are ignored): doc_id,
    piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece, its end id.  Null and repeated doc_ids are packed like any
    other.  Documents longer than ``size`` are cut so that only the first piece is shorter.
    """
    docs = texts(docs)
    schema = "task long, doc_id long, piece int, start long, length long, ids_crc32 long, rank long"
    pieces = docs.mapInArrow(_pieces(tokenizer or default_path(), size), schema.replace("piece int", "piece long"))
    pieces = materialise(pieces, "pieces")
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    hist = np.zeros(size + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # a row per length at most
        hist[length] = n
    runs = slots(plan(hist, size))
    w = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("task", "length", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    rows = pieces.join(before, ["task", "length"])
    out = rows.mapInArrow(_place(runs), "doc_id long, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumn("piece", F.col("piece").cast("int"))
