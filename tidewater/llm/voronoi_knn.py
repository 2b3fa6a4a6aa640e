"""Exact top-k search by inner product as a Voronoi kNN join.

Vectors become integers ``floor(scale * x)``.  Pivots (a sample of distinct vectors, about a quarter of the
square root of their number) split data and queries into cells; a cell's summary holds its size and the
largest distance R of its vectors from its pivot p.  As ``q.x = q.p + q.(x - p)`` lies within ``|q| R`` of
``q.p``, the summaries give each query a score that its k-th best surely reaches, and an upper bound for every
cell.  Queries form groups by cell, and a part of a cell's data is copied to a group only if some query of the
group might find a result there.  Copies are searched locally, in two steps: first each query's most
promising cell, whose k-th score sharpens the bound, then what the bound leaves.  Cells and groups are cut into
blocks of at most about ``BLOCK`` rows, so a task multiplies bounded matrices even if a third of all
vectors are the same.

Products are taken in doubles where all sums stay below 2**53, so that they are exact, and in integers elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import discard, hash_sample, materialise

#: Most pivots: a bound on what the driver and each task hold (with 1,024 components 32 MB), not on the data.
PIVOTS = 4096
#: About the most rows of either side in a unit of work.
BLOCK = 2048


def quantised(column: pa.Array, scale: int) -> tuple[list[bytes | None], list[int]]:
    """floor(scale * x) as int32 bytes (as doubles where one does not fit) and the length; None where the vector or a component is null or not finite."""
    out: list[bytes | None] = []
    size = []
    for v in column:
        row = v.values if v.is_valid else None
        x = None
        if row is not None and not row.null_count:
            x = np.asarray(row).astype(float)
            if np.isfinite(x).all():
                with np.errstate(over="ignore"):
                    x = np.floor(scale * x)
                if not np.isfinite(x).all():
                    raise ValueError(f"a component times {scale} does not fit a double")
                x = x.astype("<i4" if np.abs(x).max(initial=0) < 1 << 31 else "<f8")
            else:
                x = None
        out.append(None if x is None else x.tobytes())
        size.append(0 if x is None else len(x))
    return out, size


def _quantise(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec, size = quantised(batch.column("embedding"), scale)
            yield pa.record_batch([batch.column("vec_id"), pa.array(vec, pa.binary()), pa.array(size, pa.int64())], ["vec_id", "vec", "size"])

    return run


class Vectors:
    """Vectors as double matrices, one for each length, so that no vector is padded to another's length."""

    def __init__(self, vec: list[bytes], size: list[int]):
        self.n, self.parts = len(vec), []
        kinds = np.array([(len(v) // max(1, z), z) for v, z in zip(vec, size)], np.int64).reshape(-1, 2)
        for width, length in sorted(set(map(tuple, kinds.tolist()))):
            at = np.flatnonzero((kinds == (width, length)).all(axis=1))
            rows = np.frombuffer(b"".join(vec[i] for i in at), f"<{'i' if width == 4 else 'f'}{width}").reshape(-1, length).astype(float)
            self.parts.append((at, rows))
        self.norm = np.zeros(self.n)
        for at, rows in self.parts:
            self.norm[at] = np.sqrt((rows**2).sum(axis=1))

    @classmethod
    def of(cls, batch: pa.RecordBatch | pa.Table) -> Vectors:
        return cls(batch.column("vec").to_pylist(), batch.column("size").to_pylist())

    def dot(self, other: Vectors) -> np.ndarray:
        """All inner products in doubles; a component that one vector lacks counts as 0."""
        out = np.zeros((self.n, other.n))
        for i, a in self.parts:
            for j, b in other.parts:
                d = min(a.shape[1], b.shape[1])
                out[np.ix_(i, j)] = a[:, :d] @ b[:, :d].T
        return out

    def exact(self, other: Vectors) -> np.ndarray:
        """All inner products as integers: int64, or Python integers where a sum may pass 2**53."""
        # |a.b| and all partial sums stay below |a||b| sqrt(d); a margin of two covers the norms' rounding.
        d = max([1, *(min(a.shape[1], b.shape[1]) for _, a in self.parts for _, b in other.parts)])
        top = other.norm.max(initial=0)
        safe = 2 * self.norm * top * d**0.5 < 2.0**53
        with np.errstate(all="ignore"):
            near = self.dot(other)
        if safe.all():
            return near.astype(np.int64)
        out = np.zeros((self.n, other.n), object)
        out[safe] = near[safe].astype(np.int64).astype(object)
        left, right = self._integers(~safe), other._integers(np.ones(other.n, bool))
        for i, a in left:
            for j, b in right:
                out[i, j] = sum(x * y for x, y in zip(a, b))
        return out

    def _integers(self, some: np.ndarray) -> list[tuple[int, list[int]]]:
        return [(int(i), [int(x) for x in row]) for at, rows in self.parts for i, row in zip(at, rows) if some[i]]


def _cells(pivots: Vectors):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = Vectors.of(batch)
            with np.errstate(all="ignore"):
                squares = np.nan_to_num(pivots.norm[None, :] ** 2 - 2 * x.dot(pivots), nan=np.inf, posinf=np.inf, neginf=-np.inf)
                cell = np.argmin(squares, axis=1)
                # Rounded up by more than the sums can be off.
                both = x.norm**2 + pivots.norm[cell] ** 2
                far = np.sqrt(np.maximum(0, squares[np.arange(x.n), cell] + x.norm**2) + 1e-9 * both)
            yield pa.record_batch([batch.column("vec_id"), batch.column("vec"), batch.column("size"), pa.array(cell, pa.int64()), pa.array(np.nan_to_num(far, nan=np.inf, posinf=np.inf))], ["vec_id", "vec", "size", "cell", "far"])

    return run


def _routes(pivots: Vectors, size: np.ndarray, reach: np.ndarray, k: int, first: bool):
    """Cells a query has to visit: the most promising one (first), or all others its bound leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q = Vectors.of(batch)
            with np.errstate(all="ignore"):
                mid = q.dot(pivots)
                slack = q.norm[:, None] * reach[None, :] * (1 + 1e-9) + 1e-9 * q.norm[:, None] * pivots.norm[None, :] + 1e-6
                upper = np.where(size > 0, np.nan_to_num(mid + slack, nan=np.inf, posinf=np.inf), -np.inf)
                lower = np.where(size > 0, np.nan_to_num(mid - slack, nan=-np.inf, neginf=-np.inf), -np.inf)
            best = np.argmax(np.where(size > 0, np.nan_to_num(mid), -np.inf), axis=1)
            if first:
                rows, cells = np.arange(q.n), best
                bound = np.full(q.n, -np.inf)
            else:
                order = np.argsort(-lower, axis=1)
                # One more than k, as the query's own vector may be among them.
                enough = np.argmax(np.cumsum(size[order], axis=1) >= k + 1, axis=1)
                bound = np.where(size.sum() >= k + 1, np.take_along_axis(lower, np.take_along_axis(order, enough[:, None], 1), 1)[:, 0], -np.inf)
                bound = np.maximum(bound, np.asarray(batch.column("bound")))
                visit = (upper >= bound[:, None]) & (size > 0)
                visit[np.arange(q.n), best] = False
                rows, cells = np.nonzero(visit)
            take = pa.array(rows)
            yield pa.record_batch(
                [*(batch.column(c).take(take) for c in ("vec_id", "vec", "size", "group")), pa.array(cells, pa.int64()), pa.array(bound[rows])],
                ["query_id", "vec", "size", "group", "cell", "bound"],
            )

    return run


def _local(k: int):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            right = right.sort_by("vec_id")
            ids, data = np.asarray(right.column("vec_id")), Vectors.of(right)
            for at in range(0, left.num_rows, 256):
                part = left.slice(at, 256)
                scores = Vectors.of(part).exact(data)
                for q, bound, s in zip(part.column("query_id").to_pylist(), part.column("bound").to_pylist(), scores):
                    ok = np.flatnonzero((s >= bound) & (ids != q))
                    if len(ok) > k:
                        least = np.partition(s[ok], len(ok) - k)[len(ok) - k]
                        ok = np.concatenate([ok[s[ok] > least], ok[s[ok] == least][:k]])
                    top = ok[np.argsort(-s[ok], kind="stable")][:k]
                    out += [(q, int(ids[i]), int(s[i])) for i in top]
        if any(not -(1 << 63) <= r[2] < 1 << 63 for r in out):
            raise ValueError("a score does not fit 64 bits")
        return pa.table([pa.array([r[c] for r in out], pa.int64()) for c in range(3)], ["query_id", "vec_id", "score"])

    return run


def grouped(pivots: Vectors, queries: np.ndarray) -> tuple[list[int], list[int]]:
    """(first group, number of groups) of each cell's queries, of which there are ``queries`` by cell.

    Cells with few queries share a group with cells whose pivots are near; those with many have several.
    """
    order = list(np.lexsort((np.arange(pivots.n), np.nan_to_num(pivots.dot(Vectors([np.ones(1, "<i4").tobytes()], [1]))[:, 0]))))
    if pivots.n > 1:  # by the direction in which the pivots differ most
        with np.errstate(all="ignore"):
            gram = np.nan_to_num(pivots.dot(pivots) / max(1.0, float(pivots.norm.max()) ** 2))
        gram = gram - gram.mean(axis=0) - gram.mean(axis=1)[:, None] + gram.mean()
        order = list(np.argsort(np.linalg.eigh(gram)[1][:, -1], kind="stable"))
    first, count, group, held = [0] * pivots.n, [1] * pivots.n, 0, 0
    for c in order:
        if held and held + queries[c] > BLOCK:
            group, held = group + 1, 0
        first[c], count[c] = group, max(1, -(-int(queries[c]) // BLOCK))
        if count[c] > 1:
            group, held = group + count[c], 0
        else:
            held += int(queries[c])
    return first, count


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query with all other vectors.

    ``vectors`` has vec_id and embedding; other columns are ignored.  Queries are the rows whose
    vec_id is divisible by ``every``.  Ties go to the smaller vec_id.  Vectors that are null, empty or hold
    null or non-finite components take no part, nor do null vec_ids.  Where two vectors differ in length, the
    components that one lacks count as 0.  A repeated vec_id is one vector (the smallest of its values).
    A component whose product with ``scale`` no double holds, or a result's score beyond 64 bits, fails the query.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null")
    rows = rows.mapInArrow(_quantise(scale), "vec_id long, vec binary, size long").where("vec is not null and size > 0")
    rows = materialise(rows.groupBy("vec_id").agg(F.min(F.struct("vec", "size")).alias("v")).select("vec_id", "v.vec", "v.size"), "vectors")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    chosen = hash_sample(rows, ["vec", "size"], ["vec", "size"], max(1, min(PIVOTS, int(n**0.5 / 4)))).collect()
    pivots = Vectors([bytes(r.vec) for r in chosen], [r["size"] for r in chosen])
    data = materialise(rows.mapInArrow(_cells(pivots), "vec_id long, vec binary, size long, cell long, far double"), "cells")
    discard(rows)
    size, reach, asked = np.zeros(pivots.n), np.zeros(pivots.n), np.zeros(pivots.n)
    mine = F.pmod("vec_id", F.lit(every)) == 0
    for c, count, far, q in data.groupBy("cell").agg(F.count("*"), F.max("far"), F.count(F.when(mine, 1))).collect():  # a row per pivot
        size[c], reach[c], asked[c] = count, far, q
    first, several = grouped(pivots, asked)
    summary = [(c, int(max(1, -(-size[c] // BLOCK))), first[c], several[c]) for c in range(pivots.n)]
    cells = F.broadcast(spark.createDataFrame(summary, "cell long, blocks long, first long, several long"))  # a row per pivot
    group = F.col("first") + F.pmod(F.xxhash64("vec_id", F.lit(1)), "several")
    queries = data.where(mine).join(cells, "cell").select("vec_id", "vec", "size", group.alias("group"))
    dealt = data.join(cells.select("cell", "blocks"), "cell").select("vec_id", "vec", "size", "cell", F.pmod(F.xxhash64("vec_id"), "blocks").alias("block"))

    def visit(routes: DataFrame) -> DataFrame:
        routes = materialise(routes, "routes")
        block = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
        sent = routes.join(cells.select("cell", "blocks"), "cell").select("query_id", "vec", "size", "group", "cell", "bound", block)
        # The data that some query of a group asks for, and no other, is copied to the group.
        asked_for = routes.select("cell", "group").distinct().join(cells.select("cell", "blocks"), "cell").select("cell", "group", block)
        copies = dealt.join(asked_for, ["cell", "block"]).select("vec_id", "vec", "size", F.col("cell").alias("c"), F.col("block").alias("b"), F.col("group").alias("g"))
        met = sent.groupBy("cell", "block", "group").cogroup(copies.groupBy("c", "b", "g"))
        found = materialise(met.applyInArrow(_local(k), "query_id long, vec_id long, score long"), "found")
        discard(routes)
        return found

    schema = "query_id long, vec binary, size long, group long, cell long, bound double"
    one = visit(queries.mapInArrow(_routes(pivots, size, reach, k, True), schema))
    # Ranks by window: Spark limits each task's rows of a query to k before they are shuffled.
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    # Scores beyond 2**53 are rounded as doubles; the bound stays below them.
    low = F.col("score").cast("double") - F.abs(F.col("score").cast("double")) * 1e-12
    bound = one.withColumn("rank", rank).where(F.col("rank") <= k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), low.alias("bound"))
    known = queries.join(bound, "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
    rest = visit(known.mapInArrow(_routes(pivots, size, reach, k, False), schema))
    return one.union(rest).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
