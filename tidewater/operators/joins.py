"""Equi-joins with null-safe keys, residual predicates, strategies and matched-row masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: ``broadcast`` is for a right side of a size the caller has checked.
STRATEGIES = {"merge": "merge", "hash": "shuffle_hash", "broadcast": "broadcast"}


def join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], how: str = "inner", residual: Column | None = None, nulls_equal: bool = False, strategy: str | None = None) -> DataFrame:
    """Join on pairs of column names; the residual is part of the join condition, so an outer join keeps
    rows that it rejects.  ``strategy`` is merge, hash or broadcast; without it the optimiser and AQE choose."""
    on = [left[a].eqNullSafe(right[b]) if nulls_equal else left[a] == right[b] for a, b in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    if residual is not None:
        cond = cond & residual
    return left.join(right.hint(STRATEGIES[strategy]) if strategy else right, cond, how)


def with_matches(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], name: str = "matched") -> DataFrame:
    """``left`` with a boolean column, in place of one of that name: whether any row of ``right`` has equal keys."""
    marks = right.select(*(F.col(b).alias(f"_k{i}") for i, (_, b) in enumerate(keys))).distinct().withColumn("_hit", F.lit(True))
    cond = [left[a] == marks[f"_k{i}"] for i, (a, _) in enumerate(keys)]
    return left.join(marks, cond, "left").select(*(left[c] for c in left.columns if c != name), F.coalesce(marks["_hit"], F.lit(False)).alias(name))


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, values: Sequence[str]) -> DataFrame:
    """``left`` with the ``values`` of the last row of ``right`` with the same keys and no later time (else null).

    One shuffle and one sort by key and time, in place of a join on a range.  Of rows of ``right`` with equal keys and
    time the one with the largest values counts; null keys or times match nothing.
    """
    last = right.where(F.col(time).isNotNull()).groupBy(*keys, time).agg(F.max(F.struct(*values)).alias("_value"))
    both = left.select("*", F.lit(1).alias("_side"), F.lit(None).cast(last.schema["_value"].dataType).alias("_value"))
    both = both.unionByName(last.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    frame = Window.partitionBy(*keys).orderBy(F.col(time).asc_nulls_first(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    found = F.when(known & F.col(time).isNotNull(), F.last("_value", ignorenulls=True).over(frame))
    out = both.withColumn("_value", found).where("_side = 1")
    return out.select(*(F.col(c) for c in left.columns if c not in values), *(F.col("_value")[v].alias(v) for v in values))


def in_range(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Inner join of points with the ranges (low <= point < high) that hold them, by bins of ``width``.

    Each range goes to the bins that it overlaps, so the join is an equi-join on bins; nulls match nothing.
    """
    bins = ranges.where(F.col(low) < F.col(high)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    dealt = points.withColumn("_bin", F.floor(F.col(point) / width))
    return dealt.join(bins, "_bin").where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("_bin")
