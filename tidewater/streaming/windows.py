"""Watermarked window aggregates, interval joins and running totals, alike on batch and streaming frames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, time: str, size: str, slide: str | None = None, late: str = "10 minutes", by: tuple[str, ...] = (), **aggs) -> DataFrame:
    """Tumbling or sliding window aggregates; rows later than ``late`` behind the newest are dropped in a stream."""
    if events.isStreaming:
        events = events.withWatermark(time, late)
    w = F.window(time, size, slide or size)
    out = events.groupBy(w, *by).agg(*(a.alias(n) for n, a in aggs.items()))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, *aggs)


def sessions(events: DataFrame, time: str, gap: str, key: str, late: str = "10 minutes", **aggs) -> DataFrame:
    """Session window aggregates per key."""
    if events.isStreaming:
        events = events.withWatermark(time, late)
    out = events.groupBy(F.session_window(time, gap).alias("session"), key).agg(*(a.alias(n) for n, a in aggs.items()))
    return out.select(F.col("session.start").alias("start"), F.col("session.end").alias("end"), key, *aggs)


def deduplicated(events: DataFrame, time: str, keys: tuple[str, ...], late: str = "10 minutes") -> DataFrame:
    """One row per key; a stream keeps a key's state until ``late`` behind the newest row."""
    if events.isStreaming:
        return events.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))
    return events.dropDuplicates(list(keys))


def interval_join(left: DataFrame, right: DataFrame, keys: tuple[str, ...], time: tuple[str, str], within: str, how: str = "inner", late: str = "10 minutes") -> DataFrame:
    """Rows of both sides with equal keys where the right time is at or up to ``within`` after the left one.

    Two streams get watermarks, which with the bound on both times let Spark forget old rows.  Names of columns
    besides the keys must differ; the keys are the left side's.
    """
    if left.isStreaming:
        left = left.withWatermark(time[0], late)
    if right.isStreaming:
        right = right.withWatermark(time[1], late)
    cond = (right[time[1]] >= left[time[0]]) & (right[time[1]] <= left[time[0]] + F.expr(f"INTERVAL {within}"))
    for k in keys:
        cond = cond & (left[k] == right[k])
    return left.join(right, cond, how).select(*(left[c] for c in left.columns), *(right[c] for c in right.columns if c not in keys))


def running_totals(events: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, total) of all rows so far: one row per key of a batch; in a stream one per key and trigger that has rows of it.

    The state of a key is two numbers, and rows go through in Arrow batches.  A null value counts as 0.
    """
    events = events.select(key, F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("value"))
    if not events.isStreaming:
        return events.groupBy(key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))

    def step(keys, batches, state):
        n, total = state.get if state.exists else (0, 0.0)
        for batch in batches:
            n, total = n + len(batch), total + float(batch["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [keys[0]], "n": [n], "total": [total]})

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, total double", "n long, total double", "update", "NoTimeout")
