"""Catalyst expressions that have no SQL name; the only module that touches the JVM (classic sessions)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import DateTimeException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _jvm():
    return SparkSession.active()._jvm


def _expression(col: Column):
    return _jvm().org.apache.spark.sql.classic.ExpressionUtils.expression(col._jc)


def _column(expression) -> Column:
    from pyspark.sql.classic.column import Column as Classic

    return Classic(_jvm().org.apache.spark.sql.classic.ExpressionUtils.column(expression))


def _seq(cols: Sequence[Column]):
    jvm = _jvm()
    items = jvm.java.util.ArrayList()
    for c in cols:
        items.add(_expression(c))
    return jvm.org.apache.spark.api.python.PythonUtils.toSeq(items)


def hive_hash(*cols: Column) -> Column:
    """The hash that Hive buckets by: 31 * h + element; null counts as 0."""
    return _column(_jvm().org.apache.spark.sql.catalyst.expressions.HiveHash(_seq(cols)))


def murmur3(*cols: Column, seed: int = 42) -> Column:
    """32-bit Murmur3 with any seed; columns are chained and a null leaves the seed as it is."""
    if seed == 42:
        return F.hash(*cols)
    return _column(_jvm().org.apache.spark.sql.catalyst.expressions.Murmur3Hash(_seq(cols), seed))


def bloom_filter_agg(col: Column, items: int, bits: int) -> Column:
    """Aggregate: a Bloom filter of a bigint column's xxhash64 or values; nulls are skipped, empty input gives null."""
    e = _jvm().org.apache.spark.sql.catalyst.expressions
    agg = e.aggregate.BloomFilterAggregate(_expression(col), _expression(F.lit(items).cast("long")), _expression(F.lit(bits).cast("long")), 0, 0)
    return _column(agg.toAggregateExpression())


def might_contain(bloom: Column, value: Column) -> Column:
    return _column(_jvm().org.apache.spark.sql.catalyst.expressions.BloomFilterMightContain(_expression(bloom), _expression(value)))


def zone_supported(zone: str) -> bool:
    """Whether Spark reads a text as a time zone: an offset, a short id or a region."""
    try:
        _jvm().org.apache.spark.sql.catalyst.util.DateTimeUtils.getZoneId(zone)
    except DateTimeException:
        return False
    return True


def zone_has_dst(zone: str) -> bool:
    """Whether a zone changes its offset every year, now and in future."""
    return not _jvm().org.apache.spark.sql.catalyst.util.DateTimeUtils.getZoneId(zone).getRules().getTransitionRules().isEmpty()
