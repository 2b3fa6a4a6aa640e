"""Packed rows on every type and edge, user aggregates, and the streaming forms of joins and totals."""

import datetime
import decimal
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions import udfs
from tidewater.operators import rows
from tidewater.streaming import windows

D = decimal.Decimal
ALL = "a boolean, b tinyint, c smallint, d int, e bigint, f float, g double, h date, i timestamp, j timestamp_ntz, k decimal(7,2), l decimal(18,3), m decimal(38,0), n string, o binary"
DAY = datetime.datetime(1969, 12, 31, 23, 59, 59, 999999)
FULL = (True, -128, 32767, -1, 2**63 - 1, 0.5, math.inf, datetime.date(1, 1, 1), DAY.replace(tzinfo=datetime.timezone.utc), DAY, D("-12345.67"), D("-1.001"), D("-99999999999999999999999999999999999999"), "é\0x", b"\x00\xff")


def test_every_type_comes_back(spark):
    data = [FULL, (None,) * 15, (False, 0, 0, 0, 0, -0.0, -1.0, None, None, None, D("0.01"), D("7.000"), D(1), "", b""), (*FULL[:13], "long " * 5000, b"z" * 7)] * 40
    df = spark.createDataFrame(data, ALL).repartition(3)
    packed = rows.pack(df)
    assert packed.select((F.length("row") % 8).alias("x")).distinct().collect() == [(0,)]
    back = rows.unpack(packed, df.schema)
    assert back.schema.simpleString() == df.schema.simpleString()
    assert back.exceptAll(df).count() == df.exceptAll(back).count() == 0


def test_nan_null_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(math.nan, "x")], "a double, b string")
    assert math.isnan(rows.unpack(rows.pack(df), df.schema).first().a)
    nulls = spark.createDataFrame([(None,), (None,)], "row binary")
    assert [tuple(r) for r in rows.unpack(nulls, df.schema).collect()] == [(None, None)] * 2
    assert rows.unpack(rows.pack(df.limit(0)), df.schema).count() == 0


def test_layout():
    plan = rows.layout(T.StructType.fromDDL("a boolean, b bigint, c smallint, d string"))
    assert plan.offsets == [0, 8, 16, 20] and plan.validity == 28 and plan.size == 29


def test_what_has_no_packed_form(spark):
    with pytest.raises(TypeError):
        rows.pack(spark.createDataFrame([([1],)], "a array<int>"))
    with pytest.raises(TypeError):
        rows.pack_fixed(spark.createDataFrame([("x",)], "a string"))
    with pytest.raises(ValueError):
        rows.pack_fixed(spark.range(1).select(*(F.lit(1).alias(f"c{i}") for i in range(100))))
    with pytest.raises(ValueError):
        rows.pack_fixed(spark.range(1).select(*(F.lit(1).cast("decimal(38,0)").alias(f"c{i}") for i in range(65))))


def test_user_aggregate_has_null_groups(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 2.0), ("a", 4.0), (None, 8.0)], "g string, v double").repartition(3)
    out = udfs.merged(df, ["g"], lambda b: {"s": float((b["v"] ** 2).sum())}, "s double", {"norm": F.sqrt("s")})
    assert {r.g: round(r.norm, 6) for r in out.collect()} == {"a": round(17**0.5, 6), None: round(68**0.5, 6)}
    assert udfs.merged(df.limit(0), ["g"], lambda b: {"s": 0.0}, "s double", {"x": F.col("s")}).count() == 0


def streamed(spark, path, df):
    df.write.mode("append").parquet(str(path))
    return spark.readStream.schema(df.schema).parquet(str(path))


def collected(spark, df, name, mode):
    q = df.writeStream.format("memory").outputMode(mode).queryName(name).start()
    try:
        q.processAllAvailable()
        return sorted(tuple(r) for r in spark.table(name).collect())
    finally:
        q.stop()


def at(minute):
    return datetime.datetime(2024, 1, 1, 12, minute)


def test_streams_join_within_an_interval(spark, tmp_path):
    a = spark.createDataFrame([(1, at(0), "x"), (1, at(30), "y"), (2, at(0), "z"), (None, at(0), "n")], "u int, t timestamp, a string")
    b = spark.createDataFrame([(1, at(10), "p"), (1, at(0), "q"), (2, at(11), "r"), (None, at(1), "m")], "u int, s timestamp, b string")
    want = [("x", "p"), ("x", "q")]
    args = (("u",), ("t", "s"), "10 MINUTES")
    assert sorted(tuple(r) for r in windows.interval_join(a, b, *args).select("a", "b").collect()) == want
    live = windows.interval_join(streamed(spark, tmp_path / "a", a), streamed(spark, tmp_path / "b", b), *args).select("a", "b")
    assert collected(spark, live, "interval", "append") == want


def test_totals_run_over_triggers(spark, tmp_path):
    one = spark.createDataFrame([("k", 1.0), ("k", None), ("l", 2.0)], "u string, v double")
    live = windows.running_totals(streamed(spark, tmp_path / "in", one), "u", "v")
    q = live.writeStream.format("memory").outputMode("update").queryName("totals").start()
    try:
        q.processAllAvailable()
        spark.createDataFrame([("k", 5.0)], "u string, v double").write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
        assert sorted(tuple(r) for r in spark.table("totals").collect()) == [("k", 2, 1.0), ("k", 3, 6.0), ("l", 1, 2.0)]
    finally:
        q.stop()
    assert sorted(tuple(r) for r in windows.running_totals(one, "u", "v").collect()) == [("k", 2, 1.0), ("l", 1, 2.0)]
