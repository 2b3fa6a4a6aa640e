"""Golden values and properties of functions that the registered queries don't pin down."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions import casts, catalyst, layout, nested, numbers, times
from tidewater.operators import aggregates, joins
from tidewater.sources import tables
from tidewater.streaming import windows


def one(spark, col, **values):
    cols = [F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("x")]
    return spark.range(1).select(*cols).select(col.alias("r")).first().r


def test_hashes(spark):
    assert one(spark, catalyst.murmur3(F.lit("a"))) == 1485273170
    assert one(spark, catalyst.hive_hash(F.lit("hive"), F.lit(7))) == 99290775
    assert one(spark, catalyst.hive_hash(F.lit(None).cast("string"))) == 0
    assert one(spark, catalyst.murmur3(F.lit(None).cast("int"), seed=7)) == 7


@pytest.mark.parametrize("text,want", [("12", 12), (" 12 ", 12), ("12.9", 12), ("-3", -3), ("1e2", None), ("", None), ("2147483648", None), (".5", 0), ("x", None)])
def test_string_to_integer(spark, text, want):
    assert one(spark, casts.to_integer(F.col("s")), s=text) == want


def test_cast_modes(spark):
    assert one(spark, casts.to_double(F.col("s")), s="x") is None
    with pytest.raises(Exception, match="cannot cast"):
        one(spark, casts.to_double(F.col("s"), "ansi"), s="x")
    with pytest.raises(ValueError):
        casts.to_double(F.lit("1"), "other")
    assert one(spark, casts.to_base(F.lit(-1), 16, 32)) == "FFFFFFFF"
    assert one(spark, casts.conv_overflows(F.lit("18446744073709551616"), 10)) and not one(spark, casts.conv_overflows(F.lit("-018446744073709551615"), 10))


def test_calendars(spark):
    days = spark.range(-800000, -141000, 7).select("id", times.julian_to_gregorian_days(F.col("id")).alias("g"))
    back = days.select("id", "g", times.gregorian_to_julian_days(F.col("g")).alias("j"))
    odd = back.where("id <> j").select(F.date_format(F.date_from_unix_date(F.col("g").cast("int")), "MM-dd").alias("d"))
    assert {r.d for r in odd.collect()} <= {"03-01"}
    # The day after 1582-10-04 (Julian) is 1582-10-15 (Gregorian).
    assert one(spark, times.gregorian_to_julian_days(F.lit(-141427))) == -141427
    assert one(spark, times.gregorian_to_julian_days(F.lit(-719162))) == -719164  # 0001-01-01


def test_numbers(spark):
    assert one(spark, numbers.multiply(F.lit(2**62), F.lit(4).cast("long"))) is None
    with pytest.raises(Exception, match="overflow"):
        one(spark, numbers.multiply(F.lit(2**62), F.lit(4).cast("long"), "ansi"))
    big = F.lit("9" * 38).cast("decimal(38,0)")
    assert tuple(one(spark, numbers.with_overflow("add", big, big))) == (True, None)
    assert tuple(one(spark, numbers.with_overflow("divide", big, F.lit("0").cast("decimal(38,0)")))) == (True, None)
    df = spark.createDataFrame([(2**62,), (2**62,), (None,)], "x long")
    assert tuple(df.agg(numbers.sum_with_overflow(F.col("x")).alias("r")).first().r) == (True, None)


def z_order(values, bits):
    out = 0
    for b in range(bits - 1, -1, -1):
        for v in values:
            out = out << 1 | (v >> b) & 1
    return out.to_bytes(bits * len(values) // 8, "big")


def test_interleave_bits(spark):
    rnd = random.Random(0)
    rows = [(rnd.randrange(-(2**31), 2**31), rnd.randrange(-(2**31), 2**31)) for _ in range(50)] + [(1, 2), (3, 0), (None, 5)]
    df = spark.createDataFrame(rows, "a int, b int").select("a", "b", layout.interleave_bits([F.col("a"), F.col("b")]).alias("z"))
    for r in df.collect():
        assert bytes(r.z) == z_order([(r.a or 0) & 0xFFFFFFFF, (r.b or 0) & 0xFFFFFFFF], 32)


@pytest.mark.parametrize("n,bits", [(2, 1), (2, 3), (3, 2)])
def test_hilbert_index(spark, n, bits):
    """The curve visits every cell once and moves to a neighbour each step."""
    grid = spark.range((1 << bits) ** n).select(*(F.expr(f"cast(shiftright(id, {bits * i}) & {(1 << bits) - 1} AS int)").alias(f"c{i}") for i in range(n)))
    rows = grid.select("*", layout.hilbert_index([F.col(f"c{i}") for i in range(n)], bits).alias("h")).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(len(rows)))
    for a, b in zip(rows, rows[1:]):
        assert sum(abs(a[i] - b[i]) for i in range(n)) == 1


def test_nested(spark):
    arr = F.array(*map(F.lit, (1, 2, 3, 4)))
    assert one(spark, nested.slice_list(arr, -2, 5)) == [3, 4] and one(spark, nested.slice_list(arr, 0, 5, checked=False)) == []
    with pytest.raises(Exception):
        one(spark, nested.slice_list(arr, F.lit(0), 1))
    assert one(spark, nested.remove_quotes(F.lit('"'))) == '"' and one(spark, nested.remove_quotes(F.lit('"a"'))) == "a"
    assert one(spark, nested.url_part(F.lit("http://280.0.1.16/x?k=1"), "HOST")) is None
    assert one(spark, F.get_json_object(F.lit("[[1,2],[3]]"), "$[*][*]")) == "[1,2,3]"
    with pytest.raises(ValueError):
        nested.json_paths(F.lit("{}"), ["$" + ".a" * 17])


def test_joins_agree_over_strategies(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (2, "d")], "k int, x string")
    b = spark.createDataFrame([(2, 5), (3, 6), (None, 7)], "k2 int, y int")
    for how in ("inner", "left", "right", "full", "left_semi", "left_anti"):
        both = [sorted(map(str, joins.join(a, b, [("k", "k2")], how, nulls_equal=eq, strategy=s).collect())) for eq in (False, True) for s in ("merge", "hash", None)]
        assert both[0] == both[1] == both[2] and both[3] == both[4] == both[5]
    assert joins.join(a, b, [("k", "k2")], "inner", nulls_equal=True).count() == 3
    assert [r.matched for r in joins.with_matches(a, b, [("k", "k2")]).orderBy("x").collect()] == [False, True, False, True]


def test_sketches(spark):
    df = spark.range(20000).withColumn("g", F.col("id") % 2)
    for r in aggregates.hll_estimate(aggregates.hll_registers(df, ["g"], "id", 12), ["g"], 12).collect():
        assert abs(r.estimate - 10000) < 600
    rows = spark.createDataFrame([(1.0, 1), (10.0, 3), (99.0, 0)], "v double, n long")
    assert rows.agg(aggregates.percentiles(F.col("v"), F.col("n"), (0.5, 0.25)).alias("p")).first().p == [10.0, 7.75]


def test_schema_and_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, [2], {"a": 3})], "a int, b array<int>, m map<string,int>")
    assert [p for p, _ in tables.flatten_schema(df.schema)] == ["a", "b", "b.element", "m", "m.key", "m.value"]
    events = spark.range(100).select((F.col("id") * 600).cast("timestamp").alias("ts"), (F.col("id") % 3).alias("u"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windows.windowed(stream, "ts", "1 hour", n=F.count("*")).writeStream.format("memory").outputMode("complete").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.sql("SELECT * FROM w").collect()))
    assert got == sorted(map(tuple, windows.windowed(events, "ts", "1 hour", n=F.count("*")).collect())) and len(got) == 17


def test_bloom_with_chosen_hashes(spark):
    df = spark.createDataFrame([(i * 977,) for i in range(300)] + [(None,), (-5,)], "x long")
    words = aggregates.bloom_words(df, F.col("x"), 3, 8000)
    probe = spark.range(20000).select((F.col("id") - 10).alias("x"))
    hits = {r.x for r in probe.where(aggregates.bloom_probe(words, F.col("x"), 3, 8000)).collect()}
    members = {i * 977 for i in range(300) if i * 977 < 19990} | {-5}
    assert members <= hits and len(hits) < 400
    assert df.where("x is null").select(aggregates.bloom_probe(words, F.col("x"), 3, 8000).alias("h")).first().h is None
    empty = aggregates.bloom_words(df.where("x > 1e9"), F.col("x"), 3, 8000)
    assert probe.where(aggregates.bloom_probe(empty, F.col("x"), 3, 8000)).count() == 0
    with pytest.raises(ValueError):
        aggregates.bloom_words(df, F.col("x"), 0, 64)


def test_histogram_frequencies(spark):
    rows = spark.createDataFrame([("a", 1, 2), ("a", 1, 3), ("a", 2, 0), ("b", 7, 0)], "g string, v int, n long")
    got = {r.g: r.histogram and [tuple(h) for h in r.histogram] for r in aggregates.histogram(rows, ["g"], "v", "n").collect()}
    assert got == {"a": [(1, 5)], "b": None}  # a group of zeros only has a null
    for bad in (-1, None):
        with pytest.raises(Exception, match="frequency"):
            aggregates.histogram(spark.createDataFrame([("a", 1, bad)], rows.schema), ["g"], "v", "n").collect()


def test_modes_and_bases(spark):
    assert one(spark, numbers.multiply(F.lit(2**62), F.lit(6).cast("long"), "wrap")) == -(2**63)
    assert one(spark, numbers.multiply(F.lit(-(2**63)), F.lit(-(2**63)), "wrap")) == 0
    with pytest.raises(ValueError):
        numbers.multiply(F.lit(1), F.lit(1), "other")
    assert one(spark, casts.convert_base(F.lit("-15"), 10, F.lit(16))) == "FFFFFFFFFFFFFFF1"
    assert one(spark, casts.float_to_decimal(F.col("x"), 3, 1), x=1234.5) is None
    with pytest.raises(Exception, match="cannot cast"):
        one(spark, casts.float_to_decimal(F.col("x"), 3, 1, "ansi"), x=1234.5)


@pytest.mark.parametrize("value,width,scale,want", [("10.65", 50, 2, "10.50"), ("-0.01", 50, 2, "-0.50"), ("1.00", 1, 2, "1.00")])
def test_truncate_decimal(spark, value, width, scale, want):
    assert str(one(spark, times.truncate_number(F.lit(value).cast("decimal(9,2)"), width, scale))) == want


def test_micros_and_zones(spark):
    day = 86_400_000_000
    assert one(spark, times.gregorian_to_julian_micros(F.lit(-719162 * day + 5))) == -719164 * day + 5
    assert one(spark, times.gregorian_to_julian_micros(F.lit(-141427 * day - 1))) == -141427 * day + day - 1  # a skipped day
    assert one(spark, times.julian_to_gregorian_micros(F.lit(-719164 * day - 1))) == -719162 * day - 1
    assert one(spark, times.gregorian_to_julian_micros(F.lit(7))) == 7
    assert [catalyst.zone_supported(z) for z in ("UTC", "+5:30", "Asia/Tokyo", "PST", "+19:00", "Nowhere/At_All")] == [True, True, True, True, False, False]
    assert catalyst.zone_has_dst("Europe/Paris") and not catalyst.zone_has_dst("Asia/Tokyo")


def test_typed(spark):
    kind = T.StructType.fromDDL("a int, b struct<c: array<double>>, m map<string,date>")
    col = F.from_json(F.lit('{"a": "x", "b": {"c": ["1.5", "q"]}, "m": {"k": "2020-02-30"}}'), "a string, b struct<c: array<string>>, m map<string,string>")
    assert one(spark, nested.typed(col, kind)).asDict(True) == {"a": None, "b": {"c": [1.5, None]}, "m": {"k": None}}


@pytest.mark.parametrize("kind", ["csv", "json", "orc", "parquet"])
def test_formats(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "a", 0.5), (2, "b", None), (3, None, 2.5)], "k long, s string, x double")
    tables.write_format(df, str(tmp_path / "t"), kind)
    assert sorted(tables.read_format(spark, str(tmp_path / "t"), kind, df.schema).collect(), key=str) == sorted(df.collect(), key=str)
    tables.write_format(df, str(tmp_path / "by"), kind, ("k",))
    assert sorted(p.name for p in (tmp_path / "by").iterdir() if p.is_dir()) == ["k=1", "k=2", "k=3"]


def test_nested_pruning(spark, tmp_path):
    """Only the asked leaf of a struct is read."""
    spark.sql("SELECT named_struct('a', 1, 'b', 'x') AS s, 2 AS y").write.parquet(str(tmp_path / "n"))
    df = tables.read_parquet(spark, str(tmp_path / "n")).select("s.a")
    assert "ReadSchema: struct<s:struct<a:int>>" in df._jdf.queryExecution().toString().replace("\n", "") and df.first().a == 1


def test_stream_deduplicates(spark, tmp_path):
    events = spark.range(40).select((F.col("id") * 10).cast("timestamp").alias("ts"), (F.col("id") % 4).alias("u"))
    events.write.parquet(str(tmp_path / "in"))
    stream = windows.deduplicated(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "ts", ("u",))
    q = stream.writeStream.format("memory").queryName("once").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.u for r in spark.sql("SELECT u FROM once").collect()) == [0, 1, 2, 3]


def test_raw_fields_are_verbatim(spark):
    cases = {
        '{"Zipcode" : 704 , "City" : "PARC PARQUE"}': {"Zipcode": "704", "City": "PARC PARQUE"},
        "BAD": None,
        "": None,
        "{}": {},
        '{"a": {"b" :  1.50}, "c": [1,  "}"], "d": null, "e": 1.50}': {"a": '{"b" :  1.50}', "c": '[1,  "}"]', "d": None, "e": "1.50"},
        "{'k' : 'it\\'s'}": {"k": "it's"},
        '{"a": 1, "a": [2]}': {"a": "[2]"},
        '{"a": 1,}': None,
        '{"a": [1, }': None,
        '{"a": {}} x': None,
        "[1]": None,
        '{"a": {"b": [{"c": "\\""}]}}': {"a": '{"b": [{"c": "\\""}]}'},
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)] + [(99, None)], "i long, j string")
    got = {r.i: r.m for r in df.select("i", nested.json_map(F.col("j")).alias("m")).collect()}
    assert got == {**{i: want for i, want in enumerate(cases.values())}, 99: None}


def test_as_of_and_ranges(spark):
    from tidewater.operators import joins

    left = spark.createDataFrame([(1, 5, "x"), (1, 1, "y"), (None, 5, "z"), (2, None, "w"), (1, 9, "v")], "k int, t int, name string")
    right = spark.createDataFrame([(1, 2, 20), (1, 5, 50), (1, 5, 51), (None, 1, 7), (2, 1, 8), (1, None, 9)], "k int, t int, p int")
    assert sorted(tuple(r) for r in joins.as_of(left, right, ["k"], "t", ["p"]).select("name", "p").collect()) == [("v", 51), ("w", None), ("x", 51), ("y", None), ("z", None)]
    points = spark.createDataFrame([(-1.0,), (0.0,), (4.5,), (10.0,), (None,)], "x double")
    ranges = spark.createDataFrame([("a", -1.0, 0.0), ("b", 0.0, 10.0), ("c", 4.5, 4.5), ("d", None, 5.0)], "r string, low double, high double")
    assert sorted(tuple(r) for r in joins.in_range(points, ranges, "x", "low", "high", 3.0).select("x", "r").collect()) == [(-1.0, "a"), (0.0, "b"), (4.5, "b")]


def test_matched_column_of_the_same_name(spark):
    from tidewater.operators import joins

    left = spark.createDataFrame([(1, "old"), (2, "old")], "k int, matched string")
    assert sorted(tuple(r) for r in joins.with_matches(left, spark.createDataFrame([(2,)], "k int"), [("k", "k")]).collect()) == [(1, False), (2, True)]
