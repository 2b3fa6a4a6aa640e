"""Registered queries on hard inputs, with SQL that fails where the operator only nearly does what it is named for."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions import catalyst, layout, numbers, times, udfs
from tidewater.operators import aggregates, rows
from tidewater.sources import tables
from tidewater.streaming import windows

QUERIES: dict[str, Callable[[Callable[[str], DataFrame]], DataFrame]] = {}
SQL: dict[str, str] = {}
c = F.col


def _query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


def _timed(t) -> DataFrame:
    return t("events").withColumn("ts", c("ts").cast("timestamp"))


@_query("SELECT c_custkey, c_name FROM customer")
def scan_schema_pruned(t) -> DataFrame:
    """A scan by a schema of two columns; the others are not read."""
    spark, sf_dir = t.args
    return tables.read_parquet(spark, f"{sf_dir}/customer.parquet", T.StructType.fromDDL("c_custkey " + t("customer").schema["c_custkey"].dataType.simpleString() + ", c_name string"))


@_query("SELECT * FROM lineitem")
def row_packed(t) -> DataFrame:
    """All of a table to packed binary rows and back."""
    df = t("lineitem")
    return rows.unpack(rows.pack(df), df.schema)


@_query("SELECT l_orderkey, l_linenumber, l_extendedprice, l_shipdate FROM lineitem")
def row_packed_fixed(t) -> DataFrame:
    df = t("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate")
    return rows.unpack(rows.pack_fixed(df), df.schema)


@_query(
    "SELECT l_orderkey AS k, l_linenumber AS n, l_linenumber > 3 AS o, "
    "CASE WHEN l_linenumber <= 3 THEN (l_linenumber::HUGEINT * 25000000000000000000000000000000000000)::VARCHAR END AS r FROM lineitem"
)
def decimal_multiply_overflow(t) -> DataFrame:
    x = numbers.with_overflow("multiply", c("l_linenumber").cast("decimal(10,0)"), F.lit("25000000000000000000000000000000000000").cast("decimal(38,0)"))
    return t("lineitem").select(c("l_orderkey").alias("k"), c("l_linenumber").alias("n"), x.alias("x")).select("k", "n", c("x.overflow").alias("o"), c("x.result").cast("string").alias("r"))


@_query("SELECT l_orderkey AS k, l_linenumber AS n, l_linenumber = 2 AS o FROM lineitem")
def decimal_divide_by_zero(t) -> DataFrame:
    x = numbers.with_overflow("divide", c("l_extendedprice").cast("decimal(12,2)"), (c("l_linenumber") - 2).cast("decimal(4,0)"))
    return t("lineitem").select(c("l_orderkey").alias("k"), c("l_linenumber").alias("n"), x["overflow"].alias("o"))


@_query(
    "SELECT f, CASE WHEN f = 'O' THEN NULL ELSE s::BIGINT END AS s, f = 'O' AS o FROM "
    "(SELECT l_linestatus AS f, sum(CASE WHEN l_linestatus = 'O' THEN 4611686018427387904::HUGEINT ELSE l_orderkey END) AS s FROM lineitem GROUP BY 1)"
)
def sum_overflows(t) -> DataFrame:
    """In one group every value fits a long and the sum does not."""
    value = F.when(c("l_linestatus") == "O", F.lit(2**62)).otherwise(c("l_orderkey"))
    return t("lineitem").groupBy(c("l_linestatus").alias("f")).agg(numbers.sum_with_overflow(value).alias("x")).select("f", c("x.sum").alias("s"), c("x.overflow").alias("o"))


_MEMBERS = "l_orderkey % 4 = 0"


@_query(f"SELECT count(*) FILTER (WHERE {_MEMBERS}) AS members, count(*) FILTER (WHERE NOT {_MEMBERS}) AS others, true AS few FROM lineitem")
def bloom_false_hits(t) -> DataFrame:
    """All members hit, and of the other lines at most 5 in 100."""
    build = t("lineitem").where(_MEMBERS).select("l_orderkey").distinct()
    bits = max(64, 8 * build.count())
    words = aggregates.bloom_words(build, c("l_orderkey"), 3, bits)
    lines = aggregates.bloom_hits(t("lineitem").select("l_orderkey", F.expr(_MEMBERS).alias("member")), words, c("l_orderkey"), 3, bits)
    out = lines.agg(F.count_if(c("member") & c("hit")).alias("members"), F.count_if(~c("member")).alias("others"), F.count_if(~c("member") & c("hit")).alias("wrong"))
    return out.select("members", "others", (c("wrong") * 20 <= c("others")).alias("few"))


_CODES = "list_transform(string_split(c_name, ''), lambda x: ascii(x)::BIGINT)"
_HIVE = f"list_reduce({_CODES}, lambda a, b: (a * 31 + b) & 4294967295)"


@_query(f"SELECT k, CASE WHEN h > 2147483647 THEN h - 4294967296 ELSE h END::INTEGER AS h FROM (SELECT c_custkey AS k, ({_HIVE} * 31 + c_nationkey) & 4294967295 AS h FROM customer)")
def hash_hive_text(t) -> DataFrame:
    return t("customer").select(c("c_custkey").alias("k"), catalyst.hive_hash(c("c_name"), c("c_nationkey").cast("int")).alias("h"))


@_query("SELECT c_custkey AS k, format('{:,.2f}', c_acctbal) AS s FROM customer")
def format_number_float(t) -> DataFrame:
    return t("customer").select(c("c_custkey").alias("k"), F.format_number("c_acctbal", 2).alias("s"))


_Z = " + ".join(f"(((l_linenumber::BIGINT >> {b}) & 1) << {2 * b + 1}) + (((l_suppkey::BIGINT >> {b}) & 1) << {2 * b})" for b in range(24))


@_query(f"SELECT l_orderkey AS k, l_linenumber AS n, format('{{:016X}}', {_Z}) AS z FROM lineitem")
def interleave_bits_wide(t) -> DataFrame:
    z = F.hex(layout.interleave_bits([c("l_linenumber").cast("int"), c("l_suppkey").cast("int")]))
    return t("lineitem").select(c("l_orderkey").alias("k"), c("l_linenumber").alias("n"), z.alias("z"))


_OLD = "(l_orderkey % 600 * 500 - 400000)"
_YMD = f"SELECT l_orderkey AS k, l_linenumber AS n, {_OLD} AS g, year(DATE '1970-01-01' + CAST({_OLD} AS INTEGER)) AS y, month(DATE '1970-01-01' + CAST({_OLD} AS INTEGER)) AS m, day(DATE '1970-01-01' + CAST({_OLD} AS INTEGER)) AS d FROM lineitem"
_SHIFT = f"SELECT k, n, g, d, y + 4800 - (14 - m) // 12 AS yy, m + 12 * ((14 - m) // 12) - 3 AS mm FROM ({_YMD})"


@_query(f"SELECT k, n, CAST(CASE WHEN g >= -141427 THEN g ELSE d + (153 * mm + 2) // 5 + 365 * yy + yy // 4 - 32083 - 2440588 END AS BIGINT) AS j FROM ({_SHIFT})")
def rebase_to_julian_days(t) -> DataFrame:
    g = c("l_orderkey") % 600 * 500 - 400000
    return t("lineitem").select(c("l_orderkey").alias("k"), c("l_linenumber").alias("n"), times.gregorian_to_julian_days(g).cast("long").alias("j"))


@_query("SELECT (u - s * 1800000000)::BIGINT AS u, count(*) AS n FROM (SELECT epoch_us(time_bucket(INTERVAL 30 MINUTE, ts)) AS u, unnest([0, 1]) AS s FROM events) GROUP BY 1")
def window_sliding_counts(t) -> DataFrame:
    return windows.windowed(_timed(t), "ts", "1 hour", "30 minutes", n=F.count("*")).select(F.unix_micros("start").alias("u"), "n")


_GAPS = "SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)"
_NUMBERED = f"SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM ({_GAPS})"


@_query(f"SELECT user_id AS k, epoch_us(min(ts)) AS u, epoch_us(max(ts)) + 1800000000 AS v, count(*) AS n FROM ({_NUMBERED}) GROUP BY user_id, s")
def window_session_counts(t) -> DataFrame:
    return windows.sessions(_timed(t), "ts", "30 minutes", "user_id", n=F.count("*")).select(c("user_id").alias("k"), F.unix_micros("start").alias("u"), F.unix_micros("end").alias("v"), "n")


@_query(
    "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 2 HOUR "
    "WHERE a.event_type = 'click' AND b.event_type = 'purchase'"
)
def join_interval(t) -> DataFrame:
    """Clicks with the same user's purchases in the two hours after."""
    clicks = _timed(t).where("event_type = 'click'").select("user_id", "ts", c("event_id").alias("a"))
    buys = _timed(t).where("event_type = 'purchase'").select("user_id", c("ts").alias("at"), c("event_id").alias("b"))
    return windows.interval_join(clicks, buys, ("user_id",), ("ts", "at"), "2 HOURS").select("a", "b")


@_query("SELECT user_id AS k, count(*) AS n, sum(event_id)::DOUBLE AS total FROM events GROUP BY 1")
def running_totals(t) -> DataFrame:
    return windows.running_totals(t("events"), "user_id", "event_id").select(c("user_id").alias("k"), "n", "total")


@_query("SELECT p_partkey AS k, (p_size * 7 + 3) % 11 AS x FROM part")
def udf_vector(t) -> DataFrame:
    size = t("part").schema["p_size"].dataType
    return t("part").select(c("p_partkey").alias("k"), udfs.vector(lambda s: (s * 7 + 3) % 11, size)("p_size").alias("x"))


@_query("SELECT l_returnflag AS f, round(exp(avg(ln(l_quantity))), 6) AS g FROM lineitem GROUP BY 1")
def udaf_geometric_mean(t) -> DataFrame:
    logs = lambda rows: {"s": float(np.log(rows["q"]).sum()), "n": len(rows)}
    df = t("lineitem").select(c("l_returnflag").alias("f"), c("l_quantity").cast("double").alias("q"))
    return udfs.merged(df, ["f"], logs, "s double, n long", {"g": F.round(F.exp(c("s") / c("n")), 6)})
