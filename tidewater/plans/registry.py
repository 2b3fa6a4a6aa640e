"""All registered queries of the library proper, with their SQL.

A query is a function of a table loader ``t``; SQL is given where DuckDB can say the same.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions import casts, catalyst, layout, nested, numbers, times
from tidewater.operators import aggregates, joins
from tidewater.plans import edges
from tidewater.sources import tables
from tidewater.streaming import windows

Load = Callable[[str], DataFrame]
_QUERIES: dict[str, Callable[[Load], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _add(name: str, sql: str | None = None):
    def keep(f: Callable[[Load], DataFrame]) -> Callable[[Load], DataFrame]:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


def _project(name: str, table: str, cols: dict, sql: str | None = None, where: str | None = None) -> None:
    """A projection query; ``cols`` maps names to functions of no argument, called when a session is active."""

    def run(t: Load) -> DataFrame:
        df = t(table) if where is None else t(table).where(where)
        return df.select(*(c().alias(n) if callable(c) else F.expr(c).alias(n) for n, c in cols.items()))

    _add(name, sql and f"SELECT {sql} FROM {table}" + (f" WHERE {where}" if where else ""))(run)


c = F.col

# Scans and files
_project("scan_projection_pushdown", "lineitem", {"k": "l_orderkey", "n": "l_linenumber"}, "l_orderkey AS k, l_linenumber AS n", "l_quantity > 45")


@_add("scan_count", "SELECT count(*) AS n, CAST(11 AS BIGINT) AS columns FROM lineitem")
def _scan_count(t: Load) -> DataFrame:
    df = t("lineitem")
    return df.agg(F.count("*").alias("n"), F.lit(len(df.columns)).cast("long").alias("columns"))


@_add("scan_case_insensitive", "SELECT sum(l_linenumber)::BIGINT AS s FROM lineitem")
def _scan_case(t: Load) -> DataFrame:
    return t("lineitem").agg(F.sum("L_LINENUMBER").alias("s"))


_project("orc_rezone", "orders", {"k": "o_orderkey", "u": lambda: F.unix_micros(times.rezone(c("o_orderdate").cast("timestamp"), "UTC", "Asia/Tokyo"))}, "o_orderkey AS k, epoch_us(o_orderdate) - 32400000000 AS u")

# Predicates
_project("case_when_selector", "part", {"k": "p_partkey", "i": lambda: nested.first_true(c("p_size") < 10, c("p_size") < 25, c("p_retailprice") > 1500)}, "p_partkey AS k, CASE WHEN p_size < 10 THEN 0 WHEN p_size < 25 THEN 1 WHEN p_retailprice > 1500 THEN 2 ELSE 3 END AS i")
_project("regex_literal_range", "customer", {"k": "c_custkey", "hit": lambda: casts.contains_literal_range(c("c_name"), "#", "0", "5", 4)}, "c_custkey AS k, regexp_matches(c_name, '#[0-5]{4,}') AS hit")
_project("filter_like", "part", {"k": "p_partkey"}, "p_partkey AS k", "p_type LIKE '%STEEL%' OR p_brand = 'Brand#12'")

# Joins
_PAIR = [("l_orderkey", "o_orderkey")]


def _join_whole(t: Load, how: str, strategy: str | None, residual: bool) -> DataFrame:
    lines, o = t("lineitem"), t("orders")
    cond = lines["l_extendedprice"] > o["o_totalprice"] / 2 if residual else None
    out = joins.join(lines, o, _PAIR, how, residual=cond, strategy=strategy)
    cents = F.sum(F.round(c("o_totalprice") * 100).cast("long")) if how not in ("left_semi", "left_anti") else F.lit(0).cast("long")
    return out.agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("lines"), cents.alias("cents"))


# Orders without lines are unmatched by nature, lines are by the residual.
for _name, _how, _kind, _residual in (("inner", "inner", "JOIN", False), ("left", "left", "LEFT JOIN", True), ("right", "right", "RIGHT JOIN", False), ("full", "full", "FULL JOIN", True), ("semi", "left_semi", "SEMI JOIN", True), ("anti", "left_anti", "ANTI JOIN", True)):
    _cents = "sum(round(o_totalprice * 100)::BIGINT)::BIGINT" if _how not in ("left_semi", "left_anti") else "CAST(0 AS BIGINT)"
    _sql = f"SELECT count(*) AS n, sum(l_linenumber)::BIGINT AS lines, {_cents} AS cents FROM lineitem {_kind} orders ON l_orderkey = o_orderkey" + (" AND l_extendedprice > o_totalprice / 2" if _residual else "")
    for _strategy in ("merge", "hash") if _name == "inner" else (None,):
        _add(f"join_whole_{_name}" + (f"_{_strategy}" if _strategy else ""), _sql)(partial(_join_whole, how=_how, strategy=_strategy, residual=_residual))
_add("join_nulls_equal", "SELECT count(*) AS n FROM (SELECT nullif(c_nationkey % 5, 0) AS k FROM customer) a JOIN (SELECT nullif(s_nationkey % 5, 0) AS k2 FROM supplier) b ON k IS NOT DISTINCT FROM k2")(
    lambda t: joins.join(t("customer").select(F.expr("nullif(c_nationkey % 5, 0) AS k")).groupBy("k").agg(F.count("*").alias("x")), t("supplier").select(F.expr("nullif(s_nationkey % 5, 0) AS k2")).groupBy("k2").agg(F.count("*").alias("y")), [("k", "k2")], nulls_equal=True).agg(F.sum(c("x") * c("y")).alias("n"))
)
_add("join_residual_left", "SELECT count(*) AS n, count(l_orderkey) AS matched FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_extendedprice > o_totalprice / 2")(
    lambda t: joins.join(o := t("orders"), li := t("lineitem"), [("o_orderkey", "l_orderkey")], "left", residual=li["l_extendedprice"] > o["o_totalprice"] / 2).agg(F.count("*").alias("n"), F.count("l_orderkey").alias("matched"))
)
_add("join_matched_mask", "SELECT o_orderkey AS k, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) AS matched FROM orders")(
    lambda t: joins.with_matches(t("orders").select(c("o_orderkey").alias("k"), "o_custkey"), t("customer").where("c_acctbal > 5000"), [("o_custkey", "c_custkey")]).select("k", "matched")
)
_add("join_broadcast", "SELECT count(*) AS n, sum(s_suppkey)::BIGINT AS s FROM supplier JOIN nation ON s_nationkey = n_nationkey")(
    lambda t: joins.join(t("supplier"), t("nation"), [("s_nationkey", "n_nationkey")], strategy="broadcast").agg(F.count("*").alias("n"), F.sum("s_suppkey").alias("s"))
)
_add("join_as_of", "SELECT p.event_id AS e, c.event_id AS last_click FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY 1, 2) c ON p.user_id = c.user_id AND p.ts >= c.ts")(
    lambda t: joins.as_of(t("events").where("event_type = 'purchase'").select("user_id", "ts", c("event_id").alias("e")), t("events").where("event_type = 'click'").select("user_id", "ts", c("event_id").alias("last_click")), ["user_id"], "ts", ["last_click"]).select("e", "last_click")
)
_add("join_in_range", "SELECT n_nationkey AS k, count(*) AS n FROM customer JOIN nation ON c_acctbal >= n_nationkey * 300 - 1000 AND c_acctbal < n_nationkey * 300 - 1000 + 450 GROUP BY 1")(
    lambda t: joins.in_range(t("customer"), t("nation").select(c("n_nationkey").alias("k"), (c("n_nationkey") * 300 - 1000).alias("low"), (c("n_nationkey") * 300 - 550).alias("high")), "c_acctbal", "low", "high", 250.0).groupBy("k").agg(F.count("*").alias("n"))
)
_add("join_empty_side", "SELECT count(*) AS n FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey < 0) ON o_custkey = c_custkey")(
    lambda t: joins.join(t("orders"), t("customer").where("c_custkey < 0"), [("o_custkey", "c_custkey")], "left").agg(F.count("*").alias("n"))
)

_add("join_residual_inner", "SELECT count(*) AS n, sum(l_linenumber)::BIGINT AS lines FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_extendedprice > o_totalprice / 2")(
    lambda t: joins.join(o := t("orders"), li := t("lineitem"), [("o_orderkey", "l_orderkey")], residual=li["l_extendedprice"] > o["o_totalprice"] / 2).agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("lines"))
)

# Aggregates, windows, sorts and set operations
_project("chunk_int64", "lineitem", {"low": lambda: numbers.low_chunk(c("l_orderkey") * 7919171717), "high": lambda: numbers.high_chunk(c("l_orderkey") * 7919171717)}, "(l_orderkey * 7919171717) & 4294967295 AS low, (l_orderkey * 7919171717) >> 32 AS high")
_add("sum_with_overflow", "SELECT l_returnflag AS f, sum(l_orderkey * 1000000)::BIGINT AS s, false AS o FROM lineitem GROUP BY 1")(
    lambda t: t("lineitem").groupBy(c("l_returnflag").alias("f")).agg(numbers.sum_with_overflow(c("l_orderkey") * 1000000).alias("x")).select("f", c("x.sum").alias("s"), c("x.overflow").alias("o"))
)


@_add("bloom_filter_semi", "SELECT count(*) FILTER (WHERE l_orderkey % 4 = 0) AS members, CAST(0 AS BIGINT) AS missed FROM lineitem")
def _bloom(t: Load) -> DataFrame:
    """Semi-join of all lines with the members, behind a filter of 8 bits a member that every line is put to: rows found, and rows the filter misses."""
    return _bloom_probe(t).agg(F.count_if(c("hit") & c("member")).alias("members"), F.count_if(~c("hit") & c("member")).alias("missed"))


def _bloom_probe(t: Load) -> DataFrame:
    """Every line with hit (the filter's answer) and member (the exact one)."""
    some = t("lineitem").where(c("l_orderkey") % 4 == 0).select(c("l_orderkey").alias("k")).distinct()
    n = max(1, some.count())
    bloom = some.agg(catalyst.bloom_filter_agg(c("k"), n, max(64, 8 * n))).scalar()
    lines = t("lineitem").select("l_orderkey", F.coalesce(catalyst.might_contain(bloom, c("l_orderkey")), F.lit(False)).alias("hit"))
    return joins.with_matches(lines, some, [("l_orderkey", "k")], "member")


_add("hll_sketch")(lambda t: aggregates.hll_estimate(aggregates.hll_registers(t("lineitem"), ["l_returnflag"], "l_partkey", 12), ["l_returnflag"], 12))
_add("approx_count_distinct")(lambda t: t("lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("n")))
_add("histogram", "SELECT l_returnflag AS f, l_linenumber AS value, count(*) AS freq FROM lineitem GROUP BY ALL")(
    lambda t: aggregates.histogram(t("lineitem"), ["l_returnflag"], "l_linenumber").select(c("l_returnflag").alias("f"), F.explode("histogram").alias("h")).select("f", "h.value", "h.freq")
)
_add("histogram_percentiles", "SELECT l_returnflag AS f, quantile_cont(l_quantity, 0.25) AS p25, quantile_cont(l_quantity, 0.5) AS p50, quantile_cont(l_quantity, 0.9) AS p90 FROM lineitem GROUP BY 1")(
    lambda t: t("lineitem").groupBy(c("l_returnflag").alias("f"), "l_quantity").agg(F.count("*").alias("n")).groupBy("f").agg(aggregates.percentiles(c("l_quantity"), c("n"), (0.25, 0.5, 0.9)).alias("p")).select("f", *(c("p")[i].alias(x) for i, x in enumerate(("p25", "p50", "p90"))))
)
_add("agg_pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 0) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 0) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")(
    lambda t: t("lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 0).alias("qty"), F.round(F.sum(c("l_extendedprice") * (1 - c("l_discount"))), 0).alias("revenue"), F.count("*").alias("n"))
)
_add("agg_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")(lambda t: t("lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n")))
_add("agg_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")(lambda t: t("lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n")))
_add("agg_distinct", "SELECT l_suppkey AS k, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1")(lambda t: t("lineitem").groupBy(c("l_suppkey").alias("k")).agg(F.count_distinct("l_partkey").alias("n")))
_add("window_rank", "SELECT * FROM (SELECT o_custkey AS k, o_orderkey AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")(
    lambda t: t("orders").select(c("o_custkey").alias("k"), c("o_orderkey").alias("o"), F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long").alias("r")).where("r <= 3")
)
_add("window_lag", "SELECT event_id AS e, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events")(
    lambda t: t("events").select(c("event_id").alias("e"), F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("before"))
)
_add("sort_top", "SELECT o_orderkey AS k FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")(lambda t: t("orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select(c("o_orderkey").alias("k")))
_add("set_operations", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")(
    lambda t: t("customer").select(c("c_nationkey").alias("k")).intersect(t("supplier").select("s_nationkey")).subtract(t("nation").where("n_regionkey = 0").select("n_nationkey"))
)

_add("agg_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")(
    lambda t: t("lineitem").groupingSets([[c("l_returnflag")], [c("l_linestatus")], []], "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
)
_add("histogram_weighted", "SELECT l_returnflag AS f, l_linenumber AS value, sum(l_quantity)::BIGINT AS freq FROM lineitem GROUP BY ALL")(
    lambda t: aggregates.histogram(t("lineitem").withColumn("q", c("l_quantity").cast("long")), ["l_returnflag"], "l_linenumber", "q").select(c("l_returnflag").alias("f"), F.explode("histogram").alias("h")).select("f", "h.value", "h.freq")
)


@_add("hll_merge", "SELECT DISTINCT l_returnflag AS f, true AS same FROM lineitem")
def _hll_merge(t: Load) -> DataFrame:
    """The sketches of two halves merge into the sketch of the whole."""
    part = lambda w: aggregates.hll_registers(t("lineitem").where(w), ["l_returnflag"], "l_partkey", 10)
    merged = aggregates.hll_estimate(aggregates.hll_merge(part("l_orderkey % 2 = 0"), part("l_orderkey % 2 = 1"), groups=["l_returnflag"]), ["l_returnflag"], 10)
    whole = aggregates.hll_estimate(part("true"), ["l_returnflag"], 10).withColumnRenamed("estimate", "all")
    return merged.join(whole, "l_returnflag").select(c("l_returnflag").alias("f"), (c("estimate") == c("all")).alias("same"))


@_add("bloom_fixed_hashes", "SELECT count(*) AS members, CAST(0 AS BIGINT) AS missed FROM orders")
def _bloom_fixed(t: Load) -> DataFrame:
    """A filter with three hashes, merged of two halves, misses no member."""
    part = lambda i: aggregates.bloom_words(t("orders").where(c("o_orderkey") % 2 == i), c("o_orderkey"), 3, 1 << 20)
    hit = aggregates.bloom_probe(aggregates.bloom_merge(part(0), part(1)), c("o_orderkey"), 3, 1 << 20)
    return t("orders").select(hit.alias("hit")).agg(F.count("*").alias("members"), F.count_if(~c("hit")).alias("missed"))


_add("window_functions", "SELECT event_id AS e, rank() OVER w AS r, dense_rank() OVER w AS d, ntile(4) OVER u AS q, lead(event_id) OVER u AS after, first_value(event_id) OVER u AS first, nth_value(event_id, 2) OVER u AS second, round(percent_rank() OVER w, 9) AS p, round(cume_dist() OVER w, 9) AS cd FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_type), u AS (PARTITION BY user_id ORDER BY ts, event_id)")(
    lambda t: t("events").select(c("event_id").alias("e"), *(f.over(Window.partitionBy("user_id").orderBy("event_type")).cast(k).alias(n) for n, f, k in (("r", F.rank(), "long"), ("d", F.dense_rank(), "long"))), F.ntile(4).over(u := Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("q"), F.lead("event_id").over(u).alias("after"), F.first("event_id").over(u).alias("first"), F.nth_value("event_id", 2).over(u).alias("second"), *(F.round(f.over(Window.partitionBy("user_id").orderBy("event_type")), 9).alias(n) for n, f in (("p", F.percent_rank()), ("cd", F.cume_dist()))))
)
_add("window_rows_frame", "SELECT event_id AS e, sum(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)::BIGINT AS s FROM events")(
    lambda t: t("events").select(c("event_id").alias("e"), F.sum("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 1)).alias("s"))
)
_add("window_range_frame", "SELECT l_orderkey AS k, l_linenumber AS n, sum(l_linenumber) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey RANGE BETWEEN 500 PRECEDING AND CURRENT ROW)::BIGINT AS s FROM lineitem")(
    lambda t: t("lineitem").select(c("l_orderkey").alias("k"), c("l_linenumber").alias("n"), F.sum("l_linenumber").over(Window.partitionBy("l_suppkey").orderBy("l_orderkey").rangeBetween(-500, 0)).alias("s"))
)
for _name, _op in (("union", "unionByName"), ("intersect", "intersectAll"), ("except", "exceptAll")):
    _add(f"set_{_name}_all", f"SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer {_name.upper()} ALL SELECT s_nationkey FROM supplier) GROUP BY k")(
        lambda t, op=_op: getattr(t("customer").select(c("c_nationkey").alias("k")), op)(t("supplier").select(c("s_nationkey").alias("k"))).groupBy("k").agg(F.count("*").alias("n"))
    )

# Layout
_project("interleave_bits", "lineitem", {"k": "l_orderkey", "n": "l_linenumber", "z": lambda: F.hex(layout.interleave_bits([c("l_linenumber"), c("l_suppkey").cast("int")]))})
_project("interleave_bits_8", "part", {"k": "p_partkey", "z": lambda: F.conv(F.hex(layout.interleave_bits([c("p_size"), c("p_partkey") % 256], 8)), 16, 10).cast("long")}, "p_partkey AS k, " + " + ".join(f"(((p_size >> {b}) & 1) << {2 * b + 1}) + ((((p_partkey % 256) >> {b}) & 1) << {2 * b})" for b in range(8)) + " AS z")
_project("hilbert_index", "part", {"k": "p_partkey", "h": lambda: layout.hilbert_index([c("p_size"), c("p_partkey") % 64], 6)})
_add("layout_clustered", "SELECT p_partkey AS k, p_size AS s FROM part")(lambda t: layout.cluster_by(t("part"), layout.interleave_bits([c("p_size"), c("p_partkey").cast("int")]), 8).select(c("p_partkey").alias("k"), c("p_size").alias("s")))

# Dates and times
for _unit in ("YEAR", "QUARTER", "MONTH", "WEEK"):
    _project(f"truncate_date_{_unit.lower()}", "orders", {"k": "o_orderkey", "d": lambda u=_unit: times.truncate_date(F.to_date("o_orderdate"), u).cast("string")}, f"o_orderkey AS k, CAST(CAST(date_trunc('{_unit}', o_orderdate) AS DATE) AS VARCHAR) AS d")
for _unit in ("YEAR", "QUARTER", "MONTH", "WEEK", "DAY", "HOUR", "MINUTE", "SECOND", "MILLISECOND", "MICROSECOND"):
    _project(f"truncate_time_{_unit.lower()}", "events", {"e": "event_id", "u": lambda u=_unit: F.unix_micros(times.truncate_time(c("ts").cast("timestamp"), u))}, f"event_id AS e, epoch_us(date_trunc('{_unit}', ts)) AS u")
_project("truncate_unit_column", "events", {"e": "event_id", "d": lambda: times.truncate_date(F.to_date("ts"), F.when(c("event_id") % 2 == 0, "MM").otherwise("none")).cast("string")}, "event_id AS e, CASE WHEN event_id % 2 = 0 THEN CAST(CAST(date_trunc('month', ts) AS DATE) AS VARCHAR) END AS d")
_project("rebase_to_julian", "lineitem", {"k": "l_orderkey", "n": "l_linenumber", "d": lambda: times.gregorian_to_julian_days(c("l_orderkey") % 300000 - 400000)})


def _returns(day):
    """Whether a Julian day comes back from the Gregorian calendar as it must: as itself, or as the day after if that calendar lacks it."""
    want = day + F.when(times.gregorian_lacks(day), 1).otherwise(0)
    return times.gregorian_to_julian_days(times.julian_to_gregorian_days(day)) == want


_project("rebase_round_trip", "orders", {"k": "o_orderkey", "same": lambda: _returns(-c("o_orderkey") - 141427)}, "o_orderkey AS k, true AS same")
_project("local_to_utc", "orders", {"k": "o_orderkey", "u": lambda: F.unix_micros(times.local_to_utc(c("o_orderdate").cast("timestamp"), "America/New_York"))}, "o_orderkey AS k, epoch_us(timezone('America/New_York', o_orderdate)) AS u")
_project("utc_to_local", "orders", {"k": "o_orderkey", "u": lambda: F.unix_micros(times.utc_to_local(c("o_orderdate").cast("timestamp"), "Europe/Paris"))}, "o_orderkey AS k, epoch_us(timezone('Europe/Paris', timezone('UTC', o_orderdate))) AS u")
_project("zone_per_row", "events", {"e": "event_id", "u": lambda: F.unix_micros(times.local_to_utc(c("ts").cast("timestamp"), F.when(c("user_id") % 2 == 0, "+05:30").otherwise("Asia/Tokyo")))}, "event_id AS e, epoch_us(ts) - CASE WHEN user_id % 2 = 0 THEN 19800000000 ELSE 32400000000 END AS u")
_project("partition_years", "orders", {"k": "o_orderkey", "y": lambda: times.years(c("o_orderdate"))}, "o_orderkey AS k, CAST(year(o_orderdate) - 1970 AS INTEGER) AS y")
_project("partition_months", "orders", {"k": "o_orderkey", "m": lambda: times.months(c("o_orderdate"))}, "o_orderkey AS k, CAST((year(o_orderdate) - 1970) * 12 + month(o_orderdate) - 1 AS INTEGER) AS m")
_project("partition_days", "orders", {"k": "o_orderkey", "d": lambda: times.days(c("o_orderdate")).cast("string")}, "o_orderkey AS k, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d")
_project("partition_hours", "events", {"e": "event_id", "h": lambda: times.hours(c("ts").cast("timestamp"))}, "event_id AS e, CAST(epoch_us(ts) // 3600000000 AS INTEGER) AS h")
_project("partition_truncate_number", "lineitem", {"k": "l_orderkey", "n": "l_linenumber", "t": lambda: times.truncate_number(3 - c("l_orderkey"), 100)}, "l_orderkey AS k, l_linenumber AS n, (3 - l_orderkey) - ((((3 - l_orderkey) % 100) + 100) % 100) AS t")
_project("partition_truncate_text", "part", {"k": "p_partkey", "t": lambda: times.truncate_text(c("p_name"), 4)}, "p_partkey AS k, left(p_name, 4) AS t")

_project("partition_truncate_decimal", "customer", {"k": "c_custkey", "t": lambda: (times.truncate_number(c("c_acctbal").cast("decimal(12,2)"), 50, 2) * 100).cast("long")}, "c_custkey AS k, CAST(round(c_acctbal * 100) AS BIGINT) - ((CAST(round(c_acctbal * 100) AS BIGINT) % 50) + 50) % 50 AS t")


def _returns_micros(at):
    """``_returns`` of microseconds; the time of day stays."""
    want = at + F.when(times.gregorian_lacks_micros(at), 86_400_000_000).otherwise(0)
    return times.gregorian_to_julian_micros(times.julian_to_gregorian_micros(at)) == want


_project("rebase_micros_round_trip", "orders", {"k": "o_orderkey", "same": lambda: _returns_micros(-c("o_orderkey") * 7_000_000_007 - 12_219_292_800_000_001)}, "o_orderkey AS k, true AS same")

# Casts and strings
_project("cast_float_to_decimal", "customer", {"k": "c_custkey", "d": lambda: casts.float_to_decimal(c("c_custkey") / 8, 9, 3).cast("string")}, "c_custkey AS k, CAST(CAST(c_custkey / 8 AS DECIMAL(9,3)) AS VARCHAR) AS d")
_project("conv_base_columns", "orders", {"k": "o_orderkey", "v": lambda: casts.convert_base(c("o_orderkey").cast("string"), 10, F.when(c("o_orderkey") % 2 == 0, 2).otherwise(16))}, "o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN bin(o_orderkey) ELSE hex(o_orderkey) END AS v")
_project("strings", "customer", {"k": "c_custkey", "u": "upper(c_name)", "l": "lower(c_name)", "p": "lpad(c_custkey, 8, '*')", "s": "split_part(c_name, '#', 2)", "x": "regexp_extract(c_name, '([0-9]+)', 1)", "r": "regexp_replace(c_name, '0+', '-')"}, "c_custkey AS k, upper(c_name) AS u, lower(c_name) AS l, lpad(CAST(c_custkey AS VARCHAR), 8, '*') AS p, split_part(c_name, '#', 2) AS s, regexp_extract(c_name, '([0-9]+)', 1) AS x, regexp_replace(c_name, '0+', '-', 'g') AS r")
_project("cast_string_to_int", "events", {"e": "event_id", "i": lambda: casts.to_integer(F.concat(F.lit(" "), c("value").cast("string")))}, "event_id AS e, CAST(trunc(value) AS INTEGER) AS i")
_project("cast_string_no_strip", "events", {"e": "event_id", "i": lambda: casts.to_integer(F.concat(F.when(c("event_id") % 2 == 0, " ").otherwise(""), c("user_id").cast("string")), strip=False)}, "event_id AS e, CASE WHEN event_id % 2 = 1 THEN CAST(user_id AS INTEGER) END AS i")
_project("cast_string_to_decimal", "events", {"e": "event_id", "d": lambda: casts.to_decimal(c("value").cast("string"), 12, 1).cast("string")}, "event_id AS e, CAST(CAST(CAST(value AS VARCHAR) AS DECIMAL(12,1)) AS VARCHAR) AS d")
_project("cast_string_to_double", "events", {"e": "event_id", "d": lambda: casts.to_double(c("value").cast("string"))}, "event_id AS e, value AS d")
_project("cast_double_to_string", "events", {"e": "event_id", "s": lambda: c("value").cast("string")}, "event_id AS e, CAST(value AS VARCHAR) AS s")
_project("format_number", "customer", {"k": "c_custkey", "s": lambda: F.format_number(F.round("c_acctbal", 0).cast("long"), 0)}, "c_custkey AS k, format('{:,}', CAST(round(c_acctbal, 0) AS BIGINT)) AS s")
_project("cast_decimal_to_string", "customer", {"k": "c_custkey", "s": lambda: c("c_acctbal").cast("decimal(12,2)").cast("string")}, "c_custkey AS k, CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR) AS s")
_project("cast_long_to_binary", "orders", {"k": "o_orderkey", "b": lambda: F.bin("o_orderkey")}, "o_orderkey AS k, bin(o_orderkey) AS b")
_project("cast_string_control_characters", "part", {"k": "p_partkey", "v": lambda: casts.to_integer(F.concat(F.lit("\t\x01 "), c("p_size").cast("string"), F.lit(".9\x1f\n")))}, "p_partkey AS k, p_size AS v")
_project("string_from_base_overflow", "orders", {"k": "o_orderkey", "v": lambda: casts.from_base(F.concat(F.when(c("o_orderkey") % 2 == 0, "99999999999999999999").otherwise(""), c("o_orderkey").cast("string")), 10)}, "o_orderkey AS k, CASE WHEN o_orderkey % 2 = 1 THEN o_orderkey END AS v")
_project("string_from_base", "orders", {"k": "o_orderkey", "v": lambda: casts.from_base(F.concat(F.hex("o_orderkey"), F.lit("xyz")), 16)}, "o_orderkey AS k, o_orderkey AS v")
_project("integer_to_base", "orders", {"k": "o_orderkey", "h": lambda: casts.to_base(c("o_orderkey"), 16), "d": lambda: casts.to_base(c("o_orderkey"), 10)}, "o_orderkey AS k, hex(o_orderkey) AS h, CAST(o_orderkey AS VARCHAR) AS d")
_project("cast_string_to_timestamp", "orders", {"k": "o_orderkey", "u": lambda: F.unix_micros(casts.to_timestamp(F.concat(c("o_orderdate").cast("string"), F.lit("+01:00"))))}, "o_orderkey AS k, epoch_us(o_orderdate) - 3600000000 AS u")
_project("cast_string_to_date", "orders", {"k": "o_orderkey", "d": lambda: casts.to_date(c("o_orderdate").cast("string")).cast("string")}, "o_orderkey AS k, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d")
_project("cast_double_to_decimal", "customer", {"k": "c_custkey", "d": lambda: c("c_acctbal").cast("decimal(18,4)").cast("string")}, "c_custkey AS k, CAST(CAST(c_acctbal AS DECIMAL(18,4)) AS VARCHAR) AS d")
_project("substring_index", "pages", {"p": "page_id", "s": lambda: F.substring_index("url", "/", 3)}, "page_id AS p, array_to_string(list_slice(string_split(url, '/'), 1, 3), '/') AS s")
_project("conv_base", "orders", {"k": "o_orderkey", "v": lambda: F.conv(c("o_orderkey").cast("string"), 10, 2)}, "o_orderkey AS k, bin(o_orderkey) AS v")
_project("conv_overflow", "orders", {"k": "o_orderkey", "o": lambda: casts.conv_overflows(F.concat(F.lit("1844674407370"), F.lpad(c("o_orderkey").cast("string"), 7, "9")), 10)}, "o_orderkey AS k, CAST('1844674407370' || lpad(CAST(o_orderkey AS VARCHAR), 7, '9') AS HUGEINT) > 18446744073709551615 AS o")
_project("random_uuid", "customer", {"k": "c_custkey", "ok": lambda: F.regexp_like(F.uuid(), F.lit("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"))}, "c_custkey AS k, true AS ok")

# URLs
_URL = "regexp_extract(url, '^([a-z]+)://([^/?#]*)([^?#]*)(\\?([^#]*))?(#.*)?$', {})"
for _part, _group in (("PROTOCOL", 1), ("HOST", 2), ("PATH", 3)):
    _project(f"url_{_part.lower()}", "pages", {"p": "page_id", "x": lambda part=_part: nested.url_part(c("url"), part)}, f"page_id AS p, {_URL.format(_group)} AS x")
_project("url_query", "pages", {"p": "page_id", "x": lambda: nested.url_part(c("url"), "QUERY")}, f"page_id AS p, nullif({_URL.format(5)}, '') AS x")
_project("url_query_key", "pages", {"p": "page_id", "x": lambda: nested.url_part(c("url"), "QUERY", "ref")}, "page_id AS p, nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') AS x")
_project("url_query_key_column", "pages", {"p": "page_id", "x": lambda: nested.url_part(c("url"), "QUERY", F.when(c("page_id") % 2 == 0, "ref").otherwise("page"))}, "page_id AS p, nullif(CASE WHEN page_id % 2 = 0 THEN regexp_extract(url, '[?&]ref=([^&#]*)', 1) ELSE regexp_extract(url, '[?&]page=([^&#]*)', 1) END, '') AS x")

# Numbers
_project("multiply_wrap_int", "part", {"k": "p_partkey", "x": lambda: numbers.multiply(c("p_size"), F.lit(2147483647), "wrap", 32)}, "p_partkey AS k, CAST(((p_size::HUGEINT * 2147483647 + 2147483648) % 4294967296) - 2147483648 AS INTEGER) AS x")
_project("multiply_wrap", "lineitem", {"k": "l_orderkey", "n": "l_linenumber", "x": lambda: numbers.multiply(c("l_orderkey"), F.lit(6148914691236517205), "wrap")}, "l_orderkey AS k, l_linenumber AS n, CAST(CASE WHEN (l_orderkey::HUGEINT * 6148914691236517205) % 18446744073709551616 >= 9223372036854775808 THEN (l_orderkey::HUGEINT * 6148914691236517205) % 18446744073709551616 - 18446744073709551616 ELSE (l_orderkey::HUGEINT * 6148914691236517205) % 18446744073709551616 END AS BIGINT) AS x")
_project("multiply_try", "lineitem", {"k": "l_orderkey", "n": "l_linenumber", "x": lambda: numbers.multiply(c("l_orderkey"), c("l_partkey")), "big": lambda: numbers.multiply(c("l_orderkey") + F.lit(2**61), F.lit(4).cast("long"))}, "l_orderkey AS k, l_linenumber AS n, l_orderkey * l_partkey AS x, CAST(NULL AS BIGINT) AS big")
_project("round_half_up", "customer", {"k": "c_custkey", "r": lambda: numbers.round_half_up(c("c_custkey") * 5, -1)}, "c_custkey AS k, ((c_custkey * 5 + 5) // 10) * 10 AS r")
_project("round_half_even", "customer", {"k": "c_custkey", "r": lambda: numbers.round_half_even(c("c_custkey") / 2, 0)}, "c_custkey AS k, round_even(c_custkey / 2, 0) AS r")
_DEC = "CAST(l_extendedprice AS DECIMAL(12,2))"


def _decimal(op: str) -> Callable[[Load], DataFrame]:
    a, b = F.expr("CAST(l_extendedprice AS DECIMAL(12,2))"), F.expr("CAST(l_linenumber AS DECIMAL(4,0))")
    return lambda t: t("lineitem").select("l_orderkey", "l_linenumber", numbers.with_overflow(op, a, b).alias("x")).select(c("l_orderkey").alias("k"), c("l_linenumber").alias("n"), c("x.overflow").alias("o"), F.round(c("x.result").cast("double"), 2).alias("r"))


for _op, _sign in (("add", "+"), ("subtract", "-"), ("multiply", "*"), ("remainder", "%")):
    _add(f"decimal_{_op}", f"SELECT l_orderkey AS k, l_linenumber AS n, false AS o, round(CAST({_DEC} {_sign} CAST(l_linenumber AS DECIMAL(4,0)) AS DOUBLE), 2) AS r FROM lineitem")(lambda t, op=_op: _decimal(op)(t))
_add("decimal_divide")(lambda t: _decimal("divide")(t))
_project("decimal_integer_divide", "lineitem", {"k": "l_orderkey", "n": "l_linenumber", "q": "CAST(l_extendedprice AS DECIMAL(12,2)) div CAST(l_linenumber AS DECIMAL(4,0))"}, f"l_orderkey AS k, l_linenumber AS n, CAST(trunc(CAST(round({_DEC} * 100) AS BIGINT) // (l_linenumber * 100)) AS BIGINT) AS q")

# Hashes
_project("hash_murmur3", "customer", {"k": "c_custkey", "h": lambda: catalyst.murmur3(c("c_name"), c("c_custkey")), "s": lambda: catalyst.murmur3(c("c_name"), seed=0)})
_project("hash_xxhash64", "customer", {"k": "c_custkey", "h": lambda: F.xxhash64("c_name", "c_acctbal")})
_project("hash_hive", "customer", {"k": "c_custkey", "h": lambda: catalyst.hive_hash(c("c_nationkey"))}, "c_custkey AS k, c_nationkey AS h")
for _bits in (224, 256, 384, 512):
    _project(f"hash_sha{_bits}", "customer", {"k": "c_custkey", "h": lambda b=_bits: F.sha2("c_name", b)}, "c_custkey AS k, sha256(c_name) AS h" if _bits == 256 else None)

# JSON
_project("json_path", "events", {"e": "event_id", "k": lambda: F.get_json_object("props", "$.k")}, "event_id AS e, props ->> '$.k' AS k")
_project("json_paths", "events", {"e": "event_id", "p": lambda: nested.json_paths(c("props"), ["$.k", "$.none"])["p0"], "q": lambda: nested.json_paths(c("props"), ["$.k", "$.none"])["p1"]}, "event_id AS e, props ->> '$.k' AS p, props ->> '$.none' AS q")
_project("json_map_nested", "events", {"e": "event_id", "a": lambda: nested.json_map(F.concat(F.lit('{"a": {"b" :  1.50}, "p" :'), c("props"), F.lit(', "n": 1.50}')))["a"], "p": lambda: nested.json_map(F.concat(F.lit('{"a": [1,  "}"], "p" : '), c("props"), F.lit("}")))["p"]}, """event_id AS e, '{"b" :  1.50}' AS a, props AS p""")
_project("json_map", "events", {"e": "event_id", "k": lambda: nested.json_map(c("props"))["k"]}, "event_id AS e, props ->> '$.k' AS k")
_project("json_struct", "events", {"e": "event_id", "k": lambda: F.from_json("props", "k INT")["k"]}, "event_id AS e, CAST(props ->> '$.k' AS INTEGER) AS k")
_project("json_remove_quotes", "customer", {"k": "c_custkey", "s": lambda: nested.remove_quotes(F.concat(F.lit('"'), c("c_name"), F.lit('"'))), "b": lambda: nested.remove_quotes(c("c_name"), True)}, "c_custkey AS k, c_name AS s, CAST(NULL AS VARCHAR) AS b")

_project("json_wildcard", "events", {"e": "event_id", "x": lambda: F.get_json_object(F.format_string('[{"a":%d},{"b":0},{"a":%d}]', "event_id", "user_id"), "$[*].a")}, "event_id AS e, '[' || event_id || ',' || user_id || ']' AS x")
_project("json_nested_struct", "events", {"e": "event_id", "x": lambda: F.from_json(F.format_string('{"a":{"b":[1,%d]},"z":0}', "user_id"), "a struct<b:array<bigint>>")["a"]["b"][1]}, "event_id AS e, user_id AS x")
_project("json_typed", "events", {"e": "event_id", "x": lambda: nested.typed(F.struct(c("user_id").cast("string").alias("u"), c("event_type").alias("v")), T.StructType.fromDDL("u bigint, v int"))["u"], "y": lambda: nested.typed(F.struct(c("event_type").alias("v")), T.StructType.fromDDL("v int"))["v"]}, "event_id AS e, user_id AS x, CAST(NULL AS INTEGER) AS y")

# Arrays and maps
_project("array_slice", "embeddings", {"v": "vec_id", "x": lambda: F.size(nested.slice_list(c("embedding"), -5, 3)), "y": lambda: nested.slice_list(c("embedding"), F.lit(2), F.lit(1))[0]}, "vec_id AS v, CAST(3 AS INTEGER) AS x, embedding[2] AS y")
_project("array_slice_unchecked", "embeddings", {"v": "vec_id", "x": lambda: F.size(nested.slice_list(c("embedding"), (c("vec_id") % 2).cast("int"), F.lit(4), checked=False))}, "vec_id AS v, CAST(CASE WHEN vec_id % 2 = 0 THEN 0 ELSE 4 END AS INTEGER) AS x")
_project("map_sort_nested", "nation", {"k": "n_nationkey", "first": lambda: F.map_values(nested.sort_map(F.create_map(F.lit("b"), F.create_map(F.lit("x"), c("n_name")), F.lit("a"), F.create_map(F.lit("x"), c("n_nationkey").cast("string")))))[0]["x"]}, "n_nationkey AS k, n_nationkey::VARCHAR AS first")
_project("map_sort", "nation", {"k": "n_nationkey", "first": lambda: F.map_keys(nested.sort_map(F.create_map(F.lit("b"), c("n_name"), F.lit("a"), c("n_name")), True))[0]}, "n_nationkey AS k, 'b' AS first")
_project("map_zip", "nation", {"k": "n_nationkey", "x": lambda: nested.zip_maps(F.create_map(F.lit("a"), c("n_nationkey")), F.create_map(F.lit("b"), c("n_regionkey")))["b"]["b"]}, "n_nationkey AS k, n_regionkey AS x")


# Rows and exchange
@_add("row_round_trip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _rows(t: Load) -> DataFrame:
    """Columns to one packed JSON row and back, by the schema that the reader supplies."""
    df = t("nation")
    return df.select(F.from_json(F.to_json(F.struct("*")), df.schema).alias("r")).select("r.*")


_add("exchange_hash", "SELECT l_orderkey AS k, sum(l_linenumber)::BIGINT AS s FROM lineitem GROUP BY 1")(lambda t: t("lineitem").select("l_orderkey", "l_linenumber").repartition("l_orderkey").groupBy(c("l_orderkey").alias("k")).agg(F.sum("l_linenumber").alias("s")))

_add("exchange_range", "SELECT o_orderkey AS k FROM orders")(lambda t: t("orders").select(c("o_orderkey").alias("k")).repartitionByRange(8, "k").sortWithinPartitions("k"))

# Time windows
_add("deduplicated", "SELECT DISTINCT user_id AS u, event_type AS k FROM events")(lambda t: windows.deduplicated(t("events").withColumn("ts", c("ts").cast("timestamp")), "ts", ("user_id", "event_type")).select(c("user_id").alias("u"), c("event_type").alias("k")))
_add("window_tumbling", "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS u, event_type AS k, count(*) AS n FROM events GROUP BY 1, 2")(
    lambda t: windows.windowed(t("events").withColumn("ts", c("ts").cast("timestamp")), "ts", "1 hour", by=("event_type",), n=F.count("*")).select(F.unix_micros("start").alias("u"), c("event_type").alias("k"), "n")
)
_add("window_sliding")(lambda t: windows.windowed(t("events").withColumn("ts", c("ts").cast("timestamp")), "ts", "1 hour", "30 minutes", n=F.count("*")).select("start", "end", "n"))
_add("window_session")(lambda t: windows.sessions(t("events").withColumn("ts", c("ts").cast("timestamp")), "ts", "30 minutes", "user_id", n=F.count("*")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue and rank per nation and shipping month."""
    return _flagship(partial(tables.table, spark, sf_dir))


@_add("revenue_by_nation_month", "SELECT n_name AS nation, CAST(CAST(date_trunc('month', l_shipdate) AS DATE) AS VARCHAR) AS month, round(sum(l_extendedprice * (1 - l_discount)), 0) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def _flagship(t: Load) -> DataFrame:
    rows = t("lineitem").join(t("orders"), c("l_orderkey") == c("o_orderkey")).join(t("customer"), c("o_custkey") == c("c_custkey")).join(t("nation"), c("c_nationkey") == c("n_nationkey"))
    month = times.truncate_date(F.to_date("l_shipdate"), "MONTH").cast("string")
    return rows.groupBy(c("n_name").alias("nation"), month.alias("month")).agg(F.round(F.sum(c("l_extendedprice") * (1 - c("l_discount"))), 0).alias("revenue"), F.count("*").alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: lambda spark, sf_dir, f=f: f(partial(tables.table, spark, sf_dir)) for name, f in (_QUERIES | edges.QUERIES).items()}


def oracle_sql() -> dict[str, str]:
    return _SQL | edges.SQL
