from datetime import date

from pyspark.sql import functions as F

from tidewater.functions import times
from tidewater.plans import registry

#: 29 February of 1500, 1400 and 1300 in the Julian calendar, by their Gregorian dates; the Gregorian years lack that day.
LOST = [date(y, 3, d).toordinal() - date(1970, 1, 1).toordinal() for y, d in ((1300, 8), (1400, 9), (1500, 10))]


def same(spark, tmp_path, name, low, high):
    spark.range(low, high).withColumnRenamed("id", "o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    rows = registry.queries()[name](spark, str(tmp_path)).groupBy("same").count().collect()
    return {r.same: r["count"] for r in rows}


def test_days_that_the_gregorian_calendar_lacks(spark, tmp_path):
    j = F.col("id")
    days = spark.range(-300_000, -141_000).select("id", times.gregorian_to_julian_days(times.julian_to_gregorian_days(j)).alias("back"), times.gregorian_lacks(j).alias("lost"))
    assert sorted((r.id, r.back) for r in days.where("back <> id").collect()) == [(d, d + 1) for d in LOST]
    assert sorted(r.id for r in days.where("lost").collect()) == LOST
    assert same(spark, tmp_path, "rebase_round_trip", 0, 150_000) == {True: 150_000}


def test_times_of_such_days(spark, tmp_path):
    day = 86_400_000_000
    for at in (LOST[2] * day, LOST[2] * day + day - 1):
        r = spark.range(1).select(times.gregorian_to_julian_micros(times.julian_to_gregorian_micros(F.lit(at))).alias("back"), times.gregorian_lacks_micros(F.lit(at)).alias("lost")).first()
        assert r.back == at + day and r.lost
    assert same(spark, tmp_path, "rebase_micros_round_trip", 372_000, 373_000) == {True: 1000}
