"""Durations under a minute have one digit, rounded as C rounds the double's exact value."""

from pyspark.sql import functions as F

from folioflow.functions import text as tx


def test_one_digit_of_every_cent_as_c_prints_it(spark):
    cents = spark.range(0, 240_000).select((F.col("id") / 100 / 40).alias("x"))
    got = cents.select("x", tx.short_duration(F.col("x")).alias("timed")).collect()
    assert [r["timed"] for r in got] == ["%.1fs" % r["x"] for r in got]
    ties = spark.createDataFrame([(x,) for x in (0.25, 0.75, 46.15, 46.25, 59.96, -1.25, -0.04, 0.05, 1e-300)], "x double")
    assert all(r["timed"] == "%.1fs" % r["x"] for r in ties.select("x", tx.short_duration(F.col("x")).alias("timed")).collect())
