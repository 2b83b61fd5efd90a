from pyspark.sql import functions as F

from folioflow.llm import components


def test_size_estimates_do_not_grow_with_the_rounds(spark):
    """Each round's joins multiplied the estimates of the round before; the driver keeps them as whole numbers."""
    n = F.col("id")
    links = spark.range(999).select(F.xxhash64(n).alias("a"), F.xxhash64(n + 1).alias("b"))
    found = components.connected_components(links, one_task=0)
    stats = found._jdf.queryExecution().optimizedPlan().stats().simpleString()
    assert "E+" not in stats, stats
    assert found.select("component").distinct().count() == 1
    assert found.count() == 1000
