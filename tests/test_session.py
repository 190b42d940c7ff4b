from pyspark.sql import functions as F

from depframe.session import materialise


def test_tables_count_at_their_size_in_memory(spark):
    """A written table of few bytes and many rows is not broadcast: the driver would hold all of its rows."""
    rows = spark.range(1_000_000).select(F.col("id").alias("k"), F.lit("IF stage = 2 THEN").alias("raw"), (F.col("id") % 5).alias("v"))
    written = materialise(rows.repartitionByRange(1, "k"), "packed")
    size = written._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert int(size) > 60e6
    joined = written.join(materialise(rows.select("k"), "keys"), "k")
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().sparkPlan().toString()
    # What adaptive execution finds to be small still is.
    few = written.join(written.where("k < 5").select("k").distinct(), "k")
    assert few.count() == 5
