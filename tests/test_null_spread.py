"""Rows without a join key are dealt over the tasks of the join itself."""

from pyspark.sql import functions as F

from kinfold.operators.joins import join_back


def test_rows_without_a_key_are_dealt_by_the_spread(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(1000).withColumn("k", F.when(F.col("id") < 10, F.col("id") % 3))
        reg = rows.where(F.col("k").isNotNull()).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        out = join_back(rows, reg, "k", spread_on="id")
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    joins = [x for x in plan.splitlines() if "hashpartitioning(" in x and "__spread" in x]
    assert len(joins) == 2, plan
    assert {(r.k, r.n) for r in out.collect()} == {(None, None), (0, 4), (1, 3), (2, 3)} and out.count() == 1000
