"""The NULL 'no group' key does not land in one reducer."""

from pyspark.sql import functions as F

from kinfold.operators.joins import join_back


def test_null_keys_spread_over_partitions(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")          # keep the 8 shuffle partitions visible
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")   # force a shuffle join
    try:
        rows = spark.range(20000).select(F.col("id").alias("PassengerId"),
                                         F.when(F.col("id") % 10 == 0, (F.col("id") % 50).cast("string"))
                                          .alias("GroupId"))
        reg = rows.where(F.col("GroupId").isNotNull()).groupBy("GroupId").count()
        out = join_back(rows, reg, "GroupId", spread_on="PassengerId")
        assert out.count() == 20000                                  # no row lost or duplicated
        assert out.where(F.col("GroupId").isNotNull() & F.col("count").isNull()).count() == 0
        per_part = (out.where(F.col("GroupId").isNull()).groupBy(F.spark_partition_id().alias("p")).count()
                    .collect())
        nulls = sum(r["count"] for r in per_part)
        assert nulls == 18000
        assert len(per_part) >= 4 and max(r["count"] for r in per_part) < 0.5 * nulls
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
