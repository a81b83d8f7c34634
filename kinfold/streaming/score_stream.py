"""Score arriving manifest rows with a fitted group model.

The fitted part of the group cascade is a static registry (group key ->
labelled rate); scoring a new row is a projection plus a stream-static
join, so the same code runs on a batch or a streaming DataFrame. Not a
reference operator: the reference has no streaming code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import groups as G
from ..operators import rules as R


def fit_registry(labelled: DataFrame) -> DataFrame:
    """Group key -> rate over labelled rows (keys built without attach:
    a streamed row sees only itself)."""
    d = G.add_group_key(G.engineer_keys(labelled))
    return G.group_registry(d).select("GroupId", F.col("rate").alias("GroupSurvival"))


def score_rows(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Gender baseline, then the group flips for rows of known groups."""
    d = G.add_group_key(G.engineer_keys(rows))
    # Stream-static left join; NULL keys (adult men) never match.
    d = d.join(registry, "GroupId", "left")
    return R.run_cascade(d, R.baseline_gender(), [R.group_flip()]) \
        .select("PassengerId", "GroupId", "GroupSurvival", "prediction", "decided_by")


def run_to_memory(spark: SparkSession, source_dir: str, schema, registry: DataFrame,
                  query_name: str, checkpoint: str):
    """Process every file in ``source_dir`` once and return the rows written
    to an in-memory table (for local runs and tests)."""
    stream = spark.readStream.schema(schema).parquet(source_dir)
    q = (score_rows(stream, registry).writeStream.format("memory").queryName(query_name)
         .option("checkpointLocation", checkpoint).outputMode("append").start())
    q.processAllAvailable()
    q.stop()
    return spark.table(query_name)
