"""File sources and sinks, and schema contracts.

Everything is written under the cluster's shared ``spark.checkpoint.dir``
(or a caller-given shared path); nothing goes through the driver.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

# Fixed manifest contract (name and order).
TRAIN_SCHEMA = T.StructType([
    T.StructField("PassengerId", T.LongType()), T.StructField("Survived", T.IntegerType()),
    T.StructField("Pclass", T.IntegerType()), T.StructField("Name", T.StringType()),
    T.StructField("Sex", T.StringType()), T.StructField("Age", T.DoubleType()),
    T.StructField("SibSp", T.IntegerType()), T.StructField("Parch", T.IntegerType()),
    T.StructField("Ticket", T.StringType()), T.StructField("Fare", T.DoubleType()),
    T.StructField("Cabin", T.StringType()), T.StructField("Embarked", T.StringType()),
])
TEST_SCHEMA = T.StructType([f for f in TRAIN_SCHEMA.fields if f.name != "Survived"])
PREDICTION_SCHEMA = T.StructType([T.StructField("PassengerId", T.LongType()),
                                  T.StructField("Survived", T.IntegerType())])


def shared_path(spark: SparkSession, kind: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}/{uuid.uuid4().hex}"


def src_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Headered CSV with quoted commas; empty fields and surrounding spaces
    (right-aligned files) handled; declared schema, no inference."""
    r = (spark.read.option("header", True).option("quote", '"').option("escape", '"')
         .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
         .option("nullValue", "").option("mode", "FAILFAST"))
    return r.schema(schema).csv(path) if schema is not None else r.csv(path)


def sink_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    (df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
       .option("nullValue", "").option("emptyValue", "").csv(path))
    return path


def union_provenance(train: DataFrame, test: DataFrame, label: str = "Survived",
                     split_col: str = "split") -> DataFrame:
    """Scoring rows get a NULL label; both are tagged and unioned by name."""
    t = test.withColumn(label, F.lit(None).cast(train.schema[label].dataType)) if label not in test.columns else test
    return (train.withColumn(split_col, F.lit("train"))
            .unionByName(t.withColumn(split_col, F.lit("test")), allowMissingColumns=True))


def check_schema(df: DataFrame, expected: list[str]) -> DataFrame:
    """(column, expected_pos, actual_pos, status, non_null): status ok /
    moved / missing / extra against the expected column list (name and
    order), with the non-null count of every present column (one pass)."""
    spark = df.sparkSession
    actual = df.columns
    rows = []
    for i, c in enumerate(expected):
        if c in actual:
            j = actual.index(c)
            rows.append((c, i + 1, j + 1, "ok" if i == j else "moved"))
        else:
            rows.append((c, i + 1, None, "missing"))
    for j, c in enumerate(actual):
        if c not in expected:
            rows.append((c, None, j + 1, "extra"))
    report = spark.createDataFrame(rows, "column string, expected_pos int, actual_pos int, status string")
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(actual)])
    stack = ", ".join(f"'{c}', c{i}" for i, c in enumerate(actual))
    nn = counts.selectExpr(f"stack({len(actual)}, {stack}) AS (column, non_null)")
    return report.join(nn, "column", "left")


def check_leakage(df: DataFrame, label: str = "Survived") -> DataFrame:
    """Whether the label column is present in a table, with the row count
    and (when present) the number of non-null labels."""
    leak = label in df.columns
    agg = df.agg(F.count(F.lit(1)).alias("n_rows"),
                 (F.count(F.col(label)) if leak else F.lit(None).cast("long")).alias("n_labels"))
    return agg.select(F.lit(label).alias("column"), F.lit(leak).alias("present"),
                      F.lit("leak" if leak else "ok").alias("status"), "n_rows", "n_labels")


def check_shape(df: DataFrame, expected_rows: int | None = None, expected_cols: int | None = None) -> DataFrame:
    n = df.agg(F.count(F.lit(1)).alias("n_rows"))
    out = n.withColumn("n_cols", F.lit(len(df.columns)))
    if expected_rows is not None:
        out = out.withColumn("rows_ok", F.col("n_rows") == expected_rows)
    if expected_cols is not None:
        out = out.withColumn("cols_ok", F.col("n_cols") == expected_cols)
    return out


def sink_predictions(pred: DataFrame, id_col: str, pred_col: str, tag: str, base: str | None = None) -> str:
    """(id, Survived int) CSV with header; one folder per tag and time."""
    spark = pred.sparkSession
    path = base or shared_path(spark, f"submissions/{tag}_{time.strftime('%Y%m%d_%H%M%S')}")
    out = pred.select(F.col(id_col).cast("long").alias("PassengerId"), F.col(pred_col).cast("int").alias("Survived"))
    return sink_csv(out, path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return src_csv(spark, path, PREDICTION_SCHEMA)


def sink_table(df: DataFrame, path: str, fmt: str = "csv") -> str:
    if fmt == "csv":
        return sink_csv(df, path)
    df.write.mode("overwrite").parquet(path)
    return path


def sink_run_metrics(record: DataFrame, path: str, mode: str, tag: str, seed: int, params: dict | None = None) -> str:
    """Append metrics records (JSON): mode, tag, epoch (seconds of the run's
    time), seed, params (a JSON object) and the record's own values;
    partitioned by ``mode``. Records of different modes differ in shape."""
    head = [F.lit(mode).alias("mode"), F.lit(tag).alias("tag"), F.unix_timestamp().alias("epoch"),
            F.lit(seed).cast("long").alias("seed"), F.lit(json.dumps(params or {}, sort_keys=True)).alias("params")]
    record.select(*head, "*").write.mode("append").partitionBy("mode").json(path)
    return path


def src_metrics_json(spark: SparkSession, path: str) -> DataFrame:
    """All metrics files of differing shapes as one wide table (missing
    fields NULL), with the source file name."""
    return (spark.read.option("multiLine", False).json(path)
            .withColumn("file_name", F.col("_metadata.file_name")))


def sink_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def src_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
