"""Manifest adapter: the 12-column passenger manifest view over the driver
tables (orders joined to customer and nation).

The adapter only shapes rows into the manifest schema; it does none of the
operators' work. One SQL text is used for Spark (DataFrames bound to the
``{orders}`` style placeholders) and for the DuckDB oracle (plain view
names), so both engines see identical input.

Fare is computed with integer cents so both engines round identically
(half-up at two decimals): ``round(abs(acctbal)/20 + (c*10 + k%4) % 7, 2)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed derivation rules of the manifest view (k = o_orderkey, c = o_custkey).
MANIFEST_SELECT = """
SELECT
  CAST(k + 1 AS BIGINT) AS PassengerId,
  CAST(CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 0 END AS INT) AS Survived,
  CAST(c % 3 + 1 AS INT) AS Pclass,
  CASE WHEN k % 6 = 0 THEN 'KIN_' || CAST(k % 25 AS STRING) ELSE n_name END
    || ', ' ||
  CASE WHEN k % 11 <= 1 THEN 'Master' WHEN k % 11 <= 5 THEN 'Mr' WHEN k % 11 = 6 THEN 'Dr'
       WHEN k % 11 <= 8 THEN 'Mrs' ELSE 'Miss' END
    || '. ' || c_name AS Name,
  CASE WHEN k % 11 >= 7 THEN 'female' ELSE 'male' END AS Sex,
  CASE WHEN k % 5 = 0 THEN NULL ELSE CAST((k * 7919) % 80 AS DOUBLE) END AS Age,
  CAST(k % 4 AS INT) AS SibSp,
  CAST(k % 3 AS INT) AS Parch,
  'PC ' || CAST(c * 10 + k % 4 AS STRING) AS Ticket,
  CASE WHEN k % 97 = 0 THEN NULL
       ELSE (floor((round(abs(c_acctbal) * 100) + 10) / 20) + ((c * 10 + k % 4) % 7) * 100) / 100.0
  END AS Fare,
  CASE WHEN k % 4 = 1 THEN substr('ABCDEFG', CAST(c % 7 + 1 AS INT), 1) || CAST(c % 90 AS STRING) END AS Cabin,
  CASE WHEN k % 311 = 0 THEN NULL ELSE substr('SCQ', CAST(c % 3 + 1 AS INT), 1) END AS Embarked
FROM (
  SELECT o.o_orderkey AS k, o.o_custkey AS c, o.o_orderstatus, cu.c_name, cu.c_acctbal, n.n_name
  FROM {orders} o
  JOIN {customer} cu ON o.o_custkey = cu.c_custkey
  JOIN {nation} n ON cu.c_nationkey = n.n_nationkey
) src
"""

MANIFEST_COLUMNS = ["PassengerId", "Survived", "Pclass", "Name", "Sex", "Age", "SibSp",
                    "Parch", "Ticket", "Fare", "Cabin", "Embarked"]


def manifest_sql_for_duckdb() -> str:
    """The same text with the placeholders bound to DuckDB view names.
    Fare is cast to DOUBLE (DuckDB's decimal literal arithmetic)."""
    return (MANIFEST_SELECT.replace("{orders}", "orders")
            .replace("{customer}", "customer").replace("{nation}", "nation")
            .replace("/ 100.0\n", "/ 100.0::DOUBLE\n"))


def manifest_cte() -> str:
    """``WITH manifest AS (...)`` prefix for oracle SQL strings."""
    return f"WITH manifest AS ({manifest_sql_for_duckdb()})\n"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combined manifest (labelled and scoring rows); ``Survived`` is NULL
    on scoring rows. Nation is a fixed 25-row dimension, so it is the only
    side hinted for broadcast; orders-customer is left to AQE."""
    from pyspark.sql import functions as F
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    nation = F.broadcast(read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    df = spark.sql(MANIFEST_SELECT, orders=orders, customer=customer, nation=nation)
    return df.withColumn("Fare", F.col("Fare").cast("double"))


def manifest_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows with the 12-column training schema."""
    from pyspark.sql import functions as F
    return manifest(spark, sf_dir).where(F.col("Survived").isNotNull())


def manifest_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring rows with the 11-column schema (no label column)."""
    from pyspark.sql import functions as F
    return manifest(spark, sf_dir).where(F.col("Survived").isNull()).drop("Survived")
