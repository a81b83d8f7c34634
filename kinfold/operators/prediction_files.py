"""Stored prediction sets compared by content.

A set is a CSV file (id, prediction), or a folder of part files that Spark
wrote. Sets are rows, not columns: any number of files is read in one scan and
told apart by the path of each row.

Defined results: a row without an id is no prediction of any set's pairs, nor
is a NULL prediction; an id that a set repeats counts once, by its least
prediction. The digest of a set takes every row, repeated and NULL ones too,
in any order. A file without rows is no set. A pair of sets without a common
id has no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import PREDICTION_SCHEMA
from .joins import join_back

ID, PREDICTION = "PassengerId", "Survived"


def _decoded(text: Column) -> Column:
    return F.url_decode(F.regexp_replace(text, r"\+", "%2B"))


def set_name(path: Column) -> Column:
    """The file's name without ``.csv``; of a part file, its folder's. A folder
    ``set=<name>`` has its name escaped once more than the path."""
    parts = F.split(path, "/")
    last, folder = _decoded(F.element_at(parts, -1)), _decoded(F.element_at(parts, -2))
    name = F.when(~last.startswith("part-"), F.regexp_replace(last, r"\.csv$", ""))
    return name.when(folder.startswith("set="), _decoded(F.substring(folder, 5, 2**31 - 1))).otherwise(folder)


def write_sets(sets: DataFrame, path: str) -> str:
    """(set, id, prediction) rows as a folder of CSV files a set, in one pass."""
    out = sets.select("set", F.col(ID).cast("long").alias(ID), F.col(PREDICTION).cast("int").alias(PREDICTION))
    out.write.mode("overwrite").partitionBy("set").option("header", True).csv(path)
    return path


def read_sets(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All prediction files below ``path`` as (set, PassengerId, Survived)."""
    rows = (spark.read.schema(PREDICTION_SCHEMA).option("header", True).option("recursiveFileLookup", True)
            .option("pathGlobFilter", "*.csv").option("enforceSchema", False).option("mode", "FAILFAST")
            .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path))
    return rows.select(set_name(F.col("_metadata.file_path")).alias("set"), ID, PREDICTION)


def digests(sets: DataFrame) -> DataFrame:
    """A row a set: n_rows, positives, digest (equal for equal rows in any
    order), first_set (the least name with that digest) and n_equal."""
    row = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (ID, PREDICTION)]
    total = [F.sum(F.xxhash64(F.lit(salt), *row).cast("decimal(38,0)")).cast("string") for salt in ("a", "b")]
    one = sets.groupBy("set").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.coalesce(F.col(PREDICTION), F.lit(0))).cast("long").alias("positives"),
                                  F.concat_ws(",", *total).alias("__sums"))
    one = one.withColumn("digest", F.md5(F.concat_ws(",", F.col("n_rows").cast("string"), "__sums"))).drop("__sums")
    same = one.groupBy("digest").agg(F.min("set").alias("first_set"), F.count(F.lit(1)).alias("n_equal"))
    return join_back(one, same, "digest")


def agreement(sets: DataFrame) -> DataFrame:
    """(set_a, set_b, n, n_diff, agreement, identical) of every two sets with a
    common id, set_a < set_b; identical: no difference on the common ids.

    Ids with the same predictions in the same sets are counted together first,
    so pairs are made once a pattern and not once an id; a pattern holds no
    more entries than there are sets."""
    one = sets.where(F.col(ID).isNotNull() & F.col(PREDICTION).isNotNull()).groupBy(ID, "set").agg(F.min(PREDICTION).alias("v"))
    pattern = F.array_sort(F.collect_list(F.struct("set", "v"))).alias("pattern")
    patterns = one.groupBy(ID).agg(pattern).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    first = patterns.select("n", "pattern", F.posexplode("pattern").alias("i", "a"))
    pairs = first.select("n", "a", F.explode(F.slice("pattern", F.col("i") + 2, F.size("pattern"))).alias("b"))
    out = pairs.groupBy(F.col("a.set").alias("set_a"), F.col("b.set").alias("set_b")).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("a.v") != F.col("b.v"), F.col("n")).otherwise(0)).alias("n_diff"))
    return out.withColumn("agreement", 1 - F.col("n_diff") / F.col("n")).withColumn("identical", F.col("n_diff") == 0)
