"""Distributed ranks equal windows; CSV sources handle padded files."""

import os
import random
import tempfile

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinfold.operators import ordered
from kinfold.sources import files


def test_row_number_and_prefix_sums_equal_windows(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice(["a", "b", "c"]), rnd.randint(0, 30), rnd.random()) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, g string, k int, v double")
    got = ordered.prefix_sums(df, ["k", "id"], {"rn": F.lit(1), "cum": "v"}, ["g"], ranges=7)
    w = Window.partitionBy("g").orderBy("k", "id").rowsBetween(Window.unboundedPreceding, 0)
    exp = df.select("id", F.count(F.lit(1)).over(w).alias("rn2"), F.sum("v").over(w).alias("cum2"))
    j = got.join(exp, "id")
    assert j.count() == 3000
    assert j.where((F.col("rn") != F.col("rn2")) | (F.abs(F.col("cum") - F.col("cum2")) > 1e-9)).count() == 0


def test_dense_rank_distinct(spark):
    df = spark.createDataFrame([(x,) for x in ["b", "a", "c", "a", None, "b"]], "x string")
    r = {row["x"]: row["rank"] for row in ordered.dense_rank_distinct(df, "x").collect()}
    assert r == {"a": 1, "b": 2, "c": 3}


def test_padded_prediction_csv(spark):
    d = tempfile.mkdtemp(prefix="kinfold-csv-")
    with open(os.path.join(d, "sub.csv"), "w") as f:
        f.write("PassengerId,Survived\n        892,        0\n        893,        1\n")
    r = files.read_predictions(spark, d).orderBy("PassengerId").collect()
    assert [(x["PassengerId"], x["Survived"]) for x in r] == [(892, 0), (893, 1)]


def test_quoted_commas_and_empty_fields(spark):
    d = tempfile.mkdtemp(prefix="kinfold-csv-")
    with open(os.path.join(d, "m.csv"), "w") as f:
        f.write('PassengerId,Survived,Pclass,Name,Sex,Age,SibSp,Parch,Ticket,Fare,Cabin,Embarked\n'
                '1,0,3,"Braund, Mr. Owen",male,22,1,0,A/5 21171,7.25,,S\n'
                '2,1,1,"Cumings, Mrs. John (Florence ""Flo"")",female,,1,0,PC 17599,71.2833,C85,C\n')
    r = files.src_csv(spark, d, files.TRAIN_SCHEMA).orderBy("PassengerId").collect()
    assert r[0]["Name"] == "Braund, Mr. Owen" and r[0]["Cabin"] is None
    assert r[1]["Name"] == 'Cumings, Mrs. John (Florence "Flo")' and r[1]["Age"] is None
