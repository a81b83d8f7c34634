"""One-hot vectors from a table of levels against the columns of the stored preprocessing."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from kinfold.operators import encode as E
from kinfold.operators import models as M

TRAIN = [(1, "b", 3, None), (2, "a", 1, None), (3, "b", None, None), (4, None, 3, None), (5, "é", 2, None), (5, "é", 2, None), (6, "", 10, None)]
OTHER = [(7, "c", 9, "x"), (8, None, None, None), (9, "a", 10, "y"), (None, "b", 3, None)]
SCHEMA = "id int, `s.x` string, n int, empty string"
COLS = ["s.x", "n", "empty"]


def vectors(d):
    return sorted((r.id or 0, list(r.v)) for r in d.select("id", vector_to_array("features").alias("v")).collect())


def plain(train, rows):
    levels, modes = [], []
    for i in (1, 2, 3):
        seen = [str(r[i]) for r in train if r[i] is not None]
        levels.append(sorted(set(seen)))
        modes.append(min(levels[-1], key=lambda v: (-seen.count(v), v)) if seen else None)
    out = []
    for r in rows:
        held = [modes[i] if r[i + 1] is None else str(r[i + 1]) for i in range(3)]
        out.append((r[0] or 0, [float(held[i] == lev) for i in range(3) for lev in levels[i]]))
    return sorted(out)


def test_vectors_by_hand(spark):
    train, rows = spark.createDataFrame(TRAIN, SCHEMA), spark.createDataFrame(TRAIN + OTHER, SCHEMA)
    levels = E.fit_levels(train, COLS)
    assert levels.sizes == {"s.x": 4, "n": 4, "empty": 0} and levels.modes == {"s.x": "b", "n": "2", "empty": None}
    assert vectors(E.assemble(rows, levels, spread_on="id")) == plain(TRAIN, TRAIN + OTHER)
    assert E.assemble(rows, levels).columns == ["id", "s.x", "n", "empty", "features"]


def test_same_entries_as_the_stored_preprocessing(spark):
    cols = ["s", "n"]
    train = spark.createDataFrame(TRAIN, SCHEMA).withColumnRenamed("s.x", "s")
    rows = spark.createDataFrame(OTHER, SCHEMA).withColumnRenamed("s.x", "s").withColumn("z", F.lit(0.5))
    stored = M.fit_prep_onehot(train, cols)
    want = M.apply_prep_onehot(rows, stored).select("id", F.array("z", *[F.col(f"`{c}`") for c in M.onehot_names(stored)]).alias("v"))
    assert vectors(E.assemble(rows, E.fit_levels(train, cols), ["z"])) == sorted((r.id or 0, list(r.v)) for r in want.collect())


def test_indicators_of_named_levels(spark):
    train, rows = spark.createDataFrame(TRAIN, SCHEMA), spark.createDataFrame(OTHER, SCHEMA)
    d = E.indicators(rows, E.fit_levels(train, COLS), {"s.x": ["b", "c"], "empty": ["x"]})
    got = {r[0]: tuple(r)[4:] for r in d.collect()}
    assert got == {7: (0.0, 0.0, 0.0), 8: (1.0, 0.0, 0.0), 9: (0.0, 0.0, 0.0), None: (1.0, 0.0, 0.0)}


def test_empty_tables(spark):
    none, rows = spark.createDataFrame([], SCHEMA), spark.createDataFrame(OTHER, SCHEMA)
    assert [v for _, v in vectors(E.assemble(rows, E.fit_levels(none, COLS)))] == [[]] * 4
    assert vectors(E.assemble(none, E.fit_levels(spark.createDataFrame(TRAIN, SCHEMA), COLS))) == []


def test_many_levels_and_a_hot_one(spark):
    """100 000 levels, one of which holds a third of all rows."""
    rows = spark.range(150_000).select("id", F.when(F.col("id") >= 100_000, "000007").otherwise(F.lpad(F.col("id").cast("string"), 6, "0")).alias("c"))
    levels = E.fit_levels(rows, ["c"])
    assert levels.sizes == {"c": 100_000} and levels.modes == {"c": "000007"}
    at = E.with_positions(rows, levels).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("c__position") == F.col("c").cast("int"), 1)).alias("ok")).first()
    assert (at.n, at.ok) == (150_000, 150_000)
    v = E.assemble(rows.where("id in (0, 99999, 120000)"), levels).orderBy("id").collect()
    assert [(r.features.size, r.features.indices.tolist()) for r in v] == [(100_000, [0]), (100_000, [99_999]), (100_000, [7])]
