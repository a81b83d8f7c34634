"""One-hot vectors by a table of levels.

The levels of a column are rows of a table, ranked and joined in Spark, and a
row's levels become one sparse vector; no level value reaches the driver, which
holds two values a column: the number of levels and the mode.

Defined results: a NULL takes the column's mode (ties: the smallest level); a
value without a level in training, and any value of a column that had only
NULLs in training, gives zeros; an empty training table gives vectors without
level entries; a repeated row is a row of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .joins import join_back
from .ordered import row_number


@dataclass
class Levels:
    """``table`` (column, level, position from 0 by sorted level); ``sizes``
    and ``modes`` by column, in the order of the columns."""
    table: DataFrame
    sizes: dict[str, int]
    modes: dict[str, str | None]

    def value(self, col: str) -> Column:
        return F.coalesce(F.col(f"`{col}`").cast("string"), F.lit(self.modes[col]).cast("string"))


def fit_levels(train: DataFrame, cols: list[str]) -> Levels:
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("level")) for c in cols])
    counts = materialize(train.select(F.inline(pairs)).where(F.col("level").isNotNull())
                         .groupBy("column", "level").agg(F.count(F.lit(1)).alias("n")))
    summary = {r["column"]: r for r in counts.groupBy("column").agg(   # one row a column
        F.count(F.lit(1)).alias("size"), F.min_by("level", F.struct(-F.col("n"), "level")).alias("mode")).collect()}
    ranked = row_number(counts.select("column", "level"), ["level"], ["column"], out="position")
    table = materialize(ranked.withColumn("position", F.col("position") - 1))
    return Levels(table, {c: summary[c]["size"] if c in summary else 0 for c in cols},
                  {c: summary[c]["mode"] if c in summary else None for c in cols})


def with_positions(df: DataFrame, levels: Levels, spread_on: list[str] | str | None = None) -> DataFrame:
    """``df`` with ``<column>__position`` for each column: the level's position,
    NULL where training had no such level."""
    for c in levels.sizes:
        reg = levels.table.where(F.col("column") == c).select(F.col("level").alias("__level"), F.col("position").alias(f"{c}__position"))
        df = join_back(df.withColumn("__level", levels.value(c)), reg, "__level", spread_on=spread_on).drop("__level")
    return df


def indicators(df: DataFrame, levels: Levels, wanted: dict[str, list[str]], spread_on: list[str] | str | None = None) -> DataFrame:
    """One 0/1 column ``<column>_<level>`` for each level that the caller names;
    a level that training did not have is all zeros."""
    d = with_positions(df, levels, spread_on)
    seen = {f"{c}_{lev}": F.coalesce(((levels.value(c) == lev) & F.col(f"`{c}__position`").isNotNull()).cast("double"), F.lit(0.0))
            for c, levs in wanted.items() for lev in levs}
    return d.withColumns(seen).drop(*[f"{c}__position" for c in levels.sizes])


def assemble(df: DataFrame, levels: Levels, numeric: list[str] = (), out: str = "features",
             spread_on: list[str] | str | None = None) -> DataFrame:
    """``out``: the numeric columns, then an entry for each level of each
    column, as one sparse vector."""
    d = with_positions(df, levels, spread_on)
    used = {c: i for i, (c, n) in enumerate(levels.sizes.items()) if n}   # numbers: MLlib takes no name with a dot
    # A position of ``size`` stands for no level: "keep" adds that slot, and dropping the last one takes it off.
    d = d.withColumns({f"__p{i}": F.coalesce(F.col(f"`{c}__position`"), F.lit(levels.sizes[c])).cast("double") for c, i in used.items()})
    at, vectors = [f"__p{i}" for i in used.values()], [f"__v{i}" for i in used.values()]
    if used:
        last = df.sparkSession.createDataFrame([tuple(float(levels.sizes[c] - 1) for c in used)], ", ".join(f"{p} double" for p in at))
        d = OneHotEncoder(inputCols=at, outputCols=vectors, handleInvalid="keep", dropLast=True).fit(last).transform(d)
    d = VectorAssembler(inputCols=[*numeric, *vectors], outputCol=out).transform(d)
    return d.drop(*at, *vectors, *[f"{c}__position" for c in levels.sizes])
