"""Missing-value handling.

Scalar fills (median, mode) are one-row (or one-row-per-group) aggregates
joined back; medians are exact and distributed (``profile.exact_quantiles``).
Model-based fills train an MLlib regression tree on the rows where the value
is present and predict the rest.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ordered
from .joins import join_back, join_null_safe, with_scalar
from .profile import exact_quantiles, exact_quantiles_by_column, mode_table


def impute_constant(df: DataFrame, values: dict) -> DataFrame:
    return df.fillna(values)


def impute_median(df: DataFrame, cols: list[str], group_cols: list[str] | None = None,
                  suffix: str = "") -> DataFrame:
    """Fill NULLs with the exact median of the column (over ``group_cols``
    when given: the per-split scope). ``suffix`` writes to a new column."""
    g = list(group_cols or [])
    out = df
    if not g:  # all columns in one pass
        med = exact_quantiles_by_column(df, cols, {"med": 0.5}).groupBy().pivot("column", cols).agg(F.first("med"))
        out = with_scalar(out, med.select(*[F.col(c).alias(f"__med_{c}") for c in cols]))
        for c in cols:
            out = out.withColumn(c + suffix, F.coalesce(F.col(c), F.col(f"__med_{c}")))
        return out.drop(*[f"__med_{c}" for c in cols])
    for c in cols:
        med = exact_quantiles(df, c, {"__med": 0.5}, g).select(*g, F.col("__med").alias(f"__med_{c}"))
        out = join_null_safe(out, med, g, "left")
        out = out.withColumn(c + suffix, F.coalesce(F.col(c), F.col(f"__med_{c}"))).drop(f"__med_{c}")
    return out


def impute_mode(df: DataFrame, cols: list[str], group_cols: list[str] | None = None) -> DataFrame:
    """Fill NULLs with the most frequent value (ties -> smallest)."""
    g = list(group_cols or [])
    out = df
    for c in cols:
        top = mode_table(df, c, g).select(*g, F.col("top").alias(f"__top_{c}"))
        out = join_back(out, top, g) if g else with_scalar(out, top)
        out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"__top_{c}"))).drop(f"__top_{c}")
    return out


def label_encode(df: DataFrame, col: str, out: str) -> DataFrame:
    """Integer code of each value in sorted order of the distinct values
    (0-based); the distinct values are ranked without a global window."""
    ranks = ordered.dense_rank_distinct(df, col, "__r")
    res = join_back(df, ranks, col)
    return res.withColumn(out, F.col("__r") - 1).drop("__r")


def tree_imputer(target: str, numeric: list[str], categorical: list[str],
                 max_depth: int = 10, seed: int = 42) -> Pipeline:
    """Regression tree ``target ~ features`` (categoricals indexed)."""
    idx = [StringIndexer(inputCol=c, outputCol=f"{c}__idx", handleInvalid="keep") for c in categorical]
    vec = VectorAssembler(inputCols=numeric + [f"{c}__idx" for c in categorical],
                          outputCol=f"{target}__features", handleInvalid="keep")
    tree = DecisionTreeRegressor(featuresCol=f"{target}__features", labelCol=target,
                                 predictionCol=f"{target}__pred", maxDepth=min(max_depth, 30),
                                 maxBins=64, seed=seed)
    return Pipeline(stages=idx + [vec, tree])


def fit_tree_imputer(df: DataFrame, target: str, numeric: list[str], categorical: list[str],
                     max_depth: int = 10) -> PipelineModel:
    """Fit on the rows where ``target`` is present."""
    return tree_imputer(target, numeric, categorical, max_depth).fit(df.where(F.col(target).isNotNull()))


def apply_tree_imputer(df: DataFrame, model: PipelineModel, target: str) -> DataFrame:
    """coalesce(target, prediction); helper columns are dropped."""
    scored = model.transform(df)
    keep = [c for c in df.columns]
    return scored.select(*[F.coalesce(F.col(c), F.col(f"{target}__pred")).alias(c) if c == target else F.col(c)
                           for c in keep])


def impute_tree_fit_apply(df: DataFrame, specs: list[tuple[str, list[str], list[str]]],
                          max_depth: int = 10) -> DataFrame:
    """Fit-and-fill in sequence within one frame, e.g. Age from title and
    family columns, then Fare using the filled Age."""
    out = df
    for target, num, cat in specs:
        model = fit_tree_imputer(out, target, num, cat, max_depth)
        out = apply_tree_imputer(out, model, target)
    return out


def fit_persisted_imputers(train: DataFrame, specs, max_depth: int = 10) -> dict:
    """Fit one imputer per target on the training frame only; targets with
    no present value are skipped."""
    models = {}
    cur = train
    for target, num, cat in specs:
        if cur.where(F.col(target).isNotNull()).limit(1).count() == 0:
            continue
        models[target] = fit_tree_imputer(cur, target, num, cat, max_depth)
        cur = apply_tree_imputer(cur, models[target], target)
    return models


def apply_persisted_imputers(df: DataFrame, models: dict, specs) -> DataFrame:
    out = df
    for target, _, _ in specs:
        if target in models:
            out = apply_tree_imputer(out, models[target], target)
    return out
