"""Preprocessing and models, trained with Spark MLlib.

Preprocessing that must match the reference exactly (median fill +
population-std scaling; mode fill + one column per sorted level with
unseen levels all zero) is written as DataFrame expressions over one-row
fitted statistics, because MLlib's Imputer uses an approximate median and
StandardScaler a sample std. Boosted trees are those of ``boosting``, many
fits at once; all else is MLlib: logistic regression, random forests,
decision trees and a linear SVM over random Fourier features.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, LinearSVC,
                                       LogisticRegression, RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import boosting, forests, machines
from .profile import exact_quantiles, exact_quantiles_by_column, mode_table

NUMERIC = ["Age", "Fare", "SibSp", "Parch", "Age_Sex_interaction"]
CATEGORICAL = ["Sex", "Embarked", "Pclass"]


# ---------------------------------------------------------------------------
# Exact preprocessing
# ---------------------------------------------------------------------------
def fit_prep_numeric(train: DataFrame, cols: list[str]) -> DataFrame:
    """One row: median, and mean / population std of the median-filled
    values, per column (all medians from one quantile pass)."""
    meds = exact_quantiles_by_column(train, cols, {"med": 0.5})
    wide = meds.groupBy().pivot("column", cols).agg(F.first("med"))
    meds = wide.select(*[F.col(c).alias(f"{c}__med") for c in cols])
    filled = train.crossJoin(F.broadcast(meds))
    aggs = []
    for c in cols:
        v = F.coalesce(F.col(c).cast("double"), F.col(f"{c}__med"))
        aggs += [F.first(f"{c}__med").alias(f"{c}__med"), F.avg(v).alias(f"{c}__mean"),
                 F.stddev_pop(v).alias(f"{c}__std")]
    return filled.agg(*aggs)


def apply_prep_numeric(df: DataFrame, stats: DataFrame, cols: list[str], suffix: str = "_z") -> DataFrame:
    d = df.crossJoin(F.broadcast(stats))   # one row
    for c in cols:
        v = F.coalesce(F.col(c).cast("double"), F.col(f"{c}__med"))
        std = F.col(f"{c}__std")
        d = d.withColumn(c + suffix, F.when(std > 0, (v - F.col(f"{c}__mean")) / std).otherwise(F.lit(0.0)))
    return d.drop(*[x for x in stats.columns])


def fit_prep_onehot(train: DataFrame, cols: list[str]) -> dict:
    """Per column: the mode (ties -> smallest) and the sorted levels seen in
    training, from one aggregation of (column, value) counts. The levels are
    the model: each becomes an output column, so they come back to the driver
    as those of MLlib's StringIndexer do."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in cols]))
    counts = (train.select(pairs.alias("p")).select("p.c", "p.v").where(F.col("v").isNotNull())
              .groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")))
    got = counts.collect()
    out = {}
    for c in cols:
        rows = [(r["v"], r["n"]) for r in got if r["c"] == c]
        mode = min(rows, key=lambda t: (-t[1], t[0]))[0] if rows else None
        out[c] = {"mode": mode, "levels": sorted(v for v, _ in rows)}
    return out


def apply_prep_onehot(df: DataFrame, fitted: dict) -> DataFrame:
    """Mode-fill, then one 0/1 column per training level (unseen -> all 0)."""
    d = df
    for c, f in fitted.items():
        v = F.coalesce(F.col(c).cast("string"), F.lit(f["mode"]))
        for lev in f["levels"]:
            d = d.withColumn(f"{c}_{lev}", (v == F.lit(lev)).cast("double"))
    return d


def onehot_names(fitted: dict) -> list[str]:
    return [f"{c}_{lev}" for c, f in fitted.items() for lev in f["levels"]]


def fit_prep(train: DataFrame, numeric: list[str] | None = None, categorical: list[str] | None = None) -> dict:
    """The exact preprocessing of ``design`` as plain values, to be stored with a model."""
    numeric, categorical = numeric or NUMERIC, categorical or CATEGORICAL
    stats = fit_prep_numeric(train, numeric).first().asDict()
    return {"numeric": numeric, "stats": stats, "levels": fit_prep_onehot(train, categorical), "columns": [*numeric, *categorical]}


def apply_prep(df: DataFrame, prep: dict) -> DataFrame:
    """``df`` with its ``features`` by a stored preprocessing."""
    numeric, stats = prep["numeric"], prep["stats"]
    row = df.sparkSession.createDataFrame([tuple(stats.values())], ", ".join(f"`{c}` double" for c in stats))
    names = [c + "_z" for c in numeric] + onehot_names(prep["levels"])
    return VectorAssembler(inputCols=names, outputCol="features").transform(
        apply_prep_onehot(apply_prep_numeric(df, row, numeric), prep["levels"]))


def fitted_stage(df: DataFrame, covered: Column, features: list[Column], params: boosting.Params, label: str = "Survived", out: str = "p_rest") -> DataFrame:
    """A cascade stage that learns from what its rules leave: boosted trees are
    fitted on the labelled rows that are not ``covered``, and every row gets
    their p as ``out``. Labels of covered rows, and of rows without one, are
    never read."""
    [d] = binned(df.withColumn("__covered", F.coalesce(covered, F.lit(False))), features=features)
    left = d.where(~F.col("__covered") & F.col(label).isNotNull())
    return boosting.score(d.drop("__covered"), {"all": boosted(left, params, label)}).withColumnRenamed("p", out)


def add_interaction(df: DataFrame, median_of: DataFrame | None = None) -> DataFrame:
    """Age_Sex_interaction = median-filled Age x (Sex == male)."""
    src = median_of if median_of is not None else df
    med = exact_quantiles(src, "Age", {"__age_med": 0.5}).select("__age_med")
    d = df.crossJoin(F.broadcast(med))
    return d.withColumn("Age_Sex_interaction",
                        F.coalesce(F.col("Age"), F.col("__age_med")) * (F.col("Sex") == "male").cast("double")) \
        .drop("__age_med")


def design(train: DataFrame, other: DataFrame | None = None, numeric=None, categorical=None):
    """Fit the exact preprocessing on ``train``; return (train_vec,
    other_vec, feature_names) with a ``features`` vector column."""
    numeric = numeric or NUMERIC
    categorical = categorical or CATEGORICAL
    stats = fit_prep_numeric(train, numeric)
    oh = fit_prep_onehot(train, categorical)
    names = [c + "_z" for c in numeric] + onehot_names(oh)
    asm = VectorAssembler(inputCols=names, outputCol="features")

    def prep(d):
        return cached(asm.transform(apply_prep_onehot(apply_prep_numeric(d, stats, numeric), oh)))
    return prep(train), (prep(other) if other is not None else None), names


# ---------------------------------------------------------------------------
# The preprocessing of all folds at once
# ---------------------------------------------------------------------------
def fit_fold_preps(rows: DataFrame, folds: int, fold: str = "fold", numeric: list[str] | None = None, categorical: list[str] | None = None) -> list[dict]:
    """``fit_prep`` on the rows out of each fold, for all folds in the passes of one fit."""
    numeric, categorical = numeric or NUMERIC, categorical or CATEGORICAL
    out = lambda f: F.coalesce(F.col(fold) != f, F.lit(False))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in numeric]))
    long = rows.select(fold, each.alias("__p")).select(
        "__p.column", "__p.value", F.explode(F.filter(F.array(*[F.lit(f) for f in range(folds)]), lambda f: f != F.col(fold))).alias("without"))
    meds = {(r["without"], r["column"]): r["med"] for r in exact_quantiles(long, "value", {"med": 0.5}, ["without", "column"]).collect()}
    filled = lambda f, c: F.coalesce(F.col(c).cast("double"), F.lit(meds.get((f, c))).cast("double"))
    row = rows.agg(F.count(F.lit(1)), *[a(F.when(out(f), filled(f, c))).alias(f"{f}__{c}__{n}") for f in range(folds) for c in numeric
                                        for a, n in ((F.avg, "mean"), (F.stddev_pop, "std"))]).first()
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in categorical]))
    # A row for each level and fold, as in fit_prep_onehot.
    counts = rows.select(fold, pairs.alias("p")).where(F.col("p.v").isNotNull()).groupBy(F.col(fold).alias("f"), "p.c", "p.v").agg(F.count(F.lit(1)).alias("n")).collect()
    preps = []
    for f in range(folds):
        levels = {}
        for c in categorical:
            seen: dict = {}
            for r in counts:
                if r["c"] == c and r["f"] is not None and r["f"] != f:
                    seen[r["v"]] = seen.get(r["v"], 0) + r["n"]
            levels[c] = {"mode": min(seen, key=lambda v: (-seen[v], v)) if seen else None, "levels": sorted(seen)}
        stats = {k: v for c in numeric for k, v in ((f"{c}__med", meds.get((f, c))), (f"{c}__mean", row[f"{f}__{c}__mean"]), (f"{c}__std", row[f"{f}__{c}__std"]))}
        preps.append({"numeric": numeric, "stats": stats, "levels": levels, "columns": [*numeric, *categorical]})
    return preps


def prep_features(prep: dict) -> dict[str, Column]:
    """The entries of the ``features`` of ``apply_prep`` as columns, by their names and in their order."""
    number = lambda v: F.lit(v).cast("double")
    made, stats = {}, prep["stats"]
    for c in prep["numeric"]:
        med, mean, std = (number(stats[f"{c}__{n}"]) for n in ("med", "mean", "std"))
        made[c + "_z"] = F.when(std > 0, (F.coalesce(F.col(c).cast("double"), med) - mean) / std).otherwise(F.lit(0.0))
    for c, fitted in prep["levels"].items():
        v = F.coalesce(F.col(c).cast("string"), F.lit(fitted["mode"]))
        made |= {f"{c}_{lev}": (v == F.lit(lev)).cast("double") for lev in fitted["levels"]}
    return made


def fold_binned(rows: DataFrame, preps: list[dict], fold: str = "fold", label: str = "Survived") -> tuple[DataFrame, list[list[str]]]:
    """(fold, label, bins0, bins1, ...), written once, and the names of the bins
    of each: bins<f> are by the preprocessing and the cuts of the rows out of fold
    f, as ``binned`` of their ``design``. All cuts come from one aggregation."""
    features = [prep_features(p) for p in preps]
    out = lambda f, c: F.when(F.coalesce(F.col(fold) != f, F.lit(False)), c)
    cuts = boosting.edges(rows, [out(f, c) for f, own in enumerate(features) for c in own.values()])
    bins = []
    for f, own in enumerate(features):
        bins.append(boosting.bins_of(list(own.values()), cuts[:len(own)]).alias(f"bins{f}"))
        cuts = cuts[len(own):]
    return materialize(rows.select(fold, label, *bins)), [list(own) for own in features]


# ---------------------------------------------------------------------------
# Estimators
# ---------------------------------------------------------------------------
def logreg(n_rows: int, C: float = 1.0, label: str = "Survived", max_iter: int = 1000):
    """L2 logistic regression with sklearn's C: regParam = 1 / (C n)."""
    return LogisticRegression(featuresCol="features", labelCol=label, maxIter=max_iter,
                              regParam=1.0 / (C * max(n_rows, 1)), elasticNetParam=0.0,
                              standardization=False)


#: A tree fit runs a job for each level; a training table has a partition for each so many rows.
ROWS_PER_PARTITION = 50_000


def packed(train: DataFrame, features: str = "features", label: str = "Survived", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns that a tree fit reads, cached in partitions of about
    ``ROWS_PER_PARTITION`` rows; ``unpersist`` it after the fit."""
    d = train.select(features, label, *keep)
    return cached(d.repartition(1 + d.count() // ROWS_PER_PARTITION))


def fit_packed(estimator, train: DataFrame, features: str = "features", label: str = "Survived", keep: tuple[str, ...] = ()):
    d = packed(train, features, label, keep)
    try:
        return estimator.fit(d)
    finally:
        d.unpersist()


def binned(train: DataFrame, *others: DataFrame, features: list | None = None, size: int = 0) -> list[DataFrame]:
    """``train`` and ``others`` with ``bins``, cut at quantiles of ``train``:
    of the ``size`` entries of the vector ``features``, or of the given columns."""
    if features is None:
        entries = vector_to_array(F.col("features"))
        features = [entries[i] for i in range(size)]
    cuts = boosting.edges(train, features)
    return [boosting.with_bins(d, features, cuts) for d in (train, *others)]


def boosted(train: DataFrame, params: boosting.Params, label: str = "Survived") -> boosting.Trees:
    """One fit on all rows of a binned table."""
    return boosting.fit(boosting.counted(train, label), [boosting.Cell("all", params)])["all"]


def boosted_p(trees: boosting.Trees, df: DataFrame) -> DataFrame:
    """``df`` with p; its bins go."""
    return boosting.score(df.drop("features", "p"), {"all": trees})


def random_forest(trees: int = 400, depth: int = 6, leaf: int = 5, label: str = "Survived", seed: int = 42):
    return RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth,
                                  minInstancesPerNode=leaf, seed=seed)


def forest_fits(train: DataFrame, forms: dict, label: str = "Survived", fold: str | None = None) -> dict:
    """Per key of ``forms`` (``forests.Forest``) a function that gives a table p
    and takes its ``features``, if it has any. ``train`` and the tables have
    ``bins``, which the trees grow on."""
    trees = forests.grown(boosting.counted(train, label, fold=fold), forms)
    return {key: lambda d, own=own: forests.score(d.drop("features"), own) for key, own in trees.items()}


def forest_importance(train: DataFrame, form, features: int, label: str = "Survived") -> list[float]:
    """Share of each feature in the impurity decrease of a forest."""
    trees = forests.fit(boosting.counted(train, label), {"all": form})
    if trees is not None:
        return forests.importance(trees["all"], features)
    return fit_packed(random_forest(form.trees, form.depth, form.leaf, label, form.seed), train, label=label).featureImportances.toArray().tolist()


def cart(depth: int = 5, label: str = "Survived", seed: int = 42, features: str = "features"):
    return DecisionTreeClassifier(featuresCol=features, labelCol=label, maxDepth=depth, seed=seed)


def p1(df: DataFrame, col: str = "probability") -> DataFrame:
    """Probability of class 1 from an MLlib probability vector."""
    return df.withColumn("p", vector_to_array(F.col(col))[1])


def fourier_features(df: DataFrame, inputs: list[str], dim: int = 100, gamma: float = 0.5,
                     seed: int = 42, out: str = "rff") -> DataFrame:
    """Random Fourier features approximating an RBF kernel
    exp(-gamma ||x - y||^2): z_j = sqrt(2/D) cos(w_j . x + b_j) with
    w ~ N(0, 2 gamma I), b ~ U(0, 2 pi). Column expressions, no UDF."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, math.sqrt(2 * gamma), size=(dim, len(inputs)))
    b = rng.uniform(0, 2 * math.pi, size=dim)
    scale = math.sqrt(2.0 / dim)
    cols = []
    for j in range(dim):
        lin = F.lit(float(b[j]))
        for k, c in enumerate(inputs):
            lin = lin + F.lit(float(w[j, k])) * F.col(c)
        cols.append((F.lit(scale) * F.cos(lin)).alias(f"__rff{j}"))
    d = df.select("*", *cols)
    d = VectorAssembler(inputCols=[f"__rff{j}" for j in range(dim)], outputCol=out).transform(d)
    return d.drop(*[f"__rff{j}" for j in range(dim)])


#: Labelled rows up to which MLlib fits the machines; it keeps ``dim`` doubles a row for each.
MACHINE_ROWS = 1_000_000


def svm_rff(train: DataFrame, other: DataFrame, inputs: list[str], label: str = "Survived",
            dim: int = 100, gamma: float = 0.5, id_col: str = "PassengerId", folds: int = 3) -> DataFrame:
    """``other`` with p: an RBF-kernel SVM approximated by a linear SVM on random
    Fourier features. Its margin becomes a probability by a logistic fit (Platt
    scaling) on margins that rows got from machines fitted without them. With
    more than ``MACHINE_ROWS`` rows the machines are those of ``machines``."""
    hashed = F.pmod(F.xxhash64(F.lit("platt"), F.col(id_col)), F.lit(folds))
    n = train.count()
    if n > MACHINE_ROWS:
        return _svm_blocks(train.withColumn("__part", hashed), other, inputs, label, machines.Fourier(len(inputs), dim, gamma, 42), folds, n)
    tr = packed(fourier_features(train, inputs, dim, gamma).withColumn("__part", hashed), "rff", label, ("__part",))
    te = fourier_features(other, inputs, dim, gamma)

    def machine(d):
        return LinearSVC(featuresCol="rff", labelCol=label, regParam=0.01, maxIter=200, predictionCol="__svm_pred", rawPredictionCol="__svm_raw").fit(d)

    def margin(svm, d):
        m = svm.transform(d).withColumn("margin", vector_to_array("__svm_raw")[1])
        return VectorAssembler(inputCols=["margin"], outputCol="mfeat").transform(m.drop("__svm_pred", "__svm_raw", "rff"))
    fits = fit_all([lambda f=f: machine(tr.where(F.col("__part") != f)) for f in range(folds)] + [lambda: machine(tr)])
    held_out = margin(fits[0], tr.where(F.col("__part") == 0))
    for f in range(1, folds):
        held_out = held_out.unionByName(margin(fits[f], tr.where(F.col("__part") == f)))
    cal = fit_packed(LogisticRegression(featuresCol="mfeat", labelCol=label, regParam=0.0), held_out, "mfeat", label)
    tr.unpersist()
    return p1(cal.transform(margin(fits[folds], te)))


def _svm_blocks(train: DataFrame, other: DataFrame, inputs: list[str], label: str, fourier: machines.Fourier, folds: int, n: int) -> DataFrame:
    blocks, path = machines.packed(train, inputs, label, "__part", n)
    try:
        fits = machines.fit(blocks, fourier, folds, reg=0.01)
        held_out = VectorAssembler(inputCols=["margin"], outputCol="mfeat").transform(machines.held_out(blocks, fourier, fits))
        cal = fit_packed(LogisticRegression(featuresCol="mfeat", labelCol="label", regParam=0.0), held_out, "mfeat", "label")
    finally:
        machines.drop(blocks, path)
    return machines.score(other, inputs, fourier, fits[folds], float(cal.coefficients[0]), cal.intercept)


#: Fixed list: the features of the soft vote's members.
MEMBER_FEATURES = ["Pclass", "Sex_male", "Age", "SibSp", "Parch", "Fare", "Embarked_Q", "Embarked_S", "FamilySize", "IsAlone",
                   "FareAdj", "FareBin", "AgeBin", "Title_boy", "Title_woman"]


def soft_vote(train: DataFrame, other: DataFrame, label: str = "Survived", id_col: str = "PassengerId") -> DataFrame:
    """Per row of ``other``: p of a forest (500 trees of depth 5), of logistic
    regression and of a calibrated RBF machine over ``MEMBER_FEATURES``, and
    their mean. The members are fitted on the labelled rows of ``train``; the
    machine sees the features scaled by their deviation there."""
    cols = MEMBER_FEATURES
    stats = train.agg(*[e for c in cols for e in (F.avg(c).alias(f"{c}__m"), F.stddev_pop(c).alias(f"{c}__s"))])
    stats = train.sparkSession.createDataFrame(stats.collect(), stats.schema)   # one row, of which all scans would ask again
    scaled = [F.when(F.col(f"{c}__s") > 0, (F.col(c) - F.col(f"{c}__m")) / F.col(f"{c}__s")).otherwise(F.lit(0.0)).alias(f"{c}_s") for c in cols]
    asm = VectorAssembler(inputCols=cols, outputCol="features")

    def prep(d, extra):
        return d.select(id_col, *extra, *[F.col(c).cast("double").alias(c) for c in cols])
    # Every member reads them, most of them many times; what is made of a row's features is made as they are read.
    tr, te = (asm.transform(materialize(d)).crossJoin(F.broadcast(stats)).select("*", *scaled).drop(*stats.columns)
              for d in binned(prep(train, [label]), prep(other, []), features=[F.col(c).cast("double") for c in cols]))
    forest = forest_fits(tr, {"forest": forests.Forest(500, 5, 1)}, label)["forest"]
    logistic = fit_packed(LogisticRegression(featuresCol="features", labelCol=label, maxIter=1000, regParam=1.0 / max(tr.count(), 1)), tr, label=label)
    out = p1(logistic.transform(te)).withColumnRenamed("p", "p_logistic").drop("rawPrediction", "probability", "prediction")
    out = forest(out).withColumnRenamed("p", "p_forest").drop("bins")
    out = svm_rff(tr, out, [f"{c}_s" for c in cols], label, gamma=1.0 / len(cols), id_col=id_col).withColumnRenamed("p", "p_machine")
    return out.select(id_col, "p_forest", "p_logistic", "p_machine", ((F.col("p_forest") + F.col("p_logistic") + F.col("p_machine")) / 3).alias("p_mean"))


def stacking(train: DataFrame, other: DataFrame, fold_col: str = "fold", k: int = 5,
             label: str = "Survived", params: boosting.Params | None = None, id_col: str = "PassengerId") -> DataFrame:
    """Out-of-fold probabilities of a random forest and of boosted trees feed a
    logistic meta-model (C = 0.5); bases are refitted on all rows to score
    ``other``. Both tables have ``bins``. The boosted fits of all folds are cells
    of one table, and so are the forests."""
    params = params or boosting.Params(rows=0.8, columns=0.8)
    train = cached(train)
    table = materialize(boosting.counted(train, label, fold=fold_col))
    cells = [boosting.Cell(str(f), params, without=(f,)) for f in range(k)] + [boosting.Cell("all", params)]
    forms = {**{f: forests.Forest(without=(f,)) for f in range(k)}, "all": forests.Forest()}
    # A boosted fit is one long task, a forest many short ones: side by side they fill the cores.
    trees, grown = fit_all([lambda: boosting.fit(table, cells), lambda: forests.grown(table, forms)])
    fits = {key: lambda d, own=own: forests.score(d, own) for key, own in grown.items()}

    def rows(d, rf, key):
        d = rf(d.select(id_col, *([label] if label in d.columns else []), "bins")).withColumnRenamed("p", "rf").withColumn("__key", F.lit(key))
        return boosting.score(d, trees, by="__key").withColumnRenamed("p", "gbt").drop("__key")
    # A row is scored by the fits that did not see it; all columns stay with it, so nothing is joined.
    held_out = [rows(train.where(F.col(fold_col) == f), fits[f], str(f)) for f in range(k)]
    meta_train = held_out[0]
    for part in held_out[1:]:
        meta_train = meta_train.unionByName(part)
    asm = VectorAssembler(inputCols=["rf", "gbt"], outputCol="meta")
    meta_train = packed(asm.transform(meta_train), "meta", label)
    meta = LogisticRegression(featuresCol="meta", labelCol=label, regParam=1.0 / (0.5 * max(meta_train.count(), 1)),
                              standardization=False, maxIter=1000).fit(meta_train)
    meta_train.unpersist()
    train.unpersist()
    out = meta.transform(asm.transform(rows(other, fits["all"], "all")))
    return p1(out).select(id_col, "p", (F.col("p") >= 0.5).cast("int").alias("prediction"))


def feature_importance(shares: list[float], names: list[str], least: float | None = None) -> list[tuple[str, float, int]]:
    """(feature, importance, rank), a row for each feature; only those above ``least``."""
    rows = sorted(zip(names, shares, strict=True), key=lambda t: (-t[1], t[0]))
    return [(n, float(v), i + 1) for i, (n, v) in enumerate(rows) if least is None or v > least]


def fit_all(jobs: list, workers: int = 4) -> list:
    """Run independent fits (callables) concurrently from driver threads;
    each fit is its own set of Spark jobs, scheduled side by side."""
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=min(workers, max(len(jobs), 1))) as ex:
        return list(ex.map(lambda f: f(), jobs))


def cached(df: DataFrame) -> DataFrame:
    """Training input is read once per iteration by MLlib: keep it cached
    (MEMORY_AND_DISK; lost blocks are recomputed from lineage)."""
    from pyspark import StorageLevel
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def fitted_pipeline(train: DataFrame, estimator) -> PipelineModel:
    return Pipeline(stages=[estimator]).fit(train)
