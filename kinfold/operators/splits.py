"""Deterministic splits and resampling.

Every split ranks rows by ``md5(seed || id)`` (identical text hash in
Spark and in SQL engines), so folds are reproducible and oracle-checkable.
Ranks within a label come from ``ordered.row_number`` (range partitioned),
never from a single-partition window; the parts of a trial are told by the rows
at their ends, so the copies of the rows are not sorted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import ordered
from .joins import join_back, join_null_safe, with_scalar


def hash_key(seed, id_col: str) -> Column:
    return F.md5(F.concat(F.lit(str(seed)), F.col(id_col).cast("string")))


def _ranked(df: DataFrame, id_col: str, seed, part: list[str]) -> DataFrame:
    d = df.withColumn("__h", hash_key(seed, id_col))
    d = ordered.row_number(d, ["__h", id_col], part, out="__rn")
    n = d.groupBy(*part).agg(F.count(F.lit(1)).alias("__n"))
    return join_null_safe(d, n, part) if part else d.crossJoin(F.broadcast(n))


def holdout_stratified(df: DataFrame, label: str, id_col: str, frac: float = 0.2,
                       seed: int = 42) -> DataFrame:
    """``holdout`` = the first ceil(frac * n_label) rows of each label in
    hash order; the rest ``train``. Rows without a label are a stratum too."""
    d = _ranked(df, id_col, seed, [label])
    is_h = F.col("__rn") <= F.ceil(F.col("__n") * frac)
    return d.withColumn("subset", F.when(is_h, "holdout").otherwise("train")).drop("__h", "__rn", "__n")


def kfold_stratified(df: DataFrame, label: str, id_col: str, k: int = 5, seed: int = 42) -> DataFrame:
    """fold = (rank within label - 1) mod k: label counts per fold differ
    by at most one. Rows without a label are a stratum too."""
    d = _ranked(df, id_col, seed, [label])
    return d.withColumn("fold", ((F.col("__rn") - 1) % k).cast("int")).drop("__h", "__rn", "__n")


def with_trials(df: DataFrame, trials: int) -> DataFrame:
    """One copy of each row per trial id (an explode of a fixed sequence)."""
    return df.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))).withColumn("trial", F.col("trial").cast("int"))


#: Leading hex digits of a hash that name its bin: 4096 bins a trial.
BIN_DIGITS = 3
#: Rows of small groups a partition, and rows from which a group counts as large, in ``cv_group_model``.
GROUP_ROWS = 100_000


def _numbered(df: DataFrame) -> DataFrame:
    """``df`` written with a number of its own for each row, so that rows which
    repeat an id, or have none, have a place too."""
    return materialize(df.withColumn("__row", F.monotonically_increasing_id()))


def _hashed(rows: DataFrame, id_col: str, trials: int, seed: int) -> DataFrame:
    """A copy of each numbered row per trial, with its hash there."""
    key = F.concat(F.lit(f"{seed}-"), F.col("trial").cast("string"), F.lit("-"), F.col(id_col).cast("string"))
    return with_trials(rows, trials).withColumn("__h", F.md5(key))


def _place(id_col: str) -> Column:
    """What orders the rows of a trial: hash, id, and number for rows with equal ids."""
    return F.struct("__h", id_col, "__row")


def _cuts(rows: DataFrame, id_col: str, trials: int, seed: int, places: list[int]) -> DataFrame:
    """Per trial the place of the row at each of ``places`` (1-based ranks in
    hash order), as c0, c1, ...; NULL for a rank of 0.

    The copies are only counted, by the first digits of their hash; running
    counts over these bins tell in which one a rank lies, and the rows of such
    bins alone are ranked. So the copies are never shuffled or written."""
    every = _hashed(rows.select(id_col, "__row"), id_col, trials, seed).withColumn("__bin", F.substring("__h", 1, BIN_DIGITS))
    # At most 16^BIN_DIGITS + 1 rows a trial.
    upto = Window.partitionBy("trial").orderBy("__bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = every.groupBy("trial", "__bin").agg(F.count(F.lit(1)).alias("__c")).withColumn("__upto", F.sum("__c").over(upto))
    asked = F.array(*[F.struct(F.lit(i).alias("cut"), F.lit(p).cast("long").alias("place")) for i, p in enumerate(places)])
    found = bins.select("trial", "__bin", "__c", "__upto", F.inline(asked)).where((F.col("place") <= F.col("__upto")) & (F.col("place") > F.col("__upto") - F.col("__c")))
    # One row a trial and place.
    found = materialize(found.select("trial", "__bin", "cut", (F.col("place") - F.col("__upto") + F.col("__c")).alias("__rn")))
    near = join_null_safe(every, F.broadcast(found.select("trial", "__bin").distinct()), ["trial", "__bin"])
    ranked = ordered.row_number(near, ["__h", id_col, "__row"], ["trial", "__bin"], out="__rn")
    hit = join_null_safe(ranked, F.broadcast(found), ["trial", "__bin", "__rn"])
    return materialize(hit.groupBy("trial").agg(*[F.max(F.when(F.col("cut") == i, _place(id_col))).alias(f"c{i}") for i in range(len(places))]))


def _fold_cuts(rows: DataFrame, id_col: str, trials: int, k: int, seed: int) -> DataFrame:
    size = rows.count() // k
    return _cuts(rows, id_col, trials, seed, [size * (i + 1) for i in range(k)])


def _folded(rows: DataFrame, cuts: DataFrame, id_col: str, trials: int, k: int, seed: int) -> DataFrame:
    """A copy of each numbered row per trial with its fold: the first cut that it is not beyond."""
    d = _hashed(rows, id_col, trials, seed).join(F.broadcast(cuts), "trial", "left")
    place, fold = _place(id_col), F.when(F.lit(False), F.lit(0))
    for i in range(k):
        fold = fold.when(place <= F.col(f"c{i}"), F.lit(i))
    return d.withColumn("fold", fold).drop("__h", "__row", *[f"c{i}" for i in range(k)])


def kfold_repeated(df: DataFrame, id_col: str, trials: int = 25, k: int = 10, seed: int = 42) -> DataFrame:
    """Per trial a hash permutation cut into k folds of floor(n/k) rows;
    the remainder rows are never tested (fold NULL)."""
    rows = _numbered(df)
    return _folded(rows, _fold_cuts(rows, id_col, trials, k, seed), id_col, trials, k, seed)


def random_subsample(df: DataFrame, id_col: str, trials: int = 100, test_frac: float = 91 / 891,
                     seed: int = 42) -> DataFrame:
    """Per trial the last round(n * test_frac) rows in hash order are the
    test part."""
    rows = _numbered(df)
    n = rows.count()
    n_train = n - int(math.floor(n * test_frac + 0.5))
    cuts = _cuts(rows, id_col, trials, seed, [n_train])
    d = _hashed(rows, id_col, trials, seed).join(F.broadcast(cuts), "trial", "left")
    return d.withColumn("subset", F.when(_place(id_col) <= F.col("c0"), "train").otherwise("test")).drop("__h", "__row", "c0")


def cv_group_model(df: DataFrame, label: str = "Survived", gid: str = "GroupId", person: str = "Title", pclass: str = "Pclass",
                   id_col: str = "PassengerId", trials: int = 25, k: int = 10, seed: int = 42) -> DataFrame:
    """Repeated CV of the group model in one job, over the folds of ``kfold_repeated``.

    The training rate of a group for (trial, fold) is
    (sum over the group - sum over the group's rows in that fold) /
    (count - count in fold). Rows carry the sums of their group, and those of
    one (trial, fold, group) become one cell: the sums of that fold and the
    errors that either prediction would make there. No fold loop, and the
    copies of the rows are neither shuffled nor joined: small groups are dealt
    out before the rows are copied; of a large group, and of the rows in no
    group, which are one group here, the tasks pass on a cell a (trial, fold).
    A group with no training member falls back to class (3 -> 0, else 1).
    Returns per trial: errors, tested rows and accuracy."""
    y, some = F.col(label).cast("double"), F.col(gid).isNotNull()
    whole = [F.sum(y).alias("__tsum"), F.count(y).alias("__tcnt"), F.count(F.lit(1)).alias("__size")]
    d = join_back(df, df.where(some).groupBy(gid).agg(*whole), gid, spread_on=id_col)
    d = with_scalar(d, df.where(~some).agg(*[w.alias(f"__u{i}") for i, w in enumerate(whole)]))
    totals = ("__tsum", "__tcnt", "__size")
    d = d.withColumns({c: F.when(some, F.col(c)).otherwise(F.col(f"__u{i}")) for i, c in enumerate(totals)}).drop("__u0", "__u1", "__u2")
    rows = _numbered(d.select(id_col, label, gid, person, pclass, *totals))
    cuts = _fold_cuts(rows, id_col, trials, k, seed)
    small = some & (F.col("__size") <= GROUP_ROWS)
    dealt = rows.where(small).repartition(1 + rows.count() // GROUP_ROWS, gid)

    kinds = {"boy": F.col(person) == "boy", "woman": F.col(person) == "woman"}
    third = F.coalesce(F.col(pclass) == 3, F.lit(False))
    errors = {f"__{p}{c}{v}": F.when(is_p & (third if c else ~third), F.abs(F.lit(v) - F.col(label)))
              for p, is_p in kinds.items() for c in (0, 1) for v in (0, 1)}
    errors["__other"] = F.when(~F.coalesce(F.col(person).isin(*kinds), F.lit(False)), F.abs(F.col(label)))

    def cells(part):
        tested = _folded(part, cuts, id_col, trials, k, seed).where(F.col("fold").isNotNull())
        return tested.groupBy("trial", "fold", gid).agg(
            F.max("__tsum").alias("__tsum"), F.max("__tcnt").alias("__tcnt"), F.sum(y).alias("__fsum"), F.count(y).alias("__fcnt"),
            F.count(F.lit(1)).alias("__n"), *[F.sum(e).alias(c) for c, e in errors.items()])
    t = cells(dealt).unionByName(cells(rows.where(~small)))
    n_train = F.col("__tcnt") - F.col("__fcnt")
    rate = F.when(n_train > 0, (F.col("__tsum") - F.col("__fsum")) / n_train)
    err = F.coalesce(F.col("__other"), F.lit(0))
    for c, fallback in ((0, 1.0), (1, 0.0)):
        r = F.coalesce(rate, F.lit(fallback))
        err = err + F.coalesce(F.when(r == 1, F.col(f"__boy{c}1")).otherwise(F.col(f"__boy{c}0")), F.lit(0)) \
            + F.coalesce(F.when(r == 0, F.col(f"__woman{c}0")).otherwise(F.col(f"__woman{c}1")), F.lit(0))
    total = F.when(F.sum("__fcnt") > 0, F.sum(err)).cast("long")
    return t.groupBy("trial").agg(total.alias("errors"), F.sum("__n").alias("n_tested")) \
        .withColumn("accuracy", 1 - F.col("errors") / F.col("n_tested"))
