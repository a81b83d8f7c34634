"""Voting over many prediction sets, and prediction diagnostics.

Prediction sets are long tables ``(id, model, vote)``. Per-row vote sums
are one partial aggregation; per-model profiles are conditional sums with a
``rollup`` totals row; pairwise agreement pivots the (fixed, known) set
names per id and compares columns in one pass instead of a self-join.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import join_back


def vote_sums(votes: DataFrame, id_col: str, vote: str = "vote") -> DataFrame:
    return votes.groupBy(id_col).agg(F.sum(F.col(vote)).cast("int").alias("vote_sum"),
                                     F.count(F.lit(1)).alias("n_models"))


def k_of_n(base: Column, vote_sum: Column, hi: float = 2.5, lo: float = 2.5) -> Column:
    """base 0 and sum > hi -> 1; base 1 and sum < lo -> 0; else base."""
    return (F.when((base == 0) & (vote_sum > hi), 1).when((base == 1) & (vote_sum < lo), 0)
             .otherwise(base))


def apply_vote(df: DataFrame, votes: DataFrame, id_col: str, base: str, decided: str,
               hi: float = 2.5, lo: float = 2.5) -> DataFrame:
    """Rows not decided by groups take the k-of-n vote; decided rows keep
    ``base``. Adds vote_sum, vote_pred and changed."""
    d = join_back(df, vote_sums(votes, id_col), id_col)
    vp = k_of_n(F.col(base), F.col("vote_sum"), hi, lo)
    d = d.withColumn("vote_pred", F.when(F.coalesce(F.col(decided), F.lit(False)), F.col(base)).otherwise(vp))
    return d.withColumn("changed", F.col("vote_pred") != F.col(base))


def model_profile(votes: DataFrame, people: DataFrame, id_col: str, person: str = "Title") -> DataFrame:
    """Per model: men predicted 1, women predicted 0, boys predicted 1 and
    their total; a rollup adds the all-models row (model NULL)."""
    d = votes.join(people.select(id_col, person), id_col)
    v, p = F.col("vote"), F.col(person)
    g = d.rollup("model").agg(
        F.sum(F.when(p == "man", v).otherwise(0)).cast("long").alias("men_1"),
        F.sum(F.when(p == "woman", 1 - v).otherwise(0)).cast("long").alias("women_0"),
        F.sum(F.when(p == "boy", v).otherwise(0)).cast("long").alias("boys_1"))
    return g.withColumn("total", F.col("men_1") + F.col("women_0") + F.col("boys_1"))


def vote_histogram(df: DataFrame, person: str = "Title", in_groups: str = "InWCG") -> DataFrame:
    """Rows per vote total (votes for survival for men and boys, against
    for women) by person type and group membership."""
    votes = F.when(F.col(person) == "woman", F.col("n_models") - F.col("vote_sum")).otherwise(F.col("vote_sum"))
    return df.groupBy(person, in_groups, votes.alias("votes")).agg(F.count(F.lit(1)).alias("count"))


def agreement(sets: DataFrame, id_col: str, names: list[str], set_col: str = "set",
              pred: str = "prediction") -> DataFrame:
    """Pairwise agreement of prediction sets given in long form."""
    return agreement_of_columns(sets.groupBy(id_col).pivot(set_col, names).agg(F.first(pred)), names)


def agreement_of_columns(wide: DataFrame, names: list[str]) -> DataFrame:
    """Pairwise agreement of prediction columns: for each pair, rows compared,
    rows that differ and the agreement rate; identical sets are flagged."""
    pairs = list(combinations(names, 2))
    aggs = []
    for i, (a, b) in enumerate(pairs):
        both = F.col(f"`{a}`").isNotNull() & F.col(f"`{b}`").isNotNull()
        aggs += [F.count(F.when(both, 1)).alias(f"n{i}"),
                 F.count(F.when(both & (F.col(f"`{a}`") != F.col(f"`{b}`")), 1)).alias(f"d{i}")]
    agg = wide.agg(*aggs)
    stack = ", ".join(f"'{a}', '{b}', n{i}, d{i}" for i, (a, b) in enumerate(pairs))
    out = agg.selectExpr(f"stack({len(pairs)}, {stack}) AS (set_a, set_b, n, n_diff)")
    return out.withColumn("agreement", 1 - F.col("n_diff") / F.col("n")) \
        .withColumn("identical", F.col("n_diff") == 0)
