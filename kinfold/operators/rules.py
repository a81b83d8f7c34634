"""Rules and decision cascades.

A cascade is an ordered list of stages. Each stage is a list of
``Rule(name, condition, value)`` where the *last* matching rule wins (the
reference overwrites a prediction vector rule by rule). A stage compiles to
one ``CASE WHEN`` (rules folded from last to first) plus a ``decided_by``
column, so the whole cascade is a single projection with no row loop.
Rules that read the running prediction go into their own stage: the
``prediction`` column they see is the one left by the previous stage.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import features as fx
from .joins import join_back

ID = "PassengerId"


@dataclass
class Rule:
    name: str
    condition: Column
    value: Column | int | float


def _v(x):
    return x if isinstance(x, Column) else F.lit(x)


def apply_stage(df: DataFrame, rules: list[Rule], out: str = "prediction",
                decided_by: str = "decided_by") -> DataFrame:
    """Fold one stage of rules (last writer wins) into ``out``."""
    if not rules:
        return df
    value = None
    who = None
    for r in reversed(rules):
        cond = F.coalesce(r.condition, F.lit(False))
        value = F.when(cond, _v(r.value)) if value is None else value.when(cond, _v(r.value))
        who = F.when(cond, F.lit(r.name)) if who is None else who.when(cond, F.lit(r.name))
    out_type = df.schema[out].dataType
    return (df.withColumn(decided_by, who.otherwise(F.col(decided_by)))
              .withColumn(out, value.otherwise(F.col(out)).cast(out_type)))


def run_cascade(df: DataFrame, base: Column | int, stages: list[list[Rule]],
                out: str = "prediction", decided_by: str = "decided_by",
                base_name: str = "baseline") -> DataFrame:
    d = df.withColumn(out, _v(base).cast("int")).withColumn(decided_by, F.lit(base_name))
    for st in stages:
        d = apply_stage(d, st, out, decided_by)
    return d


# ---------------------------------------------------------------------------
# Rule constructors
# ---------------------------------------------------------------------------
def baseline_gender(sex: str = "Sex") -> Column:
    """female -> 1, else 0."""
    return F.when(F.col(sex) == "female", 1).otherwise(0)


def group_flip(rate: str = "GroupSurvival", person: str = "Title") -> list[Rule]:
    """Woman in a group that died -> 0; boy in a group that lived -> 1."""
    return [Rule("group_woman_died", (F.col(person) == "woman") & (F.col(rate) == 0), 0),
            Rule("group_boy_lived", (F.col(person) == "boy") & (F.col(rate) == 1), 1)]


def group_replace(outcome: str = "GroupOutcome") -> list[Rule]:
    """Every member of a decided group takes the stored outcome."""
    return [Rule("group_outcome", F.col(outcome).isNotNull(), F.col(outcome))]


def unknown_group(known: str = "InKnownGroup", gid: str = "GroupId", person: str = "Title",
                  pclass: str = "Pclass") -> list[Rule]:
    """Group present but unseen in training: class 3 woman -> 0; class 1-2
    woman or boy -> 1."""
    unseen = F.col(gid).isNotNull() & ~F.col(known)
    return [Rule("unknown_group_c3_woman", unseen & (F.col(person) == "woman") & (F.col(pclass) == 3), 0),
            Rule("unknown_group_c12", unseen & F.col(person).isin("woman", "boy") & (F.col(pclass) <= 2), 1)]


def submodel_override(mask: Column, score: str, threshold: float, value: int,
                      name: str, strict: bool = False, above: bool = True) -> list[Rule]:
    """Where ``mask`` holds: score >= t (or > t) -> value (``above``), or
    score <= t (< t) -> value."""
    if above:
        cmp = F.col(score) > threshold if strict else F.col(score) >= threshold
    else:
        cmp = F.col(score) < threshold if strict else F.col(score) <= threshold
    return [Rule(name, mask & cmp, value)]


def mask_solo_female(exclude: str = "known", person: str = "Title", fsize: str = "FamilySize",
                     gid: str = "GroupId", known: str = "InKnownGroup",
                     decided: str | None = None) -> Column:
    """Woman travelling alone, optionally excluding rows in a known group
    (``known``), in any group (``any``), decided rows (``decided`` column),
    or nothing (``none``)."""
    m = (F.col(person) == "woman") & (F.col(fsize) == 1)
    if exclude == "known":
        return m & ~F.coalesce(F.col(known), F.lit(False))
    if exclude == "any":
        return m & F.col(gid).isNull()
    if exclude == "decided":
        return m & ~F.coalesce(F.col(decided), F.lit(False))
    if exclude == "none":
        return m
    raise ValueError(exclude)


def heuristic_score(age="Age", pclass="Pclass", fare_adj="FareAdj", fsize="FamilySize") -> Column:
    """Age<16 +1, >60 -.5; class 1 +1, class 3 -.5; FareAdj>30 +.5, <10 -.5;
    family>4 -.5, 2-3 +.5 (unknown values add nothing)."""
    def term(cond, v):
        return F.when(F.coalesce(cond, F.lit(False)), F.lit(v)).otherwise(F.lit(0.0))
    return (term(F.col(age) < 16, 1.0) + term(F.col(age) > 60, -0.5)
            + term(F.col(pclass) == 1, 1.0) + term(F.col(pclass) == 3, -0.5)
            + term(F.col(fare_adj) > 30, 0.5) + term(F.col(fare_adj) < 10, -0.5)
            + term(F.col(fsize) > 4, -0.5) + term(F.col(fsize).between(2, 3), 0.5))


def heuristic_rules(known: str = "InKnownGroup", score: str = "HeuristicScore",
                    sex: str = "Sex", pred: str = "prediction") -> list[Rule]:
    """Outside known groups: female predicted 1 with score < 1.5 -> 0;
    male predicted 0 with score > 2.5 -> 1 (reads the running prediction)."""
    outside = ~F.coalesce(F.col(known), F.lit(False))
    return [Rule("heuristic_female_low", outside & (F.col(sex) == "female") & (F.col(pred) == 1)
                 & (F.col(score) < 1.5), 0),
            Rule("heuristic_male_high", outside & (F.col(sex) == "male") & (F.col(pred) == 0)
                 & (F.col(score) > 2.5), 1)]


def edge_case_value(known="InKnownGroup", person="Title", pclass="Pclass", age="Age",
                    fare_adj="FareAdj", fsize="FamilySize") -> Column:
    """First matching edge rule outside known groups (NULL: none):
    boy class<=2 age<10 -> 1; woman class 3 age>55 fareadj<10 -> 0;
    woman class 1 solo -> 1; man class 1 fareadj>50 family<=2 -> 1."""
    outside = ~F.coalesce(F.col(known), F.lit(False))
    p, c = F.col(person), F.col(pclass)
    return (F.when(outside & (p == "boy") & (c <= 2) & (F.col(age) < 10), 1)
             .when(outside & (p == "woman") & (c == 3) & (F.col(age) > 55) & (F.col(fare_adj) < 10), 0)
             .when(outside & (p == "woman") & (c == 1) & (F.col(fsize) == 1), 1)
             .when(outside & (p == "man") & (c == 1) & (F.col(fare_adj) > 50) & (F.col(fsize) <= 2), 1))


def soft_vote_value(p: str = "p_mean", known="InKnownGroup", person="Title", pclass="Pclass",
                    age="Age", fsize="FamilySize", fare="Fare", pred: str = "prediction") -> Column:
    """Rows outside known groups, on the mean member probability ``p``:
    man p>.7 -> 1, p<.2 -> 0; woman/boy p<.3 -> 0, p>.8 -> 1; then boy
    age<10 class<=2 -> 1; then solo class 1 fare>50: woman -> 1,
    man with p>.6 -> 1. Returns the new prediction."""
    outside = ~F.coalesce(F.col(known), F.lit(False))
    pr = F.col(person)
    v = (F.when(outside & (pr == "man") & (F.col(p) > 0.7), 1)
          .when(outside & (pr == "man") & (F.col(p) < 0.2), 0)
          .when(outside & pr.isin("woman", "boy") & (F.col(p) < 0.3), 0)
          .when(outside & pr.isin("woman", "boy") & (F.col(p) > 0.8), 1)
          .otherwise(F.col(pred)))
    solo1 = outside & (F.col(fsize) == 1) & (F.col(pclass) == 1) & (F.col(fare) > 50)
    v = (F.when(outside & (pr == "boy") & (F.col(age) < 10) & (F.col(pclass) <= 2), 1)
          .when(solo1 & (pr == "woman"), 1)
          .when(solo1 & (pr == "man") & (F.col(p) > 0.6), 1)
          .otherwise(v))
    return v


def static_ids_rule(df: DataFrame, ids: DataFrame, pred: str = "prediction",
                    decided_by: str = "decided_by", value: int = 0) -> DataFrame:
    """Listed ids -> ``value``."""
    flag = ids.select(F.col("id").alias(ID)).distinct().withColumn("__listed", F.lit(True))
    d = df.join(flag, ID, "left")
    return apply_stage(d, [Rule("static_ids", F.col("__listed"), value)], pred, decided_by).drop("__listed")


def in_registry(df: DataFrame, reg: DataFrame, gid: str = "GroupId", out: str = "InKnownGroup") -> DataFrame:
    """Flag rows whose group is in the registry (left join of distinct ids)."""
    flags = reg.select(gid).distinct().withColumn(out, F.lit(True))
    return join_back(df, flags, gid, spread_on=ID).withColumn(out, F.coalesce(F.col(out), F.lit(False)))


def with_outcome(df: DataFrame, reg: DataFrame, gid: str = "GroupId",
                 out: str = "GroupOutcome") -> DataFrame:
    return join_back(df, reg.select(gid, F.col("outcome").alias(out)), gid, spread_on=ID)


def pattern_masks(person="Title", sex="Sex", pclass="Pclass", age="Age", fare="Fare",
                  fare_adj="FareAdj", fsize="FamilySize", decided="GroupDecided") -> list[Rule]:
    """Females not decided by groups matching any death pattern -> 0;
    males matching any survival pattern -> 1 (unknown values never match)."""
    nd = ~F.coalesce(F.col(decided), F.lit(False))
    c, a, f, fa, fs = F.col(pclass), F.col(age), F.col(fare), F.col(fare_adj), F.col(fsize)
    # Fixed pattern constants of the reference rule set.
    female_death = [
        (c == 3) & (fa < 10),
        (a > 28) & (a < 50) & (c > 1) & (fa < 20),
        (a > 55) & (c > 1),
        (fs > 3) & (c == 3),
        fa < 7.5,
        (fs == 1) & (c == 2) & (fa < 15) & (a > 25),
    ]
    male_life = [
        (c == 1) & (fa > 50) & (a < 40) & (fs <= 2),
        (c == 1) & (f > 100),
        (F.col(person) == "boy") & (a < 12) & (c <= 2),
    ]

    def any_of(ms):
        out = F.coalesce(ms[0], F.lit(False))
        for m in ms[1:]:
            out = out | F.coalesce(m, F.lit(False))
        return out
    return [Rule("pattern_female_death", (F.col(sex) == "female") & nd & any_of(female_death), 0),
            Rule("pattern_male_life", (F.col(sex) == "male") & any_of(male_life), 1)]


def decided_mask(rate: str = "GroupSurvival") -> Column:
    """Rows whose (group or fallback) rate is exactly 0 or 1."""
    return F.coalesce(F.col(rate).isin(0.0, 1.0), F.lit(False))


__all__ = [n for n in dir() if not n.startswith("_")] + ["fx"]
