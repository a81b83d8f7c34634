"""Queries: the cascades with fitted sub-models in place of given scores.

Men and solo women have boosted sub-models over (x1, x2) of their cohorts, the
rest one over the general features, all fitted on labelled rows only. Rows
alone are checked: fitted scores depend on the training.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import features as fx
from ..operators import boosting as B
from ..operators import groups as G
from ..operators import models as M
from ..operators.joins import join_back
from ..session import materialize
from ..sources.manifest import manifest
from . import cascades as C
from . import q_models as Q
from .registry import register

ID = "PassengerId"


def sub_scores(spark, sf_dir, frame=None, split=None):
    """(PassengerId, p_men, p_women): the sub-models' p for the rows of their
    cohorts, or those of a ``split``, both fits at once."""
    frame = Q._sub_frame(spark, sf_dir) if frame is None else frame
    parts = []
    for c in ("men", "women"):
        d = Q._xy(Q._cohort(frame, c), c)
        [d] = M.binned(d, features=[F.col("x1"), F.col("x2")])
        parts.append(d.select(F.lit(c).alias("cohort"), ID, "Survived", "split", "bins"))
    rows = materialize(reduce(DataFrame.unionByName, parts))
    trees = B.fit(B.counted(rows, group="cohort"), [B.Cell(c, Q.SUB, group=c) for c in ("men", "women")])
    scored = B.score((rows if split is None else rows.where(F.col("split") == split)).drop("Survived", "split"), trees, by="cohort")
    return scored.groupBy(ID).agg(*[F.max(F.when(F.col("cohort") == c, F.col("p"))).alias(f"p_{c}") for c in ("men", "women")])


def rest_features():
    """General features as columns; a missing value is the lowest bin."""
    code = lambda c, v: F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0))
    return [F.col("Age"), F.col("Fare"), F.col("SibSp"), F.col("Parch"), F.col("Pclass"), code("Sex", "male"),
            code("Embarked", "C"), code("Embarked", "Q"), code("Embarked", "S")]


def rule_then_fitted(m):
    """Family rules first; boosted trees learn from the labelled rows that they leave and decide the others."""
    d = G.with_split(m.select(ID, "Survived", "Pclass", "Name", "Sex", "Age", "SibSp", "Parch", "Fare", "Embarked")).withColumn("FamilyID", fx.family_id("Name"))
    fam = G.family_unanimity(d.where(F.col("split") == "train"))
    # The cuts, the fit and the scores read it.
    dd = materialize(join_back(d, fam.select("FamilyID", "all_fb_live", "all_fb_die"), "FamilyID", spread_on=ID).drop("FamilyID"))
    covered = (fx.is_boy("Name") & F.col("all_fb_live")) | (fx.is_female("Sex") & F.col("all_fb_die"))
    scored = M.fitted_stage(dd, covered, rest_features(), Q.GENERAL)
    return C.cascade_rule_then_model(materialize(scored.select(ID, "Survived", "Name", "Sex", "SibSp", "Parch", "p_rest")))


@register("cascades_fitted")
def q_cascades_fitted(spark, sf_dir):
    """(cascade, PassengerId, prediction, decided_by) of the cascades with
    sub-models, from one pair of fits; a row outside a cohort has no score of it
    and no rule asks for one."""
    m = materialize(join_back(manifest(spark, sf_dir).drop("Cabin"), sub_scores(spark, sf_dir), ID))
    py, grouped = C.py_frame(m, keep=C.RULE_COLUMNS), C.r_attached(m, keep=C.RULE_COLUMNS)
    known = materialize(C.py_registry(py))
    r, own = C.r_frame(m, attached=grouped), C.r_frame(m, ungrouped="fallback", attached=grouped)
    made = {"complete_wcg": C.cascade_complete_wcg(py, known), "complete_r": C.cascade_complete_r(py, known), "exact_r": C.cascade_exact_r(py, known),
            "faithful": C.cascade_faithful(py, known), "enhanced": C.cascade_enhanced(py, known), "static": C.cascade_static(py, known),
            "patterns": C.cascade_patterns(own), "clone": C.cascade_clone(m), "solo_female": C.cascade_solo_female(m),
            "group": C.cascade_group(r), "rule_then_model": rule_then_fitted(m.drop("p_men", "p_women"))}
    return reduce(DataFrame.unionByName, [
        d.select(F.lit(name).alias("cascade"), ID, F.col("prediction").cast("int").alias("prediction"), "decided_by") for name, d in made.items()])


@register("cascade_soft_vote_fitted")
def q_cascade_soft_vote_fitted(spark, sf_dir):
    """The soft-vote cascade with its three fitted members and fitted sub-models."""
    frame = Q._sub_frame(spark, sf_dir)
    # The groups of all rows come first; only the scoring rows get scores.
    d = C.py_frame(manifest(spark, sf_dir).drop("Cabin"), keep=C.RULE_COLUMNS)
    known = C.py_registry(d, 2)
    members = Q.soft_votes(Q._member_frame(spark, sf_dir, frame)).select(ID, "p_forest", "p_logistic", "p_machine")
    rows = join_back(join_back(C.test_rows(d), sub_scores(spark, sf_dir, frame, "test"), ID), members, ID)
    return C.cascade_soft_vote(rows, ["p_forest", "p_logistic", "p_machine"], known)
