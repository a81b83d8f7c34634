"""Queries: rules and named cascades.

Sub-model scores are the FIXTURES deterministic scores
``((PassengerId * m) % 1000) / 1000`` (m = 37, 101, 211, 307, 401), which
makes every cascade oracle-checkable; fitted MLlib scores plug into the same
columns (see plans.q_models).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules as R
from ..sources.manifest import manifest
from . import cascades as C
from .registry import (PY_FRAME_CTES, R_FRAME_CTES, SCORE_MULTIPLIERS, register,
                       wcg_fallback_ctes, with_manifest)

ID = "PassengerId"
VOTE_COLS = [f"p{m}" for m in SCORE_MULTIPLIERS]
SOFT_VOTE_COLS = ["p211", "p307", "p401"]
OVERRIDES = [(893, 1)]


def with_scores(m):
    for mult in SCORE_MULTIPLIERS:
        m = m.withColumn(f"p{mult}", (F.col(ID) * mult % 1000).cast("double") / 1000.0)
    return (m.withColumn("p_men", F.col("p37")).withColumn("p_women", F.col("p101"))
             .withColumn("p_rest", F.col("p37")))


def scored(spark, sf_dir):
    return with_scores(manifest(spark, sf_dir))


# SQL snippets shared by the oracles (written independently of the rules).
MEN = "Title = 'man'"
MEN_V = "CAST(p37 >= 0.9 AS INT)"
WOMEN_V = "CAST(p101 > 0.08 AS INT)"


def _py_select(reg_filter: str, cases: list[tuple[str, str, str]], value_col: str = "rate",
               extra_cols: str = "", wrap: str | None = None) -> str:
    """cases: (name, condition, value) in last-writer-first order."""
    pred = "CASE " + " ".join(f"WHEN {c} THEN {v}" for _, c, v in cases) + \
        " WHEN Sex = 'female' THEN 1 ELSE 0 END"
    who = "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c, _ in cases) + " ELSE 'baseline' END"
    return PY_FRAME_CTES + f""",
reg AS (SELECT GroupId, rate, n_labelled FROM preg WHERE {reg_filter}),
x AS (SELECT pf.*, reg.rate AS GroupRate, reg.GroupId IS NOT NULL AS known{extra_cols}
      FROM pf LEFT JOIN reg ON pf.GroupId = reg.GroupId WHERE pf.split = 'test')
SELECT PassengerId, CAST({pred} AS INT) AS prediction, {who} AS decided_by FROM x"""


def _case_sql(cases, base="CASE WHEN Sex = 'female' THEN 1 ELSE 0 END", base_name="baseline"):
    pred = "CASE " + " ".join(f"WHEN {c} THEN {v}" for _, c, v in cases) + f" ELSE {base} END"
    who = "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c, _ in cases) + f" ELSE '{base_name}' END"
    return pred, who


# ---------------------------------------------------------------------------
@register("rule_baseline_gender", with_manifest("""
SELECT PassengerId, CAST(CASE WHEN Sex = 'female' THEN 1 ELSE 0 END AS INT) AS prediction,
       'baseline' AS decided_by FROM manifest WHERE Survived IS NULL"""))
def q_rule_baseline_gender(spark, sf_dir):
    return C.cascade_gender(manifest(spark, sf_dir))


@register("cascade_gender", with_manifest("""
SELECT PassengerId, CAST(CASE WHEN Sex = 'female' THEN 1 ELSE 0 END AS INT) AS prediction,
       'baseline' AS decided_by FROM manifest WHERE Survived IS NULL"""))
def q_cascade_gender(spark, sf_dir):
    return C.cascade_gender(manifest(spark, sf_dir))


_GROUP_CASES = [("group_boy_lived", "Title = 'boy' AND GroupSurvival = 1", "1"),
                ("group_woman_died", "Title = 'woman' AND GroupSurvival = 0", "0")]
_p, _w = _case_sql(_GROUP_CASES)


@register("cascade_group", with_manifest(R_FRAME_CTES + f"""
SELECT PassengerId, CAST({_p} AS INT) AS prediction, {_w} AS decided_by FROM rf WHERE split = 'test'"""))
def q_cascade_group(spark, sf_dir):
    return C.cascade_group(C.r_frame(scored(spark, sf_dir)))


@register("rule_group_flip", with_manifest(R_FRAME_CTES + f"""
SELECT PassengerId, CAST({_p} AS INT) AS prediction, {_w} AS decided_by FROM rf WHERE split = 'test'"""))
def q_rule_group_flip(spark, sf_dir):
    d = C.r_frame(manifest(spark, sf_dir))
    return C.out(C.test_rows(R.run_cascade(d, R.baseline_gender(), [R.group_flip()])))


_REPLACE_CASES = [("group_outcome", "GroupOutcome IS NOT NULL", "GroupOutcome")]


@register("rule_group_replace", with_manifest(PY_FRAME_CTES + """,
reg AS (SELECT GroupId, CAST(rate AS INT) AS GroupOutcome FROM preg WHERE n_labelled >= 2 AND rate IN (0, 1)),
x AS (SELECT pf.*, reg.GroupOutcome FROM pf LEFT JOIN reg ON pf.GroupId = reg.GroupId WHERE split = 'test')
SELECT PassengerId, CAST(CASE WHEN GroupOutcome IS NOT NULL THEN GroupOutcome WHEN Sex = 'female' THEN 1 ELSE 0 END AS INT)
       AS prediction, CASE WHEN GroupOutcome IS NOT NULL THEN 'group_outcome' ELSE 'baseline' END AS decided_by FROM x"""))
def q_rule_group_replace(spark, sf_dir):
    from ..operators import groups as G
    d = C.py_frame(manifest(spark, sf_dir))
    reg = G.outcome_definitive(C.py_registry(d, 2), 2)
    dd = C._with_rate(C.test_rows(d), reg, "outcome")
    return C.out(R.run_cascade(dd, R.baseline_gender(), [R.group_replace()]))


_UNK = [("unknown_group_c12", "GroupId IS NOT NULL AND NOT known AND Title IN ('woman', 'boy') AND Pclass <= 2", "1"),
        ("unknown_group_c3_woman", "GroupId IS NOT NULL AND NOT known AND Title = 'woman' AND Pclass = 3", "0")]
_FLIP_PY = [("group_boy_lived", "Title = 'boy' AND GroupRate = 1", "1"),
            ("group_woman_died", "Title = 'woman' AND GroupRate = 0", "0")]
_MEN = [("men_model", MEN, MEN_V)]
_WOMEN_KNOWN = [("solo_women_model", "Title = 'woman' AND FamilySize = 1 AND NOT known", WOMEN_V)]


@register("rule_unknown_group", with_manifest(_py_select("n_labelled >= 1", _UNK + _FLIP_PY)))
def q_rule_unknown_group(spark, sf_dir):
    d = C.py_frame(manifest(spark, sf_dir))
    dd = C._with_rate(C.test_rows(d), C.py_registry(d, 1), "rate")
    return C.out(R.run_cascade(dd, R.baseline_gender(), [R.group_flip("GroupRate"), R.unknown_group()]))


@register("rule_partition", with_manifest("""
f AS (SELECT PassengerId, lower(trim(split_part(Name, ',', 1))) || '_' ||
             CAST(coalesce(SibSp, 0) + coalesce(Parch, 0) + 1 AS VARCHAR) AS FamilyID,
             lower(trim(regexp_extract(Name, ',\\s*([^.]+)\\.', 1))) = 'master' AS is_boy,
             coalesce(lower(Sex) = 'female', false) AS is_fem, Survived,
             Survived IS NULL AS is_test FROM manifest),
fam AS (SELECT FamilyID, coalesce(bool_and(CASE WHEN is_fem OR is_boy THEN Survived = 1 END), false) AS live,
               coalesce(bool_and(CASE WHEN is_fem OR is_boy THEN Survived = 0 END), false) AS die
        FROM f WHERE NOT is_test GROUP BY FamilyID)
SELECT PassengerId, CASE WHEN is_fem AND coalesce(die, false) THEN 'covered_die'
                         WHEN coalesce(is_boy, false) AND coalesce(live, false) THEN 'covered_live'
                         ELSE 'uncovered' END AS coverage
FROM f LEFT JOIN fam USING (FamilyID) WHERE is_test"""))
def q_rule_partition(spark, sf_dir):
    from ..functions import features as fx
    from ..operators import groups as G
    from ..operators.joins import join_back
    d = G.with_split(manifest(spark, sf_dir)).withColumn("FamilyID", fx.family_id("Name"))
    fam = G.family_unanimity(d.where(F.col("split") == "train"))
    t = join_back(C.test_rows(d), fam, "FamilyID", spread_on=ID)
    live = fx.is_boy("Name") & F.coalesce(F.col("all_fb_live"), F.lit(False))
    die = fx.is_female("Sex") & F.coalesce(F.col("all_fb_die"), F.lit(False))
    return t.select(ID, F.when(die, "covered_die").when(live, "covered_live").otherwise("uncovered")
                    .alias("coverage"))


@register("override_submodel", with_manifest(_py_select("n_labelled >= 1", _WOMEN_KNOWN + _MEN)))
def q_override_submodel(spark, sf_dir):
    d = C.py_frame(scored(spark, sf_dir))
    dd = C._with_rate(C.test_rows(d), C.py_registry(d, 1), "rate")
    stages = [C.men_stage(), C.women_stage(R.mask_solo_female("known"))]
    return C.out(R.run_cascade(dd, R.baseline_gender(), stages))


@register("mask_solo_female", with_manifest(PY_FRAME_CTES + """,
x AS (SELECT pf.*, preg.GroupId IS NOT NULL AS known FROM pf LEFT JOIN preg ON pf.GroupId = preg.GroupId
      WHERE split = 'test')
SELECT PassengerId, Title = 'woman' AND FamilySize = 1 AND NOT known AS solo_known,
       Title = 'woman' AND FamilySize = 1 AND GroupId IS NULL AS solo_any,
       Title = 'woman' AND FamilySize = 1 AS solo_none FROM x"""))
def q_mask_solo_female(spark, sf_dir):
    d = C.py_frame(manifest(spark, sf_dir))
    dd = C._with_rate(C.test_rows(d), C.py_registry(d, 1), "rate")
    return dd.select(ID, R.mask_solo_female("known").alias("solo_known"),
                     R.mask_solo_female("any").alias("solo_any"),
                     R.mask_solo_female("none").alias("solo_none"))


_HEUR = """(CASE WHEN Age < 16 THEN 1.0 WHEN Age > 60 THEN -0.5 ELSE 0.0 END
   + CASE WHEN Pclass = 1 THEN 1.0 WHEN Pclass = 3 THEN -0.5 ELSE 0.0 END
   + CASE WHEN FareAdj > 30 THEN 0.5 WHEN FareAdj < 10 THEN -0.5 ELSE 0.0 END
   + CASE WHEN FamilySize > 4 THEN -0.5 WHEN FamilySize IN (2, 3) THEN 0.5 ELSE 0.0 END)"""


@register("rule_heuristic_score", with_manifest(PY_FRAME_CTES + f""",
x AS (SELECT pf.*, preg.GroupId IS NOT NULL AS known, {_HEUR} AS HeuristicScore
      FROM pf LEFT JOIN preg ON pf.GroupId = preg.GroupId WHERE split = 'test')
SELECT PassengerId, CAST(HeuristicScore AS DOUBLE) AS HeuristicScore,
  CAST(CASE WHEN NOT known AND Sex = 'male' AND HeuristicScore > 2.5 THEN 1
            WHEN NOT known AND Sex = 'female' AND HeuristicScore < 1.5 THEN 0
            WHEN Sex = 'female' THEN 1 ELSE 0 END AS INT) AS prediction FROM x"""))
def q_rule_heuristic_score(spark, sf_dir):
    d = C.py_frame(manifest(spark, sf_dir))
    dd = C._with_rate(C.test_rows(d), C.py_registry(d, 1), "rate")
    dd = dd.withColumn("HeuristicScore", R.heuristic_score())
    res = R.run_cascade(dd, R.baseline_gender(), [R.heuristic_rules()])
    return res.select(ID, "HeuristicScore", "prediction")


_EDGE = """CASE WHEN NOT known AND Title = 'boy' AND Pclass <= 2 AND Age < 10 THEN 1
     WHEN NOT known AND Title = 'woman' AND Pclass = 3 AND Age > 55 AND FareAdj < 10 THEN 0
     WHEN NOT known AND Title = 'woman' AND Pclass = 1 AND FamilySize = 1 THEN 1
     WHEN NOT known AND Title = 'man' AND Pclass = 1 AND FareAdj > 50 AND FamilySize <= 2 THEN 1 END"""


@register("rule_edge_cases", with_manifest(PY_FRAME_CTES + f""",
x AS (SELECT pf.*, preg.GroupId IS NOT NULL AS known FROM pf LEFT JOIN preg ON pf.GroupId = preg.GroupId
      WHERE split = 'test')
SELECT PassengerId, CAST(coalesce({_EDGE}, CASE WHEN Sex = 'female' THEN 1 ELSE 0 END) AS INT) AS prediction FROM x"""))
def q_rule_edge_cases(spark, sf_dir):
    d = C.py_frame(manifest(spark, sf_dir))
    dd = C._with_rate(C.test_rows(d), C.py_registry(d, 1), "rate")
    res = R.run_cascade(dd, R.baseline_gender(),
                        [[R.Rule("edge_case", R.edge_case_value().isNotNull(), R.edge_case_value())]])
    return res.select(ID, "prediction")


def _soft_sql(pred_col: str) -> str:
    p = "p_mean"
    inner = (f"CASE WHEN NOT known AND Title = 'man' AND {p} > 0.7 THEN 1 "
             f"WHEN NOT known AND Title = 'man' AND {p} < 0.2 THEN 0 "
             f"WHEN NOT known AND Title IN ('woman', 'boy') AND {p} < 0.3 THEN 0 "
             f"WHEN NOT known AND Title IN ('woman', 'boy') AND {p} > 0.8 THEN 1 ELSE {pred_col} END")
    solo1 = "NOT known AND FamilySize = 1 AND Pclass = 1 AND Fare > 50"
    return (f"CASE WHEN NOT known AND Title = 'boy' AND Age < 10 AND Pclass <= 2 THEN 1 "
            f"WHEN {solo1} AND Title = 'woman' THEN 1 WHEN {solo1} AND Title = 'man' AND {p} > 0.6 THEN 1 "
            f"ELSE {inner} END")


@register("rule_soft_vote", with_manifest(PY_FRAME_CTES + f""",
x AS (SELECT pf.*, preg.GroupId IS NOT NULL AS known, (p211 + p307 + p401) / 3 AS p_mean,
             CASE WHEN Sex = 'female' THEN 1 ELSE 0 END AS base
      FROM pf LEFT JOIN preg ON pf.GroupId = preg.GroupId WHERE split = 'test')
SELECT PassengerId, CAST({_soft_sql('base')} AS INT) AS prediction FROM x"""))
def q_rule_soft_vote(spark, sf_dir):
    d = C.py_frame(scored(spark, sf_dir))
    dd = C._with_rate(C.test_rows(d), C.py_registry(d, 1), "rate")
    dd = dd.withColumn("p_mean", sum(F.col(c) for c in SOFT_VOTE_COLS) / len(SOFT_VOTE_COLS))
    res = R.run_cascade(dd, R.baseline_gender(), [[R.Rule("soft_vote", ~F.col("InKnownGroup"),
                                                          R.soft_vote_value())]])
    return res.select(ID, "prediction")


_PAT_F = """((Pclass = 3 AND FareAdj < 10) OR (Age > 28 AND Age < 50 AND Pclass > 1 AND FareAdj < 20)
    OR (Age > 55 AND Pclass > 1) OR (FamilySize > 3 AND Pclass = 3) OR FareAdj < 7.5
    OR (FamilySize = 1 AND Pclass = 2 AND FareAdj < 15 AND Age > 25))"""
_PAT_M = """((Pclass = 1 AND FareAdj > 50 AND Age < 40 AND FamilySize <= 2) OR (Pclass = 1 AND Fare > 100)
    OR (Title = 'boy' AND Age < 12 AND Pclass <= 2))"""
_PATTERN_CASES = [("pattern_male_life", f"Sex = 'male' AND coalesce({_PAT_M}, false)", "1"),
                  ("pattern_female_death", f"Sex = 'female' AND NOT GroupDecided AND coalesce({_PAT_F}, false)", "0")]
_R_FALLBACK_FRAME = R_FRAME_CTES.replace(
    "coalesce(u.urate, CASE WHEN Pclass = 3 THEN 0.0 ELSE 1.0 END)", "CASE WHEN Pclass = 3 THEN 0.0 ELSE 1.0 END")
assert _R_FALLBACK_FRAME != R_FRAME_CTES and wcg_fallback_ctes()


@register("rule_pattern_masks", with_manifest(_R_FALLBACK_FRAME + """
SELECT PassengerId, CAST({p} AS INT) AS prediction, {w} AS decided_by FROM rf WHERE split = 'test'""".format(
    p=_case_sql(_PATTERN_CASES)[0], w=_case_sql(_PATTERN_CASES)[1])))
def q_rule_pattern_masks(spark, sf_dir):
    d = C.r_frame(manifest(spark, sf_dir), ungrouped="fallback")
    return C.out(C.test_rows(R.run_cascade(d, R.baseline_gender(), [R.pattern_masks()])))


@register("rule_static_ids", with_manifest("""
SELECT PassengerId, CAST(CASE WHEN PassengerId IN ({ids}) THEN 0 WHEN Sex = 'female' THEN 1 ELSE 0 END AS INT)
       AS prediction, CASE WHEN PassengerId IN ({ids}) THEN 'static_ids' ELSE 'baseline' END AS decided_by
FROM manifest WHERE Survived IS NULL""".format(ids=", ".join(map(str, C.STATIC_DEATH_IDS)))))
def q_rule_static_ids(spark, sf_dir):
    from ..operators import groups as G
    d = R.run_cascade(C.test_rows(G.with_split(manifest(spark, sf_dir))), R.baseline_gender(), [])
    ids = spark.createDataFrame([(i,) for i in C.STATIC_DEATH_IDS], "id long")
    return C.out(R.static_ids_rule(d, ids))


# ---------------------------------------------------------------------------
# Named cascades
# ---------------------------------------------------------------------------
_CW = _WOMEN_KNOWN + _MEN + _FLIP_PY


@register("cascade_complete_wcg", with_manifest(_py_select("n_labelled >= 1", _CW)))
def q_cascade_complete_wcg(spark, sf_dir):
    return C.cascade_complete_wcg(C.py_frame(scored(spark, sf_dir)))


_XR = _WOMEN_KNOWN + _MEN + _UNK + _FLIP_PY


@register("cascade_exact_r", with_manifest(_py_select("n_labelled >= 1", _XR)))
def q_cascade_exact_r(spark, sf_dir):
    return C.cascade_exact_r(C.py_frame(scored(spark, sf_dir)))


_p5, _w5 = _case_sql(_XR)


@register("cascade_complete_r", with_manifest(PY_FRAME_CTES + f""",
x AS (SELECT pf.*, preg.rate AS GroupRate, preg.GroupId IS NOT NULL AS known, {_HEUR} AS HeuristicScore
      FROM pf LEFT JOIN preg ON pf.GroupId = preg.GroupId WHERE split = 'test'),
y AS (SELECT *, {_p5} AS p5, {_w5} AS w5 FROM x)
SELECT PassengerId,
  CAST(CASE WHEN NOT known AND Sex = 'male' AND p5 = 0 AND HeuristicScore > 2.5 THEN 1
            WHEN NOT known AND Sex = 'female' AND p5 = 1 AND HeuristicScore < 1.5 THEN 0 ELSE p5 END AS INT) AS prediction,
  CASE WHEN NOT known AND Sex = 'male' AND p5 = 0 AND HeuristicScore > 2.5 THEN 'heuristic_male_high'
       WHEN NOT known AND Sex = 'female' AND p5 = 1 AND HeuristicScore < 1.5 THEN 'heuristic_female_low'
       ELSE w5 END AS decided_by FROM y"""))
def q_cascade_complete_r(spark, sf_dir):
    return C.cascade_complete_r(C.py_frame(scored(spark, sf_dir)))


_FI = [("solo_women_model", "Title = 'woman' AND FamilySize = 1 AND GroupId IS NULL", WOMEN_V)] + _MEN + \
      [("group_outcome", "GroupRate IS NOT NULL", "CAST(GroupRate AS INT)")]


@register("cascade_faithful", with_manifest(_py_select("n_labelled >= 2 AND rate IN (0, 1)", _FI)))
def q_cascade_faithful(spark, sf_dir):
    return C.cascade_faithful(C.py_frame(scored(spark, sf_dir)))


def _majority_cases(hi, lo):
    return [("group_outcome", "GroupRate IS NOT NULL", f"CASE WHEN GroupRate >= {hi} THEN 1 ELSE 0 END")]


_EN5 = _WOMEN_KNOWN + _MEN + _majority_cases(0.75, 0.25)
_p_en, _w_en = _case_sql(_EN5)


@register("cascade_enhanced", with_manifest(PY_FRAME_CTES + f""",
reg AS (SELECT GroupId, rate FROM preg WHERE n_labelled >= 2 AND (rate >= 0.75 OR rate <= 0.25)),
x AS (SELECT pf.*, reg.rate AS GroupRate, reg.GroupId IS NOT NULL AS known
      FROM pf LEFT JOIN reg ON pf.GroupId = reg.GroupId WHERE split = 'test'),
y AS (SELECT *, {_p_en} AS p5, {_w_en} AS w5, {_EDGE} AS edge FROM x)
SELECT PassengerId, CAST(coalesce(edge, p5) AS INT) AS prediction,
       CASE WHEN edge IS NOT NULL THEN 'edge_case' ELSE w5 END AS decided_by FROM y"""))
def q_cascade_enhanced(spark, sf_dir):
    return C.cascade_enhanced(C.py_frame(scored(spark, sf_dir)))


_RE5 = _WOMEN_KNOWN + _MEN + _majority_cases(0.7, 0.3)
_p_re, _w_re = _case_sql(_RE5)


@register("cascade_soft_vote", with_manifest(PY_FRAME_CTES + f""",
reg AS (SELECT GroupId, rate FROM preg WHERE n_labelled >= 2 AND (rate >= 0.7 OR rate <= 0.3)),
x AS (SELECT pf.*, reg.rate AS GroupRate, reg.GroupId IS NOT NULL AS known, (p211 + p307 + p401) / 3 AS p_mean
      FROM pf LEFT JOIN reg ON pf.GroupId = reg.GroupId WHERE split = 'test'),
y AS (SELECT *, {_p_re} AS p5, {_w_re} AS w5 FROM x)
SELECT PassengerId, CAST({_soft_sql('p5')} AS INT) AS prediction,
       CASE WHEN NOT known THEN 'soft_vote' ELSE w5 END AS decided_by FROM y"""))
def q_cascade_soft_vote(spark, sf_dir):
    return C.cascade_soft_vote(C.py_frame(scored(spark, sf_dir)), SOFT_VOTE_COLS)


_ids = ", ".join(map(str, C.STATIC_DEATH_IDS))
_EX = [("static_ids", f"PassengerId IN ({_ids})", "0")] + _WOMEN_KNOWN + _MEN + _FLIP_PY


@register("cascade_static", with_manifest(_py_select("n_labelled >= 2", _EX)))
def q_cascade_static(spark, sf_dir):
    return C.cascade_static(C.py_frame(scored(spark, sf_dir)))


_FX = _PATTERN_CASES + [("solo_women_model", "Title = 'woman' AND FamilySize = 1 AND NOT GroupDecided", WOMEN_V)] \
    + _MEN + _GROUP_CASES
_p_fx, _w_fx = _case_sql(_FX)


@register("cascade_patterns", with_manifest(_R_FALLBACK_FRAME + f"""
SELECT PassengerId, CAST({_p_fx} AS INT) AS prediction, {_w_fx} AS decided_by FROM rf WHERE split = 'test'"""))
def q_cascade_patterns(spark, sf_dir):
    return C.cascade_patterns(C.r_frame(scored(spark, sf_dir), ungrouped="fallback"))


@register("cascade_rule_then_model", with_manifest("""
f AS (SELECT PassengerId, lower(trim(split_part(Name, ',', 1))) || '_' ||
             CAST(coalesce(SibSp, 0) + coalesce(Parch, 0) + 1 AS VARCHAR) AS FamilyID,
             coalesce(lower(trim(regexp_extract(Name, ',\\s*([^.]+)\\.', 1))) = 'master', false) AS is_boy,
             coalesce(lower(Sex) = 'female', false) AS is_fem, Survived, Survived IS NULL AS is_test,
             CAST((PassengerId * 37) % 1000 AS DOUBLE) / 1000.0 AS p37 FROM manifest),
fam AS (SELECT FamilyID, coalesce(bool_and(CASE WHEN is_fem OR is_boy THEN Survived = 1 END), false) AS live,
               coalesce(bool_and(CASE WHEN is_fem OR is_boy THEN Survived = 0 END), false) AS die
        FROM f WHERE NOT is_test GROUP BY FamilyID)
SELECT PassengerId,
  CAST(CASE WHEN is_fem AND coalesce(die, false) THEN 0 WHEN is_boy AND coalesce(live, false) THEN 1
            WHEN p37 >= 0.5 THEN 1 ELSE 0 END AS INT) AS prediction,
  CASE WHEN is_fem AND coalesce(die, false) THEN 'family_die' WHEN is_boy AND coalesce(live, false) THEN 'family_live'
       ELSE 'model' END AS decided_by
FROM f LEFT JOIN fam USING (FamilyID) WHERE is_test"""))
def q_cascade_rule_then_model(spark, sf_dir):
    return C.cascade_rule_then_model(scored(spark, sf_dir))


@register("cascade_solo_female", with_manifest("""
f AS (SELECT PassengerId, coalesce(SibSp, 0) + coalesce(Parch, 0) + 1 AS FamilySize,
        CASE WHEN regexp_matches(Name, ',\\s*([^.]+)\\.') THEN lower(trim(regexp_extract(Name, ',\\s*([^.]+)\\.', 1))) END AS t,
        CAST((PassengerId * 101) % 1000 AS DOUBLE) / 1000.0 AS p101
      FROM manifest WHERE Survived IS NULL),
g AS (SELECT *, CASE WHEN t IN ('miss', 'mrs', 'ms', 'mme', 'mlle', 'lady', 'the countess') THEN 'woman' ELSE t END AS tw FROM f)
SELECT PassengerId, CAST(CASE WHEN tw = 'woman' AND FamilySize = 1 THEN CAST(p101 > 0.25 AS INT) ELSE 1 END AS INT)
       AS prediction, CASE WHEN tw = 'woman' AND FamilySize = 1 THEN 'solo_female_model' ELSE 'default' END AS decided_by
FROM g"""))
def q_cascade_solo_female(spark, sf_dir):
    return C.cascade_solo_female(scored(spark, sf_dir))


_VOTE_SUM = " + ".join(f"CAST(p{m} >= 0.5 AS INT)" for m in SCORE_MULTIPLIERS)
_VOTE_PRED = ("CASE WHEN gender = 0 AND vote_sum > 2.5 THEN 1 WHEN gender = 1 AND vote_sum < 2.5 THEN 0 "
              "ELSE gender END")
_GP = "CASE WHEN Title = 'boy' AND GroupSurvival = 1 THEN 1 WHEN Title = 'woman' AND GroupSurvival = 0 THEN 0 " \
      "WHEN Sex = 'female' THEN 1 ELSE 0 END"


@register("cascade_mega", with_manifest(R_FRAME_CTES + f""",
v0 AS (SELECT *, CASE WHEN Sex = 'female' THEN 1 ELSE 0 END AS gender, {_VOTE_SUM} AS vote_sum
       FROM rf WHERE split = 'test'),
v AS (SELECT *, {_VOTE_PRED} AS vote_pred, {_GP} AS group_pred FROM v0)
SELECT PassengerId,
  CAST(CASE WHEN PassengerId = 893 THEN 1 WHEN NOT GroupDecided AND vote_pred <> gender THEN vote_pred
            WHEN GroupDecided THEN group_pred ELSE gender END AS INT) AS prediction,
  CASE WHEN PassengerId = 893 THEN 'outcome_override' WHEN NOT GroupDecided AND vote_pred <> gender THEN 'vote'
       WHEN GroupDecided THEN 'group_model' ELSE 'baseline' END AS decided_by FROM v"""))
def q_cascade_mega(spark, sf_dir):
    ov = spark.createDataFrame(OVERRIDES, "id long, value int")
    return C.cascade_mega(C.r_frame(scored(spark, sf_dir)), VOTE_COLS, ov)


_W_CASES = [("vote_dissent", "NOT GroupDecided AND vote_pred <> gender", "0"),
            ("solo_women_model", "Title = 'woman' AND FamilySize = 1 AND NOT GroupDecided", WOMEN_V)] + _MEN + _GROUP_CASES
_p_w, _w_w = _case_sql(_W_CASES)


@register("cascade_group_models_vote", with_manifest(R_FRAME_CTES + f""",
v0 AS (SELECT *, CASE WHEN Sex = 'female' THEN 1 ELSE 0 END AS gender, {_VOTE_SUM} AS vote_sum
       FROM rf WHERE split = 'test'),
v AS (SELECT *, {_VOTE_PRED} AS vote_pred FROM v0)
SELECT PassengerId, CAST({_p_w} AS INT) AS prediction, {_w_w} AS decided_by FROM v"""))
def q_cascade_group_models_vote(spark, sf_dir):
    return C.cascade_group_models_vote(C.r_frame(scored(spark, sf_dir)), VOTE_COLS)


@register("cascade_clone", with_manifest("""
c0 AS (SELECT * REPLACE (coalesce(Fare, (SELECT median(Fare) FROM manifest)) AS Fare) FROM manifest),
c1 AS (SELECT *, CASE WHEN Name LIKE '%Master%' THEN 'boy' WHEN Sex = 'female' THEN 'woman' ELSE 'man' END AS Title,
         regexp_extract(Name, '^([^,]*),', 1) AS Surname, regexp_replace(Ticket, '.$', 'X') AS TicketMod,
         coalesce(CAST(CAST(Fare AS DECIMAL(12,2)) AS VARCHAR), 'NA') AS FareTxt,
         coalesce(SibSp, 0) + coalesce(Parch, 0) + 1 AS FamilySize,
         CAST((PassengerId * 37) % 1000 AS DOUBLE) / 1000.0 AS p37,
         CAST((PassengerId * 101) % 1000 AS DOUBLE) / 1000.0 AS p101 FROM c0),
c2 AS (SELECT *, CASE WHEN Title <> 'man' THEN coalesce(Surname, 'NA') || '-' || CAST(Pclass AS VARCHAR) || '-'
         || coalesce(TicketMod, 'NA') || '-' || FareTxt || '-' || coalesce(Embarked, 'S') END AS gid0 FROM c1),
c3 AS (SELECT *, CASE WHEN gid0 IS NOT NULL AND count(*) OVER (PARTITION BY gid0) >= 2 THEN gid0 END AS GroupId FROM c2),
creg AS (SELECT GroupId, CAST(avg(Survived) AS INT) AS GroupOutcome FROM c3
         WHERE Survived IS NOT NULL AND GroupId IS NOT NULL GROUP BY GroupId HAVING avg(Survived) IN (0, 1)),
x AS (SELECT c3.*, creg.GroupOutcome FROM c3 LEFT JOIN creg ON c3.GroupId = creg.GroupId WHERE Survived IS NULL)
SELECT PassengerId,
  CAST(CASE WHEN Title = 'woman' AND FamilySize = 1 AND GroupId IS NULL THEN CAST(p101 > 0.08 AS INT)
            WHEN Title = 'man' THEN CAST(p37 >= 0.9 AS INT) WHEN GroupOutcome IS NOT NULL THEN GroupOutcome
            WHEN Sex = 'female' THEN 1 ELSE 0 END AS INT) AS prediction,
  CASE WHEN Title = 'woman' AND FamilySize = 1 AND GroupId IS NULL THEN 'solo_women_model'
       WHEN Title = 'man' THEN 'men_model' WHEN GroupOutcome IS NOT NULL THEN 'group_outcome'
       ELSE 'baseline' END AS decided_by FROM x"""))
def q_cascade_clone(spark, sf_dir):
    return C.cascade_clone(scored(spark, sf_dir))
