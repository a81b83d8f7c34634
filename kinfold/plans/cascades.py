"""Named decision cascades (compositions of the rules in operators.rules).

Frames come in two styles that mirror the two families of reference models:

* ``r_frame``: R notebooks -- keys, sizes and frequencies over labelled and
  scoring rows together, 'Master' wins the person type, first-row attach,
  group rate with class fallback.
* ``py_frame``: Python models -- the same quantities per split, female wins
  the person type, first-*grouped* attach, missing Embarked read as 'S' in
  keys, and a group registry learned from the labelled split only.

Sub-model scores enter as columns (``p_men``, ``p_women``, ``p_vote1..5``,
``p_rest``); a fitted MLlib model or any score table can supply them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import features as fx
from ..operators import groups as G
from ..operators import rules as R
from ..operators.joins import add_key_count, join_back
from ..operators.profile import exact_quantiles
from ..session import materialize

ID = "PassengerId"

# Fixed id list of the reference's static-override model (ids set to 0).
STATIC_DEATH_IDS = [
    900, 902, 914, 925, 932, 944, 948, 965, 967, 975, 985, 1001, 1003, 1016, 1018, 1027,
    1045, 1053, 1057, 1063, 1076, 1078, 1080, 1086, 1090, 1100, 1109, 1117, 1123, 1125,
    1132, 1141, 1152, 1155, 1160, 1165, 1168, 1172, 1175, 1177, 1188, 1194, 1197, 1203,
    1205, 1215, 1217, 1220, 1226, 1229, 1234, 1241, 1243, 1245, 1248, 1252, 1254, 1259,
    1262, 1264, 1266, 1268, 1274, 1278, 1283, 1291, 1299, 1301, 1306, 1308,
]
MEN_THRESHOLD = 0.9        # men: p >= 0.9 -> 1
WOMEN_THRESHOLD = 0.08     # solo women: p > 0.08 -> 1
SOLO_FEMALE_THRESHOLD = 0.25


def add_common(df: DataFrame, scope_keys: list[str], source: DataFrame | None = None) -> DataFrame:
    """FamilySize, TicketFreq (rows sharing the Ticket in scope), FareAdj.
    ``source``: a materialized frame with the same rows to count from, so
    the count does not recompute ``df``."""
    d = df.withColumn("FamilySize", fx.family_size())
    keys = scope_keys + ["Ticket"]
    src = source if source is not None else df
    reg = src.where(F.col("Ticket").isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("TicketFreq"))
    d = join_back(d, reg, keys, spread_on=ID)
    return d.withColumn("FareAdj", F.col("Fare") / F.col("TicketFreq"))


#: What the sub-model, group, heuristic, edge and pattern rules read; the frames need no others for them.
RULE_COLUMNS = [ID, "Survived", "split", "Title", "GroupId", "Pclass", "Sex", "Age", "SibSp", "Parch", "Ticket", "Fare", "p_men", "p_women"]


def r_attached(m: DataFrame, attach: str = "first_row", link_pairs: DataFrame | None = None, keep: list[str] | None = None) -> DataFrame:
    """The grouped rows that ``r_frame`` annotates; several frames can share them."""
    return G.wcg_frame(m, scope="combined", attach=attach, precedence="master", link_pairs=link_pairs,
                       recount=False, keep=keep)


def r_frame(m: DataFrame, attach: str = "first_row", ungrouped: str = "own_mean",
            link_pairs: DataFrame | None = None, attached: DataFrame | None = None) -> DataFrame:
    a = r_attached(m, attach, link_pairs) if attached is None else attached
    d = G.annotate_groups(a, ungrouped=ungrouped)
    d = d.withColumn("GroupDecided", R.decided_mask())
    return add_common(d, [], source=a)


def py_frame(m: DataFrame, keep: list[str] | None = None) -> DataFrame:
    d = G.wcg_frame(m, scope="per_split", attach="first_grouped", precedence="female", recount=False,
                    embarked_fill="S", no_comma="whole", keep=keep)
    return materialize(add_common(d, ["split"], source=d))


def py_registry(d: DataFrame, min_labelled: int = 1, known: DataFrame | None = None) -> DataFrame:
    """``known``: the registry of ``d`` with the least number of labelled members, where several cascades share it."""
    if known is not None:
        return known.where(F.col("n_labelled") >= min_labelled)
    return G.group_registry(d.where(F.col("split") == "train"), min_labelled=min_labelled)


def _with_rate(d: DataFrame, reg: DataFrame, kind: str) -> DataFrame:
    """Join a registry (rate / outcome) to rows and flag known groups."""
    if kind == "rate":
        r = reg.select("GroupId", F.col("rate").alias("GroupRate"))
    else:
        r = reg.select("GroupId", F.col("outcome").alias("GroupOutcome"))
    d = join_back(d, r.withColumn("InKnownGroup", F.lit(True)), "GroupId", spread_on=ID)
    return d.withColumn("InKnownGroup", F.coalesce(F.col("InKnownGroup"), F.lit(False)))


def men_stage(score: str = "p_men") -> list[R.Rule]:
    return [R.Rule("men_model", F.col("Title") == "man",
                   (F.col(score) >= MEN_THRESHOLD).cast("int"))]


def women_stage(mask: Column, score: str = "p_women") -> list[R.Rule]:
    return [R.Rule("solo_women_model", mask, (F.col(score) > WOMEN_THRESHOLD).cast("int"))]


def test_rows(d: DataFrame) -> DataFrame:
    return d.where(F.col("split") == "test")


def out(d: DataFrame) -> DataFrame:
    return d.select(ID, "prediction", "decided_by")


# ---------------------------------------------------------------------------
# Cascades: frame with scores -> predictions on scoring rows
# ---------------------------------------------------------------------------
def cascade_gender(m: DataFrame) -> DataFrame:
    d = G.with_split(m)
    return out(test_rows(R.run_cascade(d, R.baseline_gender(), [])))


def cascade_group(d: DataFrame) -> DataFrame:
    """d: r_frame."""
    return out(test_rows(R.run_cascade(d, R.baseline_gender(), [R.group_flip()])))


def cascade_clone(m: DataFrame) -> DataFrame:
    """Definitive groups replace, then the two sub-models (no attach step,
    missing Embarked 'S' and missing Fare median-filled before keys)."""
    med = exact_quantiles(m, "Fare", {"__med": 0.5}).select("__med")
    m2 = m.crossJoin(F.broadcast(med)).withColumn("Fare", F.coalesce("Fare", "__med")).drop("__med")
    d = G.with_split(m2)
    d = G.engineer_keys(d, "master")
    d = G.add_group_key(d, embarked_fill="S")
    # Three branches read the sized groups: the registry, the ticket counts and the rows.
    sized = materialize(G.filter_group_size(d.select(*[c for c in RULE_COLUMNS if c in d.columns])))
    d = add_common(sized, [])
    reg = G.group_registry(sized.where(F.col("split") == "train")).where(F.col("rate").isin(0.0, 1.0)) \
        .withColumn("outcome", F.col("rate").cast("int"))
    d = _with_rate(d, reg, "outcome")
    solo = (F.col("Title") == "woman") & (F.col("FamilySize") == 1) & F.col("GroupId").isNull()
    stages = [R.group_replace("GroupOutcome"), men_stage(), women_stage(solo)]
    return out(test_rows(R.run_cascade(d, R.baseline_gender(), stages)))


def _py_cascade(d: DataFrame, reg: DataFrame, kind: str, flip_or_replace: str,
                solo_exclude: str, extra: list | None = None, unknown: bool = False) -> DataFrame:
    d = _with_rate(test_rows(d), reg, kind)
    stages = []
    if flip_or_replace == "flip":
        stages.append(R.group_flip("GroupRate"))
    else:
        stages.append(R.group_replace("GroupOutcome"))
    if unknown:
        stages.append(R.unknown_group())
    stages.append(men_stage())
    stages.append(women_stage(R.mask_solo_female(solo_exclude)))
    return d, stages + (extra or [])


def cascade_complete_wcg(d: DataFrame, known: DataFrame | None = None) -> DataFrame:
    dd, st = _py_cascade(d, py_registry(d, 1, known), "rate", "flip", "known")
    return out(R.run_cascade(dd, R.baseline_gender(), st))


def cascade_complete_r(d: DataFrame, known: DataFrame | None = None) -> DataFrame:
    dd, st = _py_cascade(d, py_registry(d, 1, known), "rate", "flip", "known", unknown=True)
    dd = dd.withColumn("HeuristicScore", R.heuristic_score())
    st.append(R.heuristic_rules())
    return out(R.run_cascade(dd, R.baseline_gender(), st))


def cascade_exact_r(d: DataFrame, known: DataFrame | None = None) -> DataFrame:
    dd, st = _py_cascade(d, py_registry(d, 1, known), "rate", "flip", "known", unknown=True)
    return out(R.run_cascade(dd, R.baseline_gender(), st))


def cascade_faithful(d: DataFrame, known: DataFrame | None = None) -> DataFrame:
    reg = G.outcome_definitive(py_registry(d, 2, known), 2)
    dd, st = _py_cascade(d, reg, "outcome", "replace", "any")
    return out(R.run_cascade(dd, R.baseline_gender(), st))


def cascade_enhanced(d: DataFrame, known: DataFrame | None = None) -> DataFrame:
    reg = G.outcome_majority(py_registry(d, 2, known), 0.75, 0.25, 2)
    dd, st = _py_cascade(d, reg, "outcome", "replace", "known")
    st.append([R.Rule("edge_case", R.edge_case_value().isNotNull(), R.edge_case_value())])
    return out(R.run_cascade(dd, R.baseline_gender(), st))


def cascade_soft_vote(d: DataFrame, prob_cols: list[str], known: DataFrame | None = None) -> DataFrame:
    reg = G.outcome_majority(py_registry(d, 2, known), 0.7, 0.3, 2)
    dd, st = _py_cascade(d, reg, "outcome", "replace", "known")
    mean_p = sum(F.col(c) for c in prob_cols) / len(prob_cols)
    dd = dd.withColumn("p_mean", mean_p)
    outside = ~F.col("InKnownGroup")
    st.append([R.Rule("soft_vote", outside, R.soft_vote_value())])
    return out(R.run_cascade(dd, R.baseline_gender(), st))


def cascade_static(d: DataFrame, known: DataFrame | None = None) -> DataFrame:
    spark = d.sparkSession
    dd, st = _py_cascade(d, py_registry(d, 2, known), "rate", "flip", "known")
    res = R.run_cascade(dd, R.baseline_gender(), st)
    ids = spark.createDataFrame([(i,) for i in STATIC_DEATH_IDS], "id long")
    return out(R.static_ids_rule(res, ids))


def cascade_patterns(d: DataFrame) -> DataFrame:
    """d: r_frame built with ``ungrouped='fallback'``."""
    solo = R.mask_solo_female("decided", decided="GroupDecided")
    stages = [R.group_flip(), men_stage(), women_stage(solo), R.pattern_masks()]
    return out(test_rows(R.run_cascade(d, R.baseline_gender(), stages)))


def cascade_rule_then_model(m: DataFrame, score: str = "p_rest") -> DataFrame:
    """Family unanimity rules decide covered rows (boys of all-live families
    -> 1, females of all-die families -> 0); the rest take score >= 0.5."""
    d = G.with_split(m).withColumn("FamilyID", fx.family_id("Name"))
    fam = G.family_unanimity(d.where(F.col("split") == "train"))
    d = join_back(test_rows(d), fam.select("FamilyID", "all_fb_live", "all_fb_die"), "FamilyID",
                  spread_on=ID)
    live = fx.is_boy("Name") & F.coalesce(F.col("all_fb_live"), F.lit(False))
    die = fx.is_female("Sex") & F.coalesce(F.col("all_fb_die"), F.lit(False))
    stages = [[R.Rule("family_live", live, 1), R.Rule("family_die", die, 0)]]
    return out(R.run_cascade(d, (F.col(score) >= 0.5).cast("int"), stages, base_name="model"))


def solo_female_stages(score: str = "p_women") -> list[list[R.Rule]]:
    mask = (fx.title_woman_map() == "woman") & (F.col("FamilySize") == 1)
    return [[R.Rule("solo_female_model", mask, (F.col(score) > SOLO_FEMALE_THRESHOLD).cast("int"))]]


def cascade_solo_female(m: DataFrame, score: str = "p_women") -> DataFrame:
    d = G.with_split(m).withColumn("FamilySize", fx.family_size())
    return out(test_rows(R.run_cascade(d, F.lit(1), solo_female_stages(score), base_name="default")))


def vote_sum(vote_cols: list[str], threshold: float = 0.5) -> Column:
    return sum((F.col(c) >= threshold).cast("int") for c in vote_cols)


def vote_rules(sum_col: str, base_col: str, hi: float = 2.5, lo: float = 2.5) -> Column:
    """base 0 & sum > hi -> 1; base 1 & sum < lo -> 0; else base."""
    return (F.when((F.col(base_col) == 0) & (F.col(sum_col) > hi), 1)
             .when((F.col(base_col) == 1) & (F.col(sum_col) < lo), 0)
             .otherwise(F.col(base_col)))


def voted(d: DataFrame, vote_cols: list[str]) -> DataFrame:
    """Scoring rows with the gender model, the vote sum and the 3-of-5 vote."""
    return test_rows(d).withColumn("gender", R.baseline_gender()) \
        .withColumn("vote_sum", vote_sum(vote_cols)) \
        .withColumn("vote_pred", vote_rules("vote_sum", "gender"))


def add_mega(d: DataFrame, overrides: DataFrame, name: str = "prediction", decided_by: str = "decided_by") -> DataFrame:
    """Gender baseline; group-decided rows take the group model; the other
    rows take the vote; then the explicit id override. ``d``: ``voted``."""
    grp = R.run_cascade(d, R.baseline_gender(), [R.group_flip()], out="__group_pred", decided_by="__g")
    stages = [[R.Rule("group_model", F.col("GroupDecided"), F.col("__group_pred")),
               R.Rule("vote", ~F.col("GroupDecided") & (F.col("vote_pred") != F.col("gender")),
                      F.col("vote_pred"))]]
    res = R.run_cascade(grp, R.baseline_gender(), stages, out=name, decided_by=decided_by)
    ov = overrides.select(F.col("id").alias(ID), F.col("value").alias("__ov"), F.lit(True).alias("__hit"))
    res = res.join(ov, ID, "left")
    res = R.apply_stage(res, [R.Rule("outcome_override", F.col("__hit"), F.col("__ov"))], name, decided_by)
    return res.drop("__group_pred", "__g", "__ov", "__hit")


def cascade_mega(d: DataFrame, vote_cols: list[str], overrides: DataFrame) -> DataFrame:
    return out(add_mega(voted(d, vote_cols), overrides))


def group_models_vote_stages() -> list[list[R.Rule]]:
    """Group model, men model, solo women outside decided groups, then rows
    outside decided groups where the vote departs from the gender model are
    set to 0."""
    solo = R.mask_solo_female("decided", decided="GroupDecided")
    ens = ~F.col("GroupDecided") & (F.col("vote_pred") != F.col("gender"))
    return [R.group_flip(), men_stage(), women_stage(solo), [R.Rule("vote_dissent", ens, 0)]]


def cascade_group_models_vote(d: DataFrame, vote_cols: list[str]) -> DataFrame:
    return out(R.run_cascade(voted(d, vote_cols), R.baseline_gender(), group_models_vote_stages()))


def prediction_sets(d: DataFrame, vote_cols: list[str], overrides: DataFrame) -> DataFrame:
    """Five cascades as columns of one frame (``d``: r_frame): gender, group,
    mega, group_models_vote and solo_female."""
    v = add_mega(voted(d, vote_cols), overrides, "mega", "__by_mega")
    v = R.run_cascade(v, R.baseline_gender(), [R.group_flip()], out="group", decided_by="__by_group")
    v = R.run_cascade(v, R.baseline_gender(), group_models_vote_stages(), out="group_models_vote", decided_by="__by_models")
    return R.run_cascade(v, F.lit(1), solo_female_stages(), out="solo_female", decided_by="__by_solo")
