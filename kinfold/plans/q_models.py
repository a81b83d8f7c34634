"""Queries: preprocessing, MLlib models, scoring and tuning (SURVEY 2.7,
and the model-based rows of 2.4 and 2.9).

Exact preprocessing has SQL oracles; fitted models are checked rows-only
(their scores depend on the training engine).
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import features as fx
from ..operators import boosting as B
from ..operators import encode as E
from ..operators import evaluate as EV
from ..operators import forests as T
from ..operators import groups as G
from ..operators import impute as I
from ..operators import models as M
from ..operators import splits as S
from ..operators.joins import add_key_count
from ..session import materialize
from ..sources import files
from ..sources import model_store as store
from ..sources.manifest import manifest
from .registry import WCG_CTES, register, with_manifest

ID = "PassengerId"
GENERAL = B.Params(rounds=500, rate=0.05, depth=4, rows=0.9, columns=0.9)
SUB = B.Params(rounds=500, rate=0.1, depth=5, rows=1.0, columns=1.0)     # men, solo women
ABLATION_ROUNDS = 50
STOP_ROUNDS, PATIENCE = 2000, 50
IMPORTANCE_FLOOR = 0.01
SWEEP = (50, 100, 200, 300, 500, 800, 1000)
GRID_DEPTHS = (3, 4, 5, 6)
GRID_THRESHOLDS = {"women": (0.08, 0.10, 0.25, 0.50), "men": (0.50, 0.75, 0.90, 0.92)}


def frames(spark, sf_dir):
    """(labelled, scoring) manifest rows with the interaction feature
    (Age median taken over the labelled rows)."""
    m = G.with_split(manifest(spark, sf_dir))
    lab = m.where(F.col("split") == "train")
    m = materialize(M.add_interaction(m, median_of=lab))
    return m.where(F.col("split") == "train"), m.where(F.col("split") == "test")


def designed(spark, sf_dir):
    tr, te = frames(spark, sf_dir)
    trv, tev, names = M.design(tr, te)
    return trv, tev, names


def r9(c):
    return F.round(F.col(c), 9)


# --- exact preprocessing ---------------------------------------------------
_NUM = ["Age", "Fare", "SibSp", "Parch", "Age_Sex_interaction"]
_PREP_SQL = with_manifest("""
lab AS (SELECT * FROM manifest WHERE Survived IS NOT NULL),
am AS (SELECT median(Age) AS age_med FROM lab),
x AS (SELECT m.*, coalesce(m.Age, am.age_med) * CAST(m.Sex = 'male' AS DOUBLE) AS Age_Sex_interaction,
        m.Survived IS NOT NULL AS is_lab FROM manifest m CROSS JOIN am),
med AS (SELECT """ + ", ".join(f"quantile_cont({c}, 0.5) AS {c}_med" for c in _NUM) + """ FROM x WHERE is_lab),
st AS (SELECT """ + ", ".join(f"avg(coalesce(x.{c}, med.{c}_med)) AS {c}_mean, stddev_pop(coalesce(x.{c}, med.{c}_med)) AS {c}_std"
                              for c in _NUM) + """ FROM x CROSS JOIN med WHERE is_lab)
SELECT PassengerId, """ + ", ".join(
    f"round(CASE WHEN {c}_std > 0 THEN (coalesce(x.{c}, med.{c}_med) - {c}_mean) / {c}_std ELSE 0.0 END, 9) AS {c}_z"
    for c in _NUM) + " FROM x CROSS JOIN med CROSS JOIN st")


@register("prep_numeric", _PREP_SQL)
def q_prep_numeric(spark, sf_dir):
    tr, te = frames(spark, sf_dir)
    allr = tr.unionByName(te)
    stats = M.fit_prep_numeric(tr, _NUM)
    d = M.apply_prep_numeric(allr, stats, _NUM)
    return d.select(ID, *[r9(c + "_z").alias(c + "_z") for c in _NUM])


def _mode_sql(c):
    return (f"(SELECT CAST({c} AS VARCHAR) FROM manifest WHERE Survived IS NOT NULL AND {c} IS NOT NULL "
            f"GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)")


_OH = {"Sex": ["female", "male"], "Embarked": ["C", "Q", "S"], "Pclass": ["1", "2", "3"]}


@register("prep_onehot", with_manifest("SELECT PassengerId, " + ", ".join(
    f"CAST(coalesce(CAST({c} AS VARCHAR), {_mode_sql(c)}) = '{lev}' AS DOUBLE) AS \"{c}_{lev}\""
    for c, levs in _OH.items() for lev in levs) + " FROM manifest"))
def q_prep_onehot(spark, sf_dir):
    tr, te = frames(spark, sf_dir)
    d = E.indicators(tr.unionByName(te), E.fit_levels(tr, list(_OH)), _OH, spread_on=ID)
    return d.select(ID, *[f"{c}_{lev}" for c, levs in _OH.items() for lev in levs])


_PREP_Z = [f"round(CASE WHEN {c}_std > 0 THEN (coalesce(x.{c}, med.{c}_med) - {c}_mean) / {c}_std ELSE 0.0 END, 9)"
           for c in _NUM]
_PREP_OH = [f"CAST(coalesce(CAST(x.{c} AS VARCHAR), {_mode_sql(c)}) = '{lev}' AS DOUBLE)"
            for c, levs in _OH.items() for lev in levs]


@register("prep_assemble", _PREP_SQL.replace(
    "SELECT PassengerId, round(CASE WHEN Age_std", "SELECT PassengerId, [" + ", ".join(_PREP_Z + _PREP_OH)
    + "] AS features, round(CASE WHEN Age_std", 1).replace(" FROM x CROSS JOIN med CROSS JOIN st",
                                                           " FROM x CROSS JOIN med CROSS JOIN st", 1))
def q_prep_assemble(spark, sf_dir):
    """The assembled feature vector (scaled numerics, then one-hot levels)."""
    tr, te = frames(spark, sf_dir)
    z = [c + "_z" for c in _NUM]
    d = E.assemble(M.apply_prep_numeric(tr.unionByName(te), M.fit_prep_numeric(tr, _NUM), _NUM), E.fit_levels(tr, list(_OH)), z, spread_on=ID)
    return d.select(ID, F.transform(vector_to_array("features"), lambda v: F.round(v, 9)).alias("features"), *[r9(c).alias(c) for c in z])


# --- models ------------------------------------------------------------------
def _scored(model, te):
    return M.p1(model.transform(te)).select(ID, F.col("p"), F.col("prediction").cast("int").alias("prediction"))


@register("model_logreg")
def q_model_logreg(spark, sf_dir):
    trv, tev, _ = designed(spark, sf_dir)
    return _scored(M.logreg(trv.count()).fit(trv), tev)


def _binned(spark, sf_dir):
    """(train, test, names) with ``features`` and ``bins``."""
    trv, tev, names = designed(spark, sf_dir)
    return *M.binned(trv, tev, size=len(names)), names


def _classed(df):
    return df.select(ID, "p", (F.col("p") >= 0.5).cast("int").alias("prediction"))


@register("model_gbt")
def q_model_gbt(spark, sf_dir):
    tr, te, _ = _binned(spark, sf_dir)
    return _classed(M.boosted_p(M.boosted(tr, GENERAL), te))


@register("model_gbt_early_stop")
def q_model_gbt_early_stop(spark, sf_dir):
    """AUC of 20 % stratified validation rows after each round; the fit ends 50
    rounds after the best one; refit on all rows with the best number."""
    tr, te, _ = _binned(spark, sf_dir)
    v = S.holdout_stratified(tr, "Survived", ID, 0.2, 42).withColumn("fold", (F.col("subset") == "holdout").cast("int"))
    first = B.fit(B.counted(v, fold="fold"), [B.Cell("stop", B.with_rounds(GENERAL, STOP_ROUNDS), without=(1,), valid=1, patience=PATIENCE)])["stop"]
    best = len(first.feature)
    final = M.boosted(tr, B.with_rounds(GENERAL, best))
    return _classed(M.boosted_p(final, te)).withColumn("n_rounds", F.lit(best)).withColumn("best_auc", F.lit(first.auc[-1]))


#: What the sub-models and their cohorts read.
_SUB_COLUMNS = [ID, "Survived", "split", "Pclass", "Sex", "Age", "SibSp", "Parch", "Ticket", "Fare", "Embarked", "Title", "GroupId"]


def _sub_frame(spark, sf_dir):
    """Men / solo-women sub-model features over the group frame; missing
    ages take the labelled median."""
    m = G.with_split(manifest(spark, sf_dir)).drop("Cabin")
    d = G.wcg_frame(m, scope="combined", attach="first_row", recount=False, keep=_SUB_COLUMNS)
    # The medians come from the written frame: their passes don't repeat the join of the counts.
    d = I.impute_median(d.withColumn("__fare", F.col("Fare")), ["Age", "Fare"])
    d = add_key_count(d, ["Ticket"], "TicketFreq", spread_on=ID)
    d = d.withColumn("FamilySize", fx.family_size()).withColumn("FareAdj", F.coalesce(F.col("__fare") / F.col("TicketFreq"), F.col("Fare")))
    return materialize(d.drop("__fare", "Ticket"))


def _xy(d, kind):
    from pyspark.ml.feature import VectorAssembler
    if kind == "men":
        x1, x2 = fx.male_xy()
    else:
        x1, x2 = fx.female_xy()
    d = d.withColumn("x1", x1).withColumn("x2", x2)
    return VectorAssembler(inputCols=["x1", "x2"], outputCol="features").transform(d)


def _cohort(d, kind):
    if kind == "men":
        return d.where(F.col("Title") == "man")
    return d.where((F.col("Title") == "woman") & (F.col("FamilySize") == 1) & F.col("GroupId").isNull())


def _sub_rows(spark, sf_dir, kind, class3=False, frame=None):
    """(labelled, scoring) rows of a cohort with x1 and x2; several cohorts share a ``frame``."""
    d = _xy(_cohort(_sub_frame(spark, sf_dir) if frame is None else frame, kind), kind)
    if class3:
        d = d.where(F.col("Pclass") == 3)
    return d.where(F.col("split") == "train"), d.where(F.col("split") == "test")


def _submodel(spark, sf_dir, kind):
    tr, te = _sub_rows(spark, sf_dir, kind)
    tr, te = M.binned(tr, te, features=[F.col("x1"), F.col("x2")])
    return M.boosted_p(M.boosted(tr, SUB), te).select(ID, "p")


@register("model_gbt_men")
def q_model_gbt_men(spark, sf_dir):
    return _submodel(spark, sf_dir, "men").withColumn("prediction", (F.col("p") >= 0.9).cast("int"))


@register("model_gbt_solo_women")
def q_model_gbt_solo_women(spark, sf_dir):
    return _submodel(spark, sf_dir, "women").withColumn("prediction", (F.col("p") > 0.08).cast("int"))


#: Trees, depth and least rows of a leaf: the general forest, the ensemble's and the library default's.
FORESTS = {"400x6x5": (400, 6, 5), "500x5": (500, 5, 1), "default": (500, 10, 1)}
#: Cohorts of the sub-models on (x1, x2): all solo women, and those of the third class.
COHORTS = {"solo": False, "solo_class3": True}


@register("model_random_forest")
def q_model_random_forest(spark, sf_dir):
    """Every form of the forest, in rows of their own."""
    tr, te, _ = _binned(spark, sf_dir)
    fits = M.forest_fits(tr, {name: T.Forest(*f) for name, f in FORESTS.items()})
    te = te.select(ID, "features", "bins")
    return reduce(DataFrame.unionByName, [
        fit(te).select(ID, "p", (F.col("p") > 0.5).cast("int").alias("prediction"), F.lit(name).alias("form")) for name, fit in fits.items()])


@register("model_svm")
def q_model_svm(spark, sf_dir):
    parts, frame = [], _sub_frame(spark, sf_dir)
    for name, class3 in COHORTS.items():
        tr, te = _sub_rows(spark, sf_dir, "women", class3, frame)
        r = M.svm_rff(tr.drop("features"), te.drop("features"), ["x1", "x2"])
        parts.append(r.select(F.lit(name).alias("cohort"), ID, "p", (F.col("p") >= 0.5).cast("int").alias("prediction")))
    return reduce(DataFrame.unionByName, parts)


@register("model_cart")
def q_model_cart(spark, sf_dir):
    parts, frame = [], _sub_frame(spark, sf_dir)
    for name, class3 in COHORTS.items():
        tr, te = _sub_rows(spark, sf_dir, "women", class3, frame)
        parts.append(_scored(M.fit_packed(M.cart(5), tr), te).withColumn("cohort", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def _member_frame(spark, sf_dir, frame=None):
    """The 15 features of the soft vote's members over the group frame."""
    d = _sub_frame(spark, sf_dir) if frame is None else frame
    ends = d.agg(*[f(c).alias(f"__{c}_{n}") for c in ("Fare", "Age") for n, f in (("lo", F.min), ("hi", F.max))])
    eq = lambda c, v: F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0))
    code = lambda c: fx.equal_width_code(c, F.col(f"__{c}_lo"), F.col(f"__{c}_hi")).cast("double")
    return d.crossJoin(F.broadcast(ends)).withColumns({
        "Sex_male": eq("Sex", "male"), "Embarked_Q": eq("Embarked", "Q"), "Embarked_S": eq("Embarked", "S"),
        "IsAlone": (F.col("FamilySize") == 1).cast("double"), "Title_boy": eq("Title", "boy"), "Title_woman": eq("Title", "woman"),
        "FareBin": code("Fare"), "AgeBin": code("Age")})


@register("model_soft_vote")
def q_model_soft_vote(spark, sf_dir):
    """The three fitted members of the soft vote and their mean, on the scoring rows."""
    return soft_votes(_member_frame(spark, sf_dir))


def soft_votes(d):
    return M.soft_vote(d.where(F.col("split") == "train"), d.where(F.col("split") == "test"))


@register("model_stacking")
def q_model_stacking(spark, sf_dir):
    designs = M.design(*(d.select(ID, "Survived", *M.NUMERIC, *M.CATEGORICAL) for d in frames(spark, sf_dir)))
    # The folds, both kinds of fits and the scores read the bins alone.
    tr, te = (materialize(d.select(ID, "Survived", "bins")) for d in M.binned(*designs[:2], size=len(designs[2])))
    for d in designs[:2]:
        d.unpersist()
    return M.stacking(S.kfold_stratified(tr, "Survived", ID, 5, 42), te)


@register("model_feature_importance")
def q_model_feature_importance(spark, sf_dir):
    """Mean gain of the boosted trees' splits and impurity decrease of the
    forest, as shares; ``kept`` marks those above the floor."""
    tr, _, names = _binned(spark, sf_dir)
    shares = {"boosted": M.boosted(tr, GENERAL).importance(len(names)).tolist(),
              "forest": M.forest_importance(tr, T.Forest(400, 6, 5), len(names))}
    rows = [(model, *r) for model, s in shares.items() for r in M.feature_importance(s, names)]
    return spark.createDataFrame(rows, "model string, feature string, importance double, rank int") \
        .withColumn("kept", F.col("importance") > IMPORTANCE_FLOOR)


@register("score_proba")
def q_score_proba(spark, sf_dir):
    trv, tev, _ = designed(spark, sf_dir)
    return M.p1(M.logreg(trv.count()).fit(trv).transform(tev)).select(ID, "p")


@register("score_class")
def q_score_class(spark, sf_dir):
    trv, tev, _ = designed(spark, sf_dir)
    p = M.p1(M.logreg(trv.count()).fit(trv).transform(tev))
    return p.select(ID, (F.col("p") >= 0.5).cast("int").alias("prediction"))


@register("score_what_if")
def q_score_what_if(spark, sf_dir):
    """Per class a template row (the lowest labelled id of that class) is
    varied over age x sex cases and scored; observed survival of the same
    (class, sex, age band) cohort is shown beside."""
    tr, te = frames(spark, sf_dir)
    tmpl = tr.groupBy("Pclass").agg(F.min_by(F.struct(*[c for c in tr.columns if c != "Pclass"]), F.col(ID)).alias("t")) \
        .select("Pclass", "t.*")
    # Fixed what-if cases (age x sex), exploded onto each template row.
    cases = F.array(*[F.struct(F.lit(a).alias("case_age"), F.lit(sx).alias("case_sex"))
                      for a in (5.0, 10.0, 15.0, 25.0, 40.0, 60.0) for sx in ("male", "female")])
    v = tmpl.withColumn("__case", F.explode(cases)).select("*", "__case.*").drop("__case")
    v = v.withColumn("Age", F.col("case_age")).withColumn("Sex", F.col("case_sex"))
    v = v.drop("Age_Sex_interaction").withColumn("Age_Sex_interaction", F.col("Age") * (F.col("Sex") == "male").cast("double"))
    trv, vv, names = M.design(tr, v)
    trv, vv = M.binned(trv, vv, size=len(names))
    scored = M.boosted_p(M.boosted(trv, GENERAL), vv).select("Pclass", "case_age", "case_sex", "p")
    band = fx.bin_right_closed("Age", [0, 16, 30, 50, 100], ["Child", "Young", "Middle", "Old"])
    obs = tr.withColumn("band", band).groupBy("Pclass", F.col("Sex").alias("case_sex"), "band") \
        .agg(F.avg(F.col("Survived").cast("double")).alias("observed_rate"), F.count(F.lit(1)).alias("observed_n"))
    scored = scored.withColumn("band", fx.bin_right_closed("case_age", [0, 16, 30, 50, 100],
                                                           ["Child", "Young", "Middle", "Old"]))
    return scored.join(obs, ["Pclass", "case_sex", "band"], "left")


GRID = 100
SURFACE_CUTS = {"forest": 0.25}      # the others: one half


def _surface(tr):
    """GRID x GRID places over the ranges of x1 and x2, by two explodes of fixed sequences."""
    b = tr.agg(F.min("x1").alias("a1"), F.max("x1").alias("b1"), F.min("x2").alias("a2"), F.max("x2").alias("b2"))
    g = b.select("*", F.explode(F.sequence(F.lit(0), F.lit(GRID - 1))).alias("i")) \
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(GRID - 1))).alias("j"))
    return g.select("i", "j", (F.col("a1") + (F.col("b1") - F.col("a1")) * F.col("i") / (GRID - 1)).alias("x1"),
                    (F.col("a2") + (F.col("b2") - F.col("a2")) * F.col("j") / (GRID - 1)).alias("x2"))


def _knn_surface(g, tr):
    from ..operators import knn
    g = g.withColumn("place", F.col("i") * GRID + F.col("j"))
    near = knn.knn_fraction(g.withColumn("v", F.array("x1", "x2")), tr.withColumn("v", F.array("x1", "x2")), "place", ID, "v", "Survived", k=3) \
        .withColumnsRenamed({"place": "__place", "knn_fraction": "p"})
    return g.join(near, F.col("place") == F.col("__place")).select("i", "j", "x1", "x2", "p")


@register("score_grid")
def q_score_grid(spark, sf_dir):
    """Five decision surfaces over (x1, x2) of solo women of the third class: a
    tree, k nearest neighbours, a calibrated RBF machine, a forest (class 1
    above 0.25) and boosted trees."""
    from pyspark.ml.feature import VectorAssembler
    tr, _ = _sub_rows(spark, sf_dir, "women", class3=True)
    tr = materialize(tr.select(ID, "x1", "x2", "Survived"))
    asm = VectorAssembler(inputCols=["x1", "x2"], outputCol="features")
    g, trv = materialize(_surface(tr)), asm.transform(tr)
    gv, place = asm.transform(g), ["i", "j", "x1", "x2"]
    binned, bg = M.binned(tr, g, features=[F.col("x1"), F.col("x2")])
    surfaces = {
        "cart": M.p1(M.fit_packed(M.cart(5), trv).transform(gv)).select(*place, "p"),
        "knn": _knn_surface(g, tr),
        "svm": M.svm_rff(tr, g, ["x1", "x2"]).select(*place, "p"),
        "forest": M.p1(M.fit_packed(M.random_forest(500, 10, 1), trv).transform(gv)).select(*place, "p"),
        "boosted": M.boosted_p(M.boosted(binned, SUB), bg).select(*place, "p")}
    parts = [d.select(F.lit(name).alias("model"), *place, "p", (F.col("p") > SURFACE_CUTS.get(name, 0.5)).cast("int").alias("prediction"))
             for name, d in surfaces.items()]
    return reduce(DataFrame.unionByName, parts)


@register("score_grid_knn", with_manifest(WCG_CTES + """,
med AS (SELECT median(Age) AS age, median(Fare) AS fare FROM g),
sub AS (SELECT g.PassengerId, g.Survived, coalesce(g.Fare / count(*) OVER (PARTITION BY g.Ticket), med.fare) / 10 AS x1, coalesce(g.Age, med.age) / 15 AS x2,
          g.Title = 'woman' AND g.SibSp + g.Parch + 1 = 1 AND g.GroupId IS NULL AND g.Pclass = 3 AND g.split = 'train' AS used FROM g CROSS JOIN med),
ref AS (SELECT * FROM sub WHERE used),
b AS (SELECT min(x1) AS a1, max(x1) AS b1, min(x2) AS a2, max(x2) AS b2 FROM ref),
place AS (SELECT i, j, a1 + (b1 - a1) * i / 99 AS x1, a2 + (b2 - a2) * j / 99 AS x2 FROM b CROSS JOIN range(0, 100) r(i) CROSS JOIN range(0, 100) s(j)),
near AS (SELECT p.i, p.j, p.x1, p.x2, ref.Survived,
           row_number() OVER (PARTITION BY p.i, p.j ORDER BY (p.x1 - ref.x1) * (p.x1 - ref.x1) + (p.x2 - ref.x2) * (p.x2 - ref.x2), ref.PassengerId) AS rn
         FROM place p CROSS JOIN ref)
SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(any_value(x1), 9) AS x1, round(any_value(x2), 9) AS x2, round(avg(Survived), 6) AS p
FROM near WHERE rn <= 3 GROUP BY i, j"""))
def q_score_grid_knn(spark, sf_dir):
    """The k-NN surface alone."""
    tr, _ = _sub_rows(spark, sf_dir, "women", class3=True)
    tr = materialize(tr.select(ID, "x1", "x2", "Survived"))
    r = _knn_surface(materialize(_surface(tr)), tr)
    return r.select("i", "j", r9("x1").alias("x1"), r9("x2").alias("x2"), F.round("p", 6).alias("p"))


@register("refit_and_predict")
def q_refit_and_predict(spark, sf_dir):
    """Fit on every labelled row, score the scoring rows, write the
    prediction CSV (shared folder) and return what was written."""
    tr, te, _ = _binned(spark, sf_dir)
    pred = _classed(M.boosted_p(M.boosted(tr, GENERAL), te))
    path = files.sink_predictions(pred, ID, "prediction", tag="refit_gbt")
    return files.read_predictions(spark, path)


def _stored_logreg(train):
    """Fit preprocessing and logistic regression on ``train``; what the store keeps."""
    prep = M.fit_prep(train)
    d = M.cached(M.apply_prep(train, prep))
    model = M.fitted_pipeline(d, M.logreg(d.count()))
    d.unpersist()
    return model, prep


@register("sink_model")
def q_sink_model(spark, sf_dir):
    """Save the fitted model with its preprocessing under a tag, load the newest of that tag and score."""
    tr, te = frames(spark, sf_dir)
    store.save(spark, "logreg", *_stored_logreg(tr))
    return _prefit_scores(spark, te)


def _prefit_scores(spark, df, tag="logreg"):
    """p by the newest stored model of a tag; nothing is fitted."""
    model, prep = store.newest(spark, tag, df.columns)
    return M.p1(model.transform(M.apply_prep(df, prep))).select(ID, *[c for c in ("Survived",) if c in df.columns], "p")


@register("src_model")
def q_src_model(spark, sf_dir):
    """Score with the newest stored model. Only where the store has none yet, one is put there first."""
    tr, te = frames(spark, sf_dir)
    if not store.versions(spark, "logreg"):
        store.save(spark, "logreg", *_stored_logreg(tr))
    return _prefit_scores(spark, te).select(ID, (F.col("p") >= 0.5).cast("int").alias("prediction"))


@register("eval_holdout_model")
def q_eval_holdout_model(spark, sf_dir):
    """Metrics on 20 % of the labelled rows of a model fitted on the others, and
    of one that was stored before (fitted on the same others, under a tag)."""
    tr, _ = frames(spark, sf_dir)
    sp = materialize(S.holdout_stratified(tr, "Survived", ID, 0.2, 42))
    fit, held = sp.where(F.col("subset") == "train"), sp.where(F.col("subset") == "holdout")
    model, prep = _stored_logreg(fit)
    store.save(spark, "holdout", model, prep)
    scores = {"fitted": M.p1(model.transform(M.apply_prep(held, prep))).select(ID, "Survived", "p"),
              "prefit": _prefit_scores(spark, held, "holdout")}
    rows = materialize(reduce(DataFrame.unionByName, [
        d.select(F.lit(form).alias("form"), F.col("Survived").alias("y"), F.col("p").alias("score"), (F.col("p") >= 0.5).cast("int").alias("pred"))
        for form, d in scores.items()]))
    return EV.prf(EV.confusion_counts(rows, group_cols=["form"]), ["form"]).join(EV.auc(rows, group_cols=["form"]), "form")


# --- model-based imputation --------------------------------------------------
_AGE_SPEC = ("Age", ["Pclass", "SibSp", "Parch"], ["Title"])
_FARE_SPEC = ("Fare", ["Pclass", "Age"], ["Title", "Embarked", "Sex"])


def _titled(spark, sf_dir):
    m = G.with_split(manifest(spark, sf_dir))
    return m.withColumn("Title", fx.person_type(precedence="female"))


@register("impute_tree_fit_apply")
def q_impute_tree_fit_apply(spark, sf_dir):
    d = I.impute_tree_fit_apply(_titled(spark, sf_dir), [_AGE_SPEC, _FARE_SPEC], max_depth=10)
    return d.select(ID, "Age", "Fare")


@register("impute_tree_persisted")
def q_impute_tree_persisted(spark, sf_dir):
    d = _titled(spark, sf_dir)
    tr, te = d.where(F.col("split") == "train"), d.where(F.col("split") == "test")
    # Fare first (its features are complete), then Age using the filled Fare.
    spec = [("Fare", ["Pclass"], ["Title", "Embarked", "Sex"]),
            ("Age", ["Pclass", "SibSp", "Parch", "Fare"], ["Title", "Embarked", "Sex"])]
    models = I.fit_persisted_imputers(tr, spec)
    return I.apply_persisted_imputers(te, models, spec).select(ID, "Age", "Fare")


# --- OOF, tuning, ablation ---------------------------------------------------
@register("eval_oof_scores")
def q_eval_oof_scores(spark, sf_dir):
    """Each labelled row scored by the logistic model of the folds that did
    not see it; per-row OOF probability and the fold's accuracy."""
    tr, _ = frames(spark, sf_dir)
    tr = materialize(S.kfold_stratified(tr, "Survived", ID, 5, 42))   # five designs read it, many times each
    designs = [M.design(tr.where(F.col("fold") != f), tr.where(F.col("fold") == f)) for f in range(5)]
    models = M.fit_all([lambda av=av: M.logreg(av.count()).fit(av) for av, _, _ in designs])
    parts = [M.p1(m.transform(bv)).select(ID, "fold", "Survived", "p") for m, (_, bv, _) in zip(models, designs)]
    oof = reduce(DataFrame.unionByName, parts)
    acc = oof.groupBy("fold").agg(F.avg(((F.col("p") >= 0.5).cast("int") == F.col("Survived")).cast("double"))
                                  .alias("fold_accuracy"))
    return oof.join(F.broadcast(acc), "fold")


@register("tune_rounds")
def q_tune_rounds(spark, sf_dir):
    """AUC, accuracy and F1 on the holdout after each candidate number of
    rounds, from one fit with the largest: each row is scored once and carries
    the running sums at the candidates. The first strict best AUC wins."""
    tr, _, _ = _binned(spark, sf_dir)
    sp = S.holdout_stratified(tr, "Survived", ID, 0.2, 42).withColumn("fold", (F.col("subset") == "holdout").cast("int"))
    trees = B.fit(B.counted(sp, fold="fold"), [B.Cell("sweep", B.with_rounds(GENERAL, max(SWEEP)), without=(1,))])
    ho = B.score(sp.where("fold = 1").select(ID, F.col("Survived").alias("y"), "bins"), trees, rounds=list(SWEEP))
    each = ho.select(ID, "y", F.posexplode("ps").alias("i", "score")) \
        .withColumn("rounds", F.element_at(F.array(*[F.lit(r) for r in SWEEP]), F.col("i") + 1)) \
        .withColumn("pred", (F.col("score") >= 0.5).cast("int"))
    each = materialize(each)
    a = EV.auc(each, "y", "score", ["rounds"]).join(
        EV.prf(EV.confusion_counts(each, "y", "pred", ["rounds"]), ["rounds"]).select("rounds", "accuracy", "f1"), "rounds")
    best = a.agg(F.max_by("rounds", F.struct(F.col("auc"), -F.col("rounds"))).alias("best_rounds"))
    return a.crossJoin(F.broadcast(best)).withColumn("chosen", F.col("rounds") == F.col("best_rounds")).drop("best_rounds")


@register("tune_grid")
def q_tune_grid(spark, sf_dir):
    """Tree depth x threshold grid of each sub-model, mean CV accuracy. The fits
    of all cohorts, depths and folds are cells of one binned table; each cell
    scores the distinct binned rows of its fold, which stand for all rows, and
    one aggregation has all thresholds. Thresholds of the other cohort are null."""
    frame = _sub_frame(spark, sf_dir)
    parts = []
    for c in GRID_THRESHOLDS:
        rows = S.kfold_stratified(_xy(_cohort(frame, c), c).where(F.col("split") == "train"), "Survived", ID, 5, 42)
        [d] = M.binned(rows, features=[F.col("x1"), F.col("x2")])
        parts.append(d.select(F.lit(c).alias("cohort"), "fold", "Survived", "bins"))
    table = materialize(B.counted(reduce(DataFrame.unionByName, parts), group="cohort", fold="fold"))
    key = lambda c, depth, f: f"{c}-{depth}-{f}"
    trees = B.fit(table, [B.Cell(key(c, depth, f), replace(SUB, depth=depth), group=c, without=(f,))
                          for c in GRID_THRESHOLDS for depth in GRID_DEPTHS for f in range(5)])
    rows = table.withColumn("depth", F.explode(F.array(*[F.lit(x) for x in GRID_DEPTHS]))) \
        .withColumn("key", F.concat_ws("-", "group", F.col("depth").cast("string"), F.col("fold").cast("string")))
    scored = B.score(rows, trees, by="key").withColumnRenamed("group", "cohort")
    lists = {c: F.array(*[F.lit(t) for t in ts]) for c, ts in GRID_THRESHOLDS.items()}
    j = scored.withColumn("threshold", F.explode(F.when(F.col("cohort") == "men", lists["men"]).otherwise(lists["women"])))
    # As in the sub-models: men survive at the threshold, women above it.
    hit = (F.col("p") > F.col("threshold")) | ((F.col("cohort") == "men") & (F.col("p") == F.col("threshold")))
    acc = j.groupBy("cohort", "depth", "threshold", "fold").agg(
        (F.sum(F.when(hit, F.col("n1")).otherwise(F.col("n0"))) / F.sum(F.col("n0") + F.col("n1"))).alias("acc"))
    return acc.groupBy("cohort", "depth").pivot("threshold", sorted({t for ts in GRID_THRESHOLDS.values() for t in ts})).agg(F.avg("acc"))


@register("ablate_features")
def q_ablate_features(spark, sf_dir):
    """5-fold CV of boosted trees (50 rounds) with and without the
    interaction feature; deltas and a verdict."""
    tr, _ = frames(spark, sf_dir)
    tr = materialize(S.kfold_stratified(tr.select(ID, "Survived", *M.NUMERIC, *M.CATEGORICAL), "Survived", ID, 5, 42))
    # Without the feature a fold's design is that with it but for one entry, so both arms have one preprocessing and one binned table.
    rows, names = M.fold_binned(tr, M.fit_fold_preps(tr, 5))
    arms = {"with": None, "without": "Age_Sex_interaction_z"}

    def bins(f, left_out):
        own = F.col(f"bins{f}")
        return own if left_out is None else F.filter(own, lambda _, i: i != names[f].index(left_out))
    cells = [(arm, f) for arm in arms for f in range(5)]
    train = lambda arm, f: rows.where(F.col("fold") != f).select("Survived", bins(f, arms[arm]).alias("bins"))
    fits = M.fit_all([lambda c=c: M.boosted(train(*c), B.with_rounds(GENERAL, ABLATION_ROUNDS)) for c in cells], workers=5)
    trees = {f"{arm}-{f}": t for (arm, f), t in zip(cells, fits, strict=True)}
    held = []
    for arm, left_out in arms.items():
        unseen = F.coalesce(*[F.when(F.col("fold") == f, bins(f, left_out)) for f in range(5)])   # by the design that did not see the row
        held.append(rows.select(F.lit(arm).alias("arm"), "fold", F.col("Survived").alias("y"), F.concat_ws("-", F.lit(arm), F.col("fold").cast("string")).alias("key"), unseen.alias("bins")))
    scored = B.score(reduce(DataFrame.unionByName, held), trees, by="key")
    oof = materialize(scored.select("arm", "fold", "y", F.col("p").alias("score"), (F.col("p") >= 0.5).cast("int").alias("pred")))
    metrics = materialize(EV.fold_metrics(oof, group_cols=["arm"]))
    out = [EV.cv_summary(metrics.where(F.col("arm") == arm)) for arm in arms]
    w = out[0].alias("a").crossJoin(out[1].alias("b"))
    d_acc = F.col("a.acc_mean") - F.col("b.acc_mean")
    verdict = (F.when(d_acc > 0.01, "significant").when(d_acc > 0.005, "modest").when(d_acc > 0, "minimal")
                .otherwise("none"))
    return w.select((F.col("a.roc_mean") - F.col("b.roc_mean")).alias("auc_delta"), d_acc.alias("accuracy_delta"),
                    (F.col("a.f1_mean") - F.col("b.f1_mean")).alias("f1_delta"), verdict.alias("verdict"))


# --- k nearest neighbours ------------------------------------------------------
@register("model_knn", """
WITH r AS (SELECT vec_id, embedding, label,
             row_number() OVER (PARTITION BY label ORDER BY md5('42' || CAST(vec_id AS VARCHAR)), vec_id) AS rn,
             count(*) OVER (PARTITION BY label) AS n FROM embeddings),
q AS (SELECT vec_id, embedding FROM r WHERE rn <= ceil(n * 0.2)),
ref AS (SELECT vec_id, embedding, label FROM r WHERE rn > ceil(n * 0.2)),
d AS (SELECT q.vec_id AS qid, ref.vec_id AS rid, ref.label,
        list_sum(list_transform(range(1, len(q.embedding) + 1),
          lambda i: (CAST(q.embedding[i] AS DOUBLE) - CAST(ref.embedding[i] AS DOUBLE)) ** 2)) AS d2
      FROM q CROSS JOIN ref),
t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, rid) AS k FROM d)
SELECT qid AS vec_id, round(avg(label), 6) AS knn_fraction, count(*) AS k FROM t WHERE k <= 3 GROUP BY qid""")
def q_model_knn(spark, sf_dir):
    """k = 3 neighbours of the 20 % hash-held-out embeddings among the rest."""
    from ..operators import knn
    from ..sources.manifest import read_table
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    sp = materialize(S.holdout_stratified(e, "label", "vec_id", 0.2, 42))
    q, r = sp.where(F.col("subset") == "holdout"), sp.where(F.col("subset") == "train")
    out = knn.knn_fraction(q, r, "vec_id", "vec_id", "embedding", "label", k=3)
    return out.select("vec_id", F.round("knn_fraction", 6).alias("knn_fraction"), "k")
