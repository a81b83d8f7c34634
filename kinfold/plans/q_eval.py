"""Queries: splits and evaluation (2.9).

Scores are the FIXTURES deterministic scores, so every metric is exact and
oracle-checkable; the same operators evaluate fitted MLlib models in
plans.q_models.
"""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate as EV
from ..operators import groups as G
from ..operators import splits as S
from ..sources.manifest import manifest
from .registry import WCG_CTES, SCORE_MULTIPLIERS, register, with_manifest

ID = "PassengerId"
MODELS = [f"m{m}" for m in SCORE_MULTIPLIERS]


def base(spark, sf_dir, mult: int = 37) -> DataFrame:
    m = manifest(spark, sf_dir).where(F.col("Survived").isNotNull())
    return m.select(ID, F.col("Survived").alias("y"),
                    ((F.col(ID) * mult % 1000).cast("double") / 1000.0).alias("score")) \
        .withColumn("pred", (F.col("score") >= 0.5).cast("int"))


def base_long(spark, sf_dir) -> DataFrame:
    """(id, model, y, score, pred) for the five deterministic scorers, from
    one read of the manifest."""
    m = manifest(spark, sf_dir).where(F.col("Survived").isNotNull())
    scores = F.array(*[F.struct(F.lit(f"m{k}").alias("model"), ((F.col(ID) * k % 1000).cast("double") / 1000.0).alias("score"))
                       for k in SCORE_MULTIPLIERS])
    return m.select(ID, F.col("Survived").alias("y"), F.inline(scores)).withColumn("pred", (F.col("score") >= 0.5).cast("int"))


def r6(c, d=6):
    return F.round(F.col(c) if isinstance(c, str) else c, d)


_B = """
b AS (SELECT PassengerId, Survived AS y, CAST((PassengerId * 37) % 1000 AS DOUBLE) / 1000.0 AS score
      FROM manifest WHERE Survived IS NOT NULL),
bp AS (SELECT *, CAST(score >= 0.5 AS INT) AS pred FROM b)"""
_BL = "bl AS (" + " UNION ALL ".join(
    f"SELECT PassengerId, 'm{m}' AS model, Survived AS y, CAST((PassengerId * {m}) % 1000 AS DOUBLE) / 1000.0 AS score, "
    f"CAST(CAST((PassengerId * {m}) % 1000 AS DOUBLE) / 1000.0 >= 0.5 AS INT) AS pred FROM manifest WHERE Survived IS NOT NULL"
    for m in SCORE_MULTIPLIERS) + ")"
_H = "md5('42' || CAST(PassengerId AS VARCHAR))"


# --- splits ---------------------------------------------------------------
@register("split_holdout_stratified", with_manifest(f"""
r AS (SELECT PassengerId, Survived, row_number() OVER (PARTITION BY Survived ORDER BY {_H}, PassengerId) AS rn,
        count(*) OVER (PARTITION BY Survived) AS n FROM manifest WHERE Survived IS NOT NULL)
SELECT PassengerId, Survived, CASE WHEN rn <= ceil(n * 0.2) THEN 'holdout' ELSE 'train' END AS subset FROM r"""))
def q_split_holdout(spark, sf_dir):
    m = manifest(spark, sf_dir).where(F.col("Survived").isNotNull()).select(ID, "Survived")
    return S.holdout_stratified(m, "Survived", ID, 0.2, 42)


@register("split_kfold_stratified", with_manifest(f"""
SELECT PassengerId, Survived,
       CAST((row_number() OVER (PARTITION BY Survived ORDER BY {_H}, PassengerId) - 1) % 5 AS INT) AS fold
FROM manifest WHERE Survived IS NOT NULL"""))
def q_split_kfold(spark, sf_dir):
    m = manifest(spark, sf_dir).where(F.col("Survived").isNotNull()).select(ID, "Survived")
    return S.kfold_stratified(m, "Survived", ID, 5, 42)


def _trial_rank_sql(src: str, trials: int) -> str:
    return f"""
tr AS (SELECT CAST(i AS INT) AS trial FROM range(0, {trials}) t(i)),
rk AS (SELECT s.*, tr.trial,
         row_number() OVER (PARTITION BY tr.trial ORDER BY md5('42-' || CAST(tr.trial AS VARCHAR) || '-'
           || CAST(s.PassengerId AS VARCHAR)), s.PassengerId) AS rn,
         count(*) OVER (PARTITION BY tr.trial) AS n
       FROM {src} s CROSS JOIN tr)"""


@register("split_kfold_plain", with_manifest(
    "lab AS (SELECT PassengerId FROM manifest WHERE Survived IS NOT NULL)," + _trial_rank_sql("lab", 25) + """
SELECT trial, PassengerId,
       CAST(CASE WHEN floor((rn - 1) / floor(n / 10)) < 10 THEN floor((rn - 1) / floor(n / 10)) END AS INT) AS fold
FROM rk"""))
def q_split_kfold_plain(spark, sf_dir):
    m = manifest(spark, sf_dir).where(F.col("Survived").isNotNull()).select(ID)
    return S.kfold_repeated(m, ID, trials=25, k=10, seed=42).select("trial", ID, "fold")


@register("split_random_subsample", with_manifest(
    "lab AS (SELECT PassengerId FROM manifest WHERE Survived IS NOT NULL)," + _trial_rank_sql("lab", 100) + f"""
SELECT trial, PassengerId, CASE WHEN rn > n - round(n * {91 / 891!r}) THEN 'test' ELSE 'train' END AS subset FROM rk"""))
def q_split_random_subsample(spark, sf_dir):
    m = manifest(spark, sf_dir).where(F.col("Survived").isNotNull()).select(ID)
    return S.random_subsample(m, ID, trials=100, seed=42).select("trial", ID, "subset")


# Group frame over labelled rows only, not-self attach (the CV form).
_CVG = WCG_CTES.replace("CASE WHEN Survived IS NULL THEN 'test' ELSE 'train' END AS split\n      FROM manifest)",
                        "CASE WHEN Survived IS NULL THEN 'test' ELSE 'train' END AS split\n      FROM manifest "
                        "WHERE Survived IS NOT NULL)")
assert _CVG != WCG_CTES


@register("cv_group_model", with_manifest(_CVG + """,
ns AS (SELECT *, (Title <> 'man' AND gid1 IS NULL) AS cand,
         row_number() OVER (PARTITION BY TicketId ORDER BY PassengerId) AS rn0,
         first_value(gid1) OVER w AS g1, nth_value(gid1, 2) OVER w AS g2,
         first_value(Title <> 'man' AND gid1 IS NULL) OVER w AS c1
       FROM s WINDOW w AS (PARTITION BY TicketId ORDER BY PassengerId
                           ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
nv AS (SELECT PassengerId, Survived, Title, Pclass,
         coalesce(CASE WHEN cand THEN (CASE WHEN rn0 = 1 THEN g2 WHEN c1 THEN g2 ELSE g1 END) ELSE gid1 END,
                  '~ungrouped') AS gid FROM ns),""" + _trial_rank_sql("nv", 25) + """,
fo AS (SELECT *, CASE WHEN floor((rn - 1) / floor(n / 10)) < 10 THEN floor((rn - 1) / floor(n / 10)) END AS fold FROM rk),
tot AS (SELECT gid, sum(Survived) AS S, count(*) AS N FROM nv GROUP BY gid),
pf AS (SELECT trial, fold, gid, sum(Survived) AS s, count(*) AS c FROM fo WHERE fold IS NOT NULL GROUP BY 1, 2, 3),
te AS (SELECT fo.*, CASE WHEN tot.N - pf.c > 0 THEN (tot.S - pf.s) / (tot.N - pf.c) END AS r0
       FROM fo JOIN tot ON fo.gid = tot.gid JOIN pf ON fo.trial = pf.trial AND fo.fold = pf.fold AND fo.gid = pf.gid
       WHERE fo.fold IS NOT NULL),
pr AS (SELECT *, coalesce(r0, CASE WHEN Pclass = 3 THEN 0.0 ELSE 1.0 END) AS rate FROM te)
SELECT trial, CAST(sum(abs(CASE WHEN Title = 'boy' AND rate = 1 THEN 1 WHEN Title = 'woman' AND rate = 0 THEN 0
                          WHEN Title = 'woman' THEN 1 ELSE 0 END - Survived)) AS BIGINT) AS errors,
       count(*) AS n_tested,
       round(1 - sum(abs(CASE WHEN Title = 'boy' AND rate = 1 THEN 1 WHEN Title = 'woman' AND rate = 0 THEN 0
                          WHEN Title = 'woman' THEN 1 ELSE 0 END - Survived)) / count(*), 6) AS accuracy
FROM pr GROUP BY trial"""))
def q_cv_group_model(spark, sf_dir):
    lab = manifest(spark, sf_dir).where(F.col("Survived").isNotNull())
    d = G.wcg_frame(lab, scope="combined", attach="not_self", recount=False, keep=[ID, "Survived", "Title", "Pclass", "GroupId"])
    d = S.cv_group_model(d.select(ID, "Survived", "Title", "Pclass", "GroupId"), id_col=ID, trials=25, k=10, seed=42)
    return d.withColumn("accuracy", r6("accuracy"))


# --- evaluation -------------------------------------------------------------
@register("eval_confusion", with_manifest(_B + """
SELECT a.actual, a.predicted, count(bp.y) AS count
FROM (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(actual, predicted)) a
LEFT JOIN bp ON bp.y = a.actual AND bp.pred = a.predicted GROUP BY 1, 2"""))
def q_eval_confusion(spark, sf_dir):
    return EV.confusion_long(base(spark, sf_dir)).select(
        F.col("actual").cast("int"), F.col("predicted").cast("int"), "count")


_PRF = """
c AS (SELECT count(CASE WHEN y = 1 AND pred = 1 THEN 1 END) AS tp, count(CASE WHEN y = 0 AND pred = 0 THEN 1 END) AS tn,
        count(CASE WHEN y = 0 AND pred = 1 THEN 1 END) AS fp, count(CASE WHEN y = 1 AND pred = 0 THEN 1 END) AS fn FROM bp),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
        CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM c)"""


@register("eval_accuracy", with_manifest(_B + "," + _PRF + """
SELECT tp, tn, fp, fn, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy FROM m"""))
def q_eval_accuracy(spark, sf_dir):
    r = EV.prf(EV.confusion_counts(base(spark, sf_dir)))
    return r.select("tp", "tn", "fp", "fn", r6("accuracy").alias("accuracy"))


@register("eval_prf", with_manifest(_B + "," + _PRF + """
SELECT round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM m"""))
def q_eval_prf(spark, sf_dir):
    r = EV.prf(EV.confusion_counts(base(spark, sf_dir)))
    return r.select(r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"))


@register("eval_class_report", with_manifest(_B + "," + _PRF + """,
k AS (SELECT *, CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0 END AS p0, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END AS r0,
        tn + fp AS s0, tp + fn AS s1, tp + tn + fp + fn AS n FROM m),
f AS (SELECT *, CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0 END AS f0,
        CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM k)
SELECT '0' AS label, round(p0, 6) AS precision, round(r0, 6) AS recall, round(f0, 6) AS f1, s0 AS support FROM f
UNION ALL SELECT '1', round(precision, 6), round(recall, 6), round(f1, 6), s1 FROM f
UNION ALL SELECT 'accuracy', round((tp + tn) / n, 6), round((tp + tn) / n, 6), round((tp + tn) / n, 6), n FROM f
UNION ALL SELECT 'macro avg', round((p0 + precision) / 2, 6), round((r0 + recall) / 2, 6), round((f0 + f1) / 2, 6), n FROM f
UNION ALL SELECT 'weighted avg', round((p0 * s0 + precision * s1) / n, 6), round((r0 * s0 + recall * s1) / n, 6),
  round((f0 * s0 + f1 * s1) / n, 6), n FROM f"""))
def q_eval_class_report(spark, sf_dir):
    r = EV.class_report(base(spark, sf_dir))
    return r.select("label", r6("precision").alias("precision"), r6("recall").alias("recall"),
                    r6("f1").alias("f1"), "support")


_AUC = """
sc AS (SELECT score, count(CASE WHEN y = 1 THEN 1 END) AS pos, count(CASE WHEN y = 0 THEN 1 END) AS neg FROM b GROUP BY score),
cu AS (SELECT *, sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM sc)"""


@register("eval_auc", with_manifest(_B + "," + _AUC + """
SELECT round(sum(pos * (coalesce(below, 0) + neg / 2.0)) / (sum(pos) * sum(neg)), 9) AS auc FROM cu"""))
def q_eval_auc(spark, sf_dir):
    return EV.auc(base(spark, sf_dir)).select(r6("auc", 9).alias("auc"))


_ROC = """
th AS (SELECT CAST(i AS INT) AS i, CAST(i AS DOUBLE) / 100.0 AS threshold FROM range(0, 102) t(i)),
ro AS (SELECT th.i, th.threshold, count(CASE WHEN b.y = 1 AND b.score >= th.threshold THEN 1 END) AS TP,
         count(CASE WHEN b.y = 0 AND b.score < th.threshold THEN 1 END) AS TN,
         count(CASE WHEN b.y = 0 AND b.score >= th.threshold THEN 1 END) AS FP,
         count(CASE WHEN b.y = 1 AND b.score < th.threshold THEN 1 END) AS FN
       FROM th CROSS JOIN b GROUP BY th.i, th.threshold)"""


@register("eval_roc_sweep", with_manifest(_B + "," + _ROC + """
SELECT i, round(threshold, 6) AS threshold, TP, TN, FP, FN, round(FP / (FP + TN), 9) AS FPR, round(TP / (TP + FN), 9) AS TPR,
       i IN (50, 75, 90) AS marked FROM ro"""))
def q_eval_roc_sweep(spark, sf_dir):
    r = EV.roc_sweep(base(spark, sf_dir))
    return r.select("i", r6("threshold").alias("threshold"), "TP", "TN", "FP", "FN", r6("FPR", 9).alias("FPR"),
                    r6("TPR", 9).alias("TPR"), F.col("i").isin(50, 75, 90).alias("marked"))


@register("eval_roc_area_step", with_manifest(_B + "," + _ROC + """,
rr AS (SELECT i, FP / (FP + TN) AS FPR, TP / (TP + FN) AS TPR FROM ro),
ld AS (SELECT *, lead(FPR) OVER (ORDER BY i) AS nx FROM rr)
SELECT round(sum(TPR * (FPR - nx)), 9) AS area FROM ld WHERE nx IS NOT NULL"""))
def q_eval_roc_area(spark, sf_dir):
    return EV.roc_area_step(EV.roc_sweep(base(spark, sf_dir))).select(r6("area", 9).alias("area"))


@register("eval_threshold_tune", with_manifest(_B + """,
th AS (SELECT CAST(i AS INT) AS i, CAST(30 + i AS DOUBLE) / 100.0 AS threshold FROM range(0, 41) t(i)),
ac AS (SELECT th.i, th.threshold, avg(CASE WHEN (b.score >= th.threshold) = (b.y = 1) THEN 1.0 ELSE 0.0 END) AS accuracy
       FROM th CROSS JOIN b GROUP BY th.i, th.threshold)
SELECT round(threshold, 6) AS threshold, round(accuracy, 6) AS accuracy FROM ac ORDER BY accuracy DESC, i LIMIT 1"""))
def q_eval_threshold_tune(spark, sf_dir):
    r = EV.threshold_tune(base(spark, sf_dir))
    return r.select(r6("threshold").alias("threshold"), r6("accuracy").alias("accuracy"))


def _folded_long(spark, sf_dir):
    bl = base_long(spark, sf_dir)
    folds = S.kfold_stratified(manifest(spark, sf_dir).where(F.col("Survived").isNotNull()).select(ID, "Survived"),
                               "Survived", ID, 5, 42).select(ID, "fold")
    return bl.join(folds, ID)


_FOLDS = f"""
fo AS (SELECT PassengerId, CAST((row_number() OVER (PARTITION BY Survived ORDER BY {_H}, PassengerId) - 1) % 5 AS INT) AS fold
       FROM manifest WHERE Survived IS NOT NULL),
x AS (SELECT bl.*, fo.fold FROM bl JOIN fo USING (PassengerId)),
sc AS (SELECT model, fold, score, count(CASE WHEN y = 1 THEN 1 END) AS pos, count(CASE WHEN y = 0 THEN 1 END) AS neg
       FROM x GROUP BY 1, 2, 3),
cu AS (SELECT *, sum(neg) OVER (PARTITION BY model, fold ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM sc),
au AS (SELECT model, fold, sum(pos * (coalesce(below, 0) + neg / 2.0)) / (sum(pos) * sum(neg)) AS auc FROM cu GROUP BY 1, 2),
cc AS (SELECT model, fold, count(CASE WHEN y = 1 AND pred = 1 THEN 1 END) AS tp, count(CASE WHEN y = 0 AND pred = 0 THEN 1 END) AS tn,
         count(CASE WHEN y = 0 AND pred = 1 THEN 1 END) AS fp, count(CASE WHEN y = 1 AND pred = 0 THEN 1 END) AS fn FROM x GROUP BY 1, 2),
pm AS (SELECT *, (tp + tn) / (tp + tn + fp + fn) AS accuracy, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
         CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM cc),
fm AS (SELECT pm.*, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1, au.auc
       FROM pm JOIN au USING (model, fold)),
su AS (SELECT model, count(*) AS n_splits,
  avg(accuracy) AS acc_mean, stddev_pop(accuracy) AS acc_std, list(round(accuracy, 6) ORDER BY fold) AS fold_acc,
  avg(auc) AS roc_mean, stddev_pop(auc) AS roc_std, list(round(auc, 6) ORDER BY fold) AS fold_roc,
  avg(precision) AS prec_mean, stddev_pop(precision) AS prec_std, list(round(precision, 6) ORDER BY fold) AS fold_prec,
  avg(recall) AS rec_mean, stddev_pop(recall) AS rec_std, list(round(recall, 6) ORDER BY fold) AS fold_rec,
  avg(f1) AS f1_mean, stddev_pop(f1) AS f1_std, list(round(f1, 6) ORDER BY fold) AS fold_f1 FROM fm GROUP BY model)"""


def _summary(spark, sf_dir):
    fm = EV.fold_metrics(_folded_long(spark, sf_dir), group_cols=["model"])
    return EV.cv_summary(fm, group_cols=["model"])


def _round_summary(s):
    out = [F.col("model"), F.col("n_splits")]
    for short in ("acc", "roc", "prec", "rec", "f1"):
        out += [r6(f"{short}_mean").alias(f"{short}_mean"), r6(f"{short}_std").alias(f"{short}_std"),
                F.transform(f"fold_{short}", lambda v: F.round(v, 6)).alias(f"fold_{short}")]
    return s.select(*out)


@register("eval_cv_summary", with_manifest(_B + "," + _BL + "," + _FOLDS + """
SELECT model, n_splits, round(acc_mean, 6) AS acc_mean, round(acc_std, 6) AS acc_std, fold_acc,
  round(roc_mean, 6) AS roc_mean, round(roc_std, 6) AS roc_std, fold_roc, round(prec_mean, 6) AS prec_mean,
  round(prec_std, 6) AS prec_std, fold_prec, round(rec_mean, 6) AS rec_mean, round(rec_std, 6) AS rec_std, fold_rec,
  round(f1_mean, 6) AS f1_mean, round(f1_std, 6) AS f1_std, fold_f1 FROM su"""))
def q_eval_cv_summary(spark, sf_dir):
    return _round_summary(_summary(spark, sf_dir))


@register("eval_cv_console", with_manifest(_B + "," + _BL + "," + _FOLDS + "\n" + " UNION ALL ".join(
    f"SELECT model, '{s}' AS metric, printf('%.4f ± %.4f', {s}_mean, {s}_std) AS mean_std, "
    f"printf('%.4f ± %.4f', {s}_mean, 2 * {s}_std) AS mean_2std FROM su" for s in ("acc", "roc", "prec", "rec", "f1"))))
def q_eval_cv_console(spark, sf_dir):
    return EV.cv_console(_summary(spark, sf_dir), ["model"])


@register("eval_holdout", with_manifest(_B + f""",
r AS (SELECT b.*, CAST(score >= 0.5 AS INT) AS pred,
        row_number() OVER (PARTITION BY y ORDER BY {_H}, PassengerId) AS rn, count(*) OVER (PARTITION BY y) AS n FROM b),
h AS (SELECT * FROM r WHERE rn <= ceil(n * 0.2)),
sc AS (SELECT score, count(CASE WHEN y = 1 THEN 1 END) AS pos, count(CASE WHEN y = 0 THEN 1 END) AS neg FROM h GROUP BY score),
cu AS (SELECT *, sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM sc),
c AS (SELECT count(CASE WHEN y = 1 AND pred = 1 THEN 1 END) AS tp, count(CASE WHEN y = 0 AND pred = 0 THEN 1 END) AS tn,
        count(CASE WHEN y = 0 AND pred = 1 THEN 1 END) AS fp, count(CASE WHEN y = 1 AND pred = 0 THEN 1 END) AS fn FROM h),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
        CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM c)
SELECT tp, tn, fp, fn, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(precision, 6) AS precision,
  round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1,
  (SELECT round(sum(pos * (coalesce(below, 0) + neg / 2.0)) / (sum(pos) * sum(neg)), 6) FROM cu) AS auc FROM m"""))
def q_eval_holdout(spark, sf_dir):
    b = base(spark, sf_dir)
    h = S.holdout_stratified(b, "y", ID, 0.2, 42).where(F.col("subset") == "holdout")
    m = EV.prf(EV.confusion_counts(h)).crossJoin(EV.auc(h))
    return m.select("tp", "tn", "fp", "fn", *[r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1", "auc")])


@register("target_bucket", with_manifest(_B + "," + _BL + "," + _FOLDS + """
SELECT model, round(acc_mean, 6) AS acc_mean, CASE WHEN acc_mean >= 0.85 THEN 'EXCELLENT' WHEN acc_mean >= 0.84 THEN 'VERY GOOD'
       WHEN acc_mean >= 0.82 THEN 'GOOD' ELSE 'BELOW' END AS bucket FROM su"""))
def q_target_bucket(spark, sf_dir):
    s = _summary(spark, sf_dir)
    return s.select("model", r6("acc_mean").alias("acc_mean"), EV.target_bucket(F.col("acc_mean")).alias("bucket"))
