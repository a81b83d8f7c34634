"""Queries: sources, sinks and contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as EV
from ..operators import profile as P
from ..sources import files
from ..sources.manifest import MANIFEST_COLUMNS, manifest, manifest_test, manifest_train
from ..sources.manifest import manifest_sql_for_duckdb
from ..session import materialize
from . import cascades as C
from . import q_eval as Q
from .registry import R_FRAME_CTES, register, with_manifest

ID = "PassengerId"
_ALL = "SELECT PassengerId, Survived, Pclass, Name, Sex, Age, SibSp, Parch, Ticket, Fare, Cabin, Embarked FROM manifest"


@register("src_csv", with_manifest(_ALL))
def q_src_csv(spark, sf_dir):
    """Round trip through a headered CSV (names hold quoted commas, missing
    values are empty fields) read back with the declared schema."""
    path = files.shared_path(spark, "csv")
    files.sink_csv(manifest(spark, sf_dir).select(*MANIFEST_COLUMNS), path)
    return files.src_csv(spark, path, files.TRAIN_SCHEMA)


@register("src_union_provenance", with_manifest(
    "SELECT *, CASE WHEN Survived IS NULL THEN 'test' ELSE 'train' END AS split FROM (" + _ALL + ")"))
def q_src_union_provenance(spark, sf_dir):
    return files.union_provenance(manifest_train(spark, sf_dir), manifest_test(spark, sf_dir))


_TEST_COLS = [c for c in MANIFEST_COLUMNS if c != "Survived"]
_EXPECTED = ", ".join(f"('{c}', {i + 1})" for i, c in enumerate(MANIFEST_COLUMNS))


def _describe(cols, where):
    return (f"(DESCRIBE SELECT {', '.join(cols)} FROM ({manifest_sql_for_duckdb()}) m WHERE {where})")


@register("chk_schema", with_manifest(f"""
e AS (SELECT * FROM (VALUES {_EXPECTED}) v("column", expected_pos)),
a AS (SELECT column_name AS "column", CAST(row_number() OVER () AS INT) AS actual_pos
      FROM {_describe(_TEST_COLS, 'Survived IS NULL')}),
t AS (SELECT * FROM manifest WHERE Survived IS NULL),
nn AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS non_null FROM t" for c in _TEST_COLS) + f""")
SELECT coalesce(e."column", a."column") AS "column", CAST(e.expected_pos AS INT) AS expected_pos, a.actual_pos,
  CASE WHEN a.actual_pos IS NULL THEN 'missing' WHEN e.expected_pos IS NULL THEN 'extra'
       WHEN e.expected_pos = a.actual_pos THEN 'ok' ELSE 'moved' END AS status, nn.non_null
FROM e FULL OUTER JOIN a ON e."column" = a."column" LEFT JOIN nn ON nn."column" = coalesce(e."column", a."column")
"""))
def q_chk_schema(spark, sf_dir):
    """Scoring table against the training contract: 'Survived' missing,
    later columns moved."""
    return files.check_schema(manifest_test(spark, sf_dir), MANIFEST_COLUMNS)


@register("chk_leakage", with_manifest(f"""
t AS (SELECT * FROM manifest WHERE Survived IS NULL), l AS (SELECT * FROM manifest WHERE Survived IS NOT NULL)
SELECT 'Survived' AS "column", EXISTS (SELECT 1 FROM {_describe(_TEST_COLS, 'Survived IS NULL')}
         WHERE column_name = 'Survived') AS present,
       CASE WHEN EXISTS (SELECT 1 FROM {_describe(_TEST_COLS, 'Survived IS NULL')} WHERE column_name = 'Survived')
            THEN 'leak' ELSE 'ok' END AS status, (SELECT count(*) FROM t) AS n_rows, CAST(NULL AS BIGINT) AS n_labels
UNION ALL
SELECT 'Survived', EXISTS (SELECT 1 FROM {_describe(MANIFEST_COLUMNS, 'Survived IS NOT NULL')} WHERE column_name = 'Survived'),
       CASE WHEN EXISTS (SELECT 1 FROM {_describe(MANIFEST_COLUMNS, 'Survived IS NOT NULL')} WHERE column_name = 'Survived')
            THEN 'leak' ELSE 'ok' END, (SELECT count(*) FROM l), (SELECT count(Survived) FROM l)"""))
def q_chk_leakage(spark, sf_dir):
    return files.check_leakage(manifest_test(spark, sf_dir)).unionByName(
        files.check_leakage(manifest_train(spark, sf_dir)))


@register("chk_shape", with_manifest("""
SELECT 'train' AS split, count(*) AS n_rows, 12 AS n_cols FROM manifest WHERE Survived IS NOT NULL
UNION ALL SELECT 'test', count(*), 11 FROM manifest WHERE Survived IS NULL"""))
def q_chk_shape(spark, sf_dir):
    tr = files.check_shape(manifest_train(spark, sf_dir)).withColumn("split", F.lit("train"))
    te = files.check_shape(manifest_test(spark, sf_dir)).withColumn("split", F.lit("test"))
    return tr.unionByName(te).select("split", "n_rows", F.col("n_cols").cast("int"))


_GP = ("CASE WHEN Title = 'boy' AND GroupSurvival = 1 THEN 1 WHEN Title = 'woman' AND GroupSurvival = 0 THEN 0 "
       "WHEN Sex = 'female' THEN 1 ELSE 0 END")


@register("sink_predictions", with_manifest(R_FRAME_CTES + f"""
SELECT PassengerId, CAST({_GP} AS INT) AS Survived FROM rf WHERE split = 'test'"""))
def q_sink_predictions(spark, sf_dir):
    from .q_cascades import scored
    pred = C.cascade_group(C.r_frame(scored(spark, sf_dir)))
    path = files.sink_predictions(pred, ID, "prediction", tag="wcg")
    return files.read_predictions(spark, path)


@register("sink_table_csv", with_manifest(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_missing FROM manifest" for c in MANIFEST_COLUMNS)))
def q_sink_table_csv(spark, sf_dir):
    t = P.missing_by_column(manifest(spark, sf_dir))
    path = files.shared_path(spark, "eda")
    files.sink_table(t, path, "csv")
    return files.src_csv(spark, path, "column string, n_missing long")


# --- metrics store -----------------------------------------------------------
_SEED = 42
_STORE_SQL = Q._B + "," + Q._BL + "," + Q._FOLDS + """,
wh AS (SELECT score, count(CASE WHEN y = 1 THEN 1 END) AS pos, count(CASE WHEN y = 0 THEN 1 END) AS neg FROM bp GROUP BY score),
wb AS (SELECT *, sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM wh),
wa AS (SELECT sum(pos * (coalesce(below, 0) + neg / 2.0)) / (sum(pos) * sum(neg)) AS auc FROM wb),
wc AS (SELECT avg(CASE WHEN y = pred THEN 1.0 ELSE 0.0 END) AS accuracy,
         2.0 * count(CASE WHEN y = 1 AND pred = 1 THEN 1 END) / (count(CASE WHEN y = 1 THEN 1 END) + count(CASE WHEN pred = 1 THEN 1 END)) AS f1 FROM bp),
th AS (SELECT CAST(i AS INT) AS i, CAST(30 + i AS DOUBLE) / 100.0 AS threshold FROM range(0, 41) t(i)),
ta AS (SELECT th.i, th.threshold, avg(CASE WHEN (b.score >= th.threshold) = (b.y = 1) THEN 1.0 ELSE 0.0 END) AS accuracy
       FROM th CROSS JOIN b GROUP BY th.i, th.threshold),
best AS (SELECT threshold, accuracy FROM ta ORDER BY accuracy DESC, i LIMIT 1),
fc AS (SELECT a.acc_mean - c.acc_mean AS accuracy_delta, a.roc_mean - c.roc_mean AS auc_delta FROM su a, su c WHERE a.model = 'm37' AND c.model = 'm101'),
store AS (
  SELECT 'cv' AS mode, 'five scorers' AS tag, '{"folds": 5}' AS params, model, acc_mean, roc_mean, CAST(NULL AS DOUBLE) AS accuracy, CAST(NULL AS DOUBLE) AS auc,
         CAST(NULL AS DOUBLE) AS f1, CAST(NULL AS DOUBLE) AS threshold, CAST(NULL AS DOUBLE) AS accuracy_delta, CAST(NULL AS DOUBLE) AS auc_delta FROM su
  UNION ALL SELECT 'holdout', 'one scorer', '{"threshold": 0.5}', 'm37', NULL, NULL, wc.accuracy, wa.auc, wc.f1, NULL, NULL, NULL FROM wc, wa
  UNION ALL SELECT 'optimal_search', 'one scorer', '{"from": 0.3, "to": 0.7}', 'm37', NULL, NULL, accuracy, NULL, NULL, threshold, NULL, NULL FROM best
  UNION ALL SELECT 'feature_comparison', 'two scorers', '{"with": "m37", "without": "m101"}', NULL, NULL, NULL, NULL, NULL, NULL, NULL, accuracy_delta, auc_delta FROM fc)
"""
_VALUES = ["acc_mean", "roc_mean", "accuracy", "auc", "f1", "threshold", "accuracy_delta", "auc_delta"]


def _write_runs(spark, sf_dir, modes):
    """Write run records of the wanted modes into a new metrics folder."""
    path = files.shared_path(spark, "metrics")
    b = Q.base(spark, sf_dir)
    cv = None
    if {"cv", "feature_comparison"} & set(modes):
        cv = materialize(Q._summary(spark, sf_dir).select("model", "n_splits", "acc_mean", "acc_std", "roc_mean", "roc_std", "fold_acc"))
    if "cv" in modes:
        files.sink_run_metrics(cv, path, "cv", "five scorers", _SEED, {"folds": 5})
    if "holdout" in modes:
        ho = EV.prf(EV.confusion_counts(b)).crossJoin(EV.auc(b)).select(F.lit("m37").alias("model"), "accuracy", "auc", "f1")
        files.sink_run_metrics(ho, path, "holdout", "one scorer", _SEED, {"threshold": 0.5})
    if "optimal_search" in modes:
        best = EV.threshold_tune(b).select(F.lit("m37").alias("model"), "threshold", "accuracy")
        files.sink_run_metrics(best, path, "optimal_search", "one scorer", _SEED, {"from": 0.3, "to": 0.7})
    if "feature_comparison" in modes:
        one = lambda m, c: F.max(F.when(F.col("model") == m, F.col(c)))
        delta = cv.agg((one("m37", "acc_mean") - one("m101", "acc_mean")).alias("accuracy_delta"),
                       (one("m37", "roc_mean") - one("m101", "roc_mean")).alias("auc_delta"))
        files.sink_run_metrics(delta, path, "feature_comparison", "two scorers", _SEED, {"with": "m37", "without": "m101"})
    return path


@register("sink_run_metrics", with_manifest(_STORE_SQL + """
SELECT mode, tag, 42 AS seed, params, model, round(acc_mean, 6) AS acc_mean, round(accuracy, 6) AS accuracy, round(auc, 6) AS auc,
  round(f1, 6) AS f1, true AS dated FROM store WHERE mode IN ('cv', 'holdout')"""))
def q_sink_run_metrics(spark, sf_dir):
    """A CV summary and a holdout record with tag, epoch, seed and
    parameters, appended to one metrics folder and read back as one table."""
    got = files.src_metrics_json(spark, _write_runs(spark, sf_dir, ["cv", "holdout"]))
    return got.select("mode", "tag", "seed", "params", "model", *[F.round(c, 6).alias(c) for c in ("acc_mean", "accuracy", "auc", "f1")],
                      (F.col("epoch") > 0).alias("dated"))


@register("src_metrics_json", with_manifest(_STORE_SQL + "SELECT mode, tag, 42 AS seed, model, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in _VALUES) + ", true AS has_file FROM store"))
def q_src_metrics_json(spark, sf_dir):
    """Records of all four shapes from their files as one wide table."""
    got = files.src_metrics_json(spark, _write_runs(spark, sf_dir, ["cv", "holdout", "optimal_search", "feature_comparison"]))
    return got.select("mode", "tag", "seed", "model", *[F.round(c, 6).alias(c) for c in _VALUES],
                      F.col("file_name").endswith(".json").alias("has_file"))


@register("leaderboard", with_manifest(Q._B + "," + Q._BL + "," + Q._FOLDS + """
SELECT model, round(roc_mean, 6) AS roc_mean, round(acc_mean, 6) AS acc_mean, CAST(rank() OVER (ORDER BY roc_mean DESC) AS INTEGER) AS rank FROM su"""))
def q_leaderboard(spark, sf_dir):
    """The CV runs stored in the metrics files, ranked."""
    runs = files.src_metrics_json(spark, _write_runs(spark, sf_dir, ["cv", "holdout"])).where(F.col("mode") == "cv")
    lb = EV.leaderboard(runs.select("model", "roc_mean", "acc_mean"), "model", "roc_mean")
    return lb.select("model", F.round("roc_mean", 6).alias("roc_mean"), F.round("acc_mean", 6).alias("acc_mean"), "rank")
