"""Evaluation of (id, y, score) / (id, y, prediction) tables.

Counting metrics are conditional sums in one aggregation, optionally per
``group_cols`` (folds, models). Rank metrics first reduce rows to distinct
scores with positive/negative counts; running counts over the score order
come from ``ordered.prefix_sums``. Threshold sweeps cross the distinct
scores with a fixed list of thresholds, so the work is one partial
aggregation per threshold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordered
from .joins import join_back


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion_counts(df: DataFrame, y: str = "y", pred: str = "pred",
                     group_cols: list[str] | None = None) -> DataFrame:
    g = list(group_cols or [])
    yy, pp = F.col(y), F.col(pred)
    return df.groupBy(*g).agg(
        F.count(F.when((yy == 1) & (pp == 1), 1)).alias("tp"),
        F.count(F.when((yy == 0) & (pp == 0), 1)).alias("tn"),
        F.count(F.when((yy == 0) & (pp == 1), 1)).alias("fp"),
        F.count(F.when((yy == 1) & (pp == 0), 1)).alias("fn"))


def confusion_long(df: DataFrame, y="y", pred="pred") -> DataFrame:
    """2x2 table as (actual, predicted, count), every cell present."""
    c = confusion_counts(df, y, pred)
    return c.selectExpr("stack(4, 0, 0, tn, 0, 1, fp, 1, 0, fn, 1, 1, tp) AS (actual, predicted, count)")


def prf(counts: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """accuracy, precision, recall, F1 of class 1 (0 when undefined)."""
    g = list(group_cols or [])
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    prec = _safe_div(tp, tp + fp)
    rec = _safe_div(tp, tp + fn)
    return counts.select(*g, "tp", "tn", "fp", "fn",
                         _safe_div(tp + tn, tp + tn + fp + fn).alias("accuracy"),
                         prec.alias("precision"), rec.alias("recall"),
                         _safe_div(2 * prec * rec, prec + rec).alias("f1"))


def class_report(df: DataFrame, y="y", pred="pred") -> DataFrame:
    """Per class precision/recall/F1/support, macro and weighted averages
    and accuracy (support = all rows), as rows."""
    c = confusion_counts(df, y, pred)
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    n = tp + tn + fp + fn
    p1, r1 = _safe_div(tp, tp + fp), _safe_div(tp, tp + fn)
    p0, r0 = _safe_div(tn, tn + fn), _safe_div(tn, tn + fp)
    f1, f0 = _safe_div(2 * p1 * r1, p1 + r1), _safe_div(2 * p0 * r0, p0 + r0)
    s1, s0 = tp + fn, tn + fp
    w = c.select(p0.alias("p0"), r0.alias("r0"), f0.alias("f0"), s0.alias("s0"),
                 p1.alias("p1"), r1.alias("r1"), f1.alias("f1"), s1.alias("s1"),
                 _safe_div(tp + tn, n).alias("acc"), n.alias("n"))
    return w.selectExpr(
        "stack(5, '0', p0, r0, f0, s0, '1', p1, r1, f1, s1, "
        "'accuracy', acc, acc, acc, n, "
        "'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n, "
        "'weighted avg', (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n, (f0 * s0 + f1 * s1) / n, n) "
        "AS (label, precision, recall, f1, support)")


def score_counts(df: DataFrame, y="y", score="score", group_cols=None) -> DataFrame:
    """Distinct scores with positive and negative counts."""
    g = list(group_cols or [])
    return df.groupBy(*g, score).agg(F.count(F.when(F.col(y) == 1, 1)).alias("pos"),
                                     F.count(F.when(F.col(y) == 0, 1)).alias("neg"))


def auc(df: DataFrame, y="y", score="score", group_cols=None) -> DataFrame:
    """Rank AUC with ties counted half: sum over scores of
    pos * (negatives below + neg / 2), divided by P * N."""
    g = list(group_cols or [])
    sc = score_counts(df, y, score, g)
    sc = ordered.prefix_sums(sc, [score], {"__cneg": "neg"}, g)
    contrib = F.col("pos") * (F.col("__cneg") - F.col("neg") + F.col("neg") / 2.0)
    r = sc.groupBy(*g).agg(F.sum(contrib).alias("__u"), F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return r.select(*g, F.when((F.col("P") > 0) & (F.col("N") > 0),
                               F.col("__u") / (F.col("P") * F.col("N"))).alias("auc"))


def weighted_auc(df: DataFrame, score: str, neg: str, pos: str) -> float:
    """AUC of rows that stand for ``neg`` and ``pos`` rows each; one half without a pair."""
    sc = df.groupBy(score).agg(F.sum(neg).alias("neg"), F.sum(pos).alias("pos"))
    sc = ordered.prefix_sums(sc, [score], {"__cneg": "neg"}, [])
    r = sc.agg(F.sum(F.col("pos") * (F.col("__cneg") - F.col("neg") / 2.0)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    return float(r.u / (r.p * r.n)) if r.p and r.n else 0.5


def _cumulated(df: DataFrame, y, score, thresholds: list[float]) -> DataFrame:
    """Per threshold: i, threshold, and the pos and neg of scores at or above
    it (pos_hit, neg_hit) and of all. A score's bin is the number of thresholds
    that it reaches; the bins are added up over the fixed list, so rows are
    never multiplied."""
    ths = F.array(*[F.lit(float(t)) for t in thresholds])
    reached = F.size(F.filter(ths, lambda t: t <= F.col(score)))
    bins = score_counts(df, y, score).groupBy(reached.alias("bin")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # One row with an array of the bins, at most one more than thresholds.
    one = bins.agg(F.collect_list(F.struct("bin", "pos", "neg")).alias("bins"))
    each = one.select("bins", F.posexplode(ths).alias("i", "threshold"))

    def total(field, least):
        return F.aggregate("bins", F.lit(0).cast("long"), lambda acc, b: acc + F.when(b["bin"] > least, b[field]).otherwise(0).cast("long"))
    return each.select("i", "threshold", *[total(f, F.col("i")).alias(f"{f}_hit") for f in ("pos", "neg")],
                       *[total(f, F.lit(-1)).alias(f"{f}_all") for f in ("pos", "neg")])


def roc_sweep(df: DataFrame, y="y", score="score", steps: int = 102, step: float = 0.01) -> DataFrame:
    """Thresholds 0, 0.01, ... (steps of them); positive iff score >= t.
    TP, TN, FP, FN, FPR, TPR per threshold."""
    c = _cumulated(df, y, score, [i / (1 / step) for i in range(steps)])
    r = c.select("i", "threshold", F.col("pos_hit").alias("TP"), (F.col("neg_all") - F.col("neg_hit")).alias("TN"),
                 F.col("neg_hit").alias("FP"), (F.col("pos_all") - F.col("pos_hit")).alias("FN"))
    return r.select("*", (F.col("FP") / (F.col("FP") + F.col("TN"))).alias("FPR"),
                    (F.col("TP") / (F.col("TP") + F.col("FN"))).alias("TPR"))


def roc_area_step(sweep: DataFrame) -> DataFrame:
    """sum_i TPR_i * (FPR_i - FPR_{i+1}) over the (fixed-size) sweep."""
    from pyspark.sql import Window
    w = Window.orderBy("i")   # over the 102-row sweep table only
    s = sweep.withColumn("__next", F.lead("FPR").over(w))
    return s.where(F.col("__next").isNotNull()).agg(
        F.sum(F.col("TPR") * (F.col("FPR") - F.col("__next"))).alias("area"))


def threshold_tune(df: DataFrame, y="y", score="score", lo: float = 0.30, hi: float = 0.70,
                   n: int = 41) -> DataFrame:
    """Accuracy of ``score >= t`` for n thresholds in [lo, hi]; first best."""
    step = (hi - lo) / (n - 1)
    # Thresholds pinned to their decimal values (0.30, 0.31, ...).
    c = _cumulated(df, y, score, [round(lo + i * step, 10) for i in range(n)])
    acc = c.select("i", "threshold", ((F.col("pos_hit") + F.col("neg_all") - F.col("neg_hit"))
                                      / (F.col("pos_all") + F.col("neg_all"))).alias("accuracy"))
    best = acc.agg(F.max_by(F.struct("threshold", "accuracy"), F.struct(F.col("accuracy"), -F.col("i")))
                   .alias("b")).select("b.*")
    return best


def fold_metrics(df: DataFrame, fold: str = "fold", y="y", score="score", pred="pred",
                 group_cols: list[str] | None = None) -> DataFrame:
    """accuracy, AUC, precision, recall, F1 per fold (and group)."""
    g = list(group_cols or []) + [fold]
    m = prf(confusion_counts(df, y, pred, g), g)
    a = auc(df, y, score, g)
    return m.join(a, g)


def cv_summary(fm: DataFrame, fold: str = "fold", group_cols: list[str] | None = None) -> DataFrame:
    """Mean, population std and the ordered fold lists of every metric."""
    g = list(group_cols or [])
    metrics = [("acc", "accuracy"), ("roc", "auc"), ("prec", "precision"), ("rec", "recall"), ("f1", "f1")]
    aggs = [F.count(F.lit(1)).alias("n_splits")]
    for short, col in metrics:
        aggs += [F.avg(col).alias(f"{short}_mean"), F.stddev_pop(col).alias(f"{short}_std"),
                 # k entries per group, ordered by fold
                 F.transform(F.array_sort(F.collect_list(F.struct(F.col(fold), F.col(col)))),
                             lambda s: s[col]).alias(f"fold_{short}")]
    return fm.groupBy(*g).agg(*aggs)


def cv_console(summary: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """"mean ± std" and "mean ± 2·std" texts per metric (long form)."""
    g = list(group_cols or [])
    parts = []
    for short in ("acc", "roc", "prec", "rec", "f1"):
        m, s = F.col(f"{short}_mean"), F.col(f"{short}_std")
        parts.append(summary.select(*g, F.lit(short).alias("metric"),
                                    F.format_string("%.4f ± %.4f", m, s).alias("mean_std"),
                                    F.format_string("%.4f ± %.4f", m, 2 * s).alias("mean_2std")))
    return reduce(DataFrame.unionByName, parts)


def target_bucket(acc: Column, cuts: tuple = (0.85, 0.84, 0.82)) -> Column:
    """EXCELLENT >= .85, VERY GOOD >= .84, GOOD >= .82, else BELOW."""
    return (F.when(acc >= cuts[0], "EXCELLENT").when(acc >= cuts[1], "VERY GOOD")
             .when(acc >= cuts[2], "GOOD").otherwise("BELOW"))


def leaderboard(summary: DataFrame, key: str, metric: str = "roc_mean") -> DataFrame:
    """Rank runs by a metric (ties share a rank). The summary holds one row
    per run, so this window is over runs, not over data rows."""
    from pyspark.sql import Window
    return summary.withColumn("rank", F.rank().over(Window.orderBy(F.desc(metric))))


def join_scores(df: DataFrame, scores: DataFrame, id_col: str) -> DataFrame:
    return join_back(df, scores, id_col)
