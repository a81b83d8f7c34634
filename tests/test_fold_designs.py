"""The preprocessing and bins of all folds at once, against a design for each fold."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from kinfold.operators import boosting as B
from kinfold.operators import models as M
from kinfold.plans import q_models as Q


def cohort(spark, n=300):
    rows = []
    for i in range(n):
        rows.append((i, i % 3 % 2, None if i % 7 == 0 else float(i * 37 % 61), None if i % 11 == 0 else i * 13 % 97 / 4, i % 4, i % 3 if i % 5 else None,
                     None if i % 7 == 0 else float(i * 37 % 61) * (i % 2), "male" if i % 2 else "female",
                     None if i % 13 == 0 else "rare" if i == 4 else "SCQ"[i % 3], i % 3 + 1, i * 7 % 5))
    return spark.createDataFrame(rows, "PassengerId long, Survived int, Age double, Fare double, SibSp int, Parch int, Age_Sex_interaction double, "
                                       "Sex string, Embarked string, Pclass int, fold int")


def test_bins_are_those_of_a_design_for_each_fold(spark):
    d = cohort(spark)
    preps = M.fit_fold_preps(d, 5)
    rows, names = M.fold_binned(d, preps)
    assert sorted(map(len, names)) == [13, 14, 14, 14, 14]    # the level that one fold alone holds
    for f in range(5):
        train, held = d.where(F.col("fold") != f), d.where(F.col("fold") == f)
        whole = M.fit_prep(train)
        assert preps[f]["levels"] == whole["levels"]
        assert preps[f]["stats"] == pytest.approx(whole["stats"])
        tr, te, own = M.design(train, held)
        assert own == names[f]
        tr, te = M.binned(tr, te, size=len(own))
        for part, cond in ((tr, F.col("fold") != f), (te, F.col("fold") == f)):
            want = part.groupBy("fold", "Survived", "bins").count().collect()
            got = rows.where(cond).groupBy("fold", "Survived", F.col(f"bins{f}").alias("bins")).count().collect()
            key = lambda r: (r.fold, r.Survived, tuple(r.bins), r["count"])
            assert sorted(map(key, got)) == sorted(map(key, want))


def test_no_labelled_row_outside_a_fold(spark):
    d = cohort(spark, 20).where("fold = 1")
    preps = M.fit_fold_preps(d, 2)
    rows, names = M.fold_binned(d, preps)
    assert preps[1]["levels"]["Sex"] == {"mode": None, "levels": []} and names[1] == [c + "_z" for c in M.NUMERIC]
    assert {tuple(r.bins1) for r in rows.collect()} == {(0,) * 5}


def test_ablation_fits_one_preprocessing(spark, monkeypatch):
    """Ten fits, but the cuts of all designs from one aggregation."""
    cuts, fits, edges, boosted = [], [], B.edges, M.boosted
    monkeypatch.setattr(B, "edges", lambda *a, **k: cuts.append(1) or edges(*a, **k))
    monkeypatch.setattr(M, "boosted", lambda *a, **k: fits.append(1) or boosted(*a, **k))
    [row] = Q.q_ablate_features(spark, SF_SMALL).collect()
    assert (len(cuts), len(fits)) == (1, 10)
    assert row.auc_delta is not None and row.verdict in ("significant", "modest", "minimal", "none")
