"""Repeated splits: exact parts per trial without a shuffle of the copies."""

import hashlib

from pyspark.sql import functions as F

from kinfold.operators import splits as S

IDS = [None, None, None, 7, 7, 7, 7, *range(100, 193)]


def _table(spark):
    return spark.createDataFrame([(i,) for i in IDS], "id long")


def _order(trial, seed=42):
    key = lambda i: (i is not None, hashlib.md5(f"{seed}-{trial}-{i}".encode()).hexdigest() if i is not None else "")
    return sorted(IDS, key=key)


def _shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.splitlines() if ("Exchange" in x and "BroadcastExchange" not in x) or "Window" in x or "Sort " in x]


def test_folds_are_those_of_the_sorted_rows(spark):
    got = S.kfold_repeated(_table(spark), "id", trials=3, k=7, seed=42)
    rows = got.collect()
    for t in range(3):
        want = [(i, r // (len(IDS) // 7) if r // (len(IDS) // 7) < 7 else None) for r, i in enumerate(_order(t))]
        assert sorted([(r.id, r.fold) for r in rows if r.trial == t], key=str) == sorted(want, key=str)


def test_subsamples_are_those_of_the_sorted_rows(spark):
    rows = S.random_subsample(_table(spark), "id", trials=3, test_frac=0.25, seed=42).collect()
    for t in range(3):
        want = [(i, "test" if r >= 75 else "train") for r, i in enumerate(_order(t))]
        assert sorted([(r.id, r.subset) for r in rows if r.trial == t], key=str) == sorted(want, key=str)


def test_copies_of_the_rows_are_not_shuffled(spark):
    assert not _shuffles(S.kfold_repeated(_table(spark), "id", trials=3, k=5))
    assert not _shuffles(S.random_subsample(_table(spark), "id", trials=3))


def test_fewer_rows_than_folds(spark):
    rows = S.kfold_repeated(spark.range(3), "id", trials=2, k=5).collect()
    assert len(rows) == 6 and all(r.fold is None for r in rows)


def test_group_cv_equals_a_loop_with_large_and_small_groups(spark, monkeypatch):
    monkeypatch.setattr(S, "GROUP_ROWS", 6)
    people = [(i, i % 3 % 2, ["woman", "boy", "man"][i % 5 % 3], i % 3 + 1, None if i % 5 % 3 == 2 else "big" if i % 4 else f"g{i // 16}") for i in range(200)]
    df = spark.createDataFrame(people, "PassengerId long, Survived int, Title string, Pclass int, GroupId string")
    folds = {(r.trial, r.PassengerId): r.fold for r in S.kfold_repeated(df, "PassengerId", trials=3, k=4).collect()}
    got = {r.trial: r for r in S.cv_group_model(df, trials=3, k=4).collect()}
    for t in range(3):
        errors = tested = 0
        for i, y, title, pclass, gid in people:
            f = folds[t, i]
            if f is None:
                continue
            fit = [p[1] for p in people if p[4] == gid and folds[t, p[0]] != f]
            rate = sum(fit) / len(fit) if fit else 0.0 if pclass == 3 else 1.0
            pred = 1 if title == "boy" and rate == 1 else 0 if title == "woman" and rate == 0 else int(title == "woman")
            errors, tested = errors + abs(pred - y), tested + 1
        assert (got[t].errors, got[t].n_tested) == (errors, tested)
    rows = S.cv_group_model(df, trials=3, k=4)
    assert rows.agg(F.count("accuracy")).first()[0] == 3
