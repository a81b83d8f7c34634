"""Hand-made edge tables (FIXTURES section 4)."""

from pyspark.sql import functions as F

from kinfold.functions import features as fx
from kinfold.operators import evaluate as EV
from kinfold.operators import profile as P
from kinfold.operators import groups as G
from kinfold.operators import rules as R


def test_names(spark):
    names = [(1, None), (2, ""), (3, "NoComma"), (4, "A, NoDot"), (5, "A, Mr. B"),
             (6, "O'X, the Countess. of (Y)")]
    df = spark.createDataFrame(names, "id int, Name string")
    r = {row["id"]: row for row in df.select(
        "id", fx.title_raw(missing="Unknown").alias("t"), fx.title_raw(missing=None).alias("tn"),
        fx.surname().alias("s"), fx.display_name().alias("d"), fx.title_normalized().alias("norm"),
        fx.title_group().alias("g")).collect()}
    assert r[1]["t"] == "Unknown" and r[1]["d"] == "Unknown"
    assert r[2]["tn"] is None and r[2]["d"] == ""
    assert r[3]["s"] == "" and r[3]["d"] == "NoComma"
    assert r[4]["t"] == "Unknown" and r[4]["d"] == "No Title A"
    assert r[5]["t"] == "Mr" and r[5]["s"] == "A" and r[5]["d"] == "Mr. A"
    assert r[6]["t"] == "the Countess" and r[6]["norm"] == "rare" and r[6]["g"] == "the Countess"
    assert r[6]["d"] == "the Countess. O'X"


def test_mode_ties_and_all_null(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, "a"), (5, None)], "id int, x string")
    assert P.mode_table(df, "x").first()["top"] == "a"          # tie -> smallest
    nulls = spark.createDataFrame([(1, None), (2, None)], "id int, x string")
    assert P.mode_table(nulls, "x").first()["top"] is None       # all null -> no mode
    one = spark.createDataFrame([(1, "z")], "id int, x string")
    assert P.mode_table(one, "x").first()["top"] == "z"


def test_quantiles_match_numpy(spark):
    import numpy as np
    vals = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0, 5.0, 3.0, 5.0]
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    q = P.exact_quantiles(df, "v", {"a": 0.25, "b": 0.5, "c": 0.75, "d": 0.1}).first()
    for name, p in (("a", 0.25), ("b", 0.5), ("c", 0.75), ("d", 0.1)):
        assert abs(q[name] - np.quantile(vals, p)) < 1e-12


def test_auc_ties_one_class_and_extremes(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (2, 0, 0.5), (3, 1, 1.0), (4, 0, 0.0)], "id int, y int, score double")
    assert abs(EV.auc(df).first()["auc"] - (1 + 1 + 1 + 0.5) / 4) < 1e-12
    one = spark.createDataFrame([(1, 1, 0.2), (2, 1, 0.9)], "id int, y int, score double")
    assert EV.auc(one).first()["auc"] is None


def test_auc_symmetry(spark):
    import random
    rnd = random.Random(7)
    rows = [(i, rnd.randint(0, 1), round(rnd.random(), 2)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, y int, score double")
    a = EV.auc(df).first()["auc"]
    b = EV.auc(df.withColumn("score", 1 - F.col("score"))).first()["auc"]
    assert abs(a + b - 1) < 1e-9


def test_confusion_sums_to_n(spark):
    df = spark.createDataFrame([(i, i % 2, (i // 3) % 2) for i in range(50)], "id int, y int, pred int")
    c = EV.confusion_counts(df).first()
    assert c["tp"] + c["tn"] + c["fp"] + c["fn"] == 50


def test_cascade_without_rules_is_baseline(spark):
    df = spark.createDataFrame([(1, "male"), (2, "female")], "PassengerId long, Sex string")
    r = R.run_cascade(df, R.baseline_gender(), []).orderBy("PassengerId").collect()
    assert [x["prediction"] for x in r] == [0, 1]


def test_last_writer_wins(spark):
    df = spark.createDataFrame([(1, 5)], "PassengerId long, x int")
    rules = [[R.Rule("a", F.col("x") > 1, 1)], [R.Rule("b", F.col("x") > 2, 0)]]
    r = R.run_cascade(df, F.lit(1), rules).first()
    assert r["prediction"] == 0 and r["decided_by"] == "b"


def test_groups_edge_table(spark):
    # attached first row, attached last row, all men, single member, two groups on one ticket
    rows = [
        (1, "A, Mrs. X", "female", "T1a"), (2, "A, Miss. Y", "female", "T1a"), (3, "Z, Miss. N", "female", "T1a"),
        (4, "Q, Miss. F", "female", "T2a"), (5, "B, Mrs. U", "female", "T2a"), (6, "B, Master. V", "male", "T2a"),
        (7, "M, Mr. Only", "male", "T3a"), (8, "M, Mr. Men", "male", "T3a"),
        (9, "S, Mrs. Single", "female", "T4a"),
        (10, "C, Mrs. C1", "female", "T5a"), (11, "C, Miss. C2", "female", "T5a"),
        (12, "D, Mrs. D1", "female", "T5a"), (13, "D, Miss. D2", "female", "T5a"),
    ]
    df = spark.createDataFrame([(i, n, s, t, 1, 10.0, "S", None) for i, n, s, t in rows],
                               "PassengerId long, Name string, Sex string, Ticket string, Pclass int, "
                               "Fare double, Embarked string, Survived int")
    out = {r["PassengerId"]: r for r in G.wcg_frame(df, attach="first_grouped").collect()}
    assert out[3]["GroupId"] == out[1]["GroupId"] and out[3]["Attached"]   # attached after the group
    assert out[4]["GroupId"] == out[5]["GroupId"] and out[4]["Attached"]   # attached before the group
    assert out[7]["GroupId"] is None and out[8]["GroupId"] is None          # men never grouped
    assert out[9]["GroupId"] is None                                       # single member
    assert out[10]["GroupId"] != out[12]["GroupId"]                         # two groups, one ticket
    first_row = {r["PassengerId"]: r for r in G.wcg_frame(df, attach="first_row").collect()}
    assert first_row[4]["GroupId"] is None                                 # first row on T2 is itself


def test_attach_closed_forms_equal_loops(spark):
    """The window-free attach forms equal the sequential reference loops on
    random small tables."""
    import random
    rnd = random.Random(11)
    for trial in range(3):
        rows = []
        for i in range(1, 61):
            title = rnd.choice(["man", "woman", "boy"])
            gid = None if title == "man" or rnd.random() < 0.5 else f"g{rnd.randint(1, 6)}"
            rows.append((i, title, gid, f"t{rnd.randint(1, 8)}"))
        df = spark.createDataFrame(rows, "PassengerId long, Title string, GroupId string, TicketId string")
        for form in ("first_grouped", "first_row", "not_self"):
            got = {r["PassengerId"]: r["GroupId"] for r in G.attach_relatives(df, form=form).collect()}
            assert got == _loop(rows, form), (trial, form)


def _loop(rows, form):
    gid = {i: g for i, _, g, _ in rows}
    title = {i: t for i, t, _, _ in rows}
    ticket = {i: t for i, _, _, t in rows}
    order = sorted(gid)
    cands = [i for i in order if title[i] != "man" and gid[i] is None]
    for i in cands:
        same = [j for j in order if ticket[j] == ticket[i]]
        if form == "first_grouped":
            grouped = [gid[j] for j in same if gid[j] is not None]
            if grouped:
                gid[i] = grouped[0]
        elif form == "first_row":
            gid[i] = gid[same[0]]
        else:
            others = [j for j in same if j != i]
            gid[i] = gid[others[0]] if others else None
    return gid


def test_quantiles_by_group_with_null_group(spark):
    import random

    import numpy as np
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", "c", None]), round(rnd.gauss(0, 10), 1)) for _ in range(2000)] + [("d", None), (None, None)]
    df = spark.createDataFrame(rows, "g string, v double")
    qs = {"q1": 0.25, "q2": 0.5, "q3": 0.9}
    got = {r["g"]: r for r in P.exact_quantiles(df, "v", qs, ["g"]).collect()}
    assert set(got) == {"a", "b", "c", None}
    for g, r in got.items():
        own = [v for k, v in rows if k == g and v is not None]
        assert r["n"] == len(own)
        for k, q in qs.items():
            assert abs(r[k] - np.quantile(own, q)) < 1e-9


def test_splits_keep_rows_without_a_label(spark):
    from kinfold.operators import splits as S
    df = spark.createDataFrame([(i, None if i % 3 == 0 else i % 2) for i in range(30)], "id long, y int")
    folds = S.kfold_stratified(df, "y", "id", 5).collect()
    assert len(folds) == 30 and all(r["fold"] is not None for r in folds)
    parts = S.holdout_stratified(df, "y", "id", 0.2).collect()
    assert len(parts) == 30 and sum(r["subset"] == "holdout" for r in parts if r["y"] is None) == 2


def test_t_p_value(spark):
    want = [(0.01, 50.0, 0.99206109), (0.5, 500.0, 0.61729498), (1.0, 30.0, 0.32530859), (4.7, 30.0, 0.0000543), (-1.0, 1.0, 0.5),
            (2.0, 2.0, 0.18350342), (0.0, 7.5, 1.0), (1.96, 1e6, 0.0499961)]
    got = P.t_p_value(spark.createDataFrame([w[:2] for w in want], "t double, df double")).collect()
    for t, df, p in want:
        r = next(r for r in got if (r["t"], r["df"]) == (t, df))
        assert abs(r["p_value"] - p) < 1e-6, (t, df, r)


def test_surname_without_comma_and_exact_key(spark):
    from kinfold.operators import groups as G
    names = spark.createDataFrame([("NoComma",), ("A, Mr. B",), (None,)], "Name string")
    rows = names.select(fx.surname().alias("a"), fx.surname(no_comma="whole").alias("b")).collect()
    assert [tuple(r) for r in rows] == [("", "NoComma"), ("A", "A"), (None, None)]
    keys = spark.createDataFrame([("T", 1, None, "S"), ("T", 1, 2.0, None), ("T", 1, 2.0, "S"), (None, 1, 2.0, "S")],
                                 "Ticket string, Pclass int, Fare double, Embarked string")
    got = [r[0] for r in G.add_exact_ticket_key(keys).select("TicketId").collect()]
    assert got == [None, "T-1-2.00-S", "T-1-2.00-S", None]


def test_cascade_compiler_equals_sequential_overwrites(spark):
    """Stages of (condition, value) rules folded into CASE expressions give
    the same result as overwriting a prediction rule by rule."""
    import random
    rnd = random.Random(13)
    rows = [(i, rnd.randint(0, 9), rnd.randint(0, 9)) for i in range(200)]
    df = spark.createDataFrame(rows, "PassengerId long, a int, b int")
    stages, py = [], []
    for s in range(3):
        st, pst = [], []
        for r in range(rnd.randint(1, 3)):
            ta, tb, v = rnd.randint(0, 9), rnd.randint(0, 9), rnd.randint(0, 1)
            st.append(R.Rule(f"s{s}r{r}", (F.col("a") >= ta) & (F.col("b") < tb), v))
            pst.append((f"s{s}r{r}", ta, tb, v))
        stages.append(st)
        py.append(pst)
    got = {x["PassengerId"]: (x["prediction"], x["decided_by"])
           for x in R.run_cascade(df, F.lit(0), stages).collect()}
    for i, a, b in rows:
        pred, who = 0, "baseline"
        for pst in py:
            for name, ta, tb, v in pst:
                if a >= ta and b < tb:
                    pred, who = v, name
        assert got[i] == (pred, who), i


def test_ungrouped_mean_per_split(spark):
    rows = [(1, None, 1, "train", 3), (2, None, 0, "train", 3), (3, None, 0, "train", 3),
            (4, None, 1, "test", 1), (5, None, 1, "test", 1), (6, "g", 1, "train", 1), (7, "g", 0, "train", 1)]
    df = spark.createDataFrame(rows, "PassengerId long, GroupId string, Survived int, split string, Pclass int")
    comb = {r["PassengerId"]: r["GroupSurvival"] for r in G.annotate_groups(df).collect()}
    per = {r["PassengerId"]: r["GroupSurvival"] for r in G.annotate_groups(df, scope="per_split").collect()}
    assert abs(comb[1] - 3 / 5) < 1e-12 and abs(comb[4] - 3 / 5) < 1e-12
    assert abs(per[1] - 1 / 3) < 1e-12 and per[4] == 1.0
    assert comb[6] == 0.5 and per[6] == 0.5
