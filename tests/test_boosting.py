"""Batched boosting: trees against plain loops, the two ways of growing, stopping, prefixes, odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.operators import boosting as B

RNG = np.random.default_rng(11)


def plain_trees(rows, y, p):
    """Boosting by loops over single rows: a list of nested (feature, cut, left, right) or leaf values."""
    margin, out = [0.0] * len(y), []
    for _ in range(p.rounds):
        prob = [1 / (1 + np.exp(-m)) for m in margin]
        g, h = [q - t for q, t in zip(prob, y)], [q * (1 - q) for q in prob]

        def node(members, level):
            gs, hs = sum(g[i] for i in members), sum(h[i] for i in members)
            best = (1e-12, None)
            if level < p.depth:
                for f in range(len(rows[0])):
                    for cut in range(B.BINS - 1):
                        left = [i for i in members if rows[i][f] <= cut]
                        gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                        gr, hr = gs - gl, hs - hl
                        if min(hl, hr) < p.least_weight:
                            continue
                        gain = .5 * (gl**2 / (hl + p.lam) + gr**2 / (hr + p.lam) - gs**2 / (hs + p.lam)) - p.gamma
                        if gain > best[0] + 1e-9:
                            best = (gain, (f, cut, left))
            if best[1] is None:
                return -p.rate * gs / (hs + p.lam)
            f, cut, left = best[1]
            return f, cut, node(left, level + 1), node([i for i in members if i not in set(left)], level + 1)
        tree = node(list(range(len(y))), 0)

        def value(t, row):
            while isinstance(t, tuple):
                t = t[2] if row[t[0]] <= t[1] else t[3]
            return t
        margin = [m + value(tree, r) for m, r in zip(margin, rows)]
        out.append(list(margin))
    return out


def data(n=160, features=3, levels=6):
    x = RNG.integers(0, levels, (n, features))
    y = ((x[:, 0] > 2) ^ (x[:, 1] > 3) ^ (RNG.random(n) < .1)).astype(int)
    return x, y


def arrays(x, y, fold=None):
    n = len(y)
    return np.array([""] * n, object), np.full(n, -1) if fold is None else fold, x.astype(np.uint8), 1 - y, y


def frame(spark, x, y, fold=None, group=None):
    rows = [(int(f) if fold is not None else -1, g, [int(v) for v in r], int(t)) for r, t, f, g in
            zip(x, y, fold if fold is not None else y, group if group is not None else [""] * len(y), strict=True)]
    return spark.createDataFrame(rows, "fold int, grp string, bins array<tinyint>, Survived int")


@pytest.mark.parametrize("params", [B.Params(4, .3, 3, 1, 1), B.Params(3, .5, 2, 1, 1, lam=0.5, gamma=.2, least_weight=3), B.Params(2, .1, 0, 1, 1)])
def test_trees_equal_plain_loops(params):
    x, y = data()
    trees = B.grow(B.Cell("a", params), *arrays(x, y))
    for got, want in zip(trees.margins(x.astype(np.uint8)), plain_trees(x.tolist(), y.tolist(), params), strict=True):
        assert np.allclose(got, want, atol=1e-9)


def test_counted_rows_give_the_trees_of_all_rows(spark):
    x, y = data(900, 2, 4)
    p = B.Params(20, .3, 3, 1, 1)
    whole = B.grow(B.Cell("a", p), *arrays(x, y))
    table = B.counted(frame(spark, x, y))
    assert table.count() <= 16
    got = B.fit(table, [B.Cell("a", p)])["a"]
    for a, b in ((whole.feature, got.feature), (whole.cut, got.cut)):
        assert (a == b).all()
    assert np.allclose(whole.value, got.value)


def test_trees_of_all_cells_in_the_cluster_equal_those_of_one_task(spark, monkeypatch):
    monkeypatch.setattr(B, "KEPT", 2)
    monkeypatch.setattr(B, "BLOCK_ROWS", 17)
    x, y = data(400, 3, 5)
    fold, group = np.arange(400) % 4, ["ab"[i % 2] for i in range(400)]
    table = B.counted(frame(spark, x, y, fold, group), group="grp", fold="fold").repartition(3)
    cells = [B.Cell("a0", B.Params(5, .3, 3, 1, 1), "a", (0,)), B.Cell("b", B.Params(3, .2, 2, 1, .7), "b"),
             B.Cell("stop", B.Params(6, .5, 2, 1, 1), "", (1,), valid=1, patience=2)]
    near, far = B.fit(table, cells), B.fit(table, cells, local_rows=0)
    for c in cells:
        assert (near[c.key].feature == far[c.key].feature).all() and (near[c.key].cut == far[c.key].cut).all()
        assert np.allclose(near[c.key].value, far[c.key].value) and np.allclose(near[c.key].auc, far[c.key].auc)


def test_stopping_rule_equals_a_plain_loop():
    for series in ([.5], [.5, .6, .6, .7, .1], [.9, .8, .7, .6, .5], [.1, .2, .3], list(RNG.random(60).round(1)), []):
        for patience in (1, 2, 5, 50):
            want, best, kept, done = None, -1, 0, False
            for n, v in enumerate(series, 1):
                if v > best:
                    best, kept = v, n
                done = n - kept >= patience
                if done:
                    break
            seen = series[:n] if series else []
            want = (max(kept, 1), done) if series else (1, False)
            got = B.stop_at(seen, patience)
            assert got[0] == want[0] and (not series or got[1] == want[1])


def test_early_stopping_keeps_the_best_round_of_the_held_out_rows():
    x, y = data(300)
    fold = (np.arange(300) % 3 == 0).astype(int)
    p = B.Params(200, .4, 4, 1, 1)
    trees = B.grow(B.Cell("a", p, without=(1,), valid=1, patience=7), *arrays(x, y, fold))
    whole = B.grow(B.Cell("a", p, without=(1,)), *arrays(x, y, fold))
    held = fold == 1
    series = [pair_auc(m, y[held]) for m in whole.margins(x[held].astype(np.uint8))]
    best = series.index(max(series[:len(trees.feature) + 7]))
    assert len(trees.feature) == best + 1 and np.allclose(trees.auc, series[:best + 1])


def pair_auc(m, y):
    pairs = [(a, b) for a, t in zip(m, y) if t for b, u in zip(m, y) if not u]
    return sum((a > b) + (a == b) / 2 for a, b in pairs) / len(pairs)


def test_auc_equals_pairs(spark):
    from kinfold.operators.evaluate import weighted_auc
    m, y = RNG.integers(0, 6, 50).astype(float), RNG.integers(0, 2, 50)
    assert B.auc(m, 1 - y, y) == pytest.approx(pair_auc(m, y))
    df = spark.createDataFrame([(float(a), int(1 - b), int(b)) for a, b in zip(m, y)], "m double, n0 long, n1 long")
    assert weighted_auc(df, "m", "n0", "n1") == pytest.approx(pair_auc(m, y))
    assert weighted_auc(df.where("n1 = 0"), "m", "n0", "n1") == B.auc(m, 1 - 0 * y, 0 * y) == 0.5


def test_prefixes_equal_shorter_fits(spark):
    x, y = data(300)
    p = B.Params(12, .3, 3, .8, .7)
    trees = B.grow(B.Cell("a", p), *arrays(x, y))
    df = frame(spark, x, y).withColumn("id", F.monotonically_increasing_id())
    got = B.score(df.select("id", "bins"), {"a": trees}, rounds=[1, 5, 12]).orderBy("id").collect()
    for j, r in enumerate((1, 5, 12)):
        short = B.grow(B.Cell("a", B.with_rounds(p, r)), *arrays(x, y))
        *_, last = short.margins(x.astype(np.uint8))
        assert np.allclose([g.ps[j] for g in got], B.sigmoid(last))


def test_near_the_trees_of_mllib(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    x = RNG.normal(size=(1500, 2))
    y = ((x[:, 0] ** 2 + x[:, 1]) > 1).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(t)) for (a, b), t in zip(x, y)], "x1 double, x2 double, Survived int")
    df = VectorAssembler(inputCols=["x1", "x2"], outputCol="features").transform(df).repartition(1).cache()
    own = df.withColumn("bins", B.bins_of([F.col("x1"), F.col("x2")], B.edges(df, [F.col("x1"), F.col("x2")])))
    trees = B.fit(B.counted(own), [B.Cell("a", B.Params(30, .3, 4, 1, 1))])
    mine = B.score(own.select("Survived", "bins"), trees).agg(F.avg(((F.col("p") >= .5).cast("int") == F.col("Survived")).cast("double"))).first()[0]
    mllib = GBTClassifier(featuresCol="features", labelCol="Survived", maxIter=30, stepSize=.3, maxDepth=4).fit(df).transform(df)
    theirs = mllib.agg(F.avg((F.col("prediction") == F.col("Survived")).cast("double"))).first()[0]
    df.unpersist()
    assert mine > 0.97 and abs(mine - theirs) < 0.02


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, 1.0, 1), (float("nan"), 2.0, 0), (3.0, None, None), (3.0, 1.0, 1)], "x1 double, x2 double, Survived int")
    cols = [F.col("x1"), F.col("x2")]
    own = df.withColumn("bins", B.bins_of(cols, B.edges(df, cols)))
    trees = B.fit(B.counted(own), [B.Cell("a", B.Params(3, .3, 2, 1, 1, least_weight=0))])
    assert all(0 <= r.p <= 1 for r in B.score(own, trees).collect())
    none = own.where("Survived > 5")
    trees = B.fit(B.counted(none), [B.Cell("a", B.Params(3, .3, 2))])
    assert [r.p for r in B.score(own, trees).collect()] == [0.5] * 4
    assert B.score(none, trees).collect() == []


def test_a_cell_never_learns_from_rows_it_leaves_out():
    x, y = data(200)
    fold = np.arange(200) % 5
    p = B.Params(10, .3, 3, 1, 1)
    a = B.grow(B.Cell("a", p, without=(2,)), *arrays(x, y, fold))
    b = B.grow(B.Cell("a", p, without=(2,)), *arrays(x, np.where(fold == 2, 1 - y, y), fold))
    assert (a.feature == b.feature).all() and np.allclose(a.value, b.value)
