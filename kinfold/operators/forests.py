"""Random forests over binned tables, many forests at once.

As in ``boosting``, equal binned rows are one row with its numbers of either
label. While the table has at most ``LOCAL_ROWS`` rows (counted, so its size is
known) it goes to every task, and a task grows ``BATCH`` trees; trees don't
depend on each other, so all trees of all forests are one job, whatever the
rows that were counted. A larger table stays in the cluster as blocks of rows,
and all trees grow together, a job or a few for each level (``grown``; ``fit``
returns None for such a table).

A tree is grown on a bootstrap sample (a row that stands for n rows is drawn
Poisson(n) times), a node chooses among a random square root of the features by
the decrease of the Gini impurity, and p is the mean over the trees of the share
of label 1 in the leaf. A tree without a row says one half.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_table, written
from .boosting import _BLOCK, BINS, BLOCK_ROWS, Trees, _pack, distinct, gathered

LOCAL_ROWS = 1_000_000
#: Trees that a task grows.
BATCH = 10
#: Rows of a task's blocks, and bytes of counts that a task keeps, when trees grow over blocks.
SPREAD_ROWS, HELD_BYTES = 262_144, 64 << 20


@dataclass(frozen=True)
class Forest:
    """Trees, depth and least rows of a leaf; rows of the folds ``without`` are left out."""
    trees: int = 400
    depth: int = 6
    leaf: int = 5
    seed: int = 42
    without: tuple[int, ...] = ()


def _splits(hist: np.ndarray, leaf: int) -> tuple[np.ndarray, ...]:
    """Per node of nodes x columns x BINS x (rows of label 0, of label 1): the
    place of the best column (-1: none pays), cut, gain, rows of the node and of its left side."""
    whole = hist[:, 0].sum(axis=1)
    left = hist.cumsum(axis=2)[:, :, :-1]
    right = whole[:, None, None] - left
    n_left, n_right, n = (x.sum(axis=-1) for x in (left, right, whole))
    score = lambda x, n: np.divide((x * x).sum(axis=-1), n, out=np.zeros_like(n), where=n > 0)
    gain = score(left, n_left) + score(right, n_right) - score(whole, n)[:, None, None]
    gain[(n_left < leaf) | (n_right < leaf)] = -1
    best = gain.reshape(len(hist), -1).argmax(axis=1)
    nodes, column, cut = np.arange(len(hist)), best // (BINS - 1), best % (BINS - 1)
    top = gain[nodes, column, cut]
    pays = top > 1e-9
    return np.where(pays, column, -1), np.where(pays, cut, 0), np.where(pays, top, 0), whole, left[nodes, column, cut]


def _tried(features: int) -> int:
    return max(1, math.ceil(math.sqrt(features)))


def _grow(forest: Forest, tree: int, bins: np.ndarray, n0: np.ndarray, n1: np.ndarray, back: np.ndarray | None = None) -> Trees:
    """One tree, as ``Trees`` of one; values are shares of label 1, gains
    decreases of rows times impurity. With ``back`` the numbers are those of rows
    that equal the ``bins`` it names: they are drawn one by one and then added up."""
    rng = np.random.default_rng([forest.seed, tree])
    w0, w1 = rng.poisson(n0).astype(np.float64), rng.poisson(n1).astype(np.float64)
    if back is not None:
        w0, w1 = (np.bincount(back, w, len(bins)) for w in (w0, w1))
    drawn = w0 + w1 > 0
    made, features = Trees.none(forest.depth, 1), bins.shape[1]
    flat, w0, w1 = np.ascontiguousarray(bins[drawn].T).ravel(), w0[drawn], w1[drawn]
    made.value[0, 0] = 0.5
    at, live, rows = np.zeros(len(w0), np.int64), np.arange(len(w0)), len(w0)
    for level in range(forest.depth + 1):
        if not len(live):
            break
        y0, y1 = w0[live], w1[live]
        nodes = np.flatnonzero(np.bincount(at[live], minlength=2**level))
        number = np.zeros(2**level, np.int64)
        number[nodes] = np.arange(len(nodes))
        place = number[at[live]]
        slot = 2**level - 1 + nodes
        if level == forest.depth:
            all0, all1 = (np.bincount(place, y, len(nodes)) for y in (y0, y1))
            made.value[0, slot] = all1 / (all0 + all1)
            break
        columns = rng.random((len(nodes), features)).argsort(axis=1)[:, :_tried(features)]
        hist = np.empty((len(nodes), columns.shape[1], BINS, 2))
        for j in range(columns.shape[1]):
            key = place * BINS + flat.take((columns[:, j] * rows)[place] + live)
            for i, y in enumerate((y0, y1)):
                hist[:, j, :, i] = np.bincount(key, y, len(nodes) * BINS).reshape(-1, BINS)
        chosen, cut, gain, whole, _ = _splits(hist, forest.leaf)
        feature = np.where(chosen >= 0, columns[np.arange(len(nodes)), chosen], -1)
        made.value[0, slot] = whole[:, 1] / whole.sum(axis=1)
        made.feature[0, slot], made.cut[0, slot], made.gain[0, slot] = feature, cut, gain
        inner = feature[place] >= 0
        live, place = live[inner], place[inner]
        at[live] = 2 * at[live] + (flat.take((feature * rows)[place] + live) > cut[place])
    return made


def _held(table: DataFrame) -> tuple[np.ndarray, ...]:
    rows = table.select("fold", "bins", "n0", "n1").toArrow()  # at most LOCAL_ROWS rows
    flat = rows.column("bins").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.uint8)
    return (rows.column("fold").to_numpy(), flat.reshape(rows.num_rows, -1) if rows.num_rows else np.zeros((0, 1), np.uint8),
            rows.column("n0").to_numpy(), rows.column("n1").to_numpy())


def fit(table: DataFrame, forests: dict, local_rows: int | None = None) -> dict | None:
    """Trees of each forest by its key, from a table of ``boosting.counted`` rows; None if that is too large for a task."""
    held, path = written(table)
    try:
        return _local(held, forests) if held.count() <= (LOCAL_ROWS if local_rows is None else local_rows) else None
    finally:
        drop_table(table.sparkSession, path)


def grown(table: DataFrame, forests: dict) -> dict:
    """Trees of each forest by its key, from ``boosting.counted`` rows, however many."""
    held, path = written(table)
    try:
        return _local(held, forests) if (rows := held.count()) <= LOCAL_ROWS else _spread(held, forests, rows)
    finally:
        drop_table(table.sparkSession, path)


def _local(held: DataFrame, forests: dict) -> dict:
    spark = held.sparkSession
    fold, bins, n0, n1 = _held(held)
    # Equal rows of several folds are drawn one by one and count as one.
    back = None
    if len(np.unique(fold)) > 1:
        bins, back = distinct(bins)
    parts = [(key, start) for key, f in forests.items() for start in range(0, f.trees, BATCH)]

    def grow(batches):
        for batch in batches:
            for i in batch.column("id").to_pylist():
                key, start = parts[i]
                f = forests[key]
                used = ~np.isin(fold, f.without)
                own = (bins[used], n0[used], n1[used]) if back is None else (bins, n0[used], n1[used], back[used])
                made = joined([_grow(f, t, *own) for t in range(start, min(start + BATCH, f.trees))])
                yield pa.RecordBatch.from_pydict({"id": pa.array([i], pa.int64()), "trees": pa.array([pickle.dumps(made)], pa.binary())})
    got = {r.id: pickle.loads(r.trees) for r in spark.range(len(parts)).repartition(len(parts), F.col("id")).mapInArrow(grow, "id long, trees binary").collect()}
    return {key: joined([got[i] for i, (k, _) in enumerate(parts) if k == key]) for key in forests}


# --- trees over blocks of rows -----------------------------------------------------
def _spread(held: DataFrame, forests: dict, rows: int) -> dict:
    """Trees level by level in the cluster: each task counts its blocks of rows
    for the nodes that all trees have reached, one aggregation adds these up and
    chooses the splits. Trees go in several jobs where a level's counts would
    not fit into ``HELD_BYTES``."""
    spark = held.sparkSession
    features = held.select(F.size("bins")).first()[0]
    blocks, path = written(held.repartition(1 + rows // SPREAD_ROWS).mapInArrow(_pack(0), _BLOCK))
    made = {key: Trees.none(f.depth, f.trees) for key, f in forests.items()}
    for m in made.values():
        m.value[:, 0] = 0.5
    for level in range(max(f.depth for f in forests.values())):
        at = slice(2**level - 1, 2 ** (level + 1) - 1)
        up = slice((at.start - 1) // 2, at.start)
        todo = [(key, t) for key, f in forests.items() if level < f.depth for t in range(f.trees) if not level or (made[key].feature[t, up] >= 0).any()]
        most = max(1, HELD_BYTES // (2**level * _tried(features) * BINS * 16))
        for some in (todo[i:i + most] for i in range(0, len(todo), most)):
            counts = _Level(forests, made, some, level, features)
            for r in blocks.mapInArrow(counts.counted, "tree int, hist binary").groupBy("tree").applyInPandas(_chooser(counts), "tree int, found binary").collect():
                key, t = some[r.tree]
                feature, cut, gain, whole, left = pickle.loads(r.found)
                n, m = whole.sum(axis=1), made[key]
                there, split = np.flatnonzero(n > 0), np.flatnonzero(feature >= 0)
                m.value[t, at.start + there] = whole[there, 1] / n[there]
                m.feature[t, at], m.cut[t, at], m.gain[t, at] = feature, cut, gain
                # The sides of a split are leaves until they are split in turn.
                for side, y in ((1, left), (2, whole - left)):
                    m.value[t, 2 * (at.start + split) + side] = y[split, 1] / y[split].sum(axis=1)
    drop_table(spark, path)
    return made


def _chooser(counts: _Level):
    return lambda rows: counts.chosen(rows)


class _Level:
    """What the jobs of a level need: the trees so far, and which of them they count for."""

    def __init__(self, forests, made, some, level, features):
        self.forests, self.some, self.level, self.features = forests, some, level, features
        self.trees = [(made[key].feature[t], made[key].cut[t]) for key, t in some]

    def _columns(self, f: Forest, t: int) -> np.ndarray:
        rng = np.random.default_rng([f.seed, t, 1 << 20, self.level])
        return rng.random((2**self.level, self.features)).argsort(axis=1)[:, :_tried(self.features)]

    def counted(self, batches):
        held: dict[int, np.ndarray] = {}
        first, nodes = 2**self.level - 1, 2**self.level
        for batch in batches:
            for b in batch.select(["block", "n", "width", "folds", "bins", "n0", "n1"]).to_pylist():
                rows, fold = b["n"], np.frombuffer(b["folds"], np.int64)
                flat = np.ascontiguousarray(np.frombuffer(b["bins"], np.uint8).reshape(rows, b["width"]).T).ravel()
                n = np.concatenate([np.frombuffer(b[c], np.int64) for c in ("n0", "n1")])
                units = {}
                for i, (key, t) in enumerate(self.some):
                    f, (feature, cut) = self.forests[key], self.trees[i]
                    if f.without not in units:
                        own = np.flatnonzero((n > 0) & ~np.isin(np.tile(fold, 2), f.without))
                        units[f.without] = _Units(own % max(rows, 1), own // max(rows, 1), n[own])
                    row, label, w = units[f.without].drawn(np.random.default_rng([f.seed, t, b["block"]]))
                    node = np.zeros(len(row), np.int64)
                    for _ in range(self.level):
                        own = feature[node]
                        inner = np.flatnonzero(own >= 0)
                        if len(inner) < len(own):
                            row, label, w, node, own = (x[inner] for x in (row, label, w, node, own))
                        node = 2 * node + 1 + (flat.take(own.astype(np.int64) * rows + row) > cut[node])
                    place, columns = node - first, self._columns(f, t)
                    hist = held.setdefault(i, np.zeros((nodes, columns.shape[1], BINS * 2)))
                    base = place * (BINS * 2) + label
                    for j in range(columns.shape[1]):
                        key_of = base + 2 * flat.take((columns[:, j] * rows)[place] + row).astype(np.int64)
                        hist[:, j] += np.bincount(key_of, w, nodes * BINS * 2).reshape(nodes, -1)
        if held:
            yield pa.RecordBatch.from_pydict({"tree": pa.array(list(held), pa.int32()), "hist": pa.array([h.tobytes() for h in held.values()], pa.binary())})

    def chosen(self, rows):
        i = int(rows["tree"].iloc[0])
        name, t = self.some[i]
        f = self.forests[name]
        columns = self._columns(f, t)
        hist = sum(np.frombuffer(x) for x in rows["hist"]).reshape(2**self.level, columns.shape[1], BINS, 2)
        column, *others = _splits(hist, f.leaf)
        feature = np.where(column >= 0, columns[np.arange(len(columns)), column], -1)
        return pd.DataFrame({"tree": [i], "found": [pickle.dumps((feature, *others))]})


class _Units:
    """The (row, label) pairs of a block with their numbers of rows, drawn Poisson(n) times each."""

    def __init__(self, row: np.ndarray, label: np.ndarray, n: np.ndarray):
        self.row, self.label, self.n, self.total = row, label, n, int(n.sum())
        # A Poisson number of draws from all rows gives each row a Poisson number.
        self.each = np.repeat(np.arange(len(n), dtype=np.int32), n) if self.total <= 16 * len(n) else None

    def drawn(self, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.each is not None:
            w = np.bincount(self.each.take(rng.integers(0, max(self.total, 1), rng.poisson(self.total), np.int32)), minlength=len(self.n))
        else:
            w = rng.poisson(self.n)
        some = np.flatnonzero(w)
        return self.row[some], self.label[some], w[some].astype(np.float64)


def joined(parts: list[Trees]) -> Trees:
    return Trees(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("feature", "cut", "value", "gain")))


def importance(trees: Trees, features: int) -> list[float]:
    """Mean over the trees of each feature's share of the tree's gain, as shares."""
    total = np.zeros(features)
    for f, g in zip(trees.feature, trees.gain, strict=True):
        own = np.bincount(f[f >= 0], g[f >= 0], features)
        total += own / own.sum() if own.sum() > 0 else 0
    return (total / total.sum() if total.sum() > 0 else total).tolist()


def score(df: DataFrame, trees: Trees, out: str = "p", bins: str = "bins") -> DataFrame:
    """``df`` with p; its bins stay."""
    from pyspark.sql import types as T
    names = df.columns

    def run(batches):
        for batch in gathered(batches, BLOCK_ROWS):
            n = batch.num_rows
            x = batch.column(bins).flatten().to_numpy(zero_copy_only=False).astype(np.uint8).reshape(n, -1) if n else np.zeros((0, 1), np.uint8)
            # Equal rows are scored once.
            rows, back = distinct(x)
            total = np.zeros(len(rows))
            for t in range(len(trees.feature)):
                total += trees.value[t, trees.leaves(t, rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((total / max(len(trees.feature), 1))[back])], names=[*names, out])
    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())]))
