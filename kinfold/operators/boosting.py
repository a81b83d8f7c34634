"""Boosted trees over binned tables, many fits at once.

Features become bins (at most ``BINS``, by quantiles of the training rows) and
equal binned rows become one row with the number of its rows of either label,
in one aggregation over the data. All fits (``Cell``: which rows, which
parameters) then read that table:

* while it has at most ``LOCAL_ROWS`` rows (counted, so its size is known) it is
  sent to one task for each cell, which grows all trees of the cell: as many
  fits cost one job, whatever the rounds. Two features have at most BINS^2 rows,
  however many rows were counted;
* beyond that the trees of all cells grow together, level by level: one
  aggregation of gradient histograms by (cell, node), from blocks of rows that
  carry their margins and are written again every ``KEPT`` rounds.

Trees are those of second-order boosting with the logistic loss: a split's gain
is half of G^2/(H + lambda) of both sides less that of the whole, a leaf is
worth -rate G/(H + lambda). A share of the rows and of the columns is drawn for
each tree. Null features are in the lowest bin; a table without a row gives
trees without a split, so every probability is one half.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_table, written

BINS = 64
LOCAL_ROWS = 1_000_000
#: Rows of a block, and rounds between two tables of blocks, when trees grow in the cluster.
BLOCK_ROWS, KEPT = 65_536, 16
#: Partial histograms of a node that one task adds up.
SALTS = 16


@dataclass(frozen=True)
class Params:
    rounds: int = 500
    rate: float = 0.05
    depth: int = 4
    rows: float = 0.9
    columns: float = 0.9
    lam: float = 1.0
    gamma: float = 0.0
    least_weight: float = 1.0
    seed: int = 42


@dataclass(frozen=True)
class Cell:
    """One fit: rows of ``group`` whose fold is none of ``without``. With
    ``patience`` the rows of fold ``valid`` give an AUC each round, and the fit
    ends that many rounds after the best."""
    key: object
    params: Params = field(default_factory=Params)
    group: str = ""
    without: tuple[int, ...] = ()
    valid: int | None = None
    patience: int | None = None


@dataclass
class Trees:
    """Trees as arrays (tree x node, children of node i at 2i + 1 and 2i + 2):
    feature (-1 at a leaf), cut (bins up to it go left), value and gain."""
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    auc: list[float] = field(default_factory=list)

    @staticmethod
    def none(depth: int, rounds: int) -> Trees:
        n = 2 ** (depth + 1) - 1
        return Trees(np.full((rounds, n), -1, np.int16), np.zeros((rounds, n), np.int16), np.zeros((rounds, n)), np.zeros((rounds, n)))

    def first(self, n: int) -> Trees:
        return Trees(self.feature[:n], self.cut[:n], self.value[:n], self.gain[:n], self.auc[:n])

    def leaves(self, tree: int, bins: np.ndarray) -> np.ndarray:
        feature, cut, width = self.feature[tree].astype(np.int64), self.cut[tree], bins.shape[1]
        flat, node, live = np.ascontiguousarray(bins).ravel(), np.zeros(len(bins), np.int64), np.arange(len(bins))
        while True:
            at = node.take(live)
            f = feature.take(at)
            inner = f >= 0
            if not inner.all():
                live, at, f = live[inner], at[inner], f[inner]
            if not len(live):
                return node
            node[live] = 2 * at + 1 + (flat.take(live * width + f) > cut.take(at))

    def margins(self, bins: np.ndarray, start: int = 0) -> Iterator[np.ndarray]:
        """Running sums of the trees from ``start`` on, after each tree."""
        total = np.zeros(len(bins))
        for t in range(start, len(self.feature)):
            total = total + self.value[t, self.leaves(t, bins)]
            yield total

    def at(self, bins: np.ndarray, rounds: list[int]) -> np.ndarray:
        """Margins after each of ``rounds`` (ascending), from one pass over the trees."""
        out, want = np.zeros((len(bins), len(rounds))), {r: i for i, r in enumerate(rounds)}
        for n, total in enumerate(self.margins(bins), 1):
            if n in want:
                out[:, want[n]] = total
        return out

    def importance(self, features: int) -> np.ndarray:
        """Mean gain of the splits of each feature, as shares."""
        split = self.feature >= 0
        total = np.bincount(self.feature[split], self.gain[split], features)
        mean = total / np.maximum(np.bincount(self.feature[split], minlength=features), 1)
        return mean / mean.sum() if mean.sum() > 0 else mean


def sigmoid(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-margin))


# --- binning -----------------------------------------------------------------
def edges(df: DataFrame, features: list, bins: int = BINS) -> list[list[float]]:
    """Ascending cut points of each feature, from one aggregation of quantiles."""
    shares = [i / bins for i in range(1, bins)]
    row = df.agg(*[F.percentile_approx(c.cast("double"), shares, 10_000).alias(f"q{i}") for i, c in enumerate(features)]).first()
    return [sorted(set(q or [])) for q in row]


def bins_of(features: list, cuts: list[list[float]]) -> F.Column:
    """Array of the bins: how many cut points each feature is above."""
    def one(c, q):
        if not q:
            return F.lit(0).cast("tinyint")
        return F.size(F.filter(F.array(*[F.lit(float(x)) for x in q]), lambda e: e < F.coalesce(c.cast("double"), F.lit(float("-inf"))))).cast("tinyint")
    return F.array(*[one(c, q) for c, q in zip(features, cuts, strict=True)])


def with_bins(df: DataFrame, features: list, cuts: list[list[float]], out: str = "bins") -> DataFrame:
    """``df`` with the array of ``bins_of``, each feature by a binary search over its cut points."""
    cuts = [[x for x in q if x == x] for q in cuts]   # nothing is above a NaN
    found = [i for i, q in enumerate(cuts) if any(x < np.inf for x in q)]
    names, value = [f"__x{i}" for i in range(len(features))], lambda c: F.coalesce(c.cast("double"), F.lit(float("-inf")))
    d = df.select("*", *[value(c).alias(n) for c, n in zip(features, names, strict=True)])
    # A bucket begins at its split; a value is above a cut from the next larger number on.
    splits = [[-np.inf, *(float(np.nextafter(x, np.inf)) for x in cuts[i] if x < np.inf), np.inf] for i in found]
    if found:
        d = Bucketizer(splitsArray=splits, inputCols=[f"__y{i}" for i in found], outputCols=[f"__b{i}" for i in found]).transform(
            d.withColumns({f"__y{i}": F.when(F.isnan(names[i]), F.lit(float("inf"))).otherwise(F.col(names[i])) for i in found}))
    bins = [F.when(F.isnan(n), F.lit(float(len(q)))).otherwise(F.col(f"__b{i}") if i in found else F.lit(0.0)).cast("tinyint") for i, (n, q) in enumerate(zip(names, cuts, strict=True))]
    return d.withColumn(out, F.array(*bins)).select(*dict.fromkeys([*df.columns, out]))


def counted(df: DataFrame, label: str = "Survived", bins: str = "bins", group: str | None = None, fold: str | None = None) -> DataFrame:
    """(group, fold, bins, n0, n1): distinct binned rows and how many rows of either label they stand for."""
    y = F.col(label).cast("int")
    return (df.where(F.col(label).isNotNull())
            .groupBy((F.col(group) if group else F.lit("")).alias("group"), (F.col(fold) if fold else F.lit(-1)).cast("int").alias("fold"), F.col(bins).alias("bins"))
            .agg(F.sum(1 - y).alias("n0"), F.sum(y).alias("n1")))


def _arrays(batch) -> tuple[np.ndarray, ...]:
    n = batch.num_rows
    bins = batch.column("bins").combine_chunks() if isinstance(batch, pa.Table) else batch.column("bins")
    flat = bins.flatten().to_numpy(zero_copy_only=False).astype(np.uint8)
    return (np.array(batch.column("group").to_pylist(), object), np.array(batch.column("fold").to_pylist(), np.int64),
            flat.reshape(n, -1) if n else np.zeros((0, 1), np.uint8), np.array(batch.column("n0").to_pylist(), np.int64), np.array(batch.column("n1").to_pylist(), np.int64))


def gathered(batches, rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches of at least ``rows``, but for the last."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


# --- one tree ------------------------------------------------------------------
def _drawn(cell: Cell, tree: int, block: int, n0: np.ndarray, n1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of either label that a tree is grown on."""
    p = cell.params
    if p.rows >= 1:
        return n0, n1
    rng = np.random.default_rng([p.seed, tree, block])
    return rng.binomial(n0, p.rows), rng.binomial(n1, p.rows)


def _columns(cell: Cell, tree: int, features: int) -> np.ndarray:
    p = cell.params
    n = max(1, round(p.columns * features))
    return np.sort(np.random.default_rng([p.seed, tree, 1 << 20]).choice(features, n, replace=False)) if n < features else np.arange(features)


def _gradients(margin: np.ndarray, k0: np.ndarray, k1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = sigmoid(margin)
    return p * (k0 + k1) - k1, p * (1 - p) * (k0 + k1)


def _histograms(bins: np.ndarray, at: np.ndarray, nodes: int, g: np.ndarray, h: np.ndarray, columns: np.ndarray | None = None) -> np.ndarray:
    """nodes x features x BINS x (G, H) of the rows whose ``at`` is a node; with
    ``columns`` only these and the first feature, whose bins give the sums of a
    node, are counted and the others are 0."""
    out = np.zeros((nodes, bins.shape[1], BINS, 2))
    live = np.flatnonzero(at >= 0)
    every = len(live) == len(at)
    first, weights = at[live] * BINS, [w if every else w[live] for w in (g, h)]
    for f in range(bins.shape[1]) if columns is None else sorted({0, *columns.tolist()}):
        key = first + (bins[:, f] if every else bins[live, f])
        for i, w in enumerate(weights):
            out[:, f, :, i] = np.bincount(key, w, nodes * BINS).reshape(nodes, BINS)
    return out


def _choose(hist: np.ndarray, p: Params, columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per node: feature (-1: none pays), cut, gain, and the leaf value it would have."""
    whole = hist[:, 0].sum(axis=1)
    left = hist[:, columns].cumsum(axis=2)[:, :, :-1]
    right = whole[:, None, None] - left
    score = lambda x: x[..., 0] ** 2 / (x[..., 1] + p.lam)
    gain = 0.5 * (score(left) + score(right) - score(whole)[:, None, None]) - p.gamma
    gain[(left[..., 1] < p.least_weight) | (right[..., 1] < p.least_weight)] = -np.inf
    flat = gain.reshape(len(hist), -1)
    best = flat.argmax(axis=1)
    top = flat[np.arange(len(hist)), best]
    pays = top > 1e-12
    return (np.where(pays, columns[best // (BINS - 1)], -1), best % (BINS - 1), np.where(pays, top, 0),
            -p.rate * whole[:, 0] / (whole[:, 1] + p.lam))


def _set_level(trees: Trees, t: int, level: int, found: tuple[np.ndarray, ...], nodes: np.ndarray, last: bool) -> None:
    """Write the choices for the ``nodes`` (places in the level) of a tree."""
    at = 2**level - 1 + nodes
    feature, cut, gain, value = found
    trees.value[t, at] = value
    if not last:
        trees.feature[t, at], trees.cut[t, at], trees.gain[t, at] = feature, cut, gain


def auc(margin: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> float:
    """Share of (0, 1) pairs in the right order, ties half; one half without a pair."""
    value, at = np.unique(margin, return_inverse=True)
    neg, pos = np.bincount(at, n0, len(value)), np.bincount(at, n1, len(value))
    pairs = neg.sum() * pos.sum()
    return float((pos * (neg.cumsum() - neg / 2)).sum() / pairs) if pairs else 0.5


def stop_at(series: list[float], patience: int) -> tuple[int, bool]:
    """Rounds to keep (up to the first best value), and whether ``patience`` rounds went by without a better one."""
    best = int(np.argmax(series)) if series else 0
    return best + 1, len(series) - 1 - best >= patience


def distinct(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different rows of ``bins``, and which of them each row is."""
    if not len(bins):
        return bins, np.zeros(0, np.int64)
    _, first, back = np.unique(np.ascontiguousarray(bins).view(f"V{bins.shape[1] * bins.itemsize}").ravel(), return_index=True, return_inverse=True)
    return bins[first], back.reshape(-1)


def grow(cell: Cell, group: np.ndarray, fold: np.ndarray, bins: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> Trees:
    """All trees of a cell from a whole binned table."""
    p = cell.params
    own = (group == cell.group) if cell.group else np.ones(len(fold), bool)
    used = own & ~np.isin(fold, cell.without)
    valid = own & (fold == cell.valid) if cell.patience else np.zeros(len(fold), bool)
    v_bins, v0, v1, v_margin = bins[valid], n0[valid], n1[valid], np.zeros(valid.sum())
    bins, n0, n1 = bins[used], n0[used], n1[used]
    # Rows are drawn as they are; those of several folds that are equal then count as one.
    back = None
    if len(np.unique(fold[used])) > 1:
        bins, back = distinct(bins)
    bins = np.asfortranarray(bins)
    trees, margin = Trees.none(p.depth, p.rounds), np.zeros(len(bins))
    for t in range(p.rounds):
        drawn = _drawn(cell, t, 0, n0, n1)
        g, h = _gradients(margin, *(drawn if back is None else (np.bincount(back, k, len(bins)) for k in drawn)))
        columns = _columns(cell, t, bins.shape[1])
        at, slot, level = np.zeros(len(bins), np.int64), np.zeros(len(bins), np.int64), 0
        while True:
            live = np.flatnonzero(at >= 0)
            nodes = np.flatnonzero(np.bincount(at[live], minlength=2**level))
            if not len(nodes):
                break
            last = level == p.depth
            tried = np.zeros(1, np.int64) if last else columns
            place = np.full(2**level, -1, np.int64)
            place[nodes] = np.arange(len(nodes))
            slot[live] = 2**level - 1 + at[live]
            found = _choose(_histograms(bins, np.where(at >= 0, place[at], -1), len(nodes), g, h, tried), p, tried)
            _set_level(trees, t, level, found, nodes, last)
            if last:
                break
            f = np.where(at >= 0, trees.feature[t, slot], -1)
            inner = np.flatnonzero(f >= 0)
            right = bins[inner, f[inner]] > trees.cut[t, slot[inner]]
            at[inner] = 2 * at[inner] + right
            at[f < 0] = -1
            level += 1
        margin = margin + trees.value[t, slot]
        if cell.patience:
            v_margin = v_margin + trees.value[t, trees.leaves(t, v_bins)]
            trees.auc.append(auc(v_margin, v0, v1))
            keep, done = stop_at(trees.auc, cell.patience)
            if done:
                return trees.first(keep)
    return trees.first(stop_at(trees.auc, cell.patience)[0]) if cell.patience else trees


# --- all cells -------------------------------------------------------------------
def _local(table: DataFrame, cells: list[Cell]) -> dict:
    spark = table.sparkSession
    held = _arrays(table.toArrow())  # at most LOCAL_ROWS rows

    def fit_one(batches):
        for batch in batches:
            for i in batch.column("id").to_pylist():
                trees = grow(cells[i], *held)
                yield pa.RecordBatch.from_pydict({"id": pa.array([i], pa.int64()), "trees": pa.array([pickle.dumps(trees)], pa.binary())})
    ids = spark.range(len(cells)).repartitionByRange(len(cells), "id")
    return {cells[r.id].key: pickle.loads(r.trees) for r in ids.mapInArrow(fit_one, "id long, trees binary").collect()}


_HIST = "cell int, node int, salt int, hist binary"


def _summed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(b) for b in rows["hist"])
    return pd.DataFrame({"cell": [int(rows["cell"].iloc[0])], "node": [int(rows["node"].iloc[0])], "salt": [0], "hist": [total.tobytes()]})


def _spread(table: DataFrame, cells: list[Cell]) -> dict:
    """Trees of all cells, level by level in the cluster."""
    blocks, path = written(table.mapInArrow(_pack(len(cells)), _BLOCK))
    width = table.select(F.size("bins")).first()[0]
    made = [Trees.none(c.params.depth, c.params.rounds) for c in cells]
    busy, since = set(range(len(cells))), 0
    for t in range(max(c.params.rounds for c in cells)):
        busy = {i for i in busy if t < cells[i].params.rounds}
        if not busy:
            break
        for level in range(max(cells[i].params.depth for i in busy) + 1):
            state = _State(cells, made, sorted(i for i in busy if level <= cells[i].params.depth), since, t, level)
            parts = blocks.mapInArrow(state.histograms, _HIST)
            sums = parts.groupBy("cell", "node", "salt").applyInPandas(_summed, _HIST).groupBy("cell", "node").applyInPandas(_summed, _HIST)
            any_split = False
            for r in sums.mapInArrow(state.choices(width), "cell int, node int, feature int, cut int, gain double, value double").collect():
                found = tuple(np.array([v]) for v in (r.feature, r.cut, r.gain, r.value))
                last = level == cells[r.cell].params.depth
                _set_level(made[r.cell], t, level, found, np.array([r.node]), last)
                any_split |= r.feature >= 0 and not last
            if not any_split:
                break
        for i in [i for i in busy if cells[i].patience]:
            made[i].auc.append(_spread_auc(blocks, cells, made, i, since, t))
            keep, done = stop_at(made[i].auc, cells[i].patience)
            if done:
                busy.discard(i)
        if (t + 1) % KEPT == 0:
            state = _State(cells, made, sorted(busy), since, t + 1, 0)
            nxt, at = written(blocks.mapInArrow(state.moved, _BLOCK))
            drop_table(blocks.sparkSession, path)
            blocks, path, since = nxt, at, t + 1
    drop_table(table.sparkSession, path)
    return {c.key: m.first(stop_at(m.auc, c.patience)[0]) if c.patience else m for c, m in zip(cells, made, strict=True)}


_BLOCK = "block long, n int, width int, groups array<string>, folds binary, bins binary, n0 binary, n1 binary, margins binary"


def _pack(cells: int):
    def run(batches):
        made = 0
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK_ROWS):
                group, fold, bins, n0, n1 = _arrays(batch.slice(i, BLOCK_ROWS))
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([(TaskContext.get().partitionId() << 20) + made], pa.int64()), "n": pa.array([len(n0)], pa.int32()),
                    "width": pa.array([bins.shape[1]], pa.int32()), "groups": pa.array([group.tolist()], pa.list_(pa.string())),
                    **{k: pa.array([v.tobytes()], pa.binary()) for k, v in (("folds", fold), ("bins", bins), ("n0", n0), ("n1", n1), ("margins", np.zeros((cells, len(n0)))))}})
                made += 1
    return run


class _State:
    """What a job over the blocks needs: the trees of tree ``since`` on, and the level that tree ``t`` has reached."""

    def __init__(self, cells, made, busy, since, t, level):
        self.cells, self.busy, self.since, self.t, self.level = cells, busy, since, t, level
        # Only the trees after the last table of blocks go out.
        self.trees = {i: Trees(m.feature[since:t + 1], m.cut[since:t + 1], m.value[since:t + 1], m.gain[since:t + 1]) for i, m in enumerate(made) if i in busy}

    def _blocks(self, batches):
        for batch in batches:
            for b in batch.to_pylist():
                n = b["n"]
                yield b, np.array(b["groups"], object), np.frombuffer(b["folds"], np.int64), np.frombuffer(b["bins"], np.uint8).reshape(n, b["width"]), \
                    np.frombuffer(b["n0"], np.int64), np.frombuffer(b["n1"], np.int64), np.frombuffer(b["margins"]).reshape(-1, n)

    def _margin(self, i: int, bins: np.ndarray, before: np.ndarray, trees: int) -> np.ndarray:
        for total in self.trees[i].first(trees).margins(bins):
            last = total
        return before + last if trees else before

    def histograms(self, batches):
        held: dict[tuple[int, int], np.ndarray] = {}
        done = self.t - self.since
        for b, group, fold, bins, n0, n1, margins in self._blocks(batches):
            for i in self.busy:
                cell = self.cells[i]
                used = ~np.isin(fold, cell.without) & ((group == cell.group) if cell.group else True)
                x, k0, k1 = bins[used], n0[used], n1[used]
                g, h = _gradients(self._margin(i, x, margins[i][used], done), *_drawn(cell, self.t, b["block"], k0, k1))
                at = self._places(self.trees[i], done, x)
                nodes, place = np.unique(at, return_inverse=True)
                hist = _histograms(x, np.where(at >= 0, place, -1), len(nodes), g, h)
                for j, node in enumerate(nodes.tolist()):
                    if node >= 0:
                        held[i, node] = held.get((i, node), 0) + hist[j]
        if held:
            yield pa.RecordBatch.from_pydict({
                "cell": pa.array([k[0] for k in held], pa.int32()), "node": pa.array([k[1] for k in held], pa.int32()),
                "salt": pa.array([TaskContext.get().partitionId() % SALTS] * len(held), pa.int32()), "hist": pa.array([v.tobytes() for v in held.values()], pa.binary())})

    def _places(self, trees: Trees, tree: int, bins: np.ndarray) -> np.ndarray:
        """Place in the level of each row; -1 where it is in a leaf above."""
        node = trees.leaves(tree, bins)
        first = 2**self.level - 1
        return np.where(node >= first, node - first, -1)

    def choices(self, width: int):
        def run(batches):
            for batch in batches:
                out = {k: [] for k in ("cell", "node", "feature", "cut", "gain", "value")}
                for i, node, hist in zip(*(batch.column(c).to_pylist() for c in ("cell", "node", "hist")), strict=True):
                    cell = self.cells[i]
                    found = _choose(np.frombuffer(hist).reshape(1, width, BINS, 2), cell.params, _columns(cell, self.t, width))
                    for k, v in zip(out, (i, node, *(f[0].item() for f in found)), strict=True):
                        out[k].append(v)
                kinds = [pa.int32()] * 4 + [pa.float64()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(out.values(), kinds, strict=True)], names=list(out))
        return run

    def moved(self, batches):
        """The blocks with the margins after all trees so far."""
        for b, _, _, bins, _, _, margins in self._blocks(batches):
            margins = margins.copy()
            for i in self.busy:
                margins[i] = self._margin(i, bins, margins[i], self.t - self.since)
            b["margins"] = margins.tobytes()
            yield pa.RecordBatch.from_pylist([b], schema=pa.schema([
                ("block", pa.int64()), ("n", pa.int32()), ("width", pa.int32()), ("groups", pa.list_(pa.string())),
                *((k, pa.binary()) for k in ("folds", "bins", "n0", "n1", "margins"))]))

    def valid(self, batches):
        [i] = self.busy
        cell = self.cells[i]
        for _, group, fold, bins, n0, n1, margins in self._blocks(batches):
            own = (fold == cell.valid) & ((group == cell.group) if cell.group else True)
            m = self._margin(i, bins[own], margins[i][own], self.t - self.since)
            yield pa.RecordBatch.from_pydict({"m": pa.array(m), "n0": pa.array(n0[own]), "n1": pa.array(n1[own])})


def _spread_auc(blocks: DataFrame, cells: list[Cell], made: list[Trees], i: int, since: int, t: int) -> float:
    """AUC of a cell's valid rows after tree ``t``, by the ordered sums of the profile operators."""
    from .evaluate import weighted_auc
    return weighted_auc(blocks.mapInArrow(_State(cells, made, [i], since, t + 1, 0).valid, "m double, n0 long, n1 long"), "m", "n0", "n1")


def fit(table: DataFrame, cells: list[Cell], local_rows: int | None = None) -> dict:
    """Trees of each cell by its key, from a table of ``counted`` rows."""
    held, path = written(table)
    try:
        if held.count() <= (LOCAL_ROWS if local_rows is None else local_rows):
            return _local(held, cells)
        return _spread(held, cells)
    finally:
        drop_table(table.sparkSession, path)


def score(df: DataFrame, trees: dict, rounds: list[int] | None = None, by: str | None = None, bins: str = "bins") -> DataFrame:
    """``df`` without its bins and with p, or, for ``rounds``, ``ps``: the
    probability after each of these numbers of rounds. ``by`` names the column
    that holds the key of a row's trees (all rows have the only ones otherwise)."""
    kept = [c for c in df.columns if c != bins]
    only = next(iter(trees.values()))

    def run(batches):
        for batch in gathered(batches, BLOCK_ROWS):
            n = batch.num_rows
            x = batch.column(bins).flatten().to_numpy(zero_copy_only=False).astype(np.uint8).reshape(n, -1) if n else np.zeros((0, 1), np.uint8)
            coded = batch.column(by).dictionary_encode() if by else None
            at = coded.indices.to_numpy(zero_copy_only=False) if by else np.zeros(n, np.int64)
            out = np.zeros((n, len(rounds) if rounds else 1))
            for i, key in enumerate(coded.dictionary.to_pylist() if by else [None] if n else []):
                rows = at == i
                own = trees[key] if by else only
                # Equal rows are scored once.
                different, back = distinct(x[rows])
                out[rows] = sigmoid(own.at(different, rounds or [len(own.feature)]))[back]
            made = pa.array(out.tolist(), pa.list_(pa.float64())) if rounds else pa.array(out[:, 0])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), made], names=[*kept, "ps" if rounds else "p"])
    from pyspark.sql import types as T
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField("ps", T.ArrayType(T.DoubleType())) if rounds else T.StructField("p", T.DoubleType())])
    return df.select(*kept, bins).mapInArrow(run, schema)


def with_rounds(p: Params, rounds: int) -> Params:
    return replace(p, rounds=rounds)
