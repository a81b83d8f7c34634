"""Linear machines over random Fourier features, several at once, from blocks of rows.

MLlib keeps ``dim`` doubles a row for each machine that it fits. Here the cluster
keeps the inputs of a row alone, in packed blocks; a pass makes the Fourier
features of one block at a time and adds up, for all machines, the loss, its
gradient and its second derivatives. Newton steps on these sums are taken on the
driver, so the passes do not depend on the rows and all machines share them.

The loss is that of ``LinearSVC``: mean hinge loss plus half ``reg`` times the
squared coefficients of the features scaled by their deviation. Its kink is
rounded over a margin of ``WIDTHS``, ever less; each row of a label counts once.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import drop_table, written
from .boosting import gathered

#: Rows of a block, of a table's partition, and of the Fourier features that a task has at a time.
BLOCK_ROWS, PART_ROWS, STEP_ROWS = 65_536, 262_144, 8_192
WIDTHS = (2.0, 0.5, 0.1, 0.03)
STEPS, CLOSE, NOISE = 20, 1e-6, 1e-7
#: Widths at which the machine of all rows moves alone.
ALONE = 2
#: Sums of tasks that one task adds up.
SALTS = 16
_BLOCK = "n int, x binary, y binary, part binary"


class Fourier:
    """z_j = scale cos(w_j . x + b_j) of rows of inputs."""

    def __init__(self, inputs: int, dim: int, gamma: float, seed: int):
        rng = np.random.default_rng(seed)
        self.w = rng.normal(0.0, np.sqrt(2 * gamma), size=(dim, inputs))
        self.b, self.scale = rng.uniform(0, 2 * np.pi, size=dim), np.sqrt(2.0 / dim)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.w.T.astype(x.dtype)
        z += self.b.astype(x.dtype)
        np.cos(z, out=z)
        z *= z.dtype.type(self.scale)
        return z


def _rows(batch, inputs: list[str]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in inputs], axis=1) if batch.num_rows else np.zeros((0, len(inputs)))


def packed(rows: DataFrame, inputs: list[str], label: str, part: str, n: int) -> tuple[DataFrame, str]:
    """A written table of blocks of the labelled rows, and its path."""
    def run(batches):
        for batch in gathered(batches, BLOCK_ROWS):
            yield pa.RecordBatch.from_pydict({
                "n": pa.array([batch.num_rows], pa.int32()), "x": pa.array([_rows(batch, inputs).astype(np.float32).tobytes()], pa.binary()),
                **{k: pa.array([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int8).tobytes()], pa.binary()) for k, c in (("y", label), ("part", part))}})
    d = rows.select(*[F.col(c).cast("double").alias(c) for c in inputs], label, part).repartition(1 + n // PART_ROWS)
    return written(d.mapInArrow(run, _BLOCK))


def _blocks(batches, inputs: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Inputs, signs and parts of rows, some at a time."""
    for batch in batches:
        for b in batch.to_pylist():
            x, y, part = np.frombuffer(b["x"], np.float32).reshape(b["n"], inputs), np.frombuffer(b["y"], np.int8), np.frombuffer(b["part"], np.int8)
            for i in range(0, b["n"], STEP_ROWS):
                some = slice(i, i + STEP_ROWS)
                yield x[some], 2 * y[some].astype(np.float32) - 1, part[some]


def _added(blocks: DataFrame, one: Callable, inputs: int) -> list[np.ndarray]:
    """Sums over all blocks of the arrays that ``one`` gives for some rows."""
    def run(batches):
        total = None
        for rows in _blocks(batches, inputs):
            got = one(*rows)
            total = got if total is None else [a + b for a, b in zip(total, got, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_pydict({"salt": pa.array([TaskContext.get().partitionId() % SALTS], pa.int32()), "sums": pa.array([pickle.dumps(total)], pa.binary())})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"salt": [int(rows["salt"].iloc[0])], "sums": [pickle.dumps([sum(x) for x in zip(*map(pickle.loads, rows["sums"]), strict=True)])]})
    schema = "salt int, sums binary"
    parts = blocks.mapInArrow(run, schema)
    if blocks.rdd.getNumPartitions() > 4 * SALTS:
        parts = parts.groupBy("salt").applyInPandas(add, schema)
    return [sum(x) for x in zip(*(pickle.loads(r.sums) for r in parts.collect()), strict=True)]


def fit(blocks: DataFrame, fourier: Fourier, folds: int, reg: float) -> np.ndarray:
    """Coefficients and, last, intercept of a machine without each part of the
    rows and of one with all of them: (folds + 1) x (dim + 1), for unscaled features."""
    inputs, dim, machines = fourier.w.shape[1], len(fourier.w), folds + 1

    def moments(x, _, part):
        z = fourier(x).astype(np.float64)
        own = [z[part == f] for f in range(folds)]
        return [np.array([len(o) for o in own]), np.array([o.sum(axis=0) for o in own]), np.array([(o * o).sum(axis=0) for o in own])]
    n, s, q = _added(blocks, moments, inputs)
    n, s, q = (np.stack([*(a.sum(axis=0) - a[f] for f in range(folds)), a.sum(axis=0)]) for a in (n, s, q))
    spread = np.sqrt(np.maximum(q - s * s / np.maximum(n, 1)[:, None], 0) / np.maximum(n - 1, 1)[:, None])
    # A feature of one value has no coefficient; the intercept is neither scaled nor held small.
    unit = np.concatenate([np.divide(1, spread, out=np.zeros_like(spread), where=spread > 1e-6), np.ones((machines, 1))], axis=1)
    held = np.append(np.full(dim, reg), 0.0)

    def sums(at: np.ndarray, width: float, which: np.ndarray):
        def one(x, sign, part):
            z = np.concatenate([fourier(x), np.ones((len(x), 1), np.float32)], axis=1)
            short = 1 - sign[:, None] * (z @ at[which].T.astype(np.float32))
            inside = np.clip((short + width) / (2 * width), 0, 1)
            loss = np.where(short >= width, short, width * inside * inside)
            # The last machine sees all parts.
            seen = part[:, None] != which
            bent = seen & (np.abs(short) < width)
            second = np.zeros((len(which), dim + 1, dim + 1))
            for i in range(len(which)):
                own = z[bent[:, i]]
                second[i] = own.T @ own / (2 * width)
            return [np.where(seen, loss, 0).sum(axis=0, dtype=np.float64), (z.T @ np.where(seen, -sign[:, None] * inside, 0)).T.astype(np.float64), second]
        return _added(blocks, one, inputs)
    u, count = np.zeros((machines, dim + 1)), np.maximum(n, 1)
    for i, width in enumerate(WIDTHS):
        # The machine of all rows goes ahead; the others, which see most of them, start from where it is.
        moving = np.arange(machines) == folds if i < ALONE else np.ones(machines, bool)
        if i == ALONE:
            u[:folds] = np.divide(u[folds] * unit[folds], unit[:folds], out=np.zeros_like(u[:folds]), where=unit[:folds] > 0)
        before, step, slope, damp = np.full(machines, np.inf), np.zeros_like(u), np.zeros(machines), np.zeros(machines)
        for _ in range(STEPS):
            which = np.flatnonzero(moving)
            for m, loss, first, second in zip(which, *sums(u * unit, width, which), strict=True):
                value = loss / count[m] + (held * u[m] * u[m]).sum() / 2
                if value > before[m] + NOISE:  # too far: back to where the parabola through both values is least
                    kept = np.clip(slope[m] / 2 / (value - before[m] + slope[m]), 0.02, 0.5)
                    u[m] += (1 - kept) * step[m]
                    step[m], slope[m], damp[m] = step[m] * kept, slope[m] * kept, max(3 * damp[m], 0.03)
                    continue
                g = first * unit[m] / count[m] + held * u[m]
                h = second * np.outer(unit[m], unit[m]) / count[m] + np.diag(held + damp[m] + 1e-6)
                before[m], step[m] = value, np.linalg.solve(h, g)
                slope[m], damp[m] = g @ step[m], damp[m] / 3
                moving[m] = slope[m] / 2 > CLOSE
                u[m] -= step[m]
            if not moving.any():
                break
    return u * unit


def held_out(blocks: DataFrame, fourier: Fourier, machines: np.ndarray) -> DataFrame:
    """(margin, label) of each row by the machine that did not see it."""
    inputs = fourier.w.shape[1]

    def run(batches):
        for x, sign, part in _blocks(batches, inputs):
            z = fourier(x.astype(np.float64))
            margin = (z * machines[part, :-1]).sum(axis=1) + machines[part, -1]
            yield pa.RecordBatch.from_pydict({"margin": pa.array(margin), "label": pa.array((sign > 0).astype(np.int32))})
    return blocks.mapInArrow(run, "margin double, label int")


def score(df: DataFrame, inputs: list[str], fourier: Fourier, machine: np.ndarray, slope: float, intercept: float) -> DataFrame:
    """``df`` with p: the logistic function of a machine's margin."""
    names = df.columns

    def run(batches):
        for batch in batches:
            margin = fourier(_rows(batch, inputs)) @ machine[:-1] + machine[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-(slope * margin + intercept))))], names=[*names, "p"])
    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("p", T.DoubleType())]))


def drop(blocks: DataFrame, path: str) -> None:
    drop_table(blocks.sparkSession, path)
