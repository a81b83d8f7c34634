"""Embedding whitening by incremental eigendecomposition.

Vectors become integers, x = floor(256 c), and each distinct x is fitted once:

1. the distinct vectors are a table in the shared folder, spread evenly, with
   their number n and the sums S, which are exact integers;
2. every task takes its vectors one by one: each moves the mean and changes the
   task's eigenpairs by a centred rank-one update (``spectra``);
3. the spectra of ``FAN`` tasks at a time are combined by successive rank-one
   updates, round by round, until one is left (d x d numbers a task);
4. a distributed Rayleigh-Ritz step refines it: the tasks sum the outer products
   of the centred vectors in that basis, and the eigenpairs of the sum are the
   components to double precision, whatever rounding the updates gathered.

Rows never meet in one task; what does is a spectrum of d x d numbers, and the
work grows with the distinct vectors.

Defined results: rows whose vector is null, empty, or holds a null or non-finite
entry are dropped, and so are vectors that are not of the most frequent length
(of equal ones the greatest); every other row gives a row per component, rows
repeated or without a vec_id too; a component whose eigenvalue is 0 (or below
1e-12 of the trace, as all are with one distinct vector) does not exist;
``deviation`` is null where it exceeds a long; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, drop_tables, write_table
from .spectra import Spectrum

COMPONENTS = 4
#: Eigenvalues below this share of the trace are none.
LEAST = 1e-12
#: States that one task combines in a round.
FAN = 16
#: Distinct vectors of a task: at least so many on a small table, at most so many on a large one.
FEW, MANY = 1024, 65536

_STATE = "part long, n long, a array<double>, b array<double>, c array<double>"


def integral(df: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows whose vector has entries, all of them finite."""
    e = F.col("embedding")
    bad = F.exists(e, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == F.lit(float("inf"))))
    kept = df.select("vec_id", "embedding").where(e.isNotNull() & (F.size(e) > 0) & ~bad)
    return kept.select("vec_id", F.transform(e, lambda c: F.floor(F.lit(256.0) * c.cast("double")).cast("long")).alias("x"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column("x")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _fold(df: DataFrame, merge, name: str) -> tuple | None:
    """One state from the states of all tasks: ``FAN`` at a time, in the order of their parts."""
    def one(_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        n, a, b, c = merge([(r.n, *(np.asarray(v, np.float64) for v in (r.a, r.b, r.c))) for r in rows.itertuples()])
        return pd.DataFrame({"part": [int(rows.part.iloc[0]) // FAN], "n": [int(n)], "a": [a.tolist()], "b": [b.tolist()], "c": [c.tolist()]})

    now, path = write_table(df, name)
    while (last := now.agg(F.max("part")).first()[0]) is not None and last > 0:
        nxt, at = write_table(now.groupBy(F.expr(f"part div {FAN}")).applyInPandas(one, _STATE), name)
        drop_tables(df.sparkSession, [path])
        now, path = nxt, at
    row = now.first()
    drop_tables(df.sparkSession, [path])
    return row and (row.n, *(np.array(v, np.float64) for v in (row.a, row.b, row.c)))


def _state(n: int, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "part": pa.array([TaskContext.get().partitionId()], pa.int64()), "n": pa.array([n], pa.int64()),
        **{k: pa.array([v.ravel()], pa.list_(pa.float64())) for k, v in (("a", a), ("b", b), ("c", c))}})


def _added(states: list[tuple]) -> tuple:
    return tuple(sum(parts[1:], parts[0]) for parts in zip(*states, strict=True))


def totals(fit: DataFrame) -> tuple[int, list[int]]:
    """n and the exact sums of each dimension."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = 0, 0
        for batch in batches:
            x = _matrix(batch)
            n += len(x)
            wide = x if np.abs(x.astype(np.float64)).max(initial=0) < 2**40 else x.astype(object)
            s = s + wide.sum(axis=0)
        if n:
            yield pa.RecordBatch.from_pydict({"n": pa.array([n] * len(s), pa.int64()), "at": pa.array(range(len(s)), pa.int64()),
                                              "s": pa.array([str(v) for v in s])})
    got = (fit.mapInArrow(add, "n long, at long, s string").groupBy("at")
           .agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("at").collect())
    return (got[0].n if got else 0), [int(r.s) for r in got]


@dataclass
class Whitening:
    """What was fitted: n vectors with sums S; ``components`` holds a unit eigenvector in each row."""
    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ (self.components / np.sqrt(self.values)[:, None]).T

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact."""
        reach = self.n * int(np.abs(x.astype(np.float64)).max(initial=0)) + max(map(abs, self.sums))
        if reach * reach * x.shape[1] < 2**62:
            off = self.n * x - np.array(self.sums, np.int64)
            return (off * off).sum(axis=1).tolist()
        off = self.n * x.astype(object) - np.array(self.sums, object)
        return [v if v < 2**63 else None for v in (off * off).sum(axis=1)]


def _spectra(fit: DataFrame, size: int) -> Spectrum:
    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Spectrum(size)
        for batch in batches:
            for x in _matrix(batch).astype(np.float64):
                s.add(x)
        if s.n:
            yield _state(s.n, s.mean, s.values, s.vectors)

    def merge(states):
        s = Spectrum(size)
        for n, mean, values, vectors in states:
            s.merge(Spectrum(size, n, mean, values, vectors.reshape(size, size)))
        return s.n, s.mean, s.values, s.vectors.ravel()
    n, mean, values, vectors = _fold(fit.mapInArrow(update, _STATE), merge, "spectra")
    return Spectrum(size, n, mean, values, vectors.reshape(size, size))


def _products(fit: DataFrame, turn) -> tuple[int, np.ndarray, np.ndarray]:
    """n, sums and sums of outer products of the rows that ``turn`` makes of the vectors."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, g = 0, 0, 0
        for batch in batches:
            y = turn(_matrix(batch).astype(np.float64))
            n, s, g = n + len(y), s + y.sum(axis=0), g + y.T @ y
        if n:
            yield _state(n, s, g, np.empty(0))
    n, s, g, _ = _fold(fit.mapInArrow(add, _STATE), _added, "products")
    return n, s, g.reshape(len(s), len(s))


def _spread(vectors: DataFrame, rows: int) -> DataFrame:
    parts = max(min(rows // FEW + 1, 4 * vectors.sparkSession.sparkContext.defaultParallelism), rows // MANY + 1)
    return vectors.distinct().repartition(parts, F.xxhash64("x"))


def fit(vectors: DataFrame, rows: int, size: int, components: int = COMPONENTS) -> tuple[Whitening | None, str]:
    """Whitening of the distinct ``x`` of ``size`` entries, and the path of their table."""
    table, path = write_table(_spread(vectors.select("x"), rows), "whitening-fit")
    n, sums = totals(table)
    if not n:
        return None, path
    mean = np.array([s / n for s in sums])
    basis = np.linalg.qr(_spectra(table, size).vectors)[0]
    _, _, ritz = _products(table, lambda x: (x - mean) @ basis)
    values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    trace = float(np.trace(ritz)) / n
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] / n > LEAST * trace]
    held = (basis @ turn[:, order]).T
    # Either sign is right; the greatest entry is made positive so that reruns agree.
    held *= np.sign(held[np.arange(len(held)), np.abs(held).argmax(axis=1)])[:, None] if len(held) else 1
    model = Whitening(n, sums, held, values[order] / n, trace, 0.0)
    if len(order):
        _, s, g = _products(table, model.whiten)
        model.identity_error = float(np.abs(g / n - np.outer(s / n, s / n) - np.eye(len(order))).max())
    return model, path


def whiten(df: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Per valid row of ``df`` (vec_id, embedding) and component: vec_id,
    component, n, deviation, whitened, explained, identity_error."""
    spark = df.sparkSession
    arrow_limits(spark)
    vectors = integral(df)
    lengths = vectors.groupBy(F.size("x").alias("size")).agg(F.count(F.lit(1)).alias("rows"))
    common = lengths.orderBy(F.desc("rows"), F.desc("size")).first()
    kind = df.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if common is None:
        return spark.createDataFrame([], schema)
    vectors = vectors.where(F.size("x") == common["size"])
    model, path = fit(vectors, common["rows"], common["size"], components)
    drop_tables(spark, [path])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        for batch in batches:
            x = _matrix(batch)
            m = len(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                 pa.array(np.full(m * k, model.n)), pa.array([v for v in model.deviation(x) for _ in range(k)], pa.int64()),
                 pa.array(model.whiten(x.astype(np.float64)).ravel()), pa.array(np.tile(model.values / model.trace, m) if k else np.empty(0)),
                 pa.array(np.full(m * k, model.identity_error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return vectors.mapInArrow(project, schema)
