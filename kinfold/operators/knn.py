"""Exact k-nearest-neighbour scoring in two phases, without a joined row for each pair.

Reference rows go to the nearest of about sqrt(n) pivots (reference rows by a
hash of their id, at most ``PIVOTS``) and are written in blocks of at most
``BLOCK`` rows of one partition. Queries are dealt into blocks in the same way.

1. A query meets the blocks of its nearest pivot's partition; its k-th distance
   there is a true bound ``tau``.
2. It goes on to another partition only if that can hold a point within ``tau``:
   points there lie within the partition's radius of its pivot, and nearer to
   that pivot than to the query's own.

Phase 1 joins blocks of queries with blocks of references; a task compares two
blocks with one matrix product and passes on at most k rows a query. A
partition with many rows is many blocks, dealt into slices of ``SLICE`` blocks,
so no join key holds more.

Phase 2 is a grid: queries and references are dealt into groups of at most
``GROUP_BYTES`` of vectors, and each cell of the grid gets one group of either
(about ``CELLS`` cells, more only with more groups). So a row is shuffled once
for each group of the other side, however many partitions a query must see. In
a cell the queries go ``BLOCK`` at a time, ordered by partition, over the
references of the partitions that one of them must see; a bound falls with the
neighbours that the cell has found, and at most k rows a query leave it.

Candidates are chosen by the product and ranked by the distance added up entry
by entry; ties go to the smaller reference id.

A query without a vector gives no row, and so does an empty reference;
references without a vector are none. All vectors have one length. The answer
is exact for any data; pruning only decides how much work it takes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import drop_table, written
from .joins import join_null_safe

PIVOTS = 4096
BLOCK = 512
SLICE = 16
#: Bytes of vectors of a group of either side, and cells of the grid of a small query set.
GROUP_BYTES = 32 << 20
CELLS = 64
#: Relative room for the rounding of bounds and products.
SLACK = 1e-9


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``a`` to those of ``b`` by one product; within ``SLACK`` of their size."""
    return np.maximum((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1), 0)


def _placed(pivots: np.ndarray, vec: str):
    """mapInArrow function that adds the nearest pivot and the distance to it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(vec))
            near = _distances(x, pivots).argmin(axis=1) if len(x) else np.empty(0, np.int64)
            far = np.sqrt(((x - pivots[near]) ** 2).sum(axis=1)) if len(x) else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int64()), pa.array(far)], names=[*batch.schema.names, "part", "far"])
    return run


def _blocks(df: DataFrame, id_type: T.DataType, extra: list[tuple[str, T.DataType]]) -> DataFrame:
    """(part, id, vec, ...) -> blocks (part, slice, ids, vecs, ...) of one part."""
    names = ["id", "vec", *(n for n, _ in extra)]
    kinds = {"id": to_arrow_type(id_type), "vec": pa.list_(pa.float64()), **{n: to_arrow_type(t) for n, t in extra}}

    def pack(batches):
        held, part, made = [], None, 0

        def out():
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int64()), "slice": pa.array([(TaskContext.get().partitionId() << 32) + made // SLICE], pa.int64()),
                **{n: pa.array([[r[i] for r in held]], pa.list_(kinds[n])) for i, n in enumerate(names)}})
        for batch in batches:
            for p, *row in zip(*(batch.column(c).to_pylist() for c in ("part", *names)), strict=True):
                if held and (p != part or len(held) == BLOCK):
                    yield out()
                    made = made + 1 if p == part else 0
                    held = []
                part = p
                held.append(row)
        if held:
            yield out()
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([T.StructField("part", T.LongType()), T.StructField("slice", T.LongType()), T.StructField("id", T.ArrayType(id_type)),
                           T.StructField("vec", T.ArrayType(T.ArrayType(T.DoubleType()))), *(T.StructField(c, T.ArrayType(t)) for c, t in extra)])
    return df.select("part", *names).repartitionByRange(n, "part", "id").sortWithinPartitions("part", "id").mapInArrow(pack, schema)


def _compared(asked: DataFrame, blocks: DataFrame, k: int, qid_type: T.DataType, rid_type: T.DataType) -> DataFrame:
    """At most k (qid, rid, d2, label) for each query of ``asked`` and block, within the query's ``tau``."""
    slices = blocks.select("part", "slice").distinct()
    met = (asked.drop("slice").join(slices, "part").withColumnsRenamed({"id": "qid", "vec": "qvec"})
           .join(blocks.withColumnRenamed("id", "rid"), ["part", "slice"]))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                qids, rids = batch.column("qid")[i].as_py(), batch.column("rid")[i].as_py()
                q, r = _matrix(batch.column("qvec")[i].values), _matrix(batch.column("vec")[i].values)
                tau, labels = np.array(batch.column("tau")[i].as_py()), batch.column("label")[i].as_py()
                d2 = _distances(q, r)
                room = SLACK * (d2.max(initial=0) + 1)
                kth = np.partition(d2, min(k, d2.shape[1]) - 1, axis=1)[:, min(k, d2.shape[1]) - 1]
                a, b = np.nonzero(d2 <= np.minimum(kth, tau * tau * (1 + SLACK))[:, None] + room)
                exact = np.zeros(len(a))
                for c in range(q.shape[1]):  # entry by entry, as the sum is defined
                    exact += (q[a, c] - r[b, c]) ** 2
                yield pa.RecordBatch.from_arrays(
                    [pa.array([qids[j] for j in a], to_arrow_type(qid_type)), pa.array([rids[j] for j in b], to_arrow_type(rid_type)),
                     pa.array(exact), pa.array([labels[j] for j in b], pa.float64())], names=["qid", "rid", "d2", "label"])
    schema = T.StructType([T.StructField("qid", qid_type), T.StructField("rid", rid_type), T.StructField("d2", T.DoubleType()), T.StructField("label", T.DoubleType())])
    near = met.select("qid", "qvec", "tau", "rid", "vec", "label").mapInArrow(run, schema)
    w = Window.partitionBy("qid").orderBy("d2", "rid")
    return near.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn")


def _needed(x: np.ndarray, own: np.ndarray, tau: np.ndarray, pivots: np.ndarray, apart: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Query x partition: whether another than the own one can hold a point within tau."""
    d2 = _distances(x, pivots)
    room = SLACK * (d2.max(initial=0) + 1)
    reach = (tau * (1 + SLACK))[:, None]
    at = np.arange(len(x))
    ball = np.sqrt(d2) <= radius[None, :] + reach + math.sqrt(room)
    with np.errstate(invalid="ignore"):
        half = (d2 - d2[at, own][:, None] <= 2 * apart[own] * reach + 2 * room) | np.isinf(reach)
    need = ball & half & (radius >= 0)[None, :]
    need[at, own] = False
    return need


def _left_pairs(pivots: np.ndarray, radius: np.ndarray, held: np.ndarray):
    """mapInArrow function: the pairs that the bounds leave to the queries of a batch in phase 2."""
    apart = np.sqrt(_distances(pivots, pivots))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                need = _needed(_matrix(batch.column("vec")), batch.column("part").to_numpy(), batch.column("tau").to_numpy(), pivots, apart, radius)
                yield pa.RecordBatch.from_arrays([pa.array([int((need @ held).sum())], pa.int64())], names=["p"])
    return run


def _best(q: np.ndarray, x: np.ndarray, order: np.ndarray, k: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the candidate pairs (a, b) the k nearest of each a by (distance, order), with the distances."""
    exact = np.zeros(len(a))
    for c in range(q.shape[1]):  # entry by entry, as the sum is defined
        exact += (q[a, c] - x[b, c]) ** 2
    by = np.lexsort((order[b], exact, a))
    a, b, exact = a[by], b[by], exact[by]
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
    rank = np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)]))
    return a[rank < k], b[rank < k], exact[rank < k]


def _cell(pivots: np.ndarray, radius: np.ndarray, k: int, qid_type: T.DataType, rid_type: T.DataType):
    """Cogroup function of a cell: for each of its queries at most k rows (qid, rid, d2, label) from other partitions than its own, within tau."""
    apart = np.sqrt(_distances(pivots, pivots))
    schema = pa.schema([("qid", to_arrow_type(qid_type)), ("rid", to_arrow_type(rid_type)), ("d2", pa.float64()), ("label", pa.float64())])

    def ordered(t: pa.Table) -> pa.Table:
        return t.take(pc.sort_indices(t["part"]))

    def run(asked: pa.Table, refs: pa.Table) -> pa.Table:
        if not (asked.num_rows and refs.num_rows):
            return schema.empty_table()
        asked, refs = ordered(asked), ordered(refs)
        all_q, own, tau = _matrix(asked["vec"].combine_chunks()), asked["part"].to_numpy(), asked["tau"].to_numpy()
        all_r, part = _matrix(refs["vec"].combine_chunks()), refs["part"].to_numpy()
        order = pc.rank(refs["rid"].combine_chunks(), sort_keys="ascending", null_placement="at_start", tiebreaker="first").to_numpy()
        made = []
        for i in range(0, len(own), BLOCK):
            q, mine, near = all_q[i:i + BLOCK], own[i:i + BLOCK], tau[i:i + BLOCK].copy()
            seen = np.flatnonzero(_needed(q, mine, near, pivots, apart, radius).any(axis=0)[part])
            a, b, exact = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            for j in range(0, len(seen), 4 * BLOCK):
                at = seen[j:j + 4 * BLOCK]
                d2 = _distances(q, all_r[at])
                room = SLACK * (d2.max(initial=0) + 1)
                d2[mine[:, None] == part[at][None, :]] = np.inf  # phase 1 has these
                n = min(k, len(at))
                kth = np.partition(d2, n - 1, axis=1)[:, n - 1] if n == k else np.full(len(q), np.inf)
                u, v = np.nonzero((d2 <= np.minimum(kth, near * near * (1 + SLACK))[:, None] + room) & (d2 < np.inf))
                if len(u):
                    a, b, exact = _best(q, all_r, order, k, np.r_[a, u], np.r_[b, at[v]])
                    full = np.bincount(a, minlength=len(q)) == k
                    far = np.zeros(len(q))
                    np.maximum.at(far, a, exact)
                    near[full] = np.minimum(near[full], np.sqrt(far[full]))
            if len(a):
                made.append(pa.Table.from_arrays([asked["qid"].take(pa.array(a + i)), refs["rid"].take(pa.array(b)), pa.array(exact), refs["label"].take(pa.array(b))], schema=schema))
        return pa.concat_tables(made) if made else schema.empty_table()
    return run


def _grid(queries: int, refs: int, size: int) -> tuple[int, int]:
    """Groups of the queries and of the references, by rows and entries of a vector."""
    groups = lambda n: max(1, -(-n * size * 8 // GROUP_BYTES))
    return groups(queries), max(groups(refs), -(-CELLS // groups(queries)))


def _dealt_out(df: DataFrame, own: str, groups: int, other: str, others: int) -> DataFrame:
    """Rows of a written table in groups of equal size, one copy for each group of the other side."""
    return df.withColumn(own, F.pmod(F.monotonically_increasing_id(), F.lit(groups)).cast("int")) \
        .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))


def knn_fraction(query: DataFrame, ref: DataFrame, qid: str, rid: str, vec: str, label: str,
                 k: int = 3, pivots: int | None = None, pairs: list | None = None) -> DataFrame:
    """Per query row: fraction of positive labels among its k nearest reference
    rows (ties broken by reference id) and how many these are. ``pairs``, if
    given, gets the number of (query, reference) pairs that were compared."""
    spark = ref.sparkSession
    doubles = F.transform(F.col(vec), lambda x: x.cast("double"))
    r = ref.where(F.col(vec).isNotNull()).select(F.col(rid).alias("id"), doubles.alias("vec"), F.col(label).cast("double").alias("label"))
    q = query.where(F.col(vec).isNotNull()).select(F.col(qid).alias("id"), doubles.alias("vec"))
    qid_type, rid_type = query.schema[qid].dataType, ref.schema[rid].dataType
    out_schema = T.StructType([T.StructField(qid, qid_type), T.StructField("knn_fraction", T.DoubleType()), T.StructField("k", T.LongType())])
    n = r.count()
    if not n:
        return spark.createDataFrame([], out_schema)
    # At most PIVOTS vectors.
    chosen = r.orderBy(F.xxhash64("id"), "id").limit(pivots or min(PIVOTS, math.isqrt(n - 1) + 1)).select("vec").collect()
    at = np.unique(np.array([p.vec for p in chosen], np.float64), axis=0)
    placed = T.StructType([*r.schema.fields, T.StructField("part", T.LongType()), T.StructField("far", T.DoubleType())])
    dealt, path_dealt = written(r.mapInArrow(_placed(at, "vec"), placed))
    radius = np.full(len(at), -1.0)
    for row in dealt.groupBy("part").agg(F.max("far").alias("far")).collect():
        radius[row.part] = row.far
    blocks, path_blocks = written(_blocks(dealt, rid_type, [("label", T.DoubleType())]))
    placed_q = T.StructType([*q.schema.fields, T.StructField("part", T.LongType()), T.StructField("far", T.DoubleType())])
    asked, path_asked = written(q.mapInArrow(_placed(at, "vec"), placed_q))
    tau = ("tau", T.DoubleType())
    first, path_first = written(_compared(_blocks(asked.withColumn("tau", F.lit(float("inf"))), qid_type, [tau]), blocks, k, qid_type, rid_type))
    # The k-th distance within the own partition; none there if it has fewer rows.
    bound = first.groupBy("qid").agg(F.when(F.count(F.lit(1)) == k, F.sqrt(F.max("d2"))).otherwise(F.lit(float("inf"))).alias("tau")).withColumnRenamed("qid", "id")
    further, path_further = written(join_null_safe(asked.select("id", "vec", "part"), bound, ["id"]))
    if pairs is not None:
        held = np.zeros(len(at), np.int64)
        for row in dealt.groupBy("part").count().collect():
            held[row.part] = row["count"]
        rows = asked.groupBy("part").count().collect()
        left = further.mapInArrow(_left_pairs(at, radius, held), "p long").agg(F.sum("p")).first()[0] or 0
        pairs.append(left + sum(row["count"] * int(held[row.part]) for row in rows))
    qs, rs = _grid(further.count(), n, at.shape[1])
    asking = _dealt_out(further.withColumnRenamed("id", "qid"), "qg", qs, "rg", rs).groupBy("qg", "rg")
    refs = _dealt_out(dealt.select(F.col("id").alias("rid"), "vec", "label", "part"), "rg", rs, "qg", qs).groupBy("qg", "rg")
    second = asking.cogroup(refs).applyInArrow(_cell(at, radius, k, qid_type, rid_type), first.schema)
    w = Window.partitionBy("qid").orderBy("d2", "rid")
    best = first.unionByName(second).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
    out, _ = written(best.groupBy(F.col("qid").alias(qid)).agg(F.avg("label").alias("knn_fraction"), F.count(F.lit(1)).alias("k")))
    for path in (path_dealt, path_blocks, path_asked, path_first, path_further):
        drop_table(spark, path)
    return out
