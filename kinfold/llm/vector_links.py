"""Near-duplicate embeddings by product quantisation.

Vectors link when their labels are equal and their cosine is at least
``COSINE``. Equal vectors of a label are one class. The classes go through an
index of coarse lists with residual subspace codes (``quantise``):

1. the quantiser is fitted on at most ``SAMPLE`` classes (those of the least
   digests, so reruns agree); every class is assigned, encoded and written, in
   blocks of at most ``BLOCK`` classes of one label and list;
2. each block goes to the lists of its label that can hold a vector within reach
   of one of its own, carrying only those vectors. The bound is exact, so the
   probes suffice;
3. a pair of blocks is compared by table look-ups. What the code's own error
   cannot rule out is reranked by the exact cosine in double precision;
4. a comparison gives the number of links of each vector and a spanning forest
   of the links it found, never the pairs, and ``components`` joins the forests.

A list with many blocks is dealt into slices of ``SLICE`` blocks, so no join
key holds more; results of the few classes that hold over a thousandth of the
rows are broadcast to their rows (there are at most 1000 of them), the others
joined. Comparisons are bound to the pairs that no bound rules out; within one
cloud of different vectors closer than the quantiser resolves, that is all of
them, block by block.

Defined results: a vector that is null, empty, zero or holds a null or
non-finite entry, or whose label is null, links with nothing; vectors of
different lengths do not link; equal rows (repeated vec_ids too) are vectors of
their own and link; component_id is the least vec_id that is not null among
the rows reached, null if there is none; kept is false for a null vec_id; every row gives a
row; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_limits, drop_tables, spread_join, write_table
from .components import components
from .quantise import SLACK, WIDTH, Quantiser

COSINE = 0.98
#: Classes that the quantiser is fitted on.
SAMPLE = 16384
#: Classes of a list of the largest label on average, and the most lists.
PER_LIST, LISTS = 1024, 1024
BLOCK = 512
SLICE = 16

_CLASSES = "vec_id long, spot string, key binary, vec binary"


def _scaled(row: np.ndarray) -> np.ndarray:
    """The vector times a power of two, its greatest entry near 1: products neither overflow nor vanish."""
    return np.ldexp(row, -int(np.frexp(np.abs(row).max())[1]))


def keyed(df: DataFrame) -> DataFrame:
    """Per row: vec_id, spot (label and length), key (a digest of spot and vector)
    and vec (doubles); spot, key and vec are null for vectors that link with nothing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots, keys, vecs = [], [], []
            for label, vec in zip(batch.column("label").to_pylist(), batch.column("embedding"), strict=True):
                spot = key = held = None
                vec = vec.values
                if label is not None and vec is not None and len(vec) and not vec.null_count:
                    v = vec.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                    if np.isfinite(v).all() and v.any():
                        spot = f"{len(v)}:{label}"
                        held = v.tobytes()
                        key = hashlib.blake2b(spot.encode() + b"\0" + held, digest_size=16).digest()
                spots.append(spot)
                keys.append(key)
                vecs.append(held)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(spots, pa.string()), pa.array(keys, pa.binary()),
                                              pa.array(vecs, pa.binary())], names=["vec_id", "spot", "key", "vec"])
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
                     "embedding").mapInArrow(run, _CLASSES)


def _units(blobs: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors scaled by powers of two, and unit vectors padded to ``width``."""
    rows = [_scaled(np.frombuffer(b, np.float64)) for b in blobs]
    wide = np.zeros((len(rows), width))
    for w, r in zip(wide, rows, strict=True):
        w[:len(r)] = r
    return wide, wide / np.sqrt((wide * wide).sum(axis=1))[:, None]


def _assigned(quantiser: Quantiser, width: int):
    """mapInArrow function: the list of each class and its distance to the centre."""
    def run(batches):
        for batch in batches:
            near, far = quantiser.assign(_units(batch.column("vec").to_pylist(), width)[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int64()), pa.array(far)],
                                             names=[*batch.schema.names, "list", "far"])
    return run


_BLOCK_FIELDS = "spot string, list long, slice long, n long, keys binary, counts binary, vecs binary, codes binary, errors binary"


def _blocks(quantiser: Quantiser, width: int):
    """mapInArrow function over classes sorted by spot, list and key: blocks of one spot and list."""
    def pack(spot: str, at: int, part: int, rows: list[tuple]) -> dict:
        wide, unit = _units([r[2] for r in rows], width)
        codes, errors = quantiser.encode(unit, np.full(len(rows), at))
        return dict(spot=spot, list=at, slice=(TaskContext.get().partitionId() << 32) + part // SLICE, n=len(rows), keys=b"".join(r[0] for r in rows),
                    counts=np.array([r[1] for r in rows], np.int64).tobytes(), vecs=wide.tobytes(), codes=codes.tobytes(), errors=errors.tobytes())

    def run(batches):
        place, part, rows = None, 0, []
        for batch in batches:
            out = []
            for spot, at, *row in zip(*(batch.column(c).to_pylist() for c in ("spot", "list", "key", "n", "vec")), strict=True):
                if rows and ((spot, at) != place or len(rows) == BLOCK):
                    out.append(pack(*place, part, rows))
                    part, rows = (part + 1 if (spot, at) == place else 0), []
                place = spot, at
                rows.append(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_schema(_BLOCK_FIELDS))
        if rows:
            yield pa.RecordBatch.from_pylist([pack(*place, part, rows)], schema=_schema(_BLOCK_FIELDS))
    return run


def _schema(fields: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.strip().split(" ") for f in fields.split(","))])


_PROBE_FIELDS = "spot string, list long, asked_list long, asked_keys binary, asked_vecs binary"


def _probes(quantiser: Quantiser, width: int, radius: np.ndarray, reach: float):
    """mapInArrow function: a block's vectors for each list that can hold a link of theirs."""
    def run(batches):
        for batch in batches:
            for b in batch.to_pylist():
                wide = np.frombuffer(b["vecs"]).reshape(-1, width)
                unit = wide / np.sqrt((wide * wide).sum(axis=1))[:, None]
                keys = np.frombuffer(b["keys"], "V16")
                need = quantiser.probes(unit, np.full(len(unit), b["list"]), radius, reach)
                yield pa.RecordBatch.from_pylist(
                    [dict(spot=b["spot"], list=int(at), asked_list=b["list"], asked_keys=keys[need[:, at]].tobytes(),
                          asked_vecs=wide[need[:, at]].tobytes()) for at in np.flatnonzero(need.any(axis=0))], schema=_schema(_PROBE_FIELDS))
    return run


_FOUND = "key binary, links long, other binary"


def _forest(left: np.ndarray, right: np.ndarray) -> list[int]:
    """Positions of links that join what the links before them have not joined."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x
    kept = []
    for i, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        a, b = root(a), root(b)
        if a != b:
            parent[a] = b
            kept.append(i)
    return kept


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with the same row of ``b``."""
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def _compare(quantiser: Quantiser, width: int, cosine: float, reach: float):
    """mapInArrow function over pairs of blocks: numbers of links, and forests of the links."""
    def pairs(asked: np.ndarray, at: int, vecs: np.ndarray, codes: np.ndarray, errors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        unit = asked / np.sqrt((asked * asked).sum(axis=1))[:, None]
        left, right = np.nonzero(quantiser.distances(unit, at, codes) <= reach + errors + 1e-6)
        kept = [np.flatnonzero(cosines(asked[left[i:i + BLOCK * 64]], vecs[right[i:i + BLOCK * 64]]) >= cosine) + i
                for i in range(0, len(left), BLOCK * 64)]
        kept = np.concatenate(kept) if kept else np.empty(0, np.int64)
        return left[kept], right[kept]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                b = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                akeys, bkeys = np.frombuffer(b["asked_keys"], "V16"), np.frombuffer(b["keys"], "V16")
                left, right = pairs(np.frombuffer(b["asked_vecs"]).reshape(-1, width), b["list"], np.frombuffer(b["vecs"]).reshape(-1, width),
                                    np.frombuffer(b["codes"], np.uint8).reshape(b["n"], -1), np.frombuffer(b["errors"]))
                other = akeys[left] != bkeys[right]
                left, right = left[other], right[other]
                if not len(left):
                    continue
                links = np.bincount(left, np.frombuffer(b["counts"], np.int64)[right], len(akeys)).astype(np.int64)
                at = np.flatnonzero(links)
                # A link is found from both of its ends; one of them passes it on.
                once = [] if b["asked_list"] > b["list"] else _forest(left, right + len(akeys))
                yield pa.RecordBatch.from_pydict({
                    "key": [akeys[j].tobytes() for j in at] + [akeys[left[j]].tobytes() for j in once],
                    "links": pa.array([*links[at].tolist(), *[0] * len(once)], pa.int64()),
                    "other": pa.array([*[None] * len(at), *(bkeys[right[j]].tobytes() for j in once)], pa.binary())},
                    schema=_schema(_FOUND))
    return run


def _index(classes: DataFrame, width: int, tables: list[str]) -> tuple[Quantiser, DataFrame, np.ndarray]:
    """The quantiser, the table of blocks and the radius of each list."""
    spark = classes.sparkSession
    sample = classes.select("key", "vec").orderBy("key").limit(SAMPLE).collect()
    rows = _units([r.vec for r in sample], width)[1] if sample else np.zeros((0, width))
    largest = classes.groupBy("spot").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    quantiser = Quantiser.fit(rows, min(largest // PER_LIST + 1, LISTS))
    placed, at = write_table(classes.mapInArrow(_assigned(quantiser, width), T.StructType(
        [*classes.schema.fields, T.StructField("list", T.LongType()), T.StructField("far", T.DoubleType())])), "vector-lists")
    radius = np.full(len(quantiser.lists), -np.inf)
    for r in placed.groupBy("list").agg(F.max("far").alias("far")).collect():
        radius[r["list"]] = r["far"]
    order = ("spot", "list", "key")
    # Ranges may cut a list anywhere; each task numbers its own slices of it.
    parts = max(spark.sparkContext.defaultParallelism, (classes.count() >> 16) + 1)
    dealt = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    blocks, path = write_table(dealt.mapInArrow(_blocks(quantiser, width), _BLOCK_FIELDS), "vector-blocks")
    drop_tables(spark, [at])
    tables.append(path)
    return quantiser, blocks, radius


def _results(classes: DataFrame, width: int, cosine: float, tables: list[str]) -> DataFrame:
    """(key, links, root) of the classes: links to vectors of other classes, and the least key of the component."""
    spark = classes.sparkSession
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + SLACK
    quantiser, blocks, radius = _index(classes, width, tables)
    slices = blocks.select("spot", "list", "slice").distinct()
    asked = blocks.mapInArrow(_probes(quantiser, width, radius, reach), _PROBE_FIELDS).join(slices, ["spot", "list"])
    met = asked.join(blocks, ["spot", "list", "slice"]).select(
        "list", "asked_list", "asked_keys", "asked_vecs", "n", "keys", "counts", "vecs", "codes", "errors")
    found, at = write_table(met.mapInArrow(_compare(quantiser, width, cosine, reach), _FOUND), "vector-links")
    roots, path = components(found.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")))
    counted = found.groupBy("key").agg(F.sum("links").alias("links"))
    out, kept = write_table(classes.select("key", "n", "least").join(counted, "key", "left")
                            .join(roots.withColumnRenamed("node", "key"), "key", "left")
                            .select("key", "n", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"),
                                    F.coalesce("root", "key").alias("root")), "vector-classes")
    drop_tables(spark, [at, path])
    tables.append(kept)
    return out


def link(df: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Per row of ``df`` (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    spark = df.sparkSession
    arrow_limits(spark)
    rows, at = write_table(keyed(df), "vector-rows")
    sound = rows.where("key is not null")
    classes, path = write_table(sound.groupBy("key").agg(F.first("spot").alias("spot"), F.first("vec").alias("vec"), F.count(F.lit(1)).alias("n"),
                                                         F.min("vec_id").alias("least")), "vector-classes")
    tables = [at, path]
    longest, total = classes.agg(F.max(F.length("vec")), F.sum("n")).first()
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if not total:
        out = alone
    else:
        width = -(-longest // 8 // WIDTH) * WIDTH
        done = _results(classes, width, cosine, tables)
        wholes = done.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"))
        many = done.count()
        done, last = write_table(spread_join(done, wholes, "root", "members", many).select("key", "n", "links", "component_id"), "vector-results")
        tables.append(last)
        out = (spread_join(sound.select("vec_id", "key"), done, "key", "n", total)
               .select("vec_id", F.col("links").alias("n_links"), "component_id").unionByName(alone))
    out, kept = write_table(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))), "vector-components")
    drop_tables(spark, tables)
    return out


OP12_SQL = f"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
  AND list_count(e) = len(e) AND isfinite(list_max(e)) AND isfinite(list_min(e)) AND (list_max(e) <> 0 OR list_min(e) <> 0)),
links AS (
  SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}),
walk AS (
  SELECT r AS a, r AS b FROM v
  UNION
  SELECT walk.a, links.b FROM walk JOIN links ON walk.b = links.a),
comp AS (SELECT walk.a, min(v.vec_id) AS component_id FROM walk JOIN v ON v.r = walk.b GROUP BY walk.a),
deg AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, CAST(coalesce(deg.n, 0) AS BIGINT) AS n_links, comp.component_id, coalesce(v.vec_id = comp.component_id, false) AS kept
FROM v JOIN comp ON comp.a = v.r LEFT JOIN deg ON deg.a = v.r
"""
