"""Ranked lexical search by dense blocked multiplication.

The items of a benchmark are a stated query set. They are dealt into blocks of
about ``BLOCK_BYTES`` of distinct terms (an item stays whole), and the
documents are ranked for one block at a time:

1. one pass over the texts writes, per document, its number of terms and the
   numbers of occurrences of the block's terms (a table in the shared folder);
2. the document frequencies are summed from that table, which gives the
   weights of the block's terms;
3. each task multiplies tiles: items times the compact vocabulary of
   ``ITEM_TILE`` items, by that vocabulary times ``DOC_TILE`` documents, in
   float64. Vocabulary tiles end where a partial sum could reach 2^53, so each
   product is an exact integer; partial sums are added in 64-bit integers;
4. a task keeps the best documents of each item, ties going to the lesser
   doc_id, and what the tasks kept meets in two steps, first by item and slice
   of the tasks, so no reducer sees more than a slice of them.

Nothing but a block's terms (bounded) and their frequencies is broadcast or
collected, and no shuffle carries texts, postings or scores of whole tables.

Defined results: a null or empty text, or one without a term, ranks nowhere
and does not count as a document; every other row is a document, repeated rows
too; rows of the benchmark with equal item_id are one item whose terms add up,
equal rows once; a null item_id is an item of its own; an item without terms or
without a document above 0 has no rows; equal scores go by ascending doc_id,
null last; a repetition of a term counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import arrow_limits, drop_tables, text_bytes, words, write_table

TOP = 20
BLOCK_BYTES = 8 << 20
ITEM_TILE = 64
VOCAB_TILE = 2048
DOC_TILE = 1024
#: Slices of the tasks whose best documents meet first.
SLICES = 64
#: An impact is below this: (10^9 tf) div (1000 tf + 12 m) with m > 0.
IMPACT_BOUND = 1_000_000
EXACT = 1 << 53


def item_terms(benchmark: DataFrame) -> DataFrame:
    """(item_id, term, n): the terms of each item with their repetitions."""
    arrow_limits(benchmark.sparkSession)
    field = benchmark.schema["item_id"]

    def count(batches):
        for batch in batches:
            rows, terms, ns = [], [], []
            for i, text in enumerate(text_bytes(batch)):
                for w, n in Counter(words(text)).items():
                    rows.append(i)
                    terms.append(w)
                    ns.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id").take(pa.array(rows, pa.int64())), pa.array(terms, pa.binary()), pa.array(ns, pa.int64())],
                names=["item_id", "term", "n"])
    schema = T.StructType([T.StructField("item_id", field.dataType), T.StructField("term", T.BinaryType()), T.StructField("n", T.LongType())])
    return (benchmark.select("item_id", "text").distinct().mapInArrow(count, schema)
            .groupBy("item_id", "term").agg(F.sum("n").alias("n")))


def postings(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """Per document with at least one term: doc_id, n (its terms), and as packed
    int32 the ids in ``vocabulary`` and numbers of the terms that it holds of it."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {w: i for i, w in enumerate(vocabulary)}.get
        for batch in batches:
            kept, ns, ids, tfs = [], [], [], []
            for i, text in enumerate(text_bytes(batch)):
                ws = words(text)
                if not ws:
                    continue
                held = Counter(map(place, ws))
                held.pop(None, None)
                kept.append(i)
                ns.append(len(ws))
                ids.append(np.fromiter(held.keys(), np.int32, len(held)).tobytes())
                tfs.append(np.fromiter(held.values(), np.int32, len(held)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(kept, pa.int64())), pa.array(ns, pa.int64()),
                 pa.array(ids, pa.binary()), pa.array(tfs, pa.binary())], names=["doc_id", "n", "ids", "tfs"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        count, "doc_id long, n long, ids binary, tfs binary")


def frequencies(held: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term of the vocabulary of ``size`` terms."""
    def count(batches):
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), np.int32), minlength=size)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], names=["id", "df"])
    out = np.zeros(size, np.int64)
    for r in held.select("ids").mapInArrow(count, "id long, df long").groupBy("id").agg(F.sum("df").alias("df")).collect():
        out[r["id"]] = r["df"]
    return out


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


def vocabulary_tiles(counts: list[dict[int, int]], weight: np.ndarray, width: int = VOCAB_TILE, exact: int = EXACT) -> list[tuple[np.ndarray, np.ndarray]]:
    """Tiles of the compact vocabulary of some items: (term ids, items x terms
    repetitions). Within a tile no item's sum can reach ``exact``; a term that is
    repeated too often for that comes in several tiles, each with a part."""
    most: Counter[int] = Counter()
    for c in counts:
        for v, n in c.items():
            most[v] = max(most[v], n)
    tiles: list[list[tuple[int, int, int]]] = []
    room, held = 0, set()
    for v, n in sorted(most.items()):
        unit = int(weight[v]) * IMPACT_BOUND
        if not unit:
            continue
        cap = (exact - 1) // unit
        for start in range(0, n, cap):
            cost = min(cap, n - start) * unit
            if not tiles or cost > room or len(tiles[-1]) == width or v in held:
                tiles.append([])
                room, held = exact - 1, set()
            tiles[-1].append((v, start, cap))
            room -= cost
            held.add(v)
    return [(np.array([v for v, _, _ in tile], np.int64),
             np.array([[min(max(c.get(v, 0) - start, 0), cap) for v, start, cap in tile] for c in counts], np.float64)) for tile in tiles]


class Best:
    """The ``top`` best documents of each item so far: highest score first, then
    the least doc_id, null last."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.floor = np.ones(items, np.int64)
        self.rows = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))] * items

    def add(self, first: int, scores: np.ndarray, docs: np.ndarray, missing: np.ndarray) -> None:
        """``scores``: items from ``first`` on times documents."""
        hit = scores >= self.floor[first:first + len(scores), None]
        for i in np.flatnonzero(hit.any(axis=1)):
            j = np.flatnonzero(hit[i])
            s, d, m = (np.concatenate(p) for p in zip(self.rows[first + i], (scores[i, j], docs[j], missing[j]), strict=True))
            order = np.lexsort((d, m, -s))[:self.top]
            self.rows[first + i] = s[order], d[order], m[order]
            if len(order) == self.top:
                self.floor[first + i] = s[order[-1]]


def _score(items: list, kind: pa.DataType, counts: list[dict[int, int]], weight: np.ndarray, n_docs: int, n_terms: int, top: int):
    """mapInArrow function: the best documents of a task for each item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = [(i, vocabulary_tiles(counts[i:i + ITEM_TILE], weight)) for i in range(0, len(items), ITEM_TILE)]
        best = Best(len(items), top)
        for whole in batches:
            for at in range(0, whole.num_rows, DOC_TILE):
                batch = whole.slice(at, DOC_TILE)
                docs = batch.column("doc_id")
                missing = np.array(docs.is_null())
                docs = docs.fill_null(0).to_numpy()
                blobs = batch.column("ids").to_pylist()
                ids = np.frombuffer(b"".join(blobs), np.int32)
                tf = np.frombuffer(b"".join(batch.column("tfs").to_pylist()), np.int32).astype(np.int64)
                row = np.repeat(np.arange(batch.num_rows), [len(b) // 4 for b in blobs])
                m = np.array([75 + 25 * n * n_docs // n_terms for n in batch.column("n").to_pylist()], np.int64)
                impact = (10**9 * tf // (1000 * tf + 12 * m[row]) * weight[ids]).astype(np.float64)
                for first, parts in tiles:
                    scores = np.zeros((min(ITEM_TILE, len(items) - first), batch.num_rows), np.int64)
                    for terms, a in parts:
                        place = np.full(len(weight), -1, np.int64)
                        place[terms] = np.arange(len(terms))
                        here = place[ids]
                        at_tile = here >= 0
                        tile = np.zeros((len(terms), batch.num_rows))
                        tile[here[at_tile], row[at_tile]] = impact[at_tile]
                        scores += (a @ tile).astype(np.int64)
                    best.add(first, scores, docs, missing)
        sizes = [len(s) for s, _, _ in best.rows]
        s, d, m = (np.concatenate(p) for p in zip(*best.rows, strict=True))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x for x, n in zip(items, sizes, strict=True) for _ in range(n)], kind), pa.array(d, pa.int64(), mask=m),
             pa.array(s, pa.int64()), pa.array(np.full(len(s), TaskContext.get().partitionId() % SLICES), pa.int64())],
            names=["item_id", "doc_id", "score", "slice"])
    return run


def search(docs: DataFrame, benchmark: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per item of ``benchmark`` (item_id, text) its ``top`` best documents of
    ``docs`` (doc_id, text): item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    arrow_limits(spark)
    terms, at = write_table(item_terms(benchmark), "search-terms")
    kind = benchmark.schema["item_id"].dataType
    schema = T.StructType([T.StructField("item_id", kind), T.StructField("doc_id", T.LongType()),
                           T.StructField("score", T.LongType()), T.StructField("slice", T.LongType())])
    size = terms.agg(F.sum(F.length("term") + 16)).first()[0] or 0
    blocks = 1 + size // block_bytes
    found = None
    for b in range(blocks):
        counts: dict[object, dict[int, int]] = {}
        place: dict[bytes, int] = {}
        for item, term, n in terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect():
            counts.setdefault(item, {})[place.setdefault(bytes(term), len(place))] = n
        if not place:
            continue
        held, _ = write_table(postings(docs, list(place)), "postings")
        n_docs, n_terms = held.agg(F.count(F.lit(1)), F.sum("n")).first()
        weight = weights(frequencies(held, len(place)), n_docs)
        part = held.mapInArrow(_score(list(counts), to_arrow_type(kind), list(counts.values()), weight, n_docs, n_terms, top), schema)
        found = part if found is None else found.unionByName(part)
    drop_tables(spark, [at])
    if found is None:
        found = spark.createDataFrame([], schema)
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    near = (found.withColumn("place", F.row_number().over(Window.partitionBy("item_id", "slice").orderBy(*order)))
            .where(F.col("place") <= top))
    return (near.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))
            .where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score"))


_TERMS = r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), [])"

OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
total AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
q AS (SELECT item_id, term, count(*) AS reps
      FROM (SELECT item_id, unnest({_TERMS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
p AS (SELECT r, doc_id, term, len_w, count(*) AS tf
      FROM (SELECT r, doc_id, unnest(w) AS term, CAST(len(w) AS BIGINT) AS len_w FROM d)
      WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS weight
      FROM (SELECT term, count(*) AS df FROM p GROUP BY term), total),
s AS (SELECT item_id, r, doc_id,
        CAST(sum(reps * weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * len_w * n_docs) // n_terms))))) AS BIGINT) AS score
      FROM q JOIN p USING (term) JOIN w USING (term), total GROUP BY item_id, r, doc_id),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS INTEGER) AS rank, doc_id, score
      FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= {TOP}
"""
