"""Document fingerprints from closed syncmers.

A k-mer of characters is a closed syncmer if the least of the hashes of its
inner s-mers is the first or the last one. Whether it is depends on the k-mer
alone, so two texts that share a passage pick the same anchors inside it
wherever it stands. The anchors are (position, hash).

Two texts are matched on all their anchors by hash and position difference: an
anchor's link is its hash with the distance to the next anchor, and the
likeness of two texts is the Jaccard similarity of their links, each counted
as often as it stands there. A shared passage is a run of shared links at one
shift between the texts; an anchor whose hash alone recurs elsewhere, with the
next one at another distance, is not matched. Nothing is sampled, and the work
is a sort of the links also where a text repeats itself. The fingerprint that
is written out holds the least distinct link hashes, one in ``SHARE`` of them
but ``SKETCH`` at least (or all), so it grows with the text.

Defined results: a null text is the empty text, whose fingerprint is empty; a
text without a syncmer (short ones) has one anchor, of the whole text; the
last anchor's distance is 0; two empty texts are alike (1), an empty and another
are not (0). Documents are ordered by descending doc_id, null last; rows of one
doc_id by the digest of their texts. The document after the last is the first,
which in a table of one row is the row itself. An empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, mix

K, S = 12, 5
SKETCH = 64
SHARE = 16
_BASE = np.uint64(0x100000001B3)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _rolled(cp: np.ndarray, at: np.ndarray | None, n: int) -> np.ndarray:
    """Hash of the ``n`` characters from each place (``at``, or all)."""
    m = max(0, len(cp) - n + 1)
    out = np.zeros(m if at is None else len(at), np.uint64)
    for j in range(n):
        out *= _BASE
        out += cp[j:j + m] if at is None else cp[at + j]
    return mix(out)


def syncmers(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the closed syncmers."""
    if len(cp) < K:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    inner = _rolled(cp, None, S)
    w = K - S + 1
    least, span = inner, 1
    while span < w:  # least of the next ``span`` hashes
        step = min(span, w - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    at = np.flatnonzero((least == inner[:len(least)]) | (least == inner[w - 1:]))
    return at, _rolled(cp, at, K)


def _whole(cp: np.ndarray) -> np.ndarray:
    return mix(np.array([int(hashlib.md5(cp.tobytes()).hexdigest()[:16], 16)], np.uint64)) if len(cp) else np.empty(0, np.uint64)


def sketch(hashes: np.ndarray, cp: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """The links of all anchors in ascending order, repeated ones as often as
    they occur; of the whole text where there is no syncmer. ``at`` are the
    anchors' positions, looked for if they are not given."""
    if not len(hashes):
        return _whole(cp)
    at = syncmers(cp)[0] if at is None else at
    return np.sort(mix(hashes ^ mix(np.append(np.diff(at), 0).astype(np.uint64))))


def as_text(links: np.ndarray) -> str:
    """The least distinct links (32 bits of each), more of them for a longer text."""
    distinct = np.unique((links >> np.uint64(32)).astype(np.uint32))
    return distinct[:max(SKETCH, len(distinct) // SHARE)].astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two ascending lists, repeated values counted."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    v, n = np.unique(a, return_counts=True)
    first, last = np.searchsorted(b, v), np.searchsorted(b, v, "right")
    both = int(np.minimum(n, last - first).sum())
    return both / (len(a) + len(b) - both)


def anchors(docs: DataFrame) -> DataFrame:
    """(doc_id, position, hash) of the syncmers of all texts, for positional matching."""
    arrow_limits(docs.sparkSession)

    def each(batches):
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                at, h = syncmers(code_points(text or ""))
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc_id] * len(at), pa.int64()), "position": pa.array(at), "hash": pa.array(h.view(np.int64))})
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, position long, hash long")


def edited_sketch(cp: np.ndarray, at: np.ndarray, hashes: np.ndarray, keep: int, tail: np.ndarray) -> np.ndarray:
    """Sketch of the first ``keep`` characters and then ``tail``: what lies in
    the kept part is known already, only what reaches the tail is looked for."""
    cut = max(0, keep - K + 1)
    where, fresh = syncmers(np.concatenate((cp[cut:keep], tail)))
    held = at + K <= keep
    return sketch(np.concatenate((hashes[held], fresh)), np.concatenate((cp[:keep], tail)), np.concatenate((at[held], where + cut)))


def in_order(docs: DataFrame) -> DataFrame:
    """(run, look, doc_id, text) so that in each task the rows of a run follow
    each other in descending doc_id; the first rows of the next run follow
    with ``look`` = 1. Runs are ranges of doc_id; their ends and first ids are
    all that reaches the driver, a few numbers for each task."""
    spark = docs.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ends = d.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000)).first()[0] or []
    # Descending: runs are numbered by the negated id; null ids come after all.
    splits = sorted({0.0, *(-float(e) for e in ends)})
    keyed = d.withColumn("key", F.coalesce(-F.col("doc_id").cast("double"), F.lit(float("inf"))))
    run = Bucketizer(splits=[-float("inf"), *splits, float("inf")], inputCol="key", outputCol="run", handleInvalid="keep")
    dealt = run.transform(keyed).withColumn("run", F.col("run").cast("int")).drop("key")
    heads = run.transform(keyed.select("key", "doc_id")).withColumn("run", F.col("run").cast("int")) \
        .groupBy("run").agg(F.max("doc_id").alias("head")).orderBy("run").collect()
    before = [(r["run"], r["head"], heads[i - 1]["run"]) for i, r in enumerate(heads)]  # the run before the first is the last
    table = spark.createDataFrame(before, "run int, head long, previous int")
    look = dealt.join(F.broadcast(table), "run").select(
        F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("head")), F.array(
            F.struct(F.col("run"), F.lit(0).alias("look")), F.struct(F.col("previous").alias("run"), F.lit(1).alias("look"))))
            .otherwise(F.array(F.struct(F.col("run"), F.lit(0).alias("look"))))).alias("to"), "doc_id", "text")
    return look.select("to.*", "doc_id", "text", F.md5("text").alias("digest")).repartition(int(n / 4), "run") \
        .sortWithinPartitions("run", "look", F.col("doc_id").desc_nulls_last(), "digest").drop("digest")


def report(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next."""
    arrow_limits(docs.sparkSession)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # run and what is known of the row that waits for its next one
        for batch in batches:
            out: list[tuple] = []
            for run, look, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("run", "look", "doc_id", "text")), strict=True):
                if look and last is None:
                    continue  # more rows of the id that comes first in the next run
                text = text or ""
                cp = code_points(text)
                at, h = syncmers(cp)
                own = sketch(h, cp, at)
                if last is not None:
                    _, d, t, c, a, hs, f = last
                    keep = len(t) - len(t) // 3
                    tail = len(t) - keep
                    edited = edited_sketch(c, a, hs, keep, cp[:tail])
                    out.append((d, len(t), hashlib.sha256((t[:keep] + text[:tail]).encode()).hexdigest(),
                                as_text(f), as_text(edited), likeness(f, edited), likeness(f, own)))
                last = None if look else (run, doc_id, text, cp, at, h, own)
            cols = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)],
                                             names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
    return in_order(docs).mapInArrow(follow, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
