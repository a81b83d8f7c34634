"""MinHash near-dedup: BagMinHash signatures, bands, and a check of every candidate.

Documents of one text are one class, known by the text's 128-bit digest. Each
class has buckets from the bands of its signature. Two classes that share a
bucket are candidates; a candidate pair is a link if the weighted Jaccard
similarity of their bags of five-word shingles is at least ``SIMILAR``; a group
is a connected component of links.

Not all pairs of a bucket are made. First each bucket's leader, the class that
shares most bucket places with others, is checked against the bucket's other
classes: a family of near copies has its common original for leader, and its
buckets are done when all their classes are in one component. In the buckets
left, pairs that cross components are looked at in blocks of ``BLOCK`` classes:
a task compares the slots of two blocks with numpy, passes over pairs that an
earlier band holds or whose slots rule out the similarity (fewer than
``LEAST_EQUAL`` of 96 agree, which at 0.8 has a probability of 1e-6), and checks
the rest on the texts. So the groups are those that all pairs would give, no
pair is a row, and no task holds more than two blocks.

Defined results: a null text is alone; texts without a word are alone but for
equal texts; a text of fewer than five words is one shingle; rows of equal
text are in one group whatever their doc_id; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bagminhash
from .common import arrow_limits, drop_tables, runs, spread_join, text_bytes, whole_row, write_table
from .components import components

SIMILAR = 0.8
#: Classes of a block, and slots (of 96) that two classes must share to be checked.
BLOCK = 512
LEAST_EQUAL = 58


def text_class() -> F.Column:
    """Digest of the text; null for null."""
    return F.unhex(F.md5("text"))


def buckets(docs: DataFrame) -> DataFrame:
    """(bucket, class) of all texts that have words; a row for each band."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = {c: t for c, t in zip(batch.column("class").to_pylist(), text_bytes(batch), strict=True)}
            bags = [(c, bag) for c, t in own.items() if len((bag := bagminhash.shingles(t))[0])]
            if bags:
                got = bagminhash.bands(bagminhash.signatures([b for _, b in bags])).view(np.int64)
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array(got.ravel()),
                    "class": pa.array([c for c, _ in bags], pa.binary()).take(pa.array(np.repeat(np.arange(len(bags)), bagminhash.BANDS)))})
    return docs.where("text IS NOT NULL").select(text_class().alias("class"), "text").mapInArrow(hashed, "bucket long, class binary").distinct()


def check_pairs(pairs: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) of classes whose texts are at least ``similar``."""
    def checked(batches):
        last: tuple[bytes | None, tuple | None] = (None, None)
        for batch in batches:
            keep = []
            for a, ta, tb in zip(batch.column("a").to_pylist(), text_bytes(batch, "text_a"), text_bytes(batch, "text_b"), strict=True):
                if last[0] != a:
                    last = (a, bagminhash.shingles(ta))
                keep.append(bagminhash.weighted_jaccard(last[1], bagminhash.shingles(tb)) >= similar)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))
    with_a = pairs.join(texts.select(F.col("class").alias("a"), F.col("text").alias("text_a")), "a")
    return with_a.join(texts.select(F.col("class").alias("b"), F.col("text").alias("text_b")), "b") \
        .select("a", "b", "text_a", "text_b").mapInArrow(checked, "a binary, b binary")


def sketched(texts: DataFrame) -> DataFrame:
    """Add ``slots``, a byte of each slot of the signature, and ``bands``, its
    bucket ids, to (class, text)."""
    def add(batches):
        for batch in batches:
            if batch.num_rows:
                sig = bagminhash.signatures([bagminhash.shingles(t) for t in text_bytes(batch)])
                slots = (sig.view(np.uint64) & np.uint64(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("class"), batch.column("text"), pa.array([x.tobytes() for x in slots], pa.binary()),
                     pa.array([x.tobytes() for x in bagminhash.bands(sig)], pa.binary())], names=["class", "text", "slots", "bands"])
    return texts.select("class", "text").mapInArrow(add, "class binary, text string, slots binary, bands binary")


class _Block:
    """Classes of one bucket: bag, component, slots and bands of each."""

    def __init__(self, rows: list[tuple]):
        self.classes, self.roots, self.texts = [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]
        self.slots = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(len(rows), -1)
        self.bands = np.frombuffer(b"".join(r[4] for r in rows), np.uint64).reshape(len(rows), -1)
        self.number = np.unique(np.array(self.roots, dtype=object), return_inverse=True)[1] if rows else np.empty(0, np.int64)
        self.bags: dict[int, tuple] = {}

    def bag(self, i: int) -> tuple:
        if i not in self.bags:
            self.bags[i] = bagminhash.shingles(self.texts[i].encode())
        return self.bags[i]


def cross_links(bucket: int, rows: list[tuple], one: list[int], two: list[int] | None, similar: float) -> list[tuple[bytes, bytes]]:
    """Links between the components of a bucket: pairs of ``one`` with ``two``,
    or of ``one`` with itself, given by places in ``rows`` (class, root, text,
    slots, bands)."""
    block, out = _Block(rows), []
    band = int(np.flatnonzero(block.bands[0] == np.int64(bucket).astype(np.uint64))[0])
    merged: dict[bytes, bytes] = {}

    def root(x):
        while x in merged:
            x = merged[x]
        return x
    b = np.array(one if two is None else two, np.int64)
    for n, i in enumerate(one):
        other = b[n + 1:] if two is None else b
        other = other[block.number[other] != block.number[i]]
        if not len(other):
            continue
        equal = (block.slots[other] == block.slots[i]).sum(axis=1) >= LEAST_EQUAL
        other = other[equal]
        other = other[~(block.bands[other, :band] == block.bands[i, :band]).any(axis=1)]
        for j in other.tolist():
            x, y = root(block.roots[i]), root(block.roots[j])
            if x != y and bagminhash.weighted_jaccard(block.bag(i), block.bag(j)) >= similar:
                merged[x] = y
                out.append((block.classes[i], block.classes[j]))
    return out


def block_links(members: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """Links (a, b) across components in the buckets of ``members`` (bucket,
    class, root), by pairs of blocks."""
    sizes = members.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    dealt = members.join(sizes, "bucket").withColumn("own", own) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select("bucket", "class", "root", "own", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"))
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = dealt.join(sketched(texts), "class").repartition(n, "bucket", "one", "two").sortWithinPartitions("bucket", "one", "two")

    def find(batches):
        for (bucket, one, two), held in runs(batches, ("bucket", "one", "two"), ("class", "root", "text", "slots", "bands", "own")):
            first = [i for i, h in enumerate(held) if h[5] == one]
            second = [i for i, h in enumerate(held) if h[5] == two]
            got = cross_links(bucket, held, first, None if one == two else second, similar)
            if got:
                yield pa.RecordBatch.from_pydict({"a": pa.array([g[0] for g in got], pa.binary()), "b": pa.array([g[1] for g in got], pa.binary())})
    return rows.mapInArrow(find, "a binary, b binary")


def class_components(docs: DataFrame, similar: float = SIMILAR) -> tuple[DataFrame, list[str]]:
    """(node, root) of the classes linked to another, and tables to drop when
    it is no longer read."""
    spark = docs.sparkSession
    arrow_limits(spark)
    every, at_every = write_table(buckets(docs), "buckets")
    shared = every.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members, at_members = write_table(every.join(shared, "bucket"), "members")
    drop_tables(spark, [at_every])
    # The texts of the classes that have a candidate.
    places = members.groupBy("class").agg(F.sum("n").alias("places"))
    texts, at_texts = write_table(
        docs.where("text IS NOT NULL").select(text_class().alias("class"), "text")
        .join(places.select("class"), "class", "left_semi").groupBy("class").agg(F.first("text").alias("text")), "texts")
    led = members.join(places, "class").groupBy("bucket").agg(F.max(F.struct("places", "class"))["class"].alias("leader"))
    pairs = members.join(led, "bucket").where(F.col("class") != F.col("leader")) \
        .select(F.least("class", "leader").alias("a"), F.greatest("class", "leader").alias("b")).distinct()
    links, at_links = write_table(check_pairs(pairs, texts, similar), "links")
    found, at_found = components(links)
    # Buckets in which two components are left.
    rooted, at_rooted = write_table(_root(members.drop("n"), found, "class", "root"), "rooted")
    apart = rooted.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bucket")
    left, at_left = write_table(rooted.join(apart, "bucket"), "members-left")
    kept = texts.join(left.select("class").distinct(), "class", "left_semi")
    more, at_more = write_table(block_links(left, kept, similar), "links")
    whole, at_whole = components(links.unionByName(more))
    drop_tables(spark, [at_members, at_links, at_found, at_rooted, at_left, at_more, at_texts])
    return whole, [at_whole]


def _root(df: DataFrame, found: DataFrame, node: str, out: str) -> DataFrame:
    """Add the root of ``node``: itself where it has no link."""
    return df.join(found.select(F.col("node").alias(node), F.col("root").alias("__r")), node, "left") \
        .withColumn(out, F.coalesce("__r", node)).drop("__r")


def groups(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Per row of ``docs``: doc_id, group_id (the least doc_id of its group;
    nulls last) and class_id (the least doc_id of its equal texts)."""
    found, drop = class_components(docs, similar)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_class().alias("class"))
    known, alone = rows.where("class IS NOT NULL"), rows.where("class IS NULL")
    classes, at = write_table(known.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("rows")), "classes")
    rooted = _root(classes, found, "class", "root")
    least = rooted.groupBy("root").agg(F.min("class_id").alias("group_id"), F.count(F.lit(1)).alias("classes"))
    ids, _ = write_table(spread_join(rooted, least, "root", "classes", classes.count()).select("class", "class_id", "group_id", "rows"), "group-ids")
    total = ids.agg(F.sum("rows")).first()[0] or 0
    drop_tables(docs.sparkSession, [*drop, at])  # the ids are written
    return spread_join(known, ids, "class", "rows", total).select("doc_id", "group_id", "class_id").unionByName(
        alone.select("doc_id", F.col("doc_id").alias("group_id"), F.col("doc_id").alias("class_id")))


def deduplicated(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One row of ``docs`` for each group, with all its columns: a row of the
    least doc_id. Rows of null text are all kept."""
    found, drop = class_components(docs, similar)
    rows = docs.select(whole_row(docs).alias("row"), F.col("doc_id").alias("id"), text_class().alias("class")).where("class IS NOT NULL")
    classes = rows.groupBy("class").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("rows"))
    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "class")).alias("best")
    by_class, at = write_table(_root(classes, found, "class", "root"), "classes")
    total = by_class.agg(F.sum("rows")).first()[0] or 0
    chosen = by_class.groupBy("root").agg(best).select(F.col("best.id").alias("kept"), F.col("best.class").alias("class"))
    kept, _ = write_table(chosen.join(by_class.select("class", "rows"), "class"), "kept")
    drop_tables(docs.sparkSession, [*drop, at])
    # Equal rows: of those with the kept id and text, the first by what they hold.
    one = spread_join(rows, kept, "class", "rows", total).where(F.col("id").eqNullSafe(F.col("kept"))) \
        .groupBy("class").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
    return one.toDF(*docs.columns).unionAll(docs.where("text IS NULL"))
