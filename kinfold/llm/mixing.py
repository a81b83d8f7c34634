"""Mixing sources to target weights by weighted fair queueing.

Every source sends its documents in a shuffled order, again and again up to
``EPOCHS`` times. A document's virtual finish time is the words its source has
sent up to its end, divided by the source's target. All documents are put in
the order of their finish times and taken until the budget (all words) is
used: sources then stand near their targets, as a fair queue serves them.

Only DataFrame functions are used. The running sums are cut into buckets by
the shuffle key and by the finish time; the number of buckets is about the
square root of the rows, so neither the table of bucket totals nor a bucket
ever holds more than about that many rows, also for a source with most rows.

Defined results: a null text has size 0; a null source is a source of its own,
the last; rows equal in doc_id, source and text are numbered copies, each with
a place of its own in the queue, so a source of equal rows comes near its target
too; documents of size 0 are taken 0 times; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_tables, spread_join, whole_row, write_table

EPOCHS = 3
WEIGHTS = (1, 2, 3)
SEED = "mix-1"
#: Copies of a row that one task numbers.
CHUNK = 10_000
_SPACE = "\t\n\x0b\x0c\r "


def word_count(text) -> F.Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text: each run becomes one
    letter, white space goes, and the letters are counted. Null: 0."""
    runs = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(F.translate(runs, _SPACE, "")), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) -> rank, weight and target. The targets share all
    words by weight; one that would pass ``EPOCHS`` times its source's size
    stops there and the rest is shared by the others. With the sources in the
    order of limit / weight, a first few stop and the level of the others is
    what these leave, by weight. The windows are over one row per source."""
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = (sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
              .withColumn("weight", w.cast("long"))
              .withColumn("most", F.lit(EPOCHS) * F.col("source_size")))
    order = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = ((F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0)))
             / F.sum("weight").over(rest))
    levels = ranked.withColumn("level", level)
    at = F.min(F.when(F.col("most") / F.col("weight") >= F.col("level"), F.struct(F.col("most") / F.col("weight"), "rank", "level"))).over(every)
    return levels.withColumn("water", at["level"]).select(
        "source", "source_size", "rank", "weight",
        F.when(F.col("most") / F.col("weight") <= F.col("water"), F.col("most").cast("double"))
         .otherwise(F.col("water") * F.col("weight")).alias("target"))


def _buckets(rows: DataFrame) -> int:
    """About the square root of the rows."""
    return max(16, int(rows.count() ** 0.5))


def _numbered(units: DataFrame) -> DataFrame:
    """A row for each copy: ``units`` (with n) and copy, from 1. The copies of
    a row that comes very often are numbered by many tasks."""
    one, chunk = F.lit(1).cast("long"), F.lit(CHUNK).cast("long")
    few = units.where(F.col("n") <= CHUNK).withColumn("copy", F.explode(F.sequence(one, "n")))
    many = units.where(F.col("n") > CHUNK).withColumn("start", F.explode(F.sequence(one, "n", chunk))) \
        .repartition("text_md5", "start") \
        .withColumn("copy", F.explode(F.sequence(F.col("start"), F.least(F.col("start") + CHUNK - 1, "n")))).drop("start")
    return few.unionByName(many).drop("n")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """(doc_id, text, source) -> a row for each row of ``docs``: doc_id,
    source, text_md5, copy, size, source_size, target, copies and taken (copies
    times size)."""
    spark = docs.sparkSession
    unit = ["doc_id", "source", "text_md5", "copy"]
    sized = docs.select("doc_id", "source", F.md5("text").alias("text_md5"), word_count(F.col("text")).alias("size"))
    counted, at_counted = write_table(
        sized.groupBy(*unit[:3]).agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size")), "mix-counted")
    units, at_units = write_table(_numbered(counted).withColumn(
        "key", F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                                 F.coalesce("text_md5", F.lit("")), F.col("copy").cast("string")))), "mix-units")
    drop_tables(spark, [at_counted])
    targets, at_targets = write_table(source_targets(units.groupBy("source").agg(F.sum("size").alias("source_size")), weights), "mix-targets")
    n = _buckets(units)
    part = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * n / F.lit(1 << 32)).cast("long")
    rows = units.join(targets, units["source"].eqNullSafe(targets["source"])).drop(targets["source"]).withColumn("part", part)
    totals = rows.groupBy("rank", "part").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("rank", "part", F.coalesce(F.sum("words").over(upto), F.lit(0)).alias("offset"))
    sent = F.sum("size").over(Window.partitionBy("rank", "part").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    queued = rows.withColumn("sent", sent).join(offsets, ["rank", "part"]).withColumn("sent", F.col("sent") + F.col("offset")).drop("offset")
    finish = (F.col("epoch") * F.col("source_size") + F.col("sent")) / F.col("target")
    slot = F.least(F.floor(F.col("finish") * n), F.lit(4 * n)).cast("long")
    times, at_times = write_table(
        queued.where((F.col("size") > 0) & (F.col("target") > 0)).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(EPOCHS - 1))))
        .select(*unit, "rank", "key", "epoch", F.col("size").alias("words"), finish.alias("finish"))
        .withColumn("slot", slot), "mix-times")
    slots = times.groupBy("slot").agg(F.sum("words").alias("words"))
    budget = targets.agg(F.sum("source_size").alias("budget"))
    before = slots.select("slot", F.coalesce(F.sum("words").over(
        Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), "words")
    # Whole slots before the budget are taken; the one in which it ends is ordered by finish time and cut.
    cut = before.crossJoin(F.broadcast(budget)).select(
        "slot", "before", "budget", (F.col("before") + F.col("words") <= F.col("budget")).alias("whole")) \
        .where(F.col("before") < F.col("budget"))
    inside = F.col("before") + F.sum("words").over(
        Window.partitionBy("slot").orderBy("finish", "rank", "epoch", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    reached = times.join(F.broadcast(cut), "slot")  # about the square root of the rows
    taken = (reached.where("whole").select(*unit)
             .unionByName(reached.where(~F.col("whole")).withColumn("upto", inside)
                          .where(F.col("upto") <= F.col("budget")).select(*unit)))
    copies, _ = write_table(taken.groupBy(*unit).agg(F.count(F.lit(1)).alias("copies")), "mix-copies")
    drop_tables(spark, [at_times])
    t, c = targets.alias("t"), copies.alias("c")
    same = [F.col(f"u.{k}").eqNullSafe(F.col(f"c.{k}")) for k in unit]
    out = units.alias("u").join(t, F.col("u.source").eqNullSafe(F.col("t.source"))).join(c, same, "left")
    return out.withColumn("copies", F.coalesce(F.col("c.copies"), F.lit(0)).cast("long")) \
        .select(*[F.col(f"u.{k}").alias(k) for k in unit],
                F.col("u.size").alias("size"), F.col("t.source_size").alias("source_size"), F.col("t.target").alias("target"),
                F.col("copies"), (F.col("copies") * F.col("u.size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as the mix
    takes it; rows that it doesn't take are gone. What the copies of a row are
    taken together is shared out evenly, the rest to the first of them."""
    unit = lambda doc_id, source, text: F.md5(F.to_json(F.struct(doc_id.alias("d"), source.alias("s"), text.alias("t"))))
    drawn, _ = write_table(
        mix(docs, weights, seed).groupBy(unit(F.col("doc_id"), F.col("source"), F.col("text_md5")).alias("unit"))
        .agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n")).where("copies > 0"), "mix-drawn")
    total = drawn.agg(F.sum("n")).first()[0] or 0
    rows = docs.select(whole_row(docs).alias("row")).withColumn("unit", unit(F.col("row.doc_id"), F.col("row.source"), F.md5("row.text")))
    each = spread_join(rows, drawn, "unit", "n", total).withColumn("rest", F.expr("copies % n")).withColumn("copies", F.expr("copies div n"))
    even = each.where("rest = 0")
    uneven, _ = write_table(each.where("rest > 0").withColumn("slice", F.spark_partition_id()), "mix-uneven")
    slices = uneven.groupBy("unit", "slice").agg(F.count(F.lit(1)).alias("held"))
    before = Window.partitionBy("unit").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select("unit", "slice", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("unit", "slice").orderBy(F.to_json("row")))
    shared = uneven.withColumn("place", place).join(offsets, ["unit", "slice"]).withColumn(
        "copies", F.col("copies") + F.when(F.col("place") + F.col("offset") <= F.col("rest"), 1).otherwise(0))
    return (even.select("row", "copies").unionByName(shared.select("row", "copies")).where("copies > 0")
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*").toDF(*docs.columns))


OP6_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, md5(text) AS text_md5,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, text_md5) AS copy FROM sized),
units AS (
  SELECT *, md5(concat_ws('|', '{SEED}', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(text_md5, ''), CAST(copy AS VARCHAR))) AS key
  FROM numbered),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM units GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM src),
weighted AS (SELECT *, (rank - 1) % 3 + 1 AS weight, 3 * source_size AS most FROM ranked),
levels AS (
  SELECT *, CAST((SELECT sum(source_size) FROM src) - coalesce(sum(most) OVER (ORDER BY most / weight, rank
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
            / CAST(sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level
  FROM weighted),
water AS (SELECT level AS water FROM levels WHERE most / weight >= level ORDER BY most / weight, rank LIMIT 1),
targets AS (
  SELECT source, source_size, rank, CASE WHEN most / weight <= water THEN CAST(most AS DOUBLE) ELSE water * weight END AS target
  FROM levels, water),
queued AS (
  SELECT u.*, t.source_size, t.rank, t.target,
         CAST(sum(size) OVER (PARTITION BY t.rank ORDER BY key ROWS UNBOUNDED PRECEDING) AS BIGINT) AS sent
  FROM units u JOIN targets t ON u.source IS NOT DISTINCT FROM t.source),
times AS (
  SELECT q.*, e.epoch, (e.epoch * source_size + sent) / target AS finish
  FROM queued q, (SELECT unnest([0, 1, 2]) AS epoch) e WHERE size > 0 AND target > 0),
cut AS (
  SELECT *, sum(size) OVER (ORDER BY finish, rank, epoch, key ROWS UNBOUNDED PRECEDING) AS upto FROM times),
copies AS (
  SELECT rank, key, count(*) AS copies FROM cut
  WHERE upto <= (SELECT sum(source_size) FROM src) GROUP BY rank, key)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(c.copies, 0) * q.size AS BIGINT) AS taken
FROM queued q LEFT JOIN copies c USING (rank, key)
"""
