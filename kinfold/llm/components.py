"""Connected components of links, by turns of large-star and small-star joins.

Every turn is two aggregations and joins over the links that are left; each
star's links are written to the shared folder, so the plan stays short and a
lost executor costs no more than a star. The centre of a large star is joined
by broadcast, so its links stay where they are. The links never leave the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, spread_join, write_table


def _least(ends: DataFrame) -> DataFrame:
    """Least neighbour of each node, and how many there are."""
    return ends.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("ends"))


def _large_star(links: DataFrame, n: int) -> DataFrame:
    """Join each greater neighbour of a node to the node's least neighbour (or itself)."""
    both = links.union(links.select(F.col("b"), F.col("a")))
    least = _least(both).select("a", F.least("a", "m").alias("m"), "ends")
    return spread_join(both, least, "a", "ends", 2 * n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame, n: int) -> DataFrame:
    """Join a node and its lesser neighbours to the least of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least(down)
    return (spread_join(down, least, "a", "ends", n).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", F.col("m").alias("b"))).distinct())


def components(links: DataFrame) -> tuple[DataFrame, str]:
    """(a, b) links -> (node, root) for every node that has a link to another,
    root being the least node of its component; and the table's path. Links of
    a node to itself and repeated links are allowed; null ends are not."""
    spark = links.sparkSession
    now, path = write_table(links.where("a <> b").select("a", "b").distinct(), "links")
    seen, n = None, now.count()
    while True:
        far, between = write_table(_large_star(now, n), "links")
        nxt, at = write_table(_small_star(far, far.count()), "links")
        mark = nxt.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        drop_tables(spark, [path, between])
        now, path, n = nxt, at, mark[0]
        if mark == seen:
            break
        seen = mark
    roots = now.groupBy("b").agg(F.first("b").alias("root")).select(F.col("b").alias("node"), "root")
    out, kept = write_table(now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots), "components")
    drop_tables(spark, [path])
    return out, kept
