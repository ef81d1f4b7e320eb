"""Connected components of a table of links, by alternating large-star and small-star rounds.

Both rounds replace links by links to smaller neighbours until every node hangs on the smallest node of its
component. All state is in tables; each round ends in the shared folder. A hub's links meet only in a partial
minimum and in an equi-join: against a broadcast table while the links are few, else by a shuffle of two numbers a link.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.sources.shared import delete

from .common import shared_dir

LINKS = "a long, b long"


def _star(links: DataFrame, large: bool, small: bool) -> DataFrame:
    """links (a, b). Large: every node's larger neighbours go to its least neighbour. Small: its smaller ones do."""
    if large:
        sides = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        sides = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = sides.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.col("n")).alias("m"))
    joined = sides.join(F.broadcast(least) if small else least, F.col("a") == F.col("n"))
    out = joined.where(F.col("b") > F.col("a")) if large else joined
    out = out.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component is its least node. No nulls in a and b.

    Loops and repeated links do no harm; an empty table gives an empty one. Each round's table of nodes and their least
    neighbours has two numbers for each end of a link at most; it is broadcast if that is below ``broadcast_bytes``.
    """
    spark, kept = links.sparkSession, shared_dir(links.sparkSession, "links")
    links.select("a", "b").where("a <> b").distinct().write.parquet(kept)
    now = spark.read.schema(LINKS).parquet(kept)
    size = now.count()
    while True:
        small = 4 * size * 16 <= broadcast_bytes  # a round makes two links of one at most
        path = shared_dir(spark, "links")
        _star(_star(now, True, small), False, small).write.parquet(path)
        new = spark.read.schema(LINKS).parquet(path)
        n = new.count()
        done = n == size and new.join(now, ["a", "b"], "left_anti").isEmpty()  # links are distinct: as many, none of them new
        delete(spark, [kept])  # the last round's links are of no more use
        now, kept, size = new, path, n
        if done:
            break
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
