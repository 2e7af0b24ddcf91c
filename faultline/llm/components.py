"""Connected components of a link table by alternating large-star and small-star steps.

Each step is joins and minimum aggregations over the links; nothing is gathered
on the driver but one count and one checksum a round.  Every round's links are
written to the shared folder, so lineage stays short and lost executors cost one
round at most.  Rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import materialize


#: Links up to which their minima (two longs each) go to every task, so that no shuffle by node has a hub's links in
#: one task; above it the joins are by shuffle, where adaptive execution splits a hub's partition.
BROADCAST_LINKS = 200_000


def _with_least(links: DataFrame, least: DataFrame, small: bool) -> DataFrame:
    return links.join(F.broadcast(least) if small else least, "a")


def _large_star(links: DataFrame, small: bool) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return _with_least(both, least, small).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame, small: bool) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    hung = _with_least(down, least, small).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return hung.unionByName(least.select("a", F.col("m").alias("b")))


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame) -> DataFrame:
    """``a``, ``b`` (longs) -> ``node``, ``root``: the smallest node of its component, for every linked node but roots."""
    links = materialize(links.filter("a <> b").distinct(), "links")
    mark = _mark(links)
    while mark[0]:
        small = mark[0] <= BROADCAST_LINKS
        links = materialize(_small_star(_large_star(links, small), small).distinct(), "links")
        before, mark = mark, _mark(links)
        if mark == before:
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
