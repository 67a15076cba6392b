"""Connected components by alternating large and small stars; no task gathers a vertex's neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.base import Scratch, materialize


def _to_least(links: DataFrame) -> DataFrame:
    """Each vertex ``a`` with the least of its ``b``."""
    return links.groupBy("a").agg(F.min("b").alias("m"))


def _large(links: DataFrame, write) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Written first, so that the join below deals out both sides itself and can split a vertex with very many neighbours.
    least = write(_to_least(both).withColumn("m", F.least("a", "m")), "least")
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(links: DataFrame) -> DataFrame:
    least = _to_least(links)
    others = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``edges`` (a, b: long) to (v, component): every vertex of an edge and the least vertex that it reaches.

    Self-links and null ends take no part. Each round is written to the shared folder, so a lost executor costs a part
    of one round; the number of rounds grows with the logarithm of the vertices. With ``scratch`` what is written goes
    with that, so the result must be used before.
    """
    write = scratch.write if scratch else materialize
    links = write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not _is_stars(links):
        links = write(_small(_large(links, write).distinct()).distinct(), "links")
    return links.select(F.col("a").alias("v"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("v"), F.col("b").alias("component")).distinct())


def _is_stars(links: DataFrame) -> bool:
    """Whether every vertex but the least of its component points to that one, and nowhere else."""
    above = links.select(F.col("b").alias("a")).join(links.select("a"), "a", "left_semi")
    twice = links.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a")
    return above.limit(1).unionByName(twice.limit(1)).isEmpty()
