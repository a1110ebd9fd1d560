"""Connected components of links between ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import shared_folder


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component): for every id in links (a, b), the smallest id reachable from it.

    Alternates two steps that hang every id below the smallest id it knows, until nothing changes.
    All sums over an id's links are minima, combined before the shuffle, and nothing is collected
    but two numbers a round. Rows with a null side and links of an id with itself are left out.
    Raises RuntimeError if `most_rounds` (far above the logarithm of any number of links) passes.
    """
    shared_folder(links.sparkSession)
    edges = (
        links.where("a != b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
        .checkpoint()
    )
    before = None
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = (
            both.where("v > u").join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        roots = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = (
            large.join(roots, "u")
            .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                                      F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u != v")
            .distinct()
            .checkpoint()
        )
        now = edges.agg(
            F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.countDistinct("u")
        ).first()
        if now == before and now[0] == now[2]:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
                edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            )
        before = now
    raise RuntimeError("links did not settle")
