"""Connected components of links, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelkit.session import written


def _are_stars(edges: DataFrame) -> bool:
    """Whether every ``u`` hangs on one ``v`` that hangs on nothing."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("hangs"), F.lit(0).alias("held"))
    ends = ends.union(edges.select("v", F.lit(0), F.lit(1))).groupBy("id").agg(F.sum("hangs").alias("hangs"), F.max("held").alias("held"))
    return ends.where("hangs > 1 OR hangs = 1 AND held = 1").isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b", id: str = "id", component: str = "component") -> DataFrame:
    """(id, component) of every id that occurs in a link to another one; component is the smallest id.

    Alternating large-star and small-star rounds: every node's larger neighbours, then its smaller ones,
    are hung on the smallest node seen, until the links form stars; links that do so at first, such as the
    result of an earlier call, take no round.  Rounds grow with the logarithm of
    the size, each is a few joins on narrow rows, and a node of very many links is split by skew handling.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = written(edges, "links")
    while not _are_stars(edges):
        least = edges.union(edges.select("v", "u")).groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = edges.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.union(least).distinct(), "links")
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias(id), F.col("v").alias(component)).union(roots.select(F.col("v").alias(id), F.col("v").alias(component)))
