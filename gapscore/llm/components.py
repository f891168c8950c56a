"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapscore.llm.work import Scratch


def _large_star(links: DataFrame) -> DataFrame:
    """Links the larger neighbours of each node to the smallest of its neighbours and itself."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def component_roots(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node that is not the smallest of its component.

    ``links`` has columns u and v of one orderable type; loops are ignored. Alternates large and small
    stars, each written to the shared folder, until the links no longer change, about log(n) times.
    """
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    links = scratch.keep(links, "links0")
    state = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before, n = state(links), 0
    while before[0]:
        starred = scratch.keep(_large_star(links), f"large{n}")
        links = scratch.keep(_small_star(starred), f"links{n + 1}")
        scratch.drop(f"links{n}", f"large{n}")
        n, last, before = n + 1, before, state(links)
        if before == last:
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
