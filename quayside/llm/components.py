"""Connected components of a graph given as a table of links.

Alternates two steps until nothing changes: every node hands its larger neighbours to its smallest
one, then every node its smaller neighbours. Each step is written to the shared folder. The
smallest neighbours are aggregated and stored first, so that the join back to the links is a plain
shuffle join in which a node with very many links can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import stored


def _handed(links: DataFrame) -> DataFrame:
    """Links (u, v), u the node: each v, and the node, linked to the smallest of both."""
    least = stored(links.groupBy("u").agg(F.min("v").alias("m")), "least").select(
        "u", F.least("u", "m").alias("m")
    )
    return links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        least.select("u", F.col("m").alias("v"))
    ).where("u <> v").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node of ``links`` (columns a and b)."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    rows = stored(links.where("a <> b").select(high.alias("u"), low.alias("v")).distinct(), "links")
    before = None
    while True:
        both = rows.unionByName(rows.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _handed(both).where("u > v")
        rows = stored(_handed(stored(large, "links")), "links")
        state = rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return rows.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        rows.select(F.col("v").alias("node"), F.col("v").alias("component"))
    ).distinct()
