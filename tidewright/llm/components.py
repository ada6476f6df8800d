"""Connected components of a graph held as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components


def connected_components(links: DataFrame) -> DataFrame:
    """node, label for every node of links (src, dst); label is the smallest node of the component."""
    return components(links.select(F.col("src").alias("u"), F.col("dst").alias("v"))).select("node", F.col("component").alias("label"))
