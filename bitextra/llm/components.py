"""Connected components named by their smallest node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import components
from ..operators.lookup import lookup
from ..session import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of ``edges`` (a, b); component is its smallest id.

    Rows with a null end and loops are ignored. Chains and stars of any size
    go in a number of rounds that follows the logarithm of their size; nothing
    but a row count per round reaches the driver. The smallest ids are
    map-side combined minima, looked up with large components spread.
    """
    found = cut_lineage(components.connected_components(edges))
    smallest = found.groupBy("component").agg(F.min("id").alias("_least"))
    named = lookup(found, cut_lineage(smallest), ["component"], ["id"], "inner")
    return named.select("id", F.col("_least").alias("component"))
