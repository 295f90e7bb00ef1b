"""Connected components by contraction and pointer jumping, each step written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitextra.session import cut_lineage


def _roots(parents: DataFrame) -> DataFrame:
    """(a, p) with every parent replaced by the root of its tree; the way halves with each jump."""
    while True:
        above = parents.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        jumped = cut_lineage(parents.join(above, "p").select("a", "p", "pp"))
        parents = jumped.select("a", F.col("pp").alias("p"))
        if jumped.filter(F.col("p") != F.col("pp")).isEmpty():
            return parents


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of ``edges`` (a, b longs); a component is named by one of its nodes.

    In a round every node hangs on the neighbour of the smallest hash, if that
    is below its own; each tree becomes one node. Hashes do not follow the
    order of ids, so chains shrink by a constant factor a round and trees stay
    flat whatever the ids are. Rows with a null end and loops are ignored.
    """
    ends = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    pairs = cut_lineage(ends.filter(F.col("a") != F.col("b")).distinct())
    labels = None
    while not pairs.isEmpty():
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ranked = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("id"))).alias("n"))
        me = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("id"))
        parents = _roots(cut_lineage(ranked.select("a", F.least(me, F.col("n"))["id"].alias("p"))))
        step = parents.select(F.col("a").alias("component"), F.col("p").alias("_next"))
        if labels is None:
            labels = step.select(F.col("component").alias("id"), F.col("_next").alias("component"))
        else:
            labels = labels.join(step, "component", "left").select(
                "id", F.coalesce("_next", "component").alias("component")
            )
        labels = cut_lineage(labels)
        left = parents.select("a", F.col("p").alias("pa"))
        right = parents.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        moved = pairs.join(left, "a").join(right, "b").filter(F.col("pa") != F.col("pb"))
        pairs = cut_lineage(
            moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        )
    if labels is None:
        return pairs.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return labels
