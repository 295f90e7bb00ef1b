"""Joins to a table that is broadcast where its measured size allows, else salted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitextra.operators.containment import fits_broadcast
from bitextra.operators.ranking import salted_lookup


def lookup(left: DataFrame, right: DataFrame, on: list[str], row_id: list[str], how: str = "left") -> DataFrame:
    """``left`` joined to ``right`` on ``on``; ``row_id`` names a row of ``left``.

    The right side is measured first. Small, it goes to the left rows where
    they are, so no key of them can be hot and none is counted; large, hot
    left keys are found and salted.
    """
    if fits_broadcast(right):
        return left.join(F.broadcast(right), on, how)
    return salted_lookup(left, right, on, row_id, how)
