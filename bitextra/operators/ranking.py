"""Skew-safe ranks, running sums and neighbours within a key.

A plain window sorts a whole key in one task. Here a key is cut into chunks
that are monotone in the order, each chunk is windowed on its own, and the
totals of earlier chunks - a small pre-aggregated table - are joined back. A
key with a third of all rows is spread over as many tasks as it has chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_CHUNK = 65536
# A key is hot from this share of the rows on; the share bounds the number of hot keys.
HOT_SHARE = 1 / 4096


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join in which null keys meet null keys; the columns of ``left`` and the new ones of ``right``."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, same, how).drop(*[f"_r_{k}" for k in keys])


def _offsets(df: DataFrame, keys: list[str], amount: Column, out: str) -> DataFrame:
    totals = df.groupBy(*keys, "_chunk").agg(F.sum(amount).alias("_amount"))
    before = (
        Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    return totals.select(
        *keys, "_chunk", F.coalesce(F.sum("_amount").over(before), F.lit(0)).alias(out)
    )


def chunked_rank(
    df: DataFrame, keys: list[str], order: list[Column], chunk: Column, out: str = "rank"
) -> DataFrame:
    """1-based row number within ``keys`` by ``order``; null is a key and a chunk of its own.

    ``chunk`` must never decrease along ``order``, e.g. ``floor(idx / 65536)``
    for a running index or the hour of a timestamp.
    """
    cut = df.withColumn("_chunk", chunk)
    before = _offsets(cut, keys, F.lit(1), "_before")
    local = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    return (
        join_null_safe(cut, before, [*keys, "_chunk"])
        .withColumn(out, (F.col("_before") + F.row_number().over(local)).cast("long"))
        .drop("_chunk", "_before")
    )


def chunked_previous(
    df: DataFrame, keys: list[str], order: list[Column], chunk: Column, value: str, out: str
) -> DataFrame:
    """The value of the preceding row within ``keys`` (lag by one).

    The last value of every chunk is taken by an aggregate that combines
    map-side; the window over chunk ends sees one row per chunk.
    """
    cut = df.withColumn("_chunk", chunk)
    ends = cut.groupBy(*keys, "_chunk").agg(
        F.max_by(F.col(value), F.struct(*order)).alias("_end")
    )
    per_key = Window.partitionBy(*keys).orderBy("_chunk")
    carried = ends.select(*keys, "_chunk", F.lag("_end").over(per_key).alias("_carried"))
    local = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    return (
        join_null_safe(cut, carried, [*keys, "_chunk"])
        .withColumn("_first", F.row_number().over(local) == 1)
        .withColumn(
            out,
            F.when(F.col("_first"), F.col("_carried")).otherwise(F.lag(value).over(local)),
        )
        .drop("_chunk", "_carried", "_first")
    )


def first_n(
    df: DataFrame, keys: list[str], order: list[Column], n: int, salt: Column, buckets: int = 64
) -> DataFrame:
    """The first ``n`` rows of every key by ``order``, in two stages.

    Each salt bucket keeps its own first ``n``; the last window then sees at
    most ``n * buckets`` rows of a key. ``salt`` should identify the row.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(buckets)))
    local = Window.partitionBy(*keys, "_salt").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn("_r", F.row_number().over(local))
        .filter(F.col("_r") <= n)
        .withColumn("_r", F.row_number().over(final))
        .filter(F.col("_r") <= n)
        .drop("_salt", "_r")
    )


def salted_lookup(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    row_id: list[str],
    how: str = "left",
    hot_share: float = HOT_SHARE,
    hot_rows: int = 1_000_000,
    buckets: int = 64,
) -> DataFrame:
    """Join whose hot left keys are spread over ``buckets`` tasks.

    Keys with more than ``hot_rows`` left rows and more than ``hot_share`` of
    them are found by a map-side combined count; only their right rows are
    copied, once per bucket. Every other key joins as usual. The share bounds
    the number of hot keys; they are broadcast as 128-bit hashes, so the list
    is small however long the keys are. Left rows with a null key match
    nothing and are spread over the buckets.
    """
    key = [F.xxhash64(*on), F.xxhash64(F.lit(1), *on)]
    counts = (
        left.groupBy(key[0].alias("_k0"), key[1].alias("_k1"))
        .agg(F.count(F.lit(1)).alias("_rows")).withColumn("_all", F.lit(0))
    )
    # One row: the sum of the counts.
    total = counts.groupBy("_all").agg(F.sum("_rows").alias("_total"))
    hot = F.broadcast(
        counts.filter(F.col("_rows") > hot_rows)
        .join(F.broadcast(total), "_all")
        .filter(F.col("_rows") > F.col("_total") * hot_share)
        .select("_k0", "_k1", F.lit(True).alias("_hot"))
    )

    def marked_by(df: DataFrame) -> DataFrame:
        named = df.withColumns({"_k0": key[0], "_k1": key[1]})
        return named.join(hot, ["_k0", "_k1"], "left").drop("_k0", "_k1")

    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(buckets - 1))).otherwise(
        F.array(F.lit(0))
    )
    spread_right = (
        marked_by(right).withColumn("_salt", F.explode(copies)).drop("_hot")
    )
    lacking = F.lit(False)
    for name in on:
        lacking = lacking | F.col(name).isNull()
    salt = F.when(
        F.coalesce(F.col("_hot"), F.lit(False)) | lacking, F.pmod(F.xxhash64(*row_id), F.lit(buckets)).cast("int")
    ).otherwise(F.lit(0))
    marked = marked_by(left).withColumn("_salt", salt).drop("_hot")
    return marked.join(spread_right, [*on, "_salt"], how).drop("_salt")
