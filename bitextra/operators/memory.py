"""Translation memory and de-duplicated entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitextra.functions.markup import encode_format_codes
from bitextra.functions.text import strip, tm_key
from bitextra.operators.ranking import salted_lookup


def build_tm(pairs: DataFrame, order: Column, source: str = "source", target: str = "target"):
    """Last stored translation per normalized key (A8); combined map-side."""
    return (
        pairs.withColumn("tm_key", tm_key(F.col(source)))
        .groupBy("tm_key")
        .agg(F.max_by(F.col(target), order).alias("translation"))
    )


def tm_lookup(units: DataFrame, tm: DataFrame, row_id: list[str], source: str = "source"):
    """Each unit with its remembered translation and a hit flag.

    A sentence that makes up a third of the corpus is one hot key; its units
    are salted over many tasks.
    """
    keyed = units.withColumn("tm_key", tm_key(F.col(source)))
    return (
        salted_lookup(keyed, tm, ["tm_key"], row_id)
        .withColumn("hit", F.col("translation").isNotNull())
        .drop("tm_key")
    )


def tm_stats(lookups: DataFrame, tm: DataFrame) -> DataFrame:
    """hits, misses and size."""
    marks = lookups.select("hit", F.lit(False).alias("stored")).unionByName(
        tm.select(F.lit(None).cast("boolean").alias("hit"), F.lit(True).alias("stored"))
    )
    return marks.agg(
        F.count_if("hit").alias("hits"),
        F.count_if(~F.col("hit")).alias("misses"),
        F.count_if("stored").alias("size"),
    )


def encoded_entities(entities: DataFrame) -> DataFrame:
    """Non-blank entities with their format codes encoded (handle, ord, text)."""
    return entities.filter(F.length(strip(F.col("text"))) > 0).withColumn(
        "encoded", encode_format_codes(F.col("text"))
    )


def dedup_entities(entities: DataFrame) -> DataFrame:
    """First entity per encoded text with the number of its copies.

    Copies are counted, not listed: the handles stay one row each and are found
    again through the encoded text, so no group of copies is ever collected.
    """
    return (
        encoded_entities(entities)
        .groupBy("encoded")
        .agg(
            F.min_by("handle", "ord").alias("entity_id"),
            F.min("ord").alias("first_ord"),
            F.count(F.lit(1)).alias("n_handles"),
        )
    )


def fan_out(entities: DataFrame, translations: DataFrame) -> DataFrame:
    """The translation of a text handed to every handle that shares it.

    ``translations`` holds encoded and translated, one row per text. The text
    with a third of all handles is salted.
    """
    return salted_lookup(
        encoded_entities(entities).select("handle", "encoded"),
        translations.select("encoded", "translated"),
        ["encoded"],
        ["handle"],
        how="inner",
    ).select("handle", "translated")
