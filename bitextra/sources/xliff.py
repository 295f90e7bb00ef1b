"""Exchange files with translation units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitextra.functions.markup import visible_text, without_comments
from bitextra.functions.text import unescape_entities


def _attribute(tag: Column, name: str) -> Column:
    quoted = F.regexp_extract(tag, rf"""\b{name}\s*=\s*(?:"([^"]*)"|'([^']*)')""", 1)
    single = F.regexp_extract(tag, rf"""\b{name}\s*=\s*(?:"([^"]*)"|'([^']*)')""", 2)
    return unescape_entities(F.concat(quoted, single))


def _element(unit: Column, name: str) -> Column:
    """Raw content of the first such element; empty for <name/>, null when absent."""
    content = F.regexp_extract(
        unit, rf"(?s)<(?:\w+:)?{name}\b[^>]*?(?:/>|>(.*?)</(?:\w+:)?{name}\s*>)", 1
    )
    return F.when(unit.rlike(rf"<(?:\w+:)?{name}\b"), content)


def read_xliff(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Units of the files below ``path`` (S3): file, unit_id, source, target, translate.

    Files are cut at unit ends by the text source, so one large file is read
    by many tasks, and the raw markup stays: an escaped ``&lt;b&gt;`` is text
    while ``<g>`` is a tag. Units without id or source are skipped. ``target``
    is null when the element is missing and empty when it is blank. Character
    references and CDATA are text; comments are dropped, and with them a unit
    that lies in one (a comment is looked for within the piece of one unit).
    """
    reader = spark.read.option("lineSep", "</trans-unit>")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    opened = r"(?s)^.*<trans-unit\b([^>]*)>(.*)$"
    # A comment that holds the unit is still open where the piece ends.
    value = F.regexp_replace(without_comments(F.col("value")), r"(?s)<!--.*$", "")
    pieces = reader.text(path).filter(F.col("value").contains("<trans-unit"))
    raw = pieces.withColumn("value", value).filter(F.col("value").contains("<trans-unit")).select(
        F.col("_metadata.file_path").alias("file"),
        F.regexp_extract("value", opened, 1).alias("tag"),
        F.regexp_replace(
            F.regexp_extract("value", opened, 2), r"(?s)<alt-trans\b.*?</alt-trans>", ""
        ).alias("unit"),
    )
    source = _element(F.col("unit"), "source")
    return raw.filter((_attribute(F.col("tag"), "id") != "") & source.isNotNull()).select(
        "file",
        _attribute(F.col("tag"), "id").alias("unit_id"),
        source.alias("source_xml"),
        visible_text(source).alias("source"),
        visible_text(_element(F.col("unit"), "target")).alias("target"),
        (F.lower(_attribute(F.col("tag"), "translate")) != "no").alias("translate"),
    )


def write_xliff(units: DataFrame, path: str) -> None:
    """Units (unit_id, source, target) as exchange files, one per task."""
    units.select(F.col("unit_id").alias("_id"), "source", "target").write.format("xml").option(
        "rowTag", "trans-unit"
    ).option("rootTag", "xliff").save(path)
