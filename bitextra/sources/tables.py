"""Glossaries, journals, catalogue, manifest and report as tables and files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitextra.functions.text import COLUMN_LANGUAGE
from bitextra.operators.ranking import chunked_rank, join_null_safe

WORDS = list(COLUMN_LANGUAGE)
BOM = "﻿"
DEFAULT = "default"


def collection_of(table: str) -> str:
    """``glossary`` is the default collection, ``glossary_<id>`` the collection id."""
    return DEFAULT if table == "glossary" else table.removeprefix("glossary_")


def glossary_from_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """All glossary tables as one frame with ``collection_id``."""
    parts = [
        df.select("id", *WORDS).withColumn("collection_id", F.lit(collection_of(name)))
        for name, df in sorted(tables.items())
    ]
    return reduce(DataFrame.unionByName, parts)


def read_glossary(spark: SparkSession, jdbc: dict | None = None, names=None, bounds=None):
    """Glossary tables of the catalog, or of a database when ``jdbc`` options are given.

    ``bounds`` (lower, upper, partitions) splits a database read by id.
    """
    if jdbc is None:
        names = names or [
            t.name for t in spark.catalog.listTables()
            if t.name == "glossary" or t.name.startswith("glossary_")
        ]
        return glossary_from_tables({n: spark.table(n) for n in names})
    tables = {}
    for name in names or ["glossary"]:
        reader = spark.read.format("jdbc").options(**jdbc).option("dbtable", name)
        if bounds:
            low, high, parts = bounds
            reader = (
                reader.option("partitionColumn", "id").option("lowerBound", low)
                .option("upperBound", high).option("numPartitions", parts)
            )
        tables[name] = reader.load()
    return glossary_from_tables(tables)


def collection_entries(glossary: DataFrame, collection: str) -> DataFrame:
    """Entries of one collection; an unknown one falls back to the default."""
    known = not glossary.filter(F.col("collection_id") == collection).isEmpty()
    return glossary.filter(F.col("collection_id") == (collection if known else DEFAULT))


def read_glossary_csv(spark: SparkSession, path: str) -> DataFrame:
    """Import file (S8): row_num and the four word columns.

    A leading byte-order mark is ignored, further columns too; a missing
    column is an error. ``row_num`` is the record's place in its file, the
    header being 1. Quoted fields may hold line breaks, so one file is read by
    one task; many files are read by many.
    """
    raw = (
        spark.read.option("header", True).option("quote", '"').option("escape", '"')
        .option("multiLine", True).csv(path)
    )
    found = {c.lstrip(BOM).strip(): c for c in raw.columns}
    missing = [c for c in WORDS if c not in found]
    if missing:
        raise ValueError(f"glossary file lacks columns {missing}; found {sorted(found)}")
    placed = raw.select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        *[F.coalesce(F.col(f"`{found[c]}`"), F.lit("")).alias(c) for c in WORDS],
    ).withColumn("_place", F.monotonically_increasing_id())
    return (
        chunked_rank(placed, ["_file"], [F.col("_place")], F.col("_block"), "_n")
        .withColumn("row_num", F.col("_n") + 1)
        .select("row_num", *WORDS)
    )


def write_glossary_csv(glossary: DataFrame, path: str) -> None:
    """Export (S9): byte-order mark, header, four columns, in id order."""
    first, *rest = WORDS
    (
        glossary.orderBy("id").select(F.col(first).alias(BOM + first), *rest)
        .write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    )


ENTRY = (
    "timestamp STRING, level STRING, stage STRING, message STRING, filename STRING, "
    "details MAP<STRING, STRING>"
)
MONITORING_ENTRY = (
    "job_id STRING, owner_id STRING, filename STRING, format STRING, status STRING, "
    "timestamp STRING"
)


def _day_documents(spark: SparkSession, path: str, entry: str, glob: str, streaming: bool) -> DataFrame:
    """file, date, the fields of each entry, and an error where a document cannot be read.

    A document is one file whatever its line breaks; an unreadable one gives
    one row with its error. Dates missing in a document are those of its name.
    """
    reader = spark.readStream.schema("value STRING") if streaming else spark.read
    files = reader.format("text").option("wholetext", True).option("pathGlobFilter", glob)
    schema = f"date STRING, created_at STRING, entries ARRAY<STRUCT<{_fields(entry)}>>, _damaged STRING"
    options = {"columnNameOfCorruptRecord": "_damaged", "mode": "PERMISSIVE"}
    named = F.regexp_extract(F.col("_metadata.file_path"), r"(\d{4}-\d\d-\d\d)[^/]*$", 1)
    days = files.option("recursiveFileLookup", True).load(path).select(
        F.col("_metadata.file_path").alias("file"), named.alias("_named"),
        F.from_json("value", schema, options).alias("d"),
    )
    broken = F.col("d").isNull() | F.col("d._damaged").isNotNull()
    none = F.array(F.lit(None).cast(f"STRUCT<{_fields(entry)}>"))
    rows = days.select(
        "file", F.coalesce(F.when(~broken, F.col("d.date")), F.nullif("_named", F.lit(""))).alias("date"),
        F.when(broken, F.lit("not a JSON document")).alias("error"),
        F.explode(F.when(broken, none).otherwise(F.coalesce("d.entries", F.array().cast(f"ARRAY<STRUCT<{_fields(entry)}>>")))).alias("e"),
    )
    return rows.select("file", "date", "e.*", "error")


def _fields(entry: str) -> str:
    return ", ".join(f"{p.split(' ', 1)[0]}: {p.split(' ', 1)[1]}" for p in _split_fields(entry))


def _split_fields(entry: str) -> list[str]:
    out, depth, part = [], 0, ""
    for ch in entry:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(part.strip())
            part = ""
        else:
            part += ch
    return [*out, part.strip()]


def journal_documents(spark: SparkSession, path: str, glob: str = "journal*.json", streaming: bool = False) -> DataFrame:
    """Entries of day documents and one error row per unreadable document."""
    return _day_documents(spark, path, ENTRY, glob, streaming)


def monitoring_documents(
    spark: SparkSession, path: str, glob: str = "monitoring*.json", streaming: bool = False
) -> DataFrame:
    """Monitoring entries of day documents, as a table or as documents arrive."""
    return _day_documents(spark, path, MONITORING_ENTRY, glob, streaming)


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """Entries of day documents; an unreadable document gives no rows."""
    return journal_documents(spark, path).filter("error IS NULL").drop("file", "error")


def read_monitoring(spark: SparkSession, path: str) -> DataFrame:
    """Monitoring entries of day documents."""
    return monitoring_documents(spark, path).filter("error IS NULL").drop("file", "error")


def append_log(entries: DataFrame, path: str, day: str = "log_date") -> None:
    """Append entries below one folder per day.

    Each task writes its own file, so a busy day is not gathered in one place.
    """
    entries.write.mode("append").partitionBy(day).json(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Entries written by :func:`append_log`; days are pruned by filters on the folder."""
    return spark.read.schema(schema).json(path)


PROFILE = (
    "STRUCT<paragraphs: BIGINT, tables: BIGINT, rows: BIGINT, media: BIGINT, "
    "text_elements: BIGINT, tabs: BIGINT, pages: BIGINT>"
)
CATALOGUE_SCHEMA = (
    "case STRING, source_origin STRING, has_translation BOOLEAN, source_language STRING, "
    f"target_language STRING, profile_original {PROFILE}, profile_translated {PROFILE}, "
    "bloat BOOLEAN, bugs ARRAY<STRING>"
)


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Corpus catalogue, one JSON object per case."""
    return spark.read.schema(CATALOGUE_SCHEMA).json(path)


DIAGNOSTIC_KEY = ["job_id", "batch", "attempt"]


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def append_diagnostics(rows: DataFrame, path: str, write_id: str) -> None:
    """Append diagnostics once per job, batch and attempt.

    Each write has a folder of its own, named by ``write_id`` (a run, or the
    number of a micro-batch) and replaced when the write is repeated. Keys
    that an earlier write holds are left out, so a batch that is reported
    again by another run adds nothing; a row repeated within a write counts
    once. One writer at a time.
    """
    spark = rows.sparkSession
    fresh = rows.dropDuplicates()
    if _exists(spark, path):
        held = read_diagnostics(spark, path, rows.schema).filter(F.col("write_id") != write_id)
        fresh = join_null_safe(fresh, held.select(*DIAGNOSTIC_KEY).distinct(), DIAGNOSTIC_KEY, "left_anti")
    fresh.write.mode("overwrite").json(f"{path}/write_id={write_id}")


def read_diagnostics(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of all writes, with the ``write_id`` of each."""
    whole = T.StructType([*schema.fields, T.StructField("write_id", T.StringType())])
    return spark.read.schema(whole).json(path)


def read_manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, size and extension of submitted files.

    The plan comes from the file listing; as no content is selected, no file is opened.
    """
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true").load(path)
        .select(
            "path",
            F.col("length").alias("size"),
            F.upper(F.regexp_extract("path", r"[^/]\.([^./]+)$", 1)).alias("extension"),
        )
    )


def write_report(report: DataFrame, path: str) -> None:
    """Corpus report rows as JSON lines."""
    report.write.mode("overwrite").json(path)
