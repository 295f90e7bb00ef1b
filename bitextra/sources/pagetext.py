"""Page-text records: one JSON object per rendered page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitextra.functions.text import runs

CORRUPT = "_corrupt"
PAGE_SCHEMA = (
    "page INT, pdf STRING, text STRING, words ARRAY<STRUCT<text: STRING, x0: DOUBLE, y0: DOUBLE, "
    f"x1: DOUBLE, y1: DOUBLE, block: INT, line: INT, word: INT>>, {CORRUPT} STRING"
)


def read_page_text(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Pages of a folder or file; blank and malformed lines are skipped."""
    reader = spark.readStream if streaming else spark.read
    pages = (
        reader.schema(PAGE_SCHEMA)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
    )
    return pages.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def page_lines(pages: DataFrame) -> DataFrame:
    """Visual lines of every page (S2): pdf, page, pos, block, line, text.

    Words are grouped by (block, line) in first-seen order inside the row; a
    page without words falls back to the lines of its raw text.
    """
    words = F.col("words")
    keyed = F.transform(
        words,
        lambda w, i: F.struct(
            F.coalesce(w["block"], F.lit(0)).alias("block"), F.coalesce(w["line"], F.lit(0)).alias("line"),
            i.alias("i"), F.coalesce(w["text"], F.lit("")).alias("text"),
        ),
    )

    def line_of(run: Column) -> Column:
        first = F.get(run, F.lit(0))
        return F.struct(
            first["i"].alias("i"), first["block"].alias("block"), first["line"].alias("line"),
            F.array_join(F.transform(run, lambda w: w["text"]), " ").alias("text"),
        )

    # Sorted once by line, cut into lines, and these put in the order of their first words.
    lines = F.transform(
        runs(F.sort_array(keyed), lambda x, y: (x["block"] == y["block"]) & (x["line"] == y["line"])), line_of
    )
    of_words = F.transform(
        F.sort_array(lines), lambda x: F.struct(x["block"].alias("block"), x["line"].alias("line"), x["text"].alias("text"))
    )
    none = F.lit(None).cast("int")
    of_text = F.transform(
        F.split(F.coalesce("text", F.lit("")), "\n"),
        lambda t: F.struct(none.alias("block"), none.alias("line"), t.alias("text")),
    )
    found = F.when(F.size(F.coalesce(words, F.array().cast(words_type()))) > 0, of_words).otherwise(
        of_text
    )
    return pages.select("pdf", "page", F.posexplode_outer(found).alias("pos", "l")).select(
        "pdf", "page", "pos", F.col("l.block").alias("block"), F.col("l.line").alias("line"),
        F.col("l.text").alias("text"),
    )


def words_type() -> str:
    return (
        "array<struct<text:string,x0:double,y0:double,x1:double,y1:double,block:int,line:int,word:int>>"
    )
