"""Unit-level joins, validation, diagnostics and entity extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitextra.functions.markup import (
    FORMAT_PLACEHOLDER, MTEXT_CODE, RAW_FORMAT_CODE, line_breaks, mtext_flags,
)
from bitextra.functions.text import strip
from bitextra.operators.leaks import skip_action

UNIT = ["doc_id", "unit_idx"]

# Default skip rules in order, and categories of entity types.
SKIP_RULES = (
    (r"^DN\d+", "SKIP"),
    (r"\d+[×xх]\d+", "SKIP"),
    (r"Ø\d+", "SKIP"),
    (r"ISO\d+", "SKIP"),
    (r"GOST\s*\d+", "SKIP"),
    (r"ГОСТ\s*\d+", "SKIP"),
    (r"^\d+$", "SKIP"),
    (r"^[A-Z]{2,}\d*$", "SKIP"),
    (r"^[A-Za-z]+\d+[A-Za-z]+$", "SKIP"),
)
TAGGED_TYPES = ("ATTRIB", "ATTDEF")


def align_pairs(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """Source and target paragraphs by document and index; a side may be missing."""
    return src.select("doc_id", "idx", F.col("text").alias("source")).join(
        tgt.select("doc_id", "idx", F.col("text").alias("target")), ["doc_id", "idx"], "full_outer"
    )


def missing_units(units: DataFrame, delivered: DataFrame) -> DataFrame:
    """Units without a delivered translation."""
    return units.join(delivered.select(*UNIT), UNIT, "left_anti")


def overlay_results(first: DataFrame, retry: DataFrame) -> DataFrame:
    """Results of both passes, the retry winning."""
    return (
        first.select(*UNIT, F.col("text").alias("_a"))
        .join(retry.select(*UNIT, F.col("text").alias("_b")), UNIT, "full_outer")
        .select(*UNIT, F.coalesce("_b", "_a").alias("text"))
    )


def source_fallback(units: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Blank or missing targets replaced by the source and flagged."""
    blank = F.coalesce(F.length(strip(F.col(target))), F.lit(0)) == 0
    return units.withColumn("fell_back", blank).withColumn(
        "final", F.when(blank, F.col(source)).otherwise(F.col(target))
    )


def validate_pairs(pairs: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Leftover placeholders, raw format codes and unequal line counts."""
    s, t = F.col(source), F.col(target)
    return (
        pairs.withColumn("placeholder_issue", t.rlike(FORMAT_PLACEHOLDER))
        .withColumn("fmt_code_issue", t.rlike(RAW_FORMAT_CODE))
        .withColumn("line_count_mismatch", line_breaks(s) != line_breaks(t))
    )


def pair_validation_summary(flagged: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Issue counts and PASS / WARN / FAIL."""
    return (
        flagged.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("checked"),
            F.count_if("placeholder_issue").alias("placeholder_issues"),
            F.count_if("fmt_code_issue").alias("fmt_code_issues"),
            F.count_if("line_count_mismatch").alias("line_count_mismatches"),
        )
        .withColumn(
            "status",
            F.when(F.col("placeholder_issues") > 0, "FAIL")
            .when((F.col("fmt_code_issues") > 0) | (F.col("line_count_mismatches") > 0), "WARN")
            .otherwise("PASS"),
        )
    )


def mtext_stats(units: DataFrame, text: str = "text", failed: str = "failed") -> DataFrame:
    """Share of units with format codes among all and among failed ones (A5)."""
    has = F.col(text).rlike(MTEXT_CODE)
    bad = F.col(failed)
    share = lambda part, whole: F.coalesce(  # noqa: E731 - two uses of one ratio
        F.round(part * 100.0 / F.nullif(whole, F.lit(0)), 4), F.lit(0.0)
    )
    counted = units.agg(
        F.count(F.lit(1)).alias("units"), F.count_if(has).alias("with_codes"),
        F.count_if(bad).alias("failed"), F.count_if(bad & has).alias("failed_with_codes"),
    )
    return counted.withColumn("pct_all", share(F.col("with_codes"), F.col("units"))).withColumn(
        "pct_failed", share(F.col("failed_with_codes"), F.col("failed"))
    )


def failed_unit_diagnostics(
    units: DataFrame, text: str = "text", loss_type: str | None = "partial_batch_loss", keys: tuple[str, ...] = ()
) -> DataFrame:
    """length, code flags, preview of 80 characters and the kind of loss.

    ``keys`` (job, batch, attempt) are kept in front; units of a batch that
    failed as a whole have no kind of loss.
    """
    return units.select(
        *keys, *UNIT,
        F.length(text).cast("long").alias("length"),
        *mtext_flags(F.col(text)),
        F.substring(text, 1, 80).alias("preview"),
        F.lit(loss_type).cast("string").alias("loss_type"),
    )


def categorize(entities: DataFrame) -> DataFrame:
    """Category of each entity by type, tag flag and text."""
    kind = F.col("entity_type")
    return entities.withColumn(
        "category",
        F.when(kind.isin(*TAGGED_TYPES) & F.coalesce("is_tag", F.lit(False)), "METADATA")
        .when((kind == "DIMENSION") & (F.length(strip(F.col("text"))) == 0), "MEASUREMENT")
        .when(kind == "FORMULA", "FORMULA")
        .otherwise("TRANSLATE"),
    )


def extract_translatable(entities: DataFrame, rules=SKIP_RULES) -> DataFrame:
    """TRANSLATE entities with their rule action and status; skipped ones stay marked (P25)."""
    return (
        categorize(entities).filter(F.col("category") == "TRANSLATE")
        .withColumn("action", skip_action(F.col("text"), rules))
        .withColumn("status", F.when(F.col("action") == "SKIP", "SKIPPED").otherwise("PENDING"))
        .withColumn("context", F.coalesce("layer", F.lit("")))
    )


def page_drift(src_pages: DataFrame, tgt_pages: DataFrame) -> DataFrame:
    """Pages of original and translation and their difference."""
    def pages(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("doc_id").agg(F.countDistinct("page").alias(name))

    return (
        pages(src_pages, "original_pages").join(pages(tgt_pages, "translated_pages"), "doc_id",
                                                "full_outer")
        .na.fill(0, ["original_pages", "translated_pages"])
        .withColumn("page_delta", F.col("translated_pages") - F.col("original_pages"))
    )
