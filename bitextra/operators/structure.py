"""Structure comparison, bloat gate and the corpus report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Counters that must match, counters that may change, size limit.
TOPOLOGICAL = ("paragraphs", "tables", "rows", "media")
COUNTS = ("text_elements", "tabs")
BLOAT_PARAGRAPHS = 50_000


def compare_structures(original: DataFrame, translated: DataFrame) -> DataFrame:
    """One row per document and counter (A2): values, kind and status.

    A changed topological counter is a hard failure, a changed count a warning.
    """
    def long(df: DataFrame, out: str) -> DataFrame:
        return df.unpivot("doc_id", [*TOPOLOGICAL, *COUNTS], "name", out)

    kind = F.when(F.col("name").isin(*TOPOLOGICAL), "topological").otherwise("count")
    return (
        long(original, "original").join(long(translated, "translated"), ["doc_id", "name"])
        .withColumn("kind", kind)
        .withColumn(
            "status",
            F.when(F.col("original") == F.col("translated"), "ok").otherwise("delta"),
        )
    )


def structure_verdict(deltas: DataFrame) -> DataFrame:
    """Names of hard failures and warnings per document; at most six each."""
    def names(kind: str):
        hit = (F.col("kind") == kind) & (F.col("status") == "delta")
        return F.array_join(F.array_sort(F.collect_set(F.when(hit, F.col("name")))), ",")

    return deltas.groupBy("doc_id").agg(
        names("topological").alias("hard_failures"), names("count").alias("warnings")
    )


def bloat_gate(
    catalogue: DataFrame, profiles: DataFrame, threshold: int = BLOAT_PARAGRAPHS
) -> DataFrame:
    """Documents above the paragraph limit and stored flags that disagree."""
    return (
        catalogue.select("doc_id", F.col("bloat").alias("stored"))
        .join(profiles.select("doc_id", "paragraphs"), "doc_id")
        .withColumn("bloat", F.col("paragraphs") > threshold)
        .withColumn("eligible", ~F.col("bloat"))
        .withColumn("flag_mismatch", F.col("bloat") != F.col("stored"))
    )


def corpus_report(sections: dict[str, DataFrame]) -> DataFrame:
    """Totals of all sections in one long frame (S15): doc_id, section, total.

    Every section is a frame of findings with doc_id; each is counted map-side
    before the union.
    """
    parts = [
        df.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"))
        .select("doc_id", F.lit(name).alias("section"), "total")
        for name, df in sections.items()
    ]
    return reduce(DataFrame.unionByName, parts)
