"""Scans for leftover source text and glued words over tables of fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitextra.functions.glue import MAX_PER_FRAGMENT, Vocabulary, glue_findings
from bitextra.functions.text import classify_leak, cyrillic_count, strip


def scan_leaks(fragments: DataFrame, text: str = "text", prefixes=None) -> DataFrame:
    """One finding per fragment with leftover Cyrillic text.

    Keeps every other column and adds fragment, cyrillic_chars and reason.
    Narrow: no shuffle, and text without Cyrillic is dropped first.
    """
    return (
        fragments.filter(F.col(text).rlike("[Ѐ-ӿ]"))
        .withColumn("reason", classify_leak(F.col(text), prefixes))
        .filter(F.col("reason").isNotNull())
        .withColumn("fragment", strip(F.col(text)))
        .withColumn("cyrillic_chars", cyrillic_count(F.col("fragment")))
        .drop(text)
    )


def scan_glue(
    fragments: DataFrame,
    text: str = "text",
    vocab: Vocabulary = Vocabulary(),
    max_per_fragment: int = MAX_PER_FRAGMENT,
) -> DataFrame:
    """Glued words per fragment, at most five each, in text order.

    Row-local: the fragment is split, judged and cut inside one row, so a hot
    document costs no shuffle. The outer generator keeps the optimizer from
    pushing a copy of the whole expression down as a size filter.
    """
    keep = [c for c in fragments.columns if c != text]
    return (
        fragments.withColumn("_found", glue_findings(F.col(text), vocab, max_per_fragment))
        .select(*keep, F.col(text).alias("fragment"), F.posexplode_outer("_found").alias("pos", "_f"))
        .filter(F.col("_f").isNotNull())
        .select(
            *keep,
            "fragment",
            F.col("pos").cast("long").alias("pos"),
            F.col("_f.token").alias("token"),
            F.col("_f.reason").alias("reason"),
            F.col("_f.context").alias("context"),
        )
    )


def findings_totals(findings: DataFrame, keys=("doc_id",), kind: str = "kind") -> DataFrame:
    """Counts per document, kind and reason with roll-up totals.

    Rolled-up levels carry null. The expansion is aggregated map-side, so a
    document with a third of the findings reaches the shuffle as a few rows.
    """
    return findings.rollup(*keys, kind, "reason").agg(F.count(F.lit(1)).alias("n"))


def skip_action(c: Column, rules) -> Column:
    """First matching rule's action, SKIP for blank text, else PASS."""
    t = strip(c)
    out = F.when(F.length(t) == 0, F.lit("SKIP"))
    for pattern, action in rules:
        out = out.when(t.rlike(pattern), F.lit(action))
    return out.otherwise(F.lit("PASS"))
