"""Numeric drift and the integrity gate over parallel units and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitextra.functions.numeric import TOKEN_TYPE, drift_of, numeric_tokens, repair
from bitextra.functions.text import is_mixed_unit, let, norm_ws, unescape_markup
from bitextra.session import cut_lineage
from bitextra.operators.ranking import ROWS_PER_CHUNK, chunked_rank, first_n

# Loss tolerance and the length of a legal reference number.
MIN_TOLERANCE = 3
TOLERANCE_SHARE = 0.05
REF_LENGTH = (2, 6)
VERIFIED_KINDS = ("ref", "sub", "num")
PARAGRAPH = "para"


def nonempty_paragraphs(paragraphs: DataFrame, text: str = "text") -> DataFrame:
    """Tags stripped, entities resolved, white space collapsed, blanks dropped."""
    return paragraphs.withColumn(text, _clean(F.col(text))).filter(F.length(text) > 0)


def _clean(c: Column) -> Column:
    return norm_ws(unescape_markup(c))


def numeric_drift(pairs: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Lost ref/sub/num values per unit, paired with extra ones by rank.

    Row-local: both multisets, their difference and the pairing are array
    expressions, so no unit is ever shuffled.
    """
    keep = [c for c in pairs.columns if c not in (source, target)]
    return (
        pairs.filter(F.col(source).rlike(r"\p{Nd}"))
        .withColumn("_s", numeric_tokens(F.col(source)))
        .withColumn("_t", numeric_tokens(F.coalesce(F.col(target), F.lit(""))))
        .withColumn("_d", drift_of(F.col("_s"), F.col("_t")))
        .select(*keep, F.explode_outer("_d").alias("_d"))
        .filter(F.col("_d").isNotNull())
        .select(
            *keep,
            F.col("_d.kind").alias("kind"),
            F.col("_d.source").alias("lost"),
            F.col("_d.target").alias("extra"),
            F.col("_d.rank").cast("long").alias("rank"),
        )
    )


def repair_numerics(units: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Target with drifted references and designators repaired.

    Adds ``repaired`` and ``unresolved`` (mismatches left as they were).
    """
    return (
        units.withColumn("_s", numeric_tokens(F.col(source)))
        .withColumn("_d", drift_of(F.col("_s"), numeric_tokens(F.col(target))))
        .withColumn("_r", repair(F.col(target), F.col("_d"), F.col("_s")))
        .withColumn("repaired", F.col("_r.text"))
        .withColumn("unresolved", F.col("_r.unresolved").cast("long"))
        .drop("_s", "_d", "_r")
    )


def document_values(src: DataFrame, tgt: DataFrame, paragraphs: bool = False) -> DataFrame:
    """Per (doc_id, kind, value): counts and first positions on both sides.

    Inputs hold doc_id, idx and text. One shuffle, combined map-side. With
    ``paragraphs`` raw texts are cleaned first and every non-empty paragraph
    also counts as a value of kind ``para``, ``mixed`` or ``plain``, so that
    one pass over the text serves all checks.
    """

    def exploded(side: DataFrame, name: str) -> DataFrame:
        def features(t: Column) -> Column:
            mixed = is_mixed_unit(t) if name == "t" else F.lit(False)
            marker = F.struct(
                F.lit(PARAGRAPH).alias("kind"), F.lit("").alias("raw"),
                F.when(mixed, "mixed").otherwise("plain").alias("value"),
            )
            return F.when(
                F.length(t) > 0,
                F.concat(F.array(marker).cast(TOKEN_TYPE), numeric_tokens(t)),
            )

        if paragraphs:
            # Cleaned inside the generator: a filter on cleaned text would be
            # pushed down and clean every paragraph twice.
            tokens = let(_clean(F.col("text")), features)
        else:
            side = side.filter(F.col("text").rlike(r"\p{Nd}"))
            tokens = numeric_tokens(F.col("text"))
        return (
            side.select("doc_id", "idx", F.posexplode_outer(tokens).alias("p", "tok"))
            .filter(F.col("tok.kind").isin(*VERIFIED_KINDS, PARAGRAPH))
            .select(
                "doc_id",
                F.col("tok.kind").alias("kind"),
                F.col("tok.value").alias("value"),
                F.struct(F.col("idx").cast("long").alias("idx"), "p").alias("at"),
                F.lit(name).alias("side"),
            )
        )

    def on(name: str) -> Column:
        return F.col("side") == name

    return (
        exploded(src, "s").unionByName(exploded(tgt, "t"))
        .groupBy("doc_id", "kind", "value")
        .agg(
            F.count_if(on("s")).alias("n_source"),
            F.count_if(on("t")).alias("n_target"),
            F.min(F.when(on("s"), F.col("at"))).alias("source_at"),
            F.min(F.when(on("t"), F.col("at"))).alias("target_at"),
        )
    )


def document_drift(values: DataFrame, written: bool = False) -> DataFrame:
    """Document-level lost values paired with extra ones (J9 over documents).

    Only surplus copies are expanded and ranked; ranks are chunked by
    paragraph, then lost and extra meet in an equi join on the rank. The
    drifted values - a small part of the tokens - are written out once because the
    ranking reads them four times (``written``: the caller already did).
    """
    values = values.filter(F.col("n_source") != F.col("n_target"))
    if not written:
        values = cut_lineage(values)

    def surplus(more: str, fewer: str, at: str, out: str) -> DataFrame:
        gap = F.col(more) - F.col(fewer)
        copies = (
            values.filter(gap > 0)
            .select(
                "doc_id", "kind", F.col("value").alias(out), F.col(at).alias("at"),
                F.explode(F.sequence(F.lit(1).cast("long"), gap)).alias("copy"),
            )
        )
        return chunked_rank(
            copies,
            ["doc_id", "kind"],
            [F.col("at"), F.col(out), F.col("copy")],
            F.floor(F.col("at.idx") / ROWS_PER_CHUNK),
        ).select("doc_id", "kind", "rank", out)

    lost = surplus("n_source", "n_target", "source_at", "lost")
    extra = surplus("n_target", "n_source", "target_at", "extra")
    return lost.join(extra, ["doc_id", "kind", "rank"], "left").withColumn(
        "extra", F.coalesce("extra", F.lit(""))
    )


def is_legal_reference(kind: Column, lost: Column, extra: Column) -> Column:
    """A drifted reference of two to six digits on both sides where present."""
    return (
        (kind == "ref")
        & F.length(lost).between(*REF_LENGTH)
        & ((extra == "") | F.length(extra).between(*REF_LENGTH))
    )


def integrity_report(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """One row per source document: loss, drift, mixed units and the verdict (A3).

    ``src`` and ``tgt`` hold doc_id, idx and text. Numbers are compared on the
    multiset of the whole document; tokens are taken per paragraph. The text is
    read once; everything else works on the written value counts. Critical
    means lost paragraphs beyond max(3, 5 %) or a drifted legal reference.
    """
    values = cut_lineage(document_values(src, tgt, paragraphs=True))
    counts = (
        values.filter(F.col("kind") == PARAGRAPH)
        .groupBy("doc_id")
        .agg(
            F.sum("n_source").alias("n_source"),
            F.sum("n_target").alias("n_target"),
            F.sum(F.when(F.col("value") == "mixed", F.col("n_target")).otherwise(0))
            .alias("mixed_count"),
        )
        .filter(F.col("n_source") > 0)
    )
    drift = (
        document_drift(values.filter(F.col("kind") != PARAGRAPH), written=True)
        .groupBy("doc_id")
        .agg(
            F.count(F.lit(1)).alias("numeric_mismatch_count"),
            F.count_if(is_legal_reference(F.col("kind"), F.col("lost"), F.col("extra")))
            .alias("ref_mismatch_count"),
        )
    )
    deficit = F.col("n_source") - F.col("n_target")
    tolerance = F.greatest(
        F.lit(MIN_TOLERANCE), F.floor(F.col("n_source") * F.lit(TOLERANCE_SHARE))
    )
    zero = F.lit(0).cast("long")
    return (
        counts.join(drift, "doc_id", "left")
        .withColumn("lost_paragraphs", F.when(deficit > tolerance, deficit).otherwise(zero))
        .withColumn("numeric_mismatch_count", F.coalesce("numeric_mismatch_count", zero))
        .withColumn("ref_mismatch_count", F.coalesce("ref_mismatch_count", zero))
        .withColumn(
            "critical", (F.col("lost_paragraphs") > 0) | (F.col("ref_mismatch_count") > 0)
        )
        .select(
            "doc_id", "n_source", "n_target", "lost_paragraphs", "numeric_mismatch_count",
            "ref_mismatch_count", "mixed_count", "critical",
        )
    )


def mixed_samples(tgt: DataFrame, limit: int = 50, width: int = 200) -> DataFrame:
    """The first ``limit`` mixed paragraphs of each document, cut to ``width``."""
    mixed = nonempty_paragraphs(tgt).filter(is_mixed_unit(F.col("text")))
    return first_n(mixed, ["doc_id"], [F.col("idx")], limit, F.col("idx")).select(
        "doc_id", "idx", F.substring("text", 1, width).alias("sample")
    )
