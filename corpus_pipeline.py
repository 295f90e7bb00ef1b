"""The corpus pipeline: language, near copies, benchmark leaks, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitextra.llm.decontaminate import drop_leaks
from bitextra.llm.language_mixture import learn, predict
from bitextra.llm.near_dup import near_duplicates
from bitextra.llm.packing import contract_tokenizer, pack
from bitextra.llm.pii_bootstrap import find_pii, masked

# A text of which no language has this share is rejected, like one without letters.
LEAST_SHARE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that are null or without letters, in no learnt language, or without a leading one.

    A text is in no learnt language if its best mixture explains it less well
    than a background of equal trigrams. Where no row has a language to learn from, every row stays.
    """
    names, table = learn(docs)
    if not names:
        return docs
    # Each text reaches Python once: the other columns ride in a struct beside it.
    rest = F.struct(*[c for c in docs.columns if c != "text"]).alias("_row")
    judged = predict(docs.select(rest, "text"), names, table, keep=["_row", "text"])
    kept = judged.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE) & (F.col("gain") > 0))
    return kept.select("_row.*", "text").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of the smallest id.

    Repeated rows of one id and text count once; rows without an id stay.
    """
    judged = near_duplicates(docs.select("doc_id", "text"), words=5, percent=80)
    gone = judged.filter(~F.col("kept")).select("doc_id").distinct()
    named = docs.filter(F.col("doc_id").isNotNull())
    stay = named.join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"])
    return stay.select(*docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, edited within the budget or not."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind; n_chars follows the text."""
    found = find_pii(docs)
    clean = masked(F.col("text"), F.col("spans"))
    out = found.withColumn("text", F.when(F.size("spans") > 0, clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        n = F.when(F.size("spans") > 0, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of every document that is left, packed into training sequences."""
    return pack(docs, tokenizer_path=contract_tokenizer())


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("benchmark_leaks", benchmark_leaks),
    ("personal_data", personal_data),
    ("packing", packing),
]
# Mixture inference and packing have no SQL form; tests/llm follows planted documents through the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, without the intermediate files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
