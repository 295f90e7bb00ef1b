"""Rows that try an operator: nulls, blanks, long texts, ties, repeats and clashing columns."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, row_id string, slot int, spans string, labels string, key long, score double"


def words(seed, n, alphabet="abcdefghij"):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(alphabet, k=rng.randint(2, 6))) for _ in range(n))


def frame(spark, rows):
    """(doc_id, text[, lang]) rows with further columns named like results."""
    full = [(*r, *[None] * (3 - len(r)), "x", 1, "s", "l", 7, 0.5) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def odd_rows():
    long = words(1, 30_000)
    return [
        (1, words(2, 120), "aa"), (2, None, "aa"), (3, "", None), (None, words(3, 60), "bb"), (None, None, None),
        (4, long, "aa"), (5, words(2, 120), "bb"), (5, words(2, 120), "bb"), (6, "   \n\t ", "aa"),
        (7, "one", None), (8, "x" * 50_000, "bb"), (9, "é日本😀 ünï", "aa"),
    ]


def empty(spark):
    return frame(spark, odd_rows()).filter(F.lit(False))
