"""Parsing of model responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitextra.functions.text import let
from bitextra.functions.markup import add_value_key_commas, clean_model_output, repair_json

# Fixed value: below this share of delivered units a batch is split.
DELIVERY_THRESHOLD = 0.75


def _elements(c: Column) -> Column:
    """JSON values of ``[c]``; null when that is not strict JSON.

    Wrapping makes the check strict: text after the first value fails, and a
    comma-separated list of objects shows up as several elements.
    """
    return F.try_variant_get(
        F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))), "$", "array<variant>"
    )


def _single(c: Column) -> Column:
    return let(_elements(c), lambda e: F.when(F.size(e) == 1, F.get(e, F.lit(0))))


def _outside_strings(c: Column) -> Column:
    """The text with everything within quotes masked, character by character.

    Escapes are masked first; then the parts between quotes are inside and
    outside in turn.
    """
    parts = F.split(F.regexp_replace(c, r"(?s)\\.", "__"), '"', -1)
    masked = F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.repeat(F.lit("_"), F.length(p))).otherwise(p))
    return F.array_join(masked, "_")


def _closing(c: Column) -> Column:
    """Length of the prefix up to the brace that closes the first one; 0 where none does."""
    def step(acc: Column, piece: Column) -> Column:
        opened = F.length(piece) - F.length(F.replace(piece, F.lit("{")))
        return let(
            F.struct((acc["depth"] + opened - 1).alias("depth"), (acc["at"] + F.length(piece) + 1).alias("at")),
            lambda now: F.struct(
                now["depth"].alias("depth"), now["at"].alias("at"),
                F.when(acc["end"] > 0, acc["end"]).when(now["depth"] == 0, now["at"]).otherwise(0).alias("end"),
            ),
        )

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))
    pieces = F.split(_outside_strings(c), r"\}", -1)
    return let(pieces, lambda x: F.aggregate(F.slice(x, F.lit(1), F.size(x) - 1), start, step))["end"]


def _longest_prefix(c: Column) -> Column:
    """The longest prefix ending in a brace that parses after repair.

    A prefix is one value only if it ends where the first brace is closed:
    shorter ones are open, longer ones go on after the value. The repairs
    move neither braces nor quotes, so one scan finds the only candidate and
    at most one text is parsed, however many braces a response has.
    """
    return let(
        _closing(c),
        lambda end: F.when(end > 0, _single(repair_json(F.substring(c, F.lit(1), end)))),
    )


def response_columns(content: str) -> list[tuple[str, Column]]:
    """The parsing attempts as named columns, in order; ``items`` is the last."""
    clean = clean_model_output(F.col(content))
    braces = F.regexp_extract(F.col("_c0"), r"(?s)(\{.*\})", 1)
    whole, listed = F.col("_whole"), F.col("_list")
    lone = (
        F.try_variant_get(whole, "$.id", "string").isNotNull()
        & F.try_variant_get(whole, "$.text", "string").isNotNull()
    )
    raw = F.coalesce(
        F.try_variant_get(whole, "$.translations", "array<variant>"),
        F.when(lone, F.array(whole)),
        F.when(F.size(listed) > 1, listed),
        F.when(whole.isNotNull(), F.array().cast("array<variant>")),
    )
    items = F.filter(
        F.transform(
            raw,
            lambda v: F.struct(
                F.try_variant_get(v, "$.id", "string").alias("id"),
                F.try_variant_get(v, "$.text", "string").alias("text"),
            ),
        ),
        lambda x: (F.coalesce(x["id"], F.lit("")) != "") & (F.coalesce(x["text"], F.lit("")) != ""),
    )
    return [
        ("_c0", clean),
        ("_c1", F.when(braces != "", braces).otherwise(F.col("_c0"))),
        # Repairs only where the attempts before have failed.
        ("_v1", _single(F.col("_c1"))),
        ("_c2", F.when(F.col("_v1").isNull(), repair_json(F.col("_c1")))),
        ("_v2", _single(F.col("_c2"))),
        ("_c3", F.when(F.coalesce("_v1", "_v2").isNull(), repair_json(add_value_key_commas(F.col("_c2"))))),
        ("_whole", F.coalesce("_v1", "_v2", _single(F.col("_c3")))),
        ("_list", F.when(whole.isNull(), _elements(F.col("_c3")))),
        (
            "_whole",
            F.when(whole.isNotNull(), whole)
            .when(F.size(listed) > 1, F.lit(None))
            .otherwise(_longest_prefix(F.col("_c3"))),
        ),
        ("items", items),
    ]


def parse_columns(responses: DataFrame, columns: list[tuple[str, Column]]) -> DataFrame:
    out = responses
    for name, column in columns:
        out = out.withColumn(name, column)
    return out.select(*responses.columns, "items")


def parse_responses(responses: DataFrame, content: str = "response") -> DataFrame:
    """Translations found in model responses.

    Attempts in order: as received, repaired, with value-key commas added and
    repaired, several objects read as a list, the longest valid prefix; an
    object with id and text counts as a list of one. Items lacking id or text
    are dropped. Adds ``items`` (array of id, text; null when nothing parsed).
    """
    return parse_columns(responses, response_columns(content))


def delivery_ratio(batches: DataFrame) -> DataFrame:
    """expected, delivered, ratio and the next step per batch (A4).

    ``batches``: one row per expected unit with doc_id, batch_id and delivered.
    """
    ratio = F.col("delivered") / F.col("expected")
    return (
        batches.groupBy("doc_id", "batch_id")
        .agg(F.count(F.lit(1)).alias("expected"), F.count_if("delivered").alias("delivered"))
        .withColumn("ratio", F.round(ratio, 6))
        .withColumn(
            "action",
            F.when((ratio < DELIVERY_THRESHOLD) & (F.col("expected") > 1), "split")
            .when(ratio < 1, "retry_missing").otherwise("complete"),
        )
    )
