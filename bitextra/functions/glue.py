"""Glued-word detection as array expressions (Column -> Column)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from bitextra.functions.vocabulary import COMPOUNDS, FUNCTION_WORDS, SUBJECT_WORDS, piece_pattern, word_pattern

TOKEN_PATTERN = r"[A-Za-z][A-Za-z'-]*"
# Limits of the scan.
MIN_LENGTH = 8
MAX_PIECES = 8
LONG_TOKEN = 16
MAX_PER_FRAGMENT = 5
CONTEXT = 40

FINDING_TYPE = "array<struct<token:string,reason:string,context:string>>"


@dataclass(frozen=True)
class Vocabulary:
    """Words the scan knows; pass another one for another subject."""

    words: frozenset = frozenset(FUNCTION_WORDS) | frozenset(SUBJECT_WORDS)
    function_words: frozenset = frozenset(FUNCTION_WORDS)
    compounds: frozenset = frozenset(COMPOUNDS)


def glue_reason(token: Column, vocab: Vocabulary = Vocabulary()) -> Column:
    """``camel_boundary`` / ``lowercase_concat`` / null for one token."""
    known = word_pattern(vocab.words)
    runs = F.regexp_extract_all(token, F.lit("([a-z]{2,})[A-Z]"), F.lit(1))
    pieces = F.regexp_extract_all(token, F.lit(piece_pattern(vocab.words)), F.lit(0))
    complete = (F.array_join(pieces, "") == token) & F.size(pieces).between(2, MAX_PIECES)
    telling = (F.length(token) >= LONG_TOKEN) | F.exists(
        pieces, lambda p: p.rlike(word_pattern(vocab.function_words))
    )
    return (
        F.when(token.rlike(word_pattern(vocab.compounds)), F.lit(None).cast("string"))
        .when(F.lower(token).rlike(known), F.lit(None).cast("string"))
        .when(
            token.rlike("[a-z]{2}[A-Z]"),
            F.when(F.exists(runs, lambda r: r.rlike(known)), F.lit("camel_boundary")),
        )
        .when(token.rlike("[A-Z]") | (F.length(token) < MIN_LENGTH), F.lit(None).cast("string"))
        .when(complete & telling, F.lit("lowercase_concat"))
    )


def glue_findings(
    c: Column, vocab: Vocabulary = Vocabulary(), max_per_fragment: int = MAX_PER_FRAGMENT
) -> Column:
    """array<struct<token, reason, context>> of glued words in a fragment.

    At most ``max_per_fragment`` findings per fragment, in text order, each
    with up to 40 characters on both sides.
    """
    tokens = F.regexp_extract_all(c, F.lit(TOKEN_PATTERN), F.lit(0))
    gaps = F.split(c, TOKEN_PATTERN, -1)
    suspects = F.filter(
        F.transform(tokens, lambda t, i: F.struct(t.alias("token"), i.alias("i"))),
        lambda x: x["token"].rlike("[a-z]{2}[A-Z]|^[a-z][a-z'-]{7}"),
    )
    judged = F.transform(
        suspects,
        lambda x: F.struct(x["token"], x["i"], glue_reason(x["token"], vocab).alias("reason")),
    )
    found = F.slice(F.filter(judged, lambda x: x["reason"].isNotNull()), 1, max_per_fragment)

    def total(parts, n):
        return F.aggregate(
            F.slice(parts, F.lit(1), n), F.lit(0), lambda acc, s: acc + F.length(s)
        )

    def with_context(x):
        start = total(gaps, x["i"] + 1) + total(tokens, x["i"])
        left = F.greatest(start - CONTEXT, F.lit(0))
        return F.struct(
            x["token"],
            x["reason"],
            c.substr(left + 1, start - left + F.length(x["token"]) + CONTEXT).alias("context"),
        )

    hits = F.transform(found, with_context).cast(FINDING_TYPE)
    return F.when(c.rlike("[a-z]{2}[A-Z]|[a-z][a-z'-]{7}"), hits).otherwise(
        F.array().cast(FINDING_TYPE)
    )
