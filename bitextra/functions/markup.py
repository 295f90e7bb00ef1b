"""Drawing format codes, model-output cleaning, JSON repair and inline markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bitextra.functions.text import (
    interleave,
    let,
    norm_ws,
    strip,
    unescape_entities,
    unescape_references,
)

# Spelling of format codes and of their placeholders.
FORMAT_CODE = r"\\[A-Za-z][^;\\]*;|\\[A-Za-z~_]"
FORMAT_PLACEHOLDER = r"\[\[F(\d+)\]\]"
# A drawing text code inside a failed unit.
MTEXT_CODE = r"\\[A-Za-z]|%%[cdpo]|\\U\+[0-9A-Fa-f]{4}"
# Format codes a translated text must not hold.
RAW_FORMAT_CODE = r"\\[PASHLQWT_OL~]|\\S[^;]*;"

# Markers and phrases models add around their answer.
BOUNDARY_MARKERS = ("<<<INPUT_TEXT>>>", "<<<END_INPUT_TEXT>>>")
BOILERPLATE = (
    "Вот перевод:",
    "Вот перевод",
    "Перевод:",
    "Sure, here is:",
    "Sure, here is the translation:",
    "Here is the translation:",
    "Here's the translation:",
    "Certainly:",
    "Certainly!",
)

# Inline elements of an exchange file whose content is code, not text.
INLINE_CODE_ELEMENTS = ("bpt", "ept", "ph", "it")


def encode_format_codes(c: Column) -> Column:
    """Replace format codes by [[F0]], [[F1]] …."""
    codes = F.regexp_extract_all(c, F.lit(FORMAT_CODE), F.lit(0))
    marks = F.transform(codes, lambda _, i: F.concat(F.lit("[[F"), i.cast("string"), F.lit("]]")))
    return F.when(c.contains("\\"), interleave(F.split(c, FORMAT_CODE, -1), marks)).otherwise(c)


def format_code_tokens(c: Column) -> Column:
    """array<struct<placeholder, original>> behind the encoding."""
    return F.transform(
        F.regexp_extract_all(c, F.lit(FORMAT_CODE), F.lit(0)),
        lambda code, i: F.struct(
            F.concat(F.lit("[[F"), i.cast("string"), F.lit("]]")).alias("placeholder"),
            code.alias("original"),
        ),
    )


def decode_format_codes(c: Column, tokens: Column) -> Column:
    """Put format codes back; placeholders without a token stay (P20)."""
    marks = F.regexp_extract_all(c, F.lit(FORMAT_PLACEHOLDER), F.lit(1))
    back = F.transform(
        marks,
        lambda m: F.coalesce(
            F.get(tokens, m.try_cast("int"))["original"],
            F.concat(F.lit("[[F"), m, F.lit("]]")),
        ),
    )
    return F.when(
        c.contains("[[F"), interleave(F.split(c, FORMAT_PLACEHOLDER, -1), back)
    ).otherwise(c)


def has_content(c: Column) -> Column:
    """Something but placeholders and white space is left."""
    return F.length(strip(F.regexp_replace(c, FORMAT_PLACEHOLDER, ""))) > 0


def clean_model_output(c: Column, preserve_tags: bool = False) -> Column:
    """Drop markers, segment tags, one leading phrase, reasoning and fences."""
    out = c
    for marker in BOUNDARY_MARKERS:
        out = F.replace(out, F.lit(marker), F.lit(""))
    if not preserve_tags:
        out = F.regexp_replace(out, r"</?s\d+>", "")
    phrases = "|".join(BOILERPLATE)
    out = F.regexp_replace(out, f"^(?:{phrases})", "")
    out = strip(F.regexp_replace(out, r"(?s)<think>.*?</think>", ""))
    return strip(F.regexp_replace(out, r"(?md)^```[^\n]*\n|```$", ""))


# The repairs of a model's JSON, in order, and the comma missing between a value and a key.
JSON_REPAIRS = (
    (r"\}(\s*)\{", r"},$1{"),
    (r",\s*\]", "]"),
    (r",\s*\}", "}"),
    (r'\\(?!["\\/bfnrtu])', r"\\\\"),
)
VALUE_KEY_COMMA = (r'"\s+"(\w+)"\s*:', r'", "$1":')


def repair_json(c: Column) -> Column:
    """Missing commas between objects, trailing commas, invalid escapes."""
    for pattern, repaired in JSON_REPAIRS:
        c = F.regexp_replace(c, pattern, repaired)
    return c


def add_value_key_commas(c: Column) -> Column:
    """Insert the comma missing between a string value and the next key."""
    return F.regexp_replace(c, *VALUE_KEY_COMMA)


def without_comments(c: Column) -> Column:
    """Markup whose CDATA sections are escaped text and whose comments are gone."""
    pattern = r"(?s)<!\[CDATA\[.*?\]\]>|<!--.*?-->"

    def plain(m: Column) -> Column:
        inner = F.regexp_extract(m, r"(?s)^<!\[CDATA\[(.*)\]\]>$", 1)
        for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            inner = F.replace(inner, F.lit(char), F.lit(entity))
        return F.when(m.startswith("<!--"), F.lit("")).otherwise(inner)

    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    return F.when(
        c.contains("<!"), interleave(F.split(c, pattern, -1), F.transform(found, plain))
    ).otherwise(c)


def visible_text(c: Column) -> Column:
    """Visible text of an exchange-file segment.

    Content of inline-code elements goes, their tails stay; other tags are
    dropped; entities are resolved twice because tools escape markup inside
    text; pseudo tags such as <run1> disappear; white space collapses.
    Character references are resolved, CDATA is text, comments are dropped.
    """
    c = without_comments(c)
    names = "|".join(INLINE_CODE_ELEMENTS)
    out = F.regexp_replace(c, rf"(?s)<(?:\w+:)?({names})\b[^>]*(?<!/)>.*?</(?:\w+:)?\1>", "")
    out = F.regexp_replace(out, r"<[^>]+>", "")
    for _ in range(2):
        out = let(out, lambda t: unescape_entities(unescape_references(t)))
    out = F.regexp_replace(out, r"</?run\d+\s*/?>", "")
    out = F.regexp_replace(out, r"</?tags?\d*\s*/?>", "")
    return norm_ws(out)


def line_breaks(c: Column) -> Column:
    """Number of paragraph codes and newlines, as the pair check counts them."""
    return (F.regexp_count(c, F.lit(r"\\P")) + F.regexp_count(c, F.lit("\n"))).cast("long")


def mtext_flags(c: Column) -> list[Column]:
    """has_backslash and has_mtext_code columns."""
    return [
        c.contains("\\").alias("has_backslash"),
        c.rlike(MTEXT_CODE).alias("has_mtext_code"),
    ]
