"""Whitespace, script and language expressions (Column -> Column)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters Unicode counts as white space.
_SPACE_CODES = (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
WHITESPACE = "".join(chr(code) for code in _SPACE_CODES)
# White space the pattern \s leaves out; translated only where a text may hold some.
_RARE_SPACE = "".join(chr(code) for code in _SPACE_CODES if code > 0x0D and code != 0x20)
_RARE_LATIN = f"[{chr(0x1C)}-{chr(0x1F)}{chr(0x85)}{chr(0xA0)}]"
_RARE_WIDE = f"[{chr(0x1680)}-{chr(0x3000)}]"

# Prefixes of normative designations kept in the source language.
DESIGNATION_PREFIXES = (
    "ГОСТ Р",
    "ГОСТ",
    "СН РК",
    "СП РК",
    "СНиП РК",
    "СНиП",
    "ГКИНП",
    "ВСН",
    "ЕНиР",
    "СанПиН",
    "ТР ТС",
    "ТКП",
    "СТ РК",
    "РДС",
    "МДС",
    "ПУЭ",
    "ПБ",
    "НПБ",
)

# List headings that must be translated although normative.
LIST_HEADINGS = (
    "НПА и технические условия",
    "Нормативные документы",
    "Нормативные ссылки",
    "Перечень НПА",
    "Список используемой литературы",
)

# Language expected in each glossary column.
COLUMN_LANGUAGE = {"ru_word": "ru", "en_word": "en", "sb_word": "sr", "ch_word": "zh"}


def strip(c: Column) -> Column:
    """Trim every Unicode white-space character from both ends."""
    return F.trim(c, F.lit(WHITESPACE))


def norm_ws(c: Column) -> Column:
    """Collapse white-space runs to one space and trim."""
    plain = F.when(
        c.rlike(_RARE_LATIN) | c.rlike(_RARE_WIDE),
        F.translate(c, _RARE_SPACE, " " * len(_RARE_SPACE)),
    ).otherwise(c)
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def tm_key(c: Column) -> Column:
    """Translation-memory key: lower case, collapsed white space."""
    return norm_ws(F.lower(c))


def _count_chars(c: Column, char_class: str) -> Column:
    return F.regexp_count(c, F.lit(f"[{char_class}]"))


def cyrillic_count(c: Column) -> Column:
    """Number of characters in U+0400-04FF."""
    return _count_chars(c, "Ѐ-ӿ").cast("long")


def is_list_heading(c: Column) -> Column:
    """Contains one of the fixed heading phrases, ignoring case."""
    low = F.lower(c)
    found = F.lit(False)
    for phrase in LIST_HEADINGS:
        found = found | low.contains(phrase.lower())
    return found


# A list bullet before a designation, and what must follow its prefix.
DESIGNATION_BULLET = r"[-–—•]"
DESIGNATION_FOLLOWED_BY = r"\s+\S*\d|[-—–]"


def designation_pattern(prefixes=None) -> str:
    """Java pattern: optional bullet, a prefix, then an identifier or a dash."""
    ranked = sorted(prefixes or DESIGNATION_PREFIXES, key=len, reverse=True)
    names = "|".join(re.escape(p) for p in ranked)
    return rf"(?iuU)^\s*(?:{DESIGNATION_BULLET}\s*)?(?:{names})(?={DESIGNATION_FOLLOWED_BY})"


def is_designation(c: Column, prefixes=None) -> Column:
    """Starts with a normative designation followed by an identifier."""
    return c.rlike(designation_pattern(prefixes))


def is_normative_reference(c: Column, prefixes=None) -> Column:
    """A designation that is not a list heading."""
    return is_designation(c, prefixes) & ~is_list_heading(c)


def classify_leak(c: Column, prefixes=None) -> Column:
    """``list_heading`` / ``untranslated_fragment`` / null (P5)."""
    t = strip(c)
    return (
        F.when(~t.rlike("[Ѐ-ӿ]"), F.lit(None).cast("string"))
        .when(is_list_heading(t), F.lit("list_heading"))
        .when(is_designation(t, prefixes), F.lit(None).cast("string"))
        .when(t.isNotNull(), F.lit("untranslated_fragment"))
    )


def leftover_source(c: Column, min_cyrillic: int = 4, prefixes=None) -> Column:
    """A leak with at least ``min_cyrillic`` Cyrillic characters."""
    return F.coalesce(
        classify_leak(c, prefixes).isNotNull() & (cyrillic_count(c) >= min_cyrillic), F.lit(False)
    )


def is_mixed_unit(c: Column, prefixes=None) -> Column:
    """Latin words next to a Cyrillic run of six or more letters.

    The run length is fixed at six.
    """
    return F.coalesce(
        c.rlike("[Ѐ-ӿ]{6,}")
        & c.rlike("[A-Za-z]{3,}")
        & classify_leak(c, prefixes).isNotNull(),
        F.lit(False),
    )


def strip_cjk(c: Column) -> Column:
    """Remove CJK, kana and hangul."""
    return F.regexp_replace(
        c, r"[一-鿿㐀-䶿぀-ヿ가-힯豈-﫿]+", ""
    )


def strip_cyrillic(c: Column) -> Column:
    """Remove Cyrillic."""
    return F.regexp_replace(c, "[Ѐ-ӿ]+", "")


def detect_language(c: Column) -> Column:
    """Script-based language id: zh, ru, en or null (P10)."""

    def decide(t: Column) -> Column:
        counts = F.struct(
            F.length(t).alias("n"),
            _count_chars(t, r"\u4e00-\u9fff\u3400-\u4dbf\uf900-\ufaff").alias("cjk"),
            _count_chars(t, r"а-яёА-ЯЁ").alias("cyr"),
            _count_chars(t, "a-zA-Z").alias("lat"),
        )
        return let(counts, _by_script)

    return let(strip(c), decide)


def _by_script(s: Column) -> Column:
    letters = s["cjk"] + s["cyr"] + s["lat"]
    short = (
        F.when(letters == 0, F.lit(None).cast("string"))
        .when(s["cjk"] == letters, F.lit("zh"))
        .when(s["cyr"] == letters, F.lit("ru"))
    )
    return (
        F.when(s["n"] < 5, short)
        .when((s["cjk"] > 0) & (s["cjk"] >= s["n"] * F.lit(0.3)), F.lit("zh"))
        .when((s["cyr"] > 0) & (s["cyr"] >= s["lat"]), F.lit("ru"))
        .when(s["lat"] > 0, F.lit("en"))
    )


def language_mismatch(c: Column, column: str) -> Column:
    """True when the detected language is not acceptable in a glossary column."""
    expected = COLUMN_LANGUAGE.get(column)
    if expected is None:
        return F.lit(False)
    allowed = ("sr", "ru", "en") if expected == "sr" else (expected,)
    found = detect_language(c)
    return F.coalesce(~found.isin(*allowed), F.lit(False))


def keeps_for_source(c: Column, lang: str) -> Column:
    """Whether a unit survives the source-language filter.

    Only Russian sources are filtered: a unit goes when another language is
    detected and it holds no Cyrillic letter at all.
    """
    if lang != "ru":
        return F.lit(True)
    return F.coalesce(
        ~((detect_language(c) != "ru") & ~c.rlike("[Ѐ-ӿ]")), F.lit(True)
    )


def is_translatable(c: Column) -> Column:
    """Non-blank and not only digits and white space."""
    return F.coalesce(c.rlike(r"(?U)[^\d\s]"), F.lit(False))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    Inside a lambda a column expression is evaluated again for every element;
    a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def runs(ordered: Column, same) -> Column:
    """The runs of an ordered array whose neighbours are the ``same``, as arrays of arrays.

    Each element is looked at once and each run cut out once, so the work
    follows the length of the array.
    """
    def cut(x: Column) -> Column:
        def slices(starts: Column) -> Column:
            return F.transform(
                starts,
                lambda at, j: F.slice(x, at + 1, F.coalesce(F.get(starts, j + 1), F.size(x)) - at),
            )

        first = F.filter(
            F.sequence(F.lit(0), F.size(x) - 1),
            lambda i: (i == 0) | ~same(F.get(x, i - 1), F.get(x, i)),
        )
        return F.when(F.size(x) > 0, let(first, slices)).otherwise(F.slice(F.array(x), 1, 0))

    return let(ordered, cut)


def interleave(gaps: Column, tokens: Column) -> Column:
    """Rebuild a text from the gaps around tokens and the tokens themselves."""
    return F.array_join(
        F.zip_with(
            gaps, tokens, lambda g, t: F.concat(F.coalesce(g, F.lit("")), F.coalesce(t, F.lit("")))
        ),
        "",
    )


def unescape_references(c: Column) -> Column:
    """Resolve decimal and hexadecimal character references, one pass."""
    pattern = r"&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});"

    def char(m: Column) -> Column:
        digits = F.regexp_extract(m, r"([0-9A-Fa-f]+);", 1)
        hexa = F.when(m.rlike("^&#[xX]"), digits).otherwise(F.conv(digits, 10, 16))
        number = F.conv(hexa, 16, 10).cast("long")
        valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        return F.when(valid, F.decode(F.unhex(F.lpad(hexa, 8, "0")), "UTF-32")).otherwise(m)

    resolved = interleave(
        F.split(c, pattern, -1), F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), char)
    )
    return F.when(c.contains("&#"), resolved).otherwise(c)


def unescape_entities(c: Column) -> Column:
    """Resolve the five predefined XML entities, one pass."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                         ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def unescape_markup(c: Column) -> Column:
    """Drop tags, then resolve entities (S5); plain text passes untouched."""
    bare = F.when(c.contains("<"), F.regexp_replace(c, "<[^>]+>", "")).otherwise(c)
    return let(bare, lambda t: F.when(t.contains("&"), unescape_entities(t)).otherwise(t))
