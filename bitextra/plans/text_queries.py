"""Bound queries: predicates, scans and numeric fidelity over parallel units."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitextra.functions import text as T
from bitextra.functions.glue import Vocabulary
from bitextra.functions.vocabulary import COMPOUNDS, FUNCTION_WORDS, piece_pattern
from bitextra.operators.leaks import findings_totals, scan_glue, scan_leaks
from bitextra.plans import fixtures as fx
from bitextra.plans.fixtures import check_sql
from bitextra.plans.registry import query

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
CYR = "[Ѐ-ӿ]"


def q_trim(x: str) -> str:
    return f"trim({x}, {WS})"


def q_cyr(x: str) -> str:
    return f"length(regexp_replace({x}, '[^Ѐ-ӿ]+', '', 'g'))"


def q_heading(x: str) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), '{p.lower()}')" for p in T.LIST_HEADINGS) + ")"


def q_designation(x: str) -> str:
    names = "|".join(
        sorted((p for p in T.DESIGNATION_PREFIXES), key=len, reverse=True)
    )
    return (
        f"regexp_matches({x}, '(?i)^\\s*(?:[-–—•]\\s*)?(?:{names})(?:\\s+\\S*\\d|[-–—])')"
    )


def q_reason(x: str) -> str:
    t = q_trim(x)
    return (
        f"CASE WHEN {x} IS NULL OR NOT regexp_matches({t}, '{CYR}') THEN NULL "
        f"WHEN {q_heading(t)} THEN 'list_heading' WHEN {q_designation(t)} THEN NULL "
        f"ELSE 'untranslated_fragment' END"
    )


def q_mixed(x: str) -> str:
    return (
        f"coalesce(regexp_matches({x}, '[Ѐ-ӿ]{{6,}}') AND regexp_matches({x}, '[A-Za-z]{{3,}}') "
        f"AND ({q_reason(x)}) IS NOT NULL, false)"
    )


def q_norm(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def q_language(x: str) -> str:
    t = q_trim(x)
    cjk = f"length(regexp_replace({t}, '[^一-鿿㐀-䶿豈-﫿]+', '', 'g'))"
    cyr = f"length(regexp_replace({t}, '[^а-яёА-ЯЁ]+', '', 'g'))"
    lat = f"length(regexp_replace({t}, '[^a-zA-Z]+', '', 'g'))"
    return f"""CASE WHEN length({t}) < 5 THEN
        CASE WHEN {cjk} + {cyr} + {lat} = 0 THEN NULL WHEN {cyr} = 0 AND {lat} = 0 THEN 'zh'
             WHEN {cjk} = 0 AND {lat} = 0 THEN 'ru' ELSE NULL END
      WHEN {cjk} > 0 AND {cjk} >= length({t}) * 0.3 THEN 'zh'
      WHEN {cyr} > 0 AND {cyr} >= {lat} THEN 'ru' WHEN {lat} > 0 THEN 'en' END"""


@query(
    "cyrillic_count",
    check_sql(
        f"SELECT doc_id, unit_idx, cast({q_cyr('target')} AS BIGINT) AS cyrillic_chars FROM units_fx",
        "units",
    ),
)
def cyrillic_count(spark, d):
    return fx.units(spark, d).select(
        "doc_id", "unit_idx", T.cyrillic_count(F.col("target")).alias("cyrillic_chars")
    )


@query(
    "normative_flags",
    check_sql(
        f"""SELECT doc_id, unit_idx, {q_heading('target')} AS list_heading,
            {q_designation('target')} AS designation,
            {q_designation('target')} AND NOT {q_heading('target')} AS normative
            FROM units_fx WHERE target IS NOT NULL""",
        "units",
    ),
)
def normative_flags(spark, d):
    t = F.col("target")
    return fx.units(spark, d).filter(t.isNotNull()).select(
        "doc_id", "unit_idx",
        T.is_list_heading(t).alias("list_heading"),
        T.is_designation(t).alias("designation"),
        T.is_normative_reference(t).alias("normative"),
    )


@query(
    "leak_scan",
    check_sql(
        f"""SELECT doc_id, unit_idx, {q_trim('target')} AS fragment, reason,
            cast({q_cyr('target')} AS BIGINT) AS cyrillic_chars
            FROM (SELECT *, {q_reason('target')} AS reason FROM units_fx) WHERE reason IS NOT NULL""",
        "units",
    ),
)
def leak_scan(spark, d):
    return scan_leaks(fx.units(spark, d).select("doc_id", "unit_idx", "target"), "target")


@query(
    "leak_totals",
    check_sql(
        f"""SELECT doc_id, kind, reason, count(*) AS n FROM (
              SELECT doc_id, 'leak' AS kind, {q_reason('target')} AS reason FROM units_fx)
            WHERE reason IS NOT NULL GROUP BY ROLLUP (doc_id, kind, reason)""",
        "units",
    ),
)
def leak_totals(spark, d):
    found = scan_leaks(fx.units(spark, d).select("doc_id", "target"), "target")
    return findings_totals(found.select("doc_id", F.lit("leak").alias("kind"), "reason"))


@query(
    "leftover_source",
    check_sql(
        f"""SELECT doc_id, unit_idx FROM units_fx
            WHERE ({q_reason('target')}) IS NOT NULL AND {q_cyr('target')} >= 4""",
        "units",
    ),
)
def leftover_source(spark, d):
    return fx.units(spark, d).filter(T.leftover_source(F.col("target"))).select("doc_id", "unit_idx")


@query(
    "mixed_units",
    check_sql(f"SELECT doc_id, unit_idx FROM units_fx WHERE {q_mixed('target')}", "units"),
)
def mixed_units(spark, d):
    return fx.units(spark, d).filter(T.is_mixed_unit(F.col("target"))).select("doc_id", "unit_idx")


@query(
    "script_strip",
    check_sql(
        """SELECT id, regexp_replace(ch_word || ' ' || ru_word, '[一-鿿㐀-䶿぀-ヿ가-힯豈-﫿]+', '', 'g')
              AS no_cjk,
            regexp_replace(ch_word || ' ' || ru_word, '[Ѐ-ӿ]+', '', 'g') AS no_cyrillic
            FROM glossary_fx""",
        "glossary",
    ),
)
def script_strip(spark, d):
    both = F.concat("ch_word", F.lit(" "), "ru_word")
    return fx.shared(spark, d, "glossary").select(
        "id", T.strip_cjk(both).alias("no_cjk"), T.strip_cyrillic(both).alias("no_cyrillic")
    )


@query(
    "language_id",
    check_sql(
        f"SELECT doc_id, unit_idx, {q_language('target')} AS detected FROM units_fx", "units"
    ),
)
def language_id(spark, d):
    return fx.units(spark, d).select(
        "doc_id", "unit_idx", T.detect_language(F.col("target")).alias("detected")
    )


def _q_mismatch(col: str) -> str:
    ok = {"ru_word": "('ru')", "en_word": "('en')", "sb_word": "('sr','ru','en')",
          "ch_word": "('zh')"}[col]
    return f"coalesce(({q_language(col)}) NOT IN {ok}, false) AS {col}_mismatch"


@query(
    "glossary_language_check",
    check_sql(
        f"SELECT id, {', '.join(_q_mismatch(c) for c in T.COLUMN_LANGUAGE)} FROM glossary_fx",
        "glossary",
    ),
)
def glossary_language_check(spark, d):
    return fx.shared(spark, d, "glossary").select(
        "id",
        *[T.language_mismatch(F.col(c), c).alias(f"{c}_mismatch") for c in T.COLUMN_LANGUAGE],
    )


@query(
    "source_filter",
    check_sql(
        f"""SELECT doc_id, unit_idx FROM units_fx WHERE coalesce(
            NOT (({q_language('target')}) <> 'ru' AND NOT regexp_matches(target, '{CYR}')), true)""",
        "units",
    ),
)
def source_filter(spark, d):
    return (
        fx.units(spark, d).filter(T.keeps_for_source(F.col("target"), "ru"))
        .select("doc_id", "unit_idx")
    )


@query(
    "translatable_flags",
    check_sql(
        r"""SELECT doc_id, unit_idx, coalesce(regexp_matches(source, '[^\d\s]'), false) AS translatable,
            regexp_matches(source, '\S') AND coalesce(target, '') = '' AS needs_translation
            FROM units_fx""",
        "units",
    ),
)
def translatable_flags(spark, d):
    return fx.units(spark, d).select(
        "doc_id", "unit_idx",
        T.is_translatable(F.col("source")).alias("translatable"),
        (F.col("source").rlike(r"\S") & (F.coalesce("target", F.lit("")) == ""))
        .alias("needs_translation"),
    )


@query(
    "normalized_keys",
    check_sql(
        f"""SELECT doc_id, unit_idx, {q_norm('source')} AS norm, {q_norm('lower(source)')} AS tm_key
            FROM units_fx""",
        "units",
    ),
)
def normalized_keys(spark, d):
    return fx.units(spark, d).select(
        "doc_id", "unit_idx",
        T.norm_ws(F.col("source")).alias("norm"), T.tm_key(F.col("source")).alias("tm_key"),
    )


_WORDS = sorted(Vocabulary().words)
_SQL_WORDS = "(" + ",".join(f"'{w}'" for w in _WORDS) + ")"
_SQL_FUNCTION = "[" + ",".join(f"'{w}'" for w in sorted(set(FUNCTION_WORDS))) + "]"
_SQL_COMPOUNDS = "(" + ",".join(f"'{w}'" for w in sorted(set(COMPOUNDS))) + ")"
_PIECE = piece_pattern(_WORDS)

GLUE_CTE = f"""
    toks AS (
      SELECT doc_id, unit_idx, target, unnest(w) AS token, unnest(range(len(w))) AS i
      FROM (SELECT doc_id, unit_idx, target,
                   regexp_extract_all(target, '[A-Za-z][A-Za-z''-]*') AS w
            FROM units_fx WHERE target IS NOT NULL)),
    vocab AS (SELECT token,
        list_filter(regexp_extract_all(token, '([a-z]{{2,}})[A-Z]', 1),
                    lambda r: r IN {_SQL_WORDS}) AS camel,
        regexp_matches(token, '[a-z]{{2}}[A-Z]') AS has_camel,
        regexp_extract_all(token, '{_PIECE}') AS pieces,
        regexp_replace(token, '{_PIECE}', '', 'g') AS residue
      FROM (SELECT DISTINCT token FROM toks)
      WHERE length(token) >= 3 AND token NOT IN {_SQL_COMPOUNDS}
        AND lower(token) NOT IN {_SQL_WORDS}),
    judged AS (SELECT token, CASE
        WHEN has_camel THEN CASE WHEN len(camel) > 0 THEN 'camel_boundary' END
        WHEN regexp_matches(token, '[A-Z]') OR length(token) < 8 THEN NULL
        WHEN residue = '' AND len(pieces) BETWEEN 2 AND 8
             AND (length(token) >= 16 OR list_has_any(pieces, {_SQL_FUNCTION}))
          THEN 'lowercase_concat' END AS reason FROM vocab),
    found AS (
      SELECT *, row_number() OVER (PARTITION BY doc_id, unit_idx ORDER BY i) - 1 AS pos
      FROM toks JOIN judged USING (token) WHERE reason IS NOT NULL QUALIFY pos < 5),
    placed AS (
      SELECT *, list_sum(list_transform(gaps[1:i + 1], lambda g: length(g)))
                + coalesce(list_sum(list_transform(words[1:i], lambda w: length(w))), 0) AS start_at
      FROM (SELECT *, string_split_regex(target, '[A-Za-z][A-Za-z''-]*') AS gaps,
                   regexp_extract_all(target, '[A-Za-z][A-Za-z''-]*') AS words FROM found))"""


@query(
    "glue_scan",
    check_sql(
        f"""WITH {GLUE_CTE} SELECT doc_id, unit_idx, cast(pos AS BIGINT) AS pos, token, reason,
            substr(target, cast(greatest(start_at - 40, 0) + 1 AS BIGINT),
              cast(start_at - greatest(start_at - 40, 0) + length(token) + 40 AS BIGINT)) AS context
            FROM placed""",
        "units",
    ),
)
def glue_scan(spark, d):
    found = scan_glue(fx.units(spark, d).select("doc_id", "unit_idx", "target"), "target")
    return found.drop("fragment")
