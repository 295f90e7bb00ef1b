"""Bound queries: terminology, translation memory, entities and import."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitextra.operators import glossary as G
from bitextra.operators import memory as M
from bitextra.operators.leaks import scan_glue
from bitextra.plans import fixtures as fx
from bitextra.plans.fixtures import check_sql
from bitextra.plans.registry import query
from bitextra.plans.text_queries import GLUE_CTE, q_language, q_norm

MATCHES = """
    matches_fx AS (
      SELECT doc_id, unit_idx, source, id, term, replacement
      FROM units_fx JOIN terms_fx ON contains(lower(source), term))"""


@query(
    "glossary_match",
    check_sql(f"WITH {MATCHES} SELECT doc_id, unit_idx, id, term FROM matches_fx", "units", "terms"),
)
def glossary_match(spark, d):
    return G.match_terms(fx.units(spark, d), fx.terms(spark, d)).select(
        "doc_id", "unit_idx", "id", "term"
    )


# Every edit leaves one mark at the end; the marks are counted and taken off.
@query(
    "glossary_apply",
    check_sql(
        f"""WITH {MATCHES}, ordered AS (
          SELECT doc_id, unit_idx, list(term || '=' || replacement ORDER BY id) AS ts
          FROM matches_fx GROUP BY doc_id, unit_idx),
        edited AS (
          SELECT doc_id, unit_idx, CASE WHEN ts IS NULL THEN source ELSE list_reduce(ts, lambda acc, t:
            CASE WHEN instr(lower(acc), split_part(t, '=', 1)) > 0 THEN
              substr(acc, 1, instr(lower(acc), split_part(t, '=', 1)) - 1) || split_part(t, '=', 2)
              || substr(acc, instr(lower(acc), split_part(t, '=', 1)) + length(split_part(t, '=', 1))) || chr(1)
            ELSE acc END, source) END AS marked
          FROM units_fx LEFT JOIN ordered USING (doc_id, unit_idx))
        SELECT doc_id, unit_idx, replace(marked, chr(1), '') AS modified,
          length(marked) - length(replace(marked, chr(1), '')) AS applied FROM edited""",
        "units", "terms",
    ),
)
def glossary_apply(spark, d):
    return G.apply_glossary(fx.units(spark, d), fx.terms(spark, d)).select(
        "doc_id", "unit_idx", "modified", "applied"
    )


@query(
    "glossary_substitute",
    check_sql(
        """WITH parts AS (
          SELECT doc_id, unit_idx, unnest(regexp_extract_all(source, '[\\p{L}\\p{M}\\p{N}_]+')) AS tok,
                 unnest(range(len(regexp_extract_all(source, '[\\p{L}\\p{M}\\p{N}_]+')))) AS i
          FROM units_fx),
        mapped AS (
          SELECT doc_id, unit_idx, list(coalesce(replacement, tok) ORDER BY i) AS toks
          FROM parts LEFT JOIN terms_fx ON lower(tok) = term GROUP BY doc_id, unit_idx)
        SELECT doc_id, unit_idx, array_to_string(list_transform(list_zip(
            string_split_regex(source, '[\\p{L}\\p{M}\\p{N}_]+'), toks),
            lambda z: coalesce(z[1], '') || coalesce(z[2], '')), '') AS modified
        FROM units_fx LEFT JOIN mapped USING (doc_id, unit_idx)""",
        "units", "terms",
    ),
)
def glossary_substitute(spark, d):
    return G.substitute_terms(fx.units(spark, d), fx.terms(spark, d)).select(
        "doc_id", "unit_idx", "modified"
    )


@query(
    "glossary_hints",
    check_sql(
        f"""WITH {MATCHES} SELECT DISTINCT doc_id, term || ' → ' || replacement AS hint
        FROM matches_fx""",
        "units", "terms",
    ),
)
def glossary_hints(spark, d):
    found = G.match_terms(fx.units(spark, d), fx.terms(spark, d))
    return G.glossary_hints(found, ["doc_id"])


@query(
    "locate_fragments",
    check_sql(
        f"""WITH frags AS (
          SELECT item_id AS fragment_id, {q_norm('lower(text)')} AS needle FROM benchmark)
        SELECT doc_id, unit_idx, fragment_id,
               coalesce(regexp_matches(target, '\\S'), false) AS is_translated
        FROM units_fx JOIN frags ON contains({q_norm('lower(source)')}, needle)
        WHERE needle <> ''""",
        "units",
    ),
)
def locate_fragments(spark, d):
    fragments = fx.table(spark, d, "benchmark").select(
        F.col("item_id").alias("fragment_id"), F.col("text").alias("fragment")
    )
    return G.locate(fx.units(spark, d), fragments)


@query(
    "units_for_findings",
    check_sql(
        f"""WITH {GLUE_CTE}
        SELECT DISTINCT doc_id, token, 'p_' || unit_idx AS unit_id FROM found""",
        "units",
    ),
)
def units_for_findings(spark, d):
    u = fx.units(spark, d)
    found = scan_glue(
        u.select("doc_id", F.col("unit_idx").alias("paragraph"), "target"), "target"
    )
    named = u.select("doc_id", "unit_idx", F.concat(F.lit("p_"), "unit_idx").alias("unit_id"))
    return G.units_for_findings(found, named)


TM = f"""
    tm_fx AS (
      SELECT {q_norm('lower(source)')} AS tm_key,
             arg_max(target, doc_id * 1000000 + unit_idx) AS translation
      FROM units_fx WHERE target <> '' GROUP BY 1)"""


def _tm(spark, d):
    pairs = fx.units(spark, d).filter("target <> ''")
    return M.build_tm(pairs, F.col("doc_id") * 1000000 + F.col("unit_idx"))


@query("memory_build", check_sql(f"WITH {TM} SELECT * FROM tm_fx", "units"))
def memory_build(spark, d):
    return _tm(spark, d)


@query(
    "memory_lookup",
    check_sql(
        f"""WITH {TM} SELECT doc_id, unit_idx, translation, translation IS NOT NULL AS hit
        FROM units_fx LEFT JOIN tm_fx ON tm_key = {q_norm('lower(source)')}""",
        "units",
    ),
)
def memory_lookup(spark, d):
    found = M.tm_lookup(fx.units(spark, d), _tm(spark, d), ["doc_id", "unit_idx"])
    return found.select("doc_id", "unit_idx", "translation", "hit")


@query(
    "memory_stats",
    check_sql(
        f"""WITH {TM} SELECT count(*) FILTER (translation IS NOT NULL) AS hits,
          count(*) FILTER (translation IS NULL) AS misses, (SELECT count(*) FROM tm_fx) AS size
        FROM units_fx LEFT JOIN tm_fx ON tm_key = {q_norm('lower(source)')}""",
        "units",
    ),
)
def memory_stats(spark, d):
    tm = _tm(spark, d)
    return M.tm_stats(M.tm_lookup(fx.units(spark, d), tm, ["doc_id", "unit_idx"]), tm)


ENTITIES = r"""
    entities_fx AS (
      SELECT doc_id || '-' || unit_idx AS handle, doc_id * 1000000 + unit_idx AS ord, doc_id,
             CASE doc_id % 5 WHEN 0 THEN '\P' || line WHEN 1 THEN '{\H1.5x;' || line || '}'
               WHEN 2 THEN replace(line, '. ', '.\P') ELSE line END AS text
      FROM lines_fx)"""
ENCODED = r"""
    encoded_fx AS (
      SELECT handle, ord, text, array_to_string(list_transform(list_zip(gaps, marks),
               lambda z: coalesce(z[1], '') || coalesce(z[2], '')), '') AS encoded
      FROM (SELECT *, string_split_regex(text, '\\[A-Za-z][^;\\]*;|\\[A-Za-z~_]') AS gaps,
                   list_transform(range(len(regexp_extract_all(text,
                     '\\[A-Za-z][^;\\]*;|\\[A-Za-z~_]'))), lambda i: '[[F' || i || ']]') AS marks
            FROM entities_fx))"""


def entities(spark, d):
    line = F.col("line")
    text = (
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("\\P"), line))
        .when(F.col("doc_id") % 5 == 1, F.concat(F.lit("{\\H1.5x;"), line, F.lit("}")))
        .when(F.col("doc_id") % 5 == 2, F.replace(line, F.lit(". "), F.lit(".\\P")))
        .otherwise(line)
    )
    return fx.lines(spark, d).select(
        F.concat_ws("-", "doc_id", "unit_idx").alias("handle"),
        (F.col("doc_id") * 1000000 + F.col("unit_idx")).alias("ord"), "doc_id",
        F.inline(F.array(F.struct(text.alias("text")))),
    )


@query(
    "format_codes",
    check_sql(
        f"""WITH {ENTITIES}, {ENCODED} SELECT handle, encoded, text AS decoded,
          regexp_matches(regexp_replace(encoded, '\\[\\[F\\d+\\]\\]', '', 'g'), '\\S') AS has_content,
          contains(text, chr(92)) AS has_backslash,
          regexp_matches(text, '\\\\[A-Za-z]|%%[cdpo]|\\\\U\\+[0-9A-Fa-f]{{4}}') AS has_mtext_code
        FROM encoded_fx""",
        "lines",
    ),
)
def format_codes(spark, d):
    from bitextra.functions import markup as K

    t = F.col("text")
    coded = entities(spark, d).withColumn("encoded", K.encode_format_codes(t)).withColumn(
        "tokens", K.format_code_tokens(t)
    )
    return coded.select(
        "handle", "encoded",
        K.decode_format_codes(F.col("encoded"), F.col("tokens")).alias("decoded"),
        K.has_content(F.col("encoded")).alias("has_content"), *K.mtext_flags(t),
    )


@query(
    "entity_dedup",
    check_sql(
        f"""WITH {ENTITIES}, {ENCODED} SELECT encoded, arg_min(handle, ord) AS entity_id,
          min(ord) AS first_ord, count(*) AS n_handles FROM encoded_fx GROUP BY encoded""",
        "lines",
    ),
)
def entity_dedup(spark, d):
    return M.dedup_entities(entities(spark, d))


@query(
    "handle_fan_out",
    check_sql(
        f"""WITH {ENTITIES}, {ENCODED} SELECT handle, '<' || encoded || '>' AS translated
        FROM encoded_fx""",
        "lines",
    ),
)
def handle_fan_out(spark, d):
    e = entities(spark, d)
    done = M.dedup_entities(e).select("encoded", F.concat(F.lit("<"), "encoded", F.lit(">")).alias("translated"))
    return M.fan_out(e, done)


IMPORT_SQL = f"""
    SELECT p_partkey + 1 AS row_num,
           concat(translate(p_name, '{fx.LATIN}', '{fx.CYRILLIC}'), ' ', cast(p_size AS string))
             AS ru_word,
           CASE WHEN p_partkey % 41 = 0 THEN '' ELSE concat(p_name, ' ', p_brand) END AS en_word,
           upper(p_type) || ' ' || cast(p_partkey % 1013 AS string) AS sb_word,
           CASE WHEN p_partkey % 29 = 0 THEN p_name
             ELSE concat('词汇', cast((p_partkey * 7) % 1511 AS string)) END AS ch_word
    FROM {{part}}"""
EXISTING_SQL = f"""
    SELECT translate(p_name, '{fx.LATIN}', '{fx.CYRILLIC}') AS ru_word,
           concat(p_name, ' ', p_brand) AS en_word, '' AS sb_word, '' AS ch_word
    FROM {{part}} WHERE p_retailprice > 1200"""
_C = ("ru_word", "en_word", "sb_word", "ch_word")


def _dup(col: str) -> str:
    return f"list_contains(s_{col}, i.{col})"


_ANY = " OR ".join(_dup(c) for c in _C)
_MIS = " OR ".join(
    f"coalesce(({q_language('r.' + c)}) NOT IN {ok}, false)"
    for c, ok in zip(_C, ("('ru')", "('en')", "('sr','ru','en')", "('zh')"))
)


@query(
    "glossary_import",
    f"""WITH RECURSIVE imp AS ({IMPORT_SQL.format(part='part')}),
    existing AS ({EXISTING_SQL.format(part='part')}),
    filled AS (SELECT *, row_number() OVER (ORDER BY row_num) AS n FROM imp
               WHERE ru_word <> '' AND en_word <> '' AND sb_word <> '' AND ch_word <> ''),
    steps AS (
      SELECT 0::BIGINT AS n, 0::BIGINT AS row_num, NULL::VARCHAR AS col, NULL::VARCHAR AS val,
             {', '.join(f"[]::VARCHAR[] AS s_{c}" for c in _C)}
      UNION ALL
      SELECT i.n, i.row_num,
             CASE {' '.join(f"WHEN {_dup(c)} THEN '{c}'" for c in _C)} END,
             CASE {' '.join(f"WHEN {_dup(c)} THEN i.{c}" for c in _C)} END,
             {', '.join(f"CASE WHEN {_ANY} THEN s_{c} ELSE list_append(s_{c}, i.{c}) END" for c in _C)}
      FROM steps s JOIN filled i ON i.n = s.n + 1),
    decided AS (SELECT row_num, col, val FROM steps WHERE n > 0),
    kept AS (SELECT f.* FROM filled f JOIN decided USING (row_num) WHERE col IS NULL)
    SELECT r.row_num,
      CASE WHEN d.row_num IS NULL THEN 'blank' WHEN d.col IS NOT NULL THEN 'repeated'
           WHEN {_MIS} THEN 'language'
           WHEN EXISTS (SELECT 1 FROM existing e WHERE {' OR '.join(
               f"(e.{c} <> '' AND e.{c} = r.{c})" for c in _C)}) THEN 'exists'
           ELSE 'imported' END AS outcome,
      d.col AS repeated_column,
      CASE d.col {' '.join(
          f"WHEN '{c}' THEN (SELECT max(k.row_num) FROM kept k WHERE k.{c} = d.val)" for c in _C)}
      END AS repeated_row
    FROM imp r LEFT JOIN decided d USING (row_num)""",
)
def glossary_import(spark, d):
    part = fx.table(spark, d, "part")
    return G.import_glossary(
        spark.sql(IMPORT_SQL, part=part), spark.sql(EXISTING_SQL, part=part)
    )
