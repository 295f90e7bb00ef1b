"""Bound queries: numeric tokens, drift, repair and the integrity gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitextra.functions import numeric as N
from bitextra.operators.integrity import (
    document_drift, document_values, integrity_report, mixed_samples, numeric_drift,
    repair_numerics,
)
from bitextra.plans import fixtures as fx
from bitextra.plans.fixtures import check_sql
from bitextra.plans.registry import query
from bitextra.plans.text_queries import q_mixed, q_norm

_REF = r"(?i)(?:№|No\.?|No)\s*\d+(?:\.\d+)*\b"
_SUB = r"\b\d+(?:\.\d+)+(?:-\d+(?:\.\d+)*)*\b"
_NUM = r"\d{2,}"
_UNIT = (
    r"(?i)^\s*(?:(?:кПа|МПа|Па|MPa|kPa|кВт|kW|Вт|В|А|мм рт\.? ст\.?|\d+|°[CС]|[мсдк]м|см|мм|км|м/с|т"
    r"|кг|г|мг|м\^?3|м\^?2|л|мл|с|ч|мин)(?:[^\p{L}\p{N}_]|$)|[%°][\p{L}\p{N}_])"
)


def _spans(name: str, pattern: str) -> str:
    """Every match of a pattern in texts_fx(doc_id, idx, side, t) with its position."""
    return f"""
    {name} AS (
      SELECT doc_id, idx, side, t, raw, at_, at_ + length(raw) AS until FROM (
        SELECT *, sum(length(gap)) OVER w + coalesce(sum(length(raw)) OVER b, 0) AS at_ FROM (
          SELECT doc_id, idx, side, t, unnest(toks) AS raw, unnest(gaps[1:len(toks)]) AS gap,
                 unnest(range(len(toks))) AS i
          FROM (SELECT *, regexp_extract_all(t, '{pattern}') AS toks,
                       string_split_regex(t, '{pattern}') AS gaps
                FROM texts_fx WHERE regexp_matches(t, '\\d')))
        WINDOW w AS (PARTITION BY doc_id, idx, side ORDER BY i),
          b AS (PARTITION BY doc_id, idx, side ORDER BY i
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))"""


TOKENS = f"""{_spans('refs_fx', _REF)}, {_spans('subs_all', _SUB)}, {_spans('nums_all', _NUM)},
    subs_fx AS (
      SELECT s.*, CASE WHEN regexp_matches(raw, '^\\d{{1,2}}[./-]\\d{{1,2}}[./-]\\d{{2,4}}$')
        THEN 'date' WHEN regexp_matches(substr(t, cast(until + 1 AS BIGINT)), '{_UNIT}') THEN 'num'
        ELSE 'sub' END AS kind
      FROM subs_all s WHERE NOT EXISTS (
        SELECT 1 FROM refs_fx r WHERE r.doc_id = s.doc_id AND r.idx = s.idx AND r.side = s.side
          AND r.at_ <= s.at_ AND r.until >= s.until)),
    taken AS (SELECT doc_id, idx, side, at_, until FROM refs_fx
              UNION ALL SELECT doc_id, idx, side, at_, until FROM subs_fx),
    tokens_fx AS (
      SELECT doc_id, idx, side, 'ref' AS kind, raw, regexp_replace(raw, '\\D', '', 'g') AS value, at_
      FROM refs_fx
      UNION ALL
      SELECT doc_id, idx, side, kind, raw, CASE WHEN kind = 'date' THEN
        array_to_string(list_transform(string_split_regex(raw, '[./-]'),
          lambda p: CASE WHEN length(p) = 1 THEN '0' || p ELSE p END), '-') ELSE raw END, at_
      FROM subs_fx
      UNION ALL
      SELECT doc_id, idx, side, 'num', raw, raw, at_ FROM nums_all n WHERE NOT EXISTS (
        SELECT 1 FROM taken r WHERE r.doc_id = n.doc_id AND r.idx = n.idx AND r.side = n.side
          AND r.at_ <= n.at_ AND r.until >= n.until))"""

UNIT_TEXTS = """
    texts_fx AS (
      SELECT doc_id, unit_idx AS idx, 's' AS side, source AS t FROM units_fx
      UNION ALL SELECT doc_id, unit_idx, 't', coalesce(target, '') FROM units_fx)"""


def _drift(keys: str, order: str) -> str:
    """feat(keys, side, kind, value, first position) -> drift_fx."""
    eq = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))

    def surplus(name: str, more: str, less: str) -> str:
        return f"""
        {name} AS (
          SELECT {keys}, kind, value,
                 row_number() OVER (PARTITION BY {keys}, kind ORDER BY p, copy) AS rank
          FROM (SELECT *, unnest(range(d)) AS copy FROM (
            SELECT a.*, a.c - coalesce(b.c, 0) AS d FROM feat a LEFT JOIN feat b
            ON {eq} AND a.kind = b.kind AND a.value = b.value AND b.side = '{less}'
            WHERE a.side = '{more}') WHERE d > 0))"""

    return f"""
    feat AS (
      SELECT {keys}, side, kind, value, min({order}) AS p, count(*) AS c FROM tokens_fx
      WHERE kind <> 'date' GROUP BY {keys}, side, kind, value),
    {surplus('lost_fx', 's', 't')}, {surplus('extra_fx', 't', 's')},
    drift_fx AS (
      SELECT {', '.join('a.' + k for k in keys.split(', '))}, a.kind, a.value AS lost,
             coalesce(b.value, '') AS extra, a.rank
      FROM lost_fx a LEFT JOIN extra_fx b ON {eq} AND a.kind = b.kind AND a.rank = b.rank)"""


@query(
    "numeric_tokens",
    check_sql(
        f"""WITH {UNIT_TEXTS}, {TOKENS}
        SELECT doc_id, idx AS unit_idx, kind, raw, value,
               row_number() OVER (PARTITION BY doc_id, idx, kind ORDER BY at_) AS seq
        FROM tokens_fx WHERE side = 't'""",
        "units",
    ),
)
def numeric_tokens(spark, d):
    toks = fx.units(spark, d).select(
        "doc_id", "unit_idx", N.numeric_tokens(F.col("target")).alias("toks")
    )
    kinds = F.explode(F.array(*[N.of_kind(F.col("toks"), k) for k in ("ref", "sub", "num", "date")]))
    return (
        toks.select("doc_id", "unit_idx", kinds.alias("of_kind"))
        .select("doc_id", "unit_idx", F.posexplode_outer("of_kind").alias("p", "x"))
        .filter("x IS NOT NULL")
        .select(
            "doc_id", "unit_idx", "x.kind", "x.raw", "x.value",
            (F.col("p") + 1).cast("long").alias("seq"),
        )
    )


@query(
    "numeric_drift",
    check_sql(
        f"""WITH {UNIT_TEXTS}, {TOKENS}, {_drift('doc_id, idx', 'at_')}
        SELECT doc_id, idx AS unit_idx, kind, lost, extra, rank FROM drift_fx""",
        "units",
    ),
)
def numeric_drift_query(spark, d):
    return numeric_drift(fx.units(spark, d).select("doc_id", "unit_idx", "source", "target"))


_PARA = "regexp_replace({x}, '<[^>]+>', '', 'g')"


def _clean(x: str) -> str:
    out = _PARA.format(x=x)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"),
                         ("&apos;", "''"), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{char}')"
    return q_norm(out)


PARAGRAPHS = f"""
    paras_fx AS (
      SELECT * FROM (
        SELECT doc_id, unit_idx AS idx, 's' AS side, {_clean('source')} AS t FROM units_fx
        UNION ALL SELECT doc_id, unit_idx, 't', {_clean('target')} FROM units_fx)
      WHERE length(t) > 0),
    texts_fx AS (SELECT * FROM paras_fx)"""


def _sides(spark, d):
    u = fx.units(spark, d)
    src = u.select("doc_id", F.col("unit_idx").alias("idx"), F.col("source").alias("text"))
    tgt = u.select("doc_id", F.col("unit_idx").alias("idx"), F.col("target").alias("text"))
    return src, tgt


@query(
    "document_drift",
    check_sql(
        f"""WITH {PARAGRAPHS}, {TOKENS}, {_drift('doc_id', 'idx * 1000000 + at_')}
        SELECT doc_id, kind, lost, extra, rank FROM drift_fx""",
        "units",
    ),
)
def document_drift_query(spark, d):
    from bitextra.operators.integrity import nonempty_paragraphs

    src, tgt = _sides(spark, d)
    return document_drift(
        document_values(nonempty_paragraphs(src), nonempty_paragraphs(tgt))
    ).select("doc_id", "kind", "lost", "extra", "rank")


@query(
    "integrity_report",
    check_sql(
        f"""WITH {PARAGRAPHS}, {TOKENS}, {_drift('doc_id', 'idx * 1000000 + at_')},
        n AS (SELECT doc_id, count(*) FILTER (side = 's') AS n_source,
                count(*) FILTER (side = 't') AS n_target,
                count(*) FILTER (side = 't' AND {q_mixed('t')}) AS mixed_count
              FROM paras_fx GROUP BY doc_id HAVING count(*) FILTER (side = 's') > 0),
        m AS (SELECT doc_id, count(*) AS mm, count(*) FILTER (
                kind = 'ref' AND length(lost) BETWEEN 2 AND 6
                AND (extra = '' OR length(extra) BETWEEN 2 AND 6)) AS rm
              FROM drift_fx GROUP BY doc_id)
        SELECT *, lost_paragraphs > 0 OR ref_mismatch_count > 0 AS critical FROM (
          SELECT doc_id, n_source, n_target,
                 CASE WHEN n_source - n_target > greatest(3, floor(n_source * 0.05))
                   THEN n_source - n_target ELSE 0 END AS lost_paragraphs,
                 coalesce(mm, 0) AS numeric_mismatch_count,
                 coalesce(rm, 0) AS ref_mismatch_count, mixed_count
          FROM n LEFT JOIN m USING (doc_id))""",
        "units",
    ),
)
def integrity_report_query(spark, d):
    return integrity_report(*_sides(spark, d))


@query(
    "mixed_samples",
    check_sql(
        f"""WITH {PARAGRAPHS}
        SELECT doc_id, idx, substr(t, 1, 200) AS sample FROM paras_fx
        WHERE side = 't' AND {q_mixed('t')}
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY idx) <= 50""",
        "units",
    ),
)
def mixed_samples_query(spark, d):
    return mixed_samples(_sides(spark, d)[1])


_SPAN = r"(?i)(?:№|No\.?|No)\s*\d+(?:\.\d+)*\b|\b\d+(?:\.\d+)+(?:-\d+(?:\.\d+)*)*\b|\d{2,}"


def _weave(gaps: str, toks: str) -> str:
    return (
        f"array_to_string(list_transform(list_zip({gaps}, {toks}), "
        f"lambda z: coalesce(z[1], '') || coalesce(z[2], '')), '')"
    )


@query(
    "protect_numerics",
    check_sql(
        f"""SELECT doc_id, unit_idx, {_weave('gaps',
            "list_transform(range(len(toks)), lambda i: '⟦NUM' || i || '⟧')")} AS protected,
            cast(len(toks) AS BIGINT) AS n_tokens, source AS restored
        FROM (SELECT *, string_split_regex(source, '{_SPAN}') AS gaps,
                     regexp_extract_all(source, '{_SPAN}') AS toks FROM units_fx)""",
        "units",
    ),
)
def protect_numerics_query(spark, d):
    s = F.col("source")
    guarded = fx.units(spark, d).select(
        "doc_id", "unit_idx", N.protect(s).alias("protected"), N.registry(s).alias("spellings")
    )
    return guarded.select(
        "doc_id", "unit_idx", "protected", F.size("spellings").cast("long").alias("n_tokens"),
        N.restore(F.col("protected"), F.col("spellings")).alias("restored"),
    )


@query(
    "restore_numerics",
    check_sql(
        f"""SELECT doc_id, unit_idx, '<' || coalesce(toks[1], '⟦NUM0⟧') || '> '
            || coalesce(toks[10], '⟦NUM9⟧') AS restored
        FROM (SELECT *, regexp_extract_all(source, '{_SPAN}') AS toks FROM units_fx)""",
        "units",
    ),
)
def restore_numerics_query(spark, d):
    s = F.col("source")
    return fx.units(spark, d).select(
        "doc_id", "unit_idx",
        N.restore(F.lit("<⟦NUM0⟧> ⟦NUM9⟧"), N.registry(s)).alias("restored"),
    )


# Both sides hold the same line, so only the injected reference can have drifted;
# an empty target lacks every token of its source.
@query(
    "repair_numerics",
    check_sql(
        f"""WITH {UNIT_TEXTS}, {TOKENS},
        lost AS (SELECT doc_id, idx, count(*) AS n FROM tokens_fx WHERE side = 's' GROUP BY 1, 2)
        SELECT u.doc_id, unit_idx,
            CASE WHEN k = 6 THEN 'No. ' || u.n || ' ' || line ELSE target END AS repaired,
            CASE WHEN k = 0 THEN coalesce(lost.n, 0) ELSE 0 END AS unresolved
        FROM units_fx u LEFT JOIN lost ON lost.doc_id = u.doc_id AND lost.idx = u.unit_idx
        WHERE target IS NOT NULL""",
        "units",
    ),
)
def repair_numerics_query(spark, d):
    fixed = repair_numerics(
        fx.units(spark, d).filter("target IS NOT NULL").select("doc_id", "unit_idx", "source", "target")
    )
    return fixed.select("doc_id", "unit_idx", "repaired", "unresolved")
