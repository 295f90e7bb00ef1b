"""Bound queries: batches, joins of units, entities, responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitextra.operators import batching as B
from bitextra.operators import units as U
from bitextra.operators.responses import delivery_ratio, parse_responses
from bitextra.plans import fixtures as fx
from bitextra.plans.fixtures import check_sql
from bitextra.plans.glossary_queries import ENTITIES, entities
from bitextra.plans.registry import query
from bitextra.plans.text_queries import q_trim
from bitextra.session import scratch_path
from bitextra.sources import tables


@query(
    "batches_flat",
    check_sql(
        """SELECT doc_id, unit_idx, cast(floor((row_number() OVER (PARTITION BY doc_id
          ORDER BY unit_idx) - 1) / 5) + 1 AS BIGINT) AS batch_id FROM units_fx WHERE k <> 0""",
        "units",
    ),
)
def batches_flat(spark, d):
    u = fx.units(spark, d).filter("k <> 0").select("doc_id", "unit_idx")
    return B.assign_batches(u, 5)


LAYER = "'L' || cast((unit_idx * unit_idx + doc_id) % 3 AS BIGINT)"


def _layered(spark, d):
    return fx.units(spark, d).select(
        "doc_id", "unit_idx",
        F.concat(
            F.lit("L"), ((F.col("unit_idx") * F.col("unit_idx") + F.col("doc_id")) % 3).cast("string")
        ).alias("layer"),
    )


@query(
    "batches_by_layer",
    check_sql(
        f"""WITH l AS (SELECT doc_id, unit_idx, {LAYER} AS layer FROM units_fx),
        s AS (SELECT doc_id, layer, min(unit_idx) AS f, ceil(count(*) / 4) AS n FROM l GROUP BY ALL),
        o AS (SELECT doc_id, layer, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY f
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM s)
        SELECT doc_id, unit_idx, layer, cast(b + floor((row_number() OVER (
            PARTITION BY doc_id, layer ORDER BY unit_idx) - 1) / 4) + 1 AS BIGINT) AS batch_id
        FROM l JOIN o USING (doc_id, layer)""",
        "units",
    ),
)
def batches_by_layer(spark, d):
    return B.assign_batches(_layered(spark, d), 4, by="layer")


@query(
    "batch_payload",
    check_sql(
        """WITH b AS (SELECT doc_id, unit_idx, line, floor((row_number() OVER (PARTITION BY doc_id
            ORDER BY unit_idx) - 1) / 50) + 1 AS batch_id FROM units_fx)
        SELECT doc_id, cast(batch_id AS BIGINT) AS batch_id, count(*) AS n_units,
          to_json(list({'id': 'p_' || unit_idx, 'text': line, 'context': 'doc ' || doc_id}
            ORDER BY unit_idx))::VARCHAR AS payload
        FROM b GROUP BY ALL""",
        "units",
    ),
)
def batch_payload(spark, d):
    u = fx.units(spark, d).select(
        "doc_id", "unit_idx", F.concat(F.lit("p_"), "unit_idx").alias("unit_id"),
        F.col("line").alias("text"), F.concat(F.lit("doc "), "doc_id").alias("context"),
    )
    return B.batch_payload(B.assign_batches(u))


@query(
    "aligned_pairs",
    check_sql(
        """SELECT coalesce(s.doc_id, t.doc_id) AS doc_id, coalesce(s.unit_idx, t.unit_idx) AS idx,
          s.source, t.target
        FROM (SELECT * FROM units_fx WHERE k <> 9) s
        FULL JOIN (SELECT * FROM units_fx WHERE target IS NOT NULL) t
          ON s.doc_id = t.doc_id AND s.unit_idx = t.unit_idx""",
        "units",
    ),
)
def aligned_pairs(spark, d):
    u = fx.units(spark, d).withColumnRenamed("unit_idx", "idx")
    return U.align_pairs(
        u.filter("k <> 9").withColumn("text", F.col("source")),
        u.filter("target IS NOT NULL").withColumn("text", F.col("target")),
    )


@query(
    "missing_units",
    check_sql(
        "SELECT doc_id, unit_idx, source FROM units_fx WHERE coalesce(target, '') = ''", "units"
    ),
)
def missing_units(spark, d):
    u = fx.units(spark, d)
    return U.missing_units(
        u.select("doc_id", "unit_idx", "source"), u.filter("target <> ''")
    )


@query(
    "overlay_results",
    check_sql(
        """SELECT doc_id, unit_idx, CASE WHEN k IN (2, 3, 6) THEN source ELSE target END AS text
        FROM units_fx WHERE target <> ''""",
        "units",
    ),
)
def overlay_results(spark, d):
    u = fx.units(spark, d).filter("target <> ''")
    return U.overlay_results(
        u.withColumn("text", F.col("target")),
        u.filter("k IN (2, 3, 6)").withColumn("text", F.col("source")),
    )


@query(
    "source_fallback",
    check_sql(
        """SELECT doc_id, unit_idx, coalesce(target, '') = '' AS fell_back,
          CASE WHEN coalesce(target, '') = '' THEN source ELSE target END AS final FROM units_fx""",
        "units",
    ),
)
def source_fallback(spark, d):
    return U.source_fallback(fx.units(spark, d)).select("doc_id", "unit_idx", "fell_back", "final")


@query(
    "pair_validation",
    check_sql(
        rf"""WITH {ENTITIES}, p AS (
          SELECT doc_id, handle, text AS source, CASE ord % 7 WHEN 0 THEN text || ' [[F0]]'
            WHEN 1 THEN replace(text, '\P', '') ELSE text END AS target FROM entities_fx)
        SELECT handle, regexp_matches(target, '\[\[F\d+\]\]') AS placeholder_issue,
          regexp_matches(target, '\\[PASHLQWT_OL~]|\\S[^;]*;') AS fmt_code_issue,
          len(string_split(source, '\P')) <> len(string_split(target, '\P')) AS line_count_mismatch
        FROM p""",
        "lines",
    ),
)
def pair_validation(spark, d):
    return U.validate_pairs(_pairs(spark, d)).select(
        "handle", "placeholder_issue", "fmt_code_issue", "line_count_mismatch"
    )


def _pairs(spark, d):
    t = F.col("text")
    return entities(spark, d).select(
        "doc_id", "handle", t.alias("source"),
        F.when(F.col("ord") % 7 == 0, F.concat(t, F.lit(" [[F0]]")))
        .when(F.col("ord") % 7 == 1, F.replace(t, F.lit("\\P"), F.lit(""))).otherwise(t)
        .alias("target"),
    )


@query(
    "pair_validation_summary",
    check_sql(
        rf"""WITH {ENTITIES}, p AS (
          SELECT doc_id, text AS source, CASE ord % 7 WHEN 0 THEN text || ' [[F0]]'
            WHEN 1 THEN replace(text, '\P', '') ELSE text END AS target FROM entities_fx),
        c AS (SELECT doc_id, count(*) AS checked,
            count(*) FILTER (regexp_matches(target, '\[\[F\d+\]\]')) AS placeholder_issues,
            count(*) FILTER (regexp_matches(target, '\\[PASHLQWT_OL~]|\\S[^;]*;')) AS fmt_code_issues,
            count(*) FILTER (len(string_split(source, '\P')) <> len(string_split(target, '\P')))
              AS line_count_mismatches FROM p GROUP BY doc_id)
        SELECT *, CASE WHEN placeholder_issues > 0 THEN 'FAIL'
          WHEN fmt_code_issues > 0 OR line_count_mismatches > 0 THEN 'WARN' ELSE 'PASS' END AS status
        FROM c""",
        "lines",
    ),
)
def pair_validation_summary(spark, d):
    return U.pair_validation_summary(U.validate_pairs(_pairs(spark, d)))


@query(
    "format_code_stats",
    check_sql(
        rf"""WITH {ENTITIES}, f AS (SELECT regexp_matches(text, '\\[A-Za-z]|%%[cdpo]') AS has,
            doc_id % 3 = 0 AS failed FROM entities_fx)
        SELECT count(*) AS units, count(*) FILTER (has) AS with_codes,
          count(*) FILTER (failed) AS failed, count(*) FILTER (failed AND has) AS failed_with_codes,
          round(count(*) FILTER (has) * 100.0::DOUBLE / count(*), 4) AS pct_all,
          round(count(*) FILTER (failed AND has) * 100.0::DOUBLE / count(*) FILTER (failed), 4)
            AS pct_failed FROM f""",
        "lines",
    ),
)
def format_code_stats(spark, d):
    return U.mtext_stats(entities(spark, d).withColumn("failed", F.col("doc_id") % 3 == 0))


@query(
    "failed_unit_diagnostics",
    check_sql(
        r"""SELECT doc_id, unit_idx, length(source) AS length, contains(source, chr(92))
            AS has_backslash, regexp_matches(source, '\\[A-Za-z]|%%[cdpo]') AS has_mtext_code,
          substr(source, 1, 80) AS preview, 'partial_batch_loss' AS loss_type
        FROM units_fx WHERE coalesce(target, '') = ''""",
        "units",
    ),
)
def failed_unit_diagnostics(spark, d):
    u = fx.units(spark, d)
    return U.failed_unit_diagnostics(
        U.missing_units(u, u.filter("target <> ''")), "source"
    )


@query(
    "diagnostics_sink",
    check_sql(
        r"""SELECT cast(doc_id AS VARCHAR) AS job_id, unit_idx % 7 AS batch, CASE WHEN target IS NULL THEN 1 ELSE 2 END AS attempt, doc_id, unit_idx,
          length(source) AS length, contains(source, chr(92)) AS has_backslash,
          regexp_matches(source, '\\[A-Za-z]|%%[cdpo]') AS has_mtext_code, substr(source, 1, 80) AS preview,
          CASE WHEN target IS NULL THEN NULL ELSE 'partial_batch_loss' END AS loss_type,
          CASE WHEN target IS NULL THEN 'run-1' ELSE 'run-2' END AS write_id
        FROM units_fx WHERE coalesce(target, '') = ''""",
        "units",
    ),
)
def diagnostics_sink(spark, d):
    """Every write is repeated, under its own name and under another; one copy is read back."""
    keyed = fx.units(spark, d).withColumns({
        "job_id": F.col("doc_id").cast("string"), "batch": F.col("unit_idx") % 7, "attempt": F.lit(1).cast("long"),
    })
    keys = tuple(tables.DIAGNOSTIC_KEY)
    failed = U.failed_unit_diagnostics(keyed.filter("target IS NULL"), "source", None, keys)
    # Batches of which only some units came back; they share no key with the failed ones.
    partial = U.failed_unit_diagnostics(keyed.filter("target = ''"), "source", keys=keys)
    partial = partial.withColumn("attempt", F.lit(2).cast("long"))
    path = scratch_path(spark, "diagnostics")
    for rows, name in ((failed, "run-1"), (failed, "run-1"), (partial, "run-2"), (partial, "run-2"), (failed.union(partial), "run-3")):
        tables.append_diagnostics(rows, path, name)
    return tables.read_diagnostics(spark, path, failed.schema)


DRAWING = r"""
    drawing_fx AS (
      SELECT doc_id || '-' || unit_idx AS handle,
        CASE unit_idx % 6 WHEN 0 THEN 'TEXT' WHEN 1 THEN 'MTEXT' WHEN 2 THEN 'ATTRIB'
          WHEN 3 THEN 'DIMENSION' WHEN 4 THEN 'FORMULA' ELSE 'CELL' END AS entity_type,
        doc_id % 2 = 0 AS is_tag,
        CASE doc_id % 9 WHEN 0 THEN ' ' WHEN 1 THEN 'DN' || unit_idx WHEN 2 THEN '10x' || unit_idx
          WHEN 3 THEN ' ' || unit_idx || ' ' WHEN 4 THEN 'VALVE' || unit_idx
          WHEN 5 THEN 'St' || unit_idx || 'kp' ELSE line END AS text,
        'L' || (doc_id % 3) AS layer FROM lines_fx),
    rules_fx AS (SELECT *, CASE WHEN t = '' THEN 'SKIP'
        WHEN regexp_matches(t, '^DN\d+') OR regexp_matches(t, '\d+[×xх]\d+')
          OR regexp_matches(t, 'Ø\d+') OR regexp_matches(t, 'ISO\d+')
          OR regexp_matches(t, 'GOST\s*\d+') OR regexp_matches(t, 'ГОСТ\s*\d+')
          OR regexp_matches(t, '^\d+$') OR regexp_matches(t, '^[A-Z]{2,}\d*$')
          OR regexp_matches(t, '^[A-Za-z]+\d+[A-Za-z]+$') THEN 'SKIP' ELSE 'PASS' END AS action
      FROM (SELECT *, """ + q_trim("text") + r""" AS t FROM drawing_fx)),
    categories_fx AS (SELECT *, CASE WHEN entity_type = 'ATTRIB' AND is_tag THEN 'METADATA'
        WHEN entity_type = 'DIMENSION' AND t = '' THEN 'MEASUREMENT'
        WHEN entity_type = 'FORMULA' THEN 'FORMULA' ELSE 'TRANSLATE' END AS category
      FROM rules_fx)"""


def drawing(spark, d):
    i, doc = F.col("unit_idx"), F.col("doc_id")
    n = i.cast("string")
    kind = F.when(i % 6 == 0, "TEXT").when(i % 6 == 1, "MTEXT").when(i % 6 == 2, "ATTRIB").when(
        i % 6 == 3, "DIMENSION").when(i % 6 == 4, "FORMULA").otherwise("CELL")
    text = (
        F.when(doc % 9 == 0, F.lit(" ")).when(doc % 9 == 1, F.concat(F.lit("DN"), n))
        .when(doc % 9 == 2, F.concat(F.lit("10x"), n))
        .when(doc % 9 == 3, F.concat(F.lit(" "), n, F.lit(" ")))
        .when(doc % 9 == 4, F.concat(F.lit("VALVE"), n))
        .when(doc % 9 == 5, F.concat(F.lit("St"), n, F.lit("kp"))).otherwise(F.col("line"))
    )
    return fx.lines(spark, d).select(
        F.concat_ws("-", "doc_id", "unit_idx").alias("handle"), kind.alias("entity_type"),
        (doc % 2 == 0).alias("is_tag"), text.alias("text"),
        F.concat(F.lit("L"), (doc % 3).cast("string")).alias("layer"),
    )


@query(
    "skip_rules",
    check_sql(f"WITH {DRAWING} SELECT handle, action FROM rules_fx", "lines"),
)
def skip_rules(spark, d):
    from bitextra.operators.leaks import skip_action

    return drawing(spark, d).select(
        "handle", skip_action(F.col("text"), U.SKIP_RULES).alias("action")
    )


@query(
    "entity_categories",
    check_sql(f"WITH {DRAWING} SELECT handle, category FROM categories_fx", "lines"),
)
def entity_categories(spark, d):
    return U.categorize(drawing(spark, d)).select("handle", "category")


@query(
    "extract_translatable",
    check_sql(
        f"""WITH {DRAWING} SELECT handle, text, layer AS context,
          CASE action WHEN 'SKIP' THEN 'SKIPPED' ELSE 'PENDING' END AS status
        FROM categories_fx WHERE category = 'TRANSLATE'""",
        "lines",
    ),
)
def extract_translatable(spark, d):
    return U.extract_translatable(drawing(spark, d)).select("handle", "text", "context", "status")


SPLIT = rf"""
    {ENTITIES},
    long_fx AS (SELECT handle, text, len(string_split(text, '\P')) - 1 >= 3 AND length(text) >= 300
                  AS is_long FROM entities_fx),
    parts_fx AS (
      SELECT handle, is_long, unnest(p) AS part, cast(unnest(range(len(p))) AS BIGINT) AS i
      FROM (SELECT *, CASE WHEN is_long THEN string_split(text, '\P') ELSE [text] END AS p
            FROM long_fx)),
    coded_fx AS (
      SELECT *, array_to_string(list_transform(list_zip(gaps, list_transform(range(len(codes)),
          lambda j: '[[F' || j || ']]')), lambda z: coalesce(z[1], '') || coalesce(z[2], '')), '')
          AS coded
      FROM (SELECT *, string_split_regex(part, '\\[A-Za-z][^;\\]*;|\\[A-Za-z~_]') AS gaps,
              regexp_extract_all(part, '\\[A-Za-z][^;\\]*;|\\[A-Za-z~_]') AS codes FROM parts_fx))"""


def _split(spark, d):
    e = entities(spark, d).select(F.col("handle").alias("unit_id"), "text")
    return e, B.split_paragraphs(e)


@query(
    "split_paragraphs",
    check_sql(
        rf"""WITH {SPLIT} SELECT CASE WHEN is_long THEN handle || '__p' || i ELSE handle END AS unit_id,
          coded AS text, CASE WHEN is_long THEN handle END AS split_parent,
          CASE WHEN is_long THEN i END AS split_index
        FROM coded_fx WHERE regexp_matches(regexp_replace(coded, '\[\[F\d+\]\]', '', 'g'), '\S')""",
        "lines",
    ),
)
def split_paragraphs(spark, d):
    return _split(spark, d)[1].select("unit_id", "text", "split_parent", "split_index")


@query(
    "merge_paragraphs",
    check_sql(
        rf"""WITH {SPLIT} SELECT handle AS unit_id, string_agg(CASE WHEN regexp_matches(
            regexp_replace(coded, '\[\[F\d+\]\]', '', 'g'), '\S') AND i % 2 = 0
            THEN '<' || part || '>' ELSE part END, '\P' ORDER BY i) AS merged
        FROM coded_fx WHERE is_long GROUP BY handle""",
        "lines",
    ),
)
def merge_paragraphs(spark, d):
    e, parts = _split(spark, d)
    children = parts.filter("split_parent IS NOT NULL").select(
        "split_parent", "split_index",
        F.when(F.col("split_index") % 2 == 0, F.concat(F.lit("<"), "original", F.lit(">")))
        .alias("translated"),
    )
    return B.merge_paragraphs(e, children)


# Runs of a line: a short head, a blank run, the middle and the tail.
RUNS = """
    runs_fx AS (
      SELECT doc_id, unit_idx, line, [substr(line, 1, 7), ' ', substr(line, 8, 11),
        substr(line, 19)] AS runs FROM lines_fx)"""


def _runs(spark, d):
    line = F.col("line")
    return fx.lines(spark, d).withColumn(
        "runs", F.array(line.substr(1, 7), F.lit(" "), line.substr(8, 11),
                        F.expr("substring(line, 19)"))
    )


@query(
    "distribute_words",
    check_sql(
        r"""WITH """ + RUNS + r""",
        m AS (SELECT *, list_filter(string_split_regex(line, '\s+'), lambda w: w <> '') AS words,
            list_transform(runs, lambda r: CASE WHEN regexp_matches(r, '\S') THEN length(r) ELSE 0 END)
              AS lens FROM runs_fx),
        e AS (SELECT *, list_transform(lens, lambda x: x::DOUBLE / list_sum(lens) * len(words)) AS exact
              FROM m),
        rr AS (SELECT doc_id, unit_idx, runs, words, unnest(range(1, 5)) AS i, unnest(exact) AS x,
                 unnest(lens) AS n, unnest(runs) AS r FROM e),
        ranked AS (SELECT *, floor(x) AS b, len(words) - sum(floor(x)) OVER u AS spare,
            row_number() OVER (PARTITION BY doc_id, unit_idx, n > 0 ORDER BY -(x - floor(x)), i) AS k
          FROM rr WINDOW u AS (PARTITION BY doc_id, unit_idx)),
        c AS (SELECT *, cast(b + CASE WHEN n > 0 AND k <= spare THEN 1 ELSE 0 END AS BIGINT) AS cnt
              FROM ranked),
        s AS (SELECT *, cast(sum(cnt) OVER (PARTITION BY doc_id, unit_idx ORDER BY i) - cnt AS BIGINT)
                AS start_at FROM c)
        SELECT doc_id, unit_idx, i - 1 AS run, CASE WHEN NOT regexp_matches(r, '\S') THEN r ELSE
          array_to_string(words[start_at + 1:start_at + cnt], ' ') || regexp_extract(r, '(\s*)$', 1)
          END AS text FROM s""",
        "lines",
    ),
)
def distribute_words(spark, d):
    r = _runs(spark, d).select(
        "doc_id", "unit_idx", B.distribute_words(F.col("runs"), F.col("line")).alias("parts")
    )
    return r.select("doc_id", "unit_idx", F.posexplode("parts").alias("run", "text")).withColumn(
        "run", F.col("run").cast("long")
    )


@query(
    "distribute_chars",
    check_sql(
        r"""WITH """ + RUNS + r""",
        w AS (SELECT *, length(line) + 2 AS n, '>' || line || '<' AS t, list_transform(runs, lambda r:
            greatest(1, cast(floor((length(line) + 2) * (length(r)::DOUBLE / (length(line) + 1)))
              AS BIGINT))) AS want FROM runs_fx),
        p AS (SELECT doc_id, unit_idx, t, n, unnest(range(1, 5)) AS i, unnest(want) AS x FROM w),
        q AS (SELECT *, least(n, sum(x) OVER (PARTITION BY doc_id, unit_idx ORDER BY i) - x) AS s FROM p)
        SELECT doc_id, unit_idx, i - 1 AS run, substr(t, cast(s + 1 AS BIGINT), cast(
          CASE WHEN i < 4 THEN least(x, n - s) ELSE n - s END AS BIGINT)) AS text FROM q""",
        "lines",
    ),
)
def distribute_chars(spark, d):
    text = F.concat(F.lit(">"), "line", F.lit("<"))
    r = _runs(spark, d).select(
        "doc_id", "unit_idx", B.distribute_chars(F.col("runs"), text).alias("parts")
    )
    return r.select("doc_id", "unit_idx", F.posexplode("parts").alias("run", "text")).withColumn(
        "run", F.col("run").cast("long")
    )


# A response for every line: one fault per document class.
def _responses(spark, d):
    doc = F.col("doc_id")
    body = F.to_json(F.struct(F.concat(F.lit("p_"), "unit_idx").alias("id"), F.col("line").alias("text")))
    extra = F.lit('{"id": "x", "text": "more"}')
    full = F.concat(F.lit('{"translations": ['), body, F.lit(", "), extra, F.lit("]}"))
    response = (
        F.when(doc % 9 == 0, F.regexp_replace(full, r"\]\}$", ",]}"))
        .when(doc % 9 == 1, F.concat(F.lit('{"translations": ['), body, extra, F.lit("]}")))
        .when(doc % 9 == 2, F.concat(F.lit("```json\n"), full, F.lit("\n```")))
        .when(doc % 9 == 3, F.concat(F.lit("Here is the translation: <think>a {b} c</think>"), full))
        .when(doc % 9 == 4, F.concat(body, F.lit(", "), extra))
        .when(doc % 9 == 5, body)
        .when(doc % 9 == 6, F.regexp_replace(full, r"\]\}$", ""))
        .when(doc % 9 == 7, F.concat(F.lit('{"translations": [{"id": "x" "text": "more"}, '), body,
                                     F.lit("]}")))
        .otherwise(F.concat(full, F.lit(" trailing }")))
    )
    return fx.lines(spark, d).select("doc_id", "unit_idx", response.alias("response"), "line")


@query(
    "response_parse",
    check_sql(
        """SELECT doc_id, unit_idx, 'p_' || unit_idx AS id, line AS text FROM lines_fx
          WHERE doc_id % 9 <> 6
        UNION ALL SELECT doc_id, unit_idx, 'x', 'more' FROM lines_fx WHERE doc_id % 9 NOT IN (5, 6)""",
        "lines",
    ),
)
def response_parse(spark, d):
    parsed = parse_responses(_responses(spark, d))
    return parsed.select("doc_id", "unit_idx", F.inline_outer("items")).filter("id IS NOT NULL")


@query(
    "model_output_cleaning",
    check_sql(
        rf"""SELECT doc_id, unit_idx, {q_trim('line')} AS cleaned FROM lines_fx""",
        "lines",
    ),
)
def model_output_cleaning(spark, d):
    from bitextra.functions.markup import clean_model_output

    doc, line = F.col("doc_id"), F.col("line")
    noisy = (
        F.when(doc % 5 == 0, F.concat(F.lit("<<<INPUT_TEXT>>>"), line, F.lit("<<<END_INPUT_TEXT>>>")))
        .when(doc % 5 == 1, F.concat(F.lit("Вот перевод: <s1>"), line, F.lit("</s1>")))
        .when(doc % 5 == 2, F.concat(F.lit("<think>one\ntwo</think>\n"), line))
        .when(doc % 5 == 3, F.concat(F.lit("```text\n"), line, F.lit("\n```")))
        .otherwise(F.concat(F.lit("Certainly!"), line))
    )
    return fx.lines(spark, d).select(
        "doc_id", "unit_idx", clean_model_output(noisy).alias("cleaned")
    )


@query(
    "json_repair",
    check_sql(
        r"""SELECT doc_id, unit_idx, '{"a":"\\P' || unit_idx || '\n"},{"b":[1]}' AS repaired
        FROM lines_fx""",
        "lines",
    ),
)
def json_repair(spark, d):
    from bitextra.functions.markup import repair_json

    broken = F.concat(F.lit('{"a":"\\P'), F.col("unit_idx"), F.lit('\\n",}{"b":[1, ]}'))
    return fx.lines(spark, d).select("doc_id", "unit_idx", repair_json(broken).alias("repaired"))


@query(
    "delivery_ratio",
    check_sql(
        """WITH b AS (SELECT doc_id, coalesce(target, '') <> '' AS ok, cast(floor((row_number()
            OVER (PARTITION BY doc_id ORDER BY unit_idx) - 1) / 6) + 1 AS BIGINT) AS batch_id
            FROM units_fx),
        r AS (SELECT doc_id, batch_id, count(*) AS expected, count(*) FILTER (ok) AS delivered
              FROM b GROUP BY ALL)
        SELECT *, round(delivered / expected, 6) AS ratio,
          CASE WHEN delivered / expected < 0.75 AND expected > 1 THEN 'split'
            WHEN delivered < expected THEN 'retry_missing' ELSE 'complete' END AS action FROM r""",
        "units",
    ),
)
def delivery_ratio_query(spark, d):
    u = fx.units(spark, d).select(
        "doc_id", "unit_idx", (F.coalesce("target", F.lit("")) != "").alias("delivered")
    )
    return delivery_ratio(B.assign_batches(u, 6))


@query(
    "page_drift",
    check_sql(
        """SELECT doc_id, count(DISTINCT unit_idx // 4) AS original_pages,
          count(DISTINCT CASE WHEN coalesce(target, '') <> '' THEN unit_idx // 3 END)
            AS translated_pages,
          count(DISTINCT CASE WHEN coalesce(target, '') <> '' THEN unit_idx // 3 END)
            - count(DISTINCT unit_idx // 4) AS page_delta
        FROM units_fx GROUP BY doc_id""",
        "units",
    ),
)
def page_drift(spark, d):
    u = fx.units(spark, d)
    return U.page_drift(
        u.select("doc_id", F.floor(F.col("unit_idx") / 4).alias("page")),
        u.filter("target <> ''").select("doc_id", F.floor(F.col("unit_idx") / 3).alias("page")),
    )
