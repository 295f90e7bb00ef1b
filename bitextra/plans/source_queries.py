"""Bound queries: sources and sinks over files that Spark writes from the tables."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import functions as F

from bitextra.operators import structure as S
from bitextra.operators.integrity import nonempty_paragraphs, numeric_drift
from bitextra.operators.leaks import scan_glue, scan_leaks
from bitextra.plans import fixtures as fx
from bitextra.plans.fixtures import check_sql
from bitextra.plans.numeric_queries import TOKENS, UNIT_TEXTS, _clean, _drift
from bitextra.plans.registry import query
from bitextra.plans.text_queries import GLUE_CTE, q_cyr, q_norm, q_reason, q_trim
from bitextra.session import scratch_path
from bitextra.sources import office, tables
from bitextra.sources.pagetext import page_lines, read_page_text
from bitextra.sources.xliff import read_xliff, write_xliff
from bitextra.streaming.logs import run_available


def write_pages(spark, d) -> str:
    """Four units a page; every seventh document has raw text only; some lines are broken."""
    u = fx.units(spark, d).filter("target <> ''")
    per_unit = u.select(
        "doc_id", (F.floor(F.col("unit_idx") / 4)).cast("int").alias("page"), "unit_idx", "target"
    )
    # Only the texts are gathered; their words are made in the page itself.
    pages = per_unit.groupBy("doc_id", "page").agg(
        F.array_sort(F.collect_list(F.struct("unit_idx", "target"))).alias("us")
    )
    plain = F.col("doc_id") % 7 == 0

    def words(x):
        block = (x["unit_idx"] % 4).cast("int")
        return F.transform(
            F.split(x["target"], " "), lambda w: F.struct(w.alias("text"), block.alias("block"), F.lit(0).alias("line"))
        )

    record = F.to_json(
        F.struct(
            "page", F.col("doc_id").cast("string").alias("pdf"),
            F.array_join(F.transform("us", lambda x: x["target"]), "\n").alias("text"),
            F.when(~plain, F.flatten(F.transform("us", words))).alias("words"),
        )
    )
    broken = F.when(F.col("doc_id") % 5 == 0, F.lit('{"page": 1, "pdf": '))
    path = scratch_path(spark, "pages")
    # Every word repeats its field names: packed, the records take about as much room as their texts.
    values = pages.select(F.explode(F.array_compact(F.array(record, broken))).alias("value"))
    values.write.option("compression", "lz4").text(path)
    return path


PAGE_FIELDS = """cast(doc_id AS VARCHAR) AS pdf, cast(unit_idx // 4 AS INT) AS page,
    CASE WHEN doc_id % 7 = 0 THEN NULL ELSE cast(unit_idx % 4 AS INT) END AS block,
    CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 0 END AS line"""


@query(
    "page_text_lines",
    check_sql(f"SELECT {PAGE_FIELDS}, target AS text FROM units_fx WHERE target <> ''", "units"),
)
def page_text_lines(spark, d):
    return page_lines(read_page_text(spark, write_pages(spark, d))).drop("pos")


@query(
    "page_text_leaks",
    check_sql(
        f"""SELECT {PAGE_FIELDS}, {q_trim('target')} AS fragment, reason,
          cast({q_cyr('target')} AS BIGINT) AS cyrillic_chars
        FROM (SELECT *, {q_reason('target')} AS reason FROM units_fx)
        WHERE reason IS NOT NULL""",
        "units",
    ),
)
def page_text_leaks(spark, d):
    return scan_leaks(page_lines(read_page_text(spark, write_pages(spark, d)))).drop("pos")


def _shown(x: str) -> str:
    """Entities resolved once more, pseudo tags gone, white space collapsed."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"),
                         ("&apos;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    x = f"regexp_replace({x}, '</?run\\d+\\s*/?>', '', 'g')"
    return q_norm(f"regexp_replace({x}, '</?tags?\\d*\\s*/?>', '', 'g')")


@query(
    "xliff_units",
    check_sql(
        f"""SELECT doc_id || '_' || unit_idx AS unit_id, {_shown('source')} AS source,
          {_shown('target')} AS target, true AS translate FROM units_fx WHERE target <> ''""",
        "units",
    ),
)
def xliff_units(spark, d):
    u = fx.units(spark, d).filter("target <> ''")
    path = scratch_path(spark, "xliff")
    write_xliff(
        u.select(F.concat_ws("_", "doc_id", "unit_idx").alias("unit_id"), "source", "target"), path
    )
    return read_xliff(spark, path).select("unit_id", "source", "target", "translate")


@query(
    "inline_markup",
    check_sql(
        f"""SELECT doc_id, unit_idx, {_shown("(line || ' b&c ' || line)")} AS text FROM lines_fx""",
        "lines",
    ),
)
def inline_markup(spark, d):
    from bitextra.functions.markup import visible_text

    line = F.col("line")
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        line = F.replace(line, F.lit(char), F.lit(entity))
    xml = F.concat(
        F.lit('<ph id="1">&lt;hyperlink1&gt;</ph><g id="2">'), line,
        F.lit('</g>&lt;run1&gt; b&amp;amp;c<x id="3"/>&lt;/run1&gt; <bpt id="4">z</bpt>'), line,
    )
    return fx.lines(spark, d).select(
        "doc_id", "unit_idx", visible_text(xml).alias("text")
    )


# Bytes of files that leave a task together.
FILES_BYTES = 2 * 1024 * 1024


def _file_batches(batches, make):
    """Batches of path and content: the files that ``make`` gives for each row, one row after the other."""

    def leave(held):
        columns = [pa.array([h[0] for h in held], pa.string()), pa.array([h[1] for h in held], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["path", "content"])

    held, size = [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            for path, content in make(*(column[i].as_py() for column in batch.columns)):
                held.append((path, content))
                size += len(content)
            if size >= FILES_BYTES:
                yield leave(held)
                held, size = [], 0
    yield leave(held)


def _files(rows, make):
    return rows.mapInArrow(lambda batches: _file_batches(batches, make), "path STRING, content BINARY")


def _archives(spark, d, column):
    """One archive per document: a paragraph per unit, a table, tabs and media."""
    u = fx.units(spark, d).select("doc_id", "unit_idx", F.col(column).alias("text"))
    if column == "target":
        u = u.filter("text <> ''")
    docs = u.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("unit_idx", "text"))).alias("paras")
    )

    def archive(doc, paras):
        body = "".join(
            f"<w:p><w:r><w:tab/><w:t>{escape(p['text'])}</w:t></w:r></w:p>" for p in paras
        )
        rows = "<w:tr/>" * (doc % 3)
        xml = f'<w:document xmlns:w="w"><w:body>{body}<w:tbl>{rows}</w:tbl></w:body></w:document>'
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            if doc % 50 != 49:
                z.writestr("word/document.xml", xml)
            z.writestr("word/_rels/document.xml.rels", "<p/>")
            for i in range(doc % 2):
                z.writestr(f"word/media/image{i}.png", b"x")
        return [(str(doc), held.getvalue())]

    return _files(docs, archive)


def _damaged(files):
    """A truncated, a malformed and an encrypted copy of some of the archives."""

    def spoil(path, content):
        if int(path) % 50 != 7:
            return []
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            z.writestr("word/document.xml", "<w:document><w:p></w:document>")
        locked = bytearray(content)
        for mark, at in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
            found = locked.find(mark)
            while found >= 0:
                locked[found + at] |= 1
                found = locked.find(mark, found + 4)
        return [
            (f"cut {path}", content[: len(content) // 2]), (f"bad {path}", held.getvalue()),
            (f"locked {path}", bytes(locked)),
        ]

    return _files(files, spoil)


@query(
    "docx_paragraphs",
    check_sql(
        """SELECT cast(doc_id AS VARCHAR) AS path, row_number() OVER (PARTITION BY doc_id
          ORDER BY unit_idx) - 1 AS idx, source AS text, false AS failed FROM units_fx
          WHERE doc_id % 50 <> 49
        UNION ALL SELECT cast(doc_id AS VARCHAR), NULL, NULL, true FROM units_fx
          WHERE doc_id % 50 = 49 GROUP BY doc_id
        UNION ALL SELECT k || cast(doc_id AS VARCHAR), NULL, NULL, true
          FROM (SELECT DISTINCT doc_id FROM units_fx WHERE doc_id % 50 = 7),
            (VALUES ('cut '), ('bad '), ('locked ')) AS kinds(k)""",
        "units",
    ),
)
def docx_paragraphs(spark, d):
    files = _archives(spark, d, "source")
    return office.docx_paragraphs(files.unionByName(_damaged(files))).select(
        "path", "idx", "text", F.col("error").isNotNull().alias("failed")
    )


@query(
    "nonempty_paragraphs",
    check_sql(
        f"""SELECT doc_id, unit_idx, text FROM (SELECT doc_id, unit_idx, {_clean('target')} AS text
          FROM units_fx) WHERE text <> ''""",
        "units",
    ),
)
def nonempty(spark, d):
    return nonempty_paragraphs(
        fx.units(spark, d).select("doc_id", "unit_idx", F.col("target").alias("text"))
    )


PROFILES = """
    prof AS (SELECT doc_id, side, CASE WHEN doc_id % 50 = 49 THEN 0 ELSE n END AS paragraphs,
        CASE WHEN doc_id % 50 = 49 THEN 0 ELSE 1 END AS tables,
        CASE WHEN doc_id % 50 = 49 THEN 0 ELSE doc_id % 3 END AS rows, doc_id % 2 AS media,
        CASE WHEN doc_id % 50 = 49 THEN 0 ELSE n END AS text_elements,
        CASE WHEN doc_id % 50 = 49 THEN 0 ELSE n END AS tabs
      FROM (SELECT doc_id, 's' AS side, count(*) AS n FROM units_fx GROUP BY 1
            UNION ALL SELECT doc_id, 't', count(*) FROM units_fx WHERE target <> '' GROUP BY 1))"""


@query(
    "structure_profile",
    check_sql(
        f"""WITH {PROFILES} SELECT cast(doc_id AS VARCHAR) AS path, paragraphs, tables, rows, media,
          text_elements, tabs, false AS failed FROM prof WHERE side = 's'
        UNION ALL SELECT k || cast(doc_id AS VARCHAR), NULL, NULL, NULL, NULL, NULL, NULL, true
          FROM (SELECT DISTINCT doc_id FROM units_fx WHERE doc_id % 50 = 7),
            (VALUES ('cut '), ('bad '), ('locked ')) AS kinds(k)""",
        "units",
    ),
)
def structure_profile(spark, d):
    files = _archives(spark, d, "source")
    return office.structure_profile(files.unionByName(_damaged(files))).withColumn(
        "failed", F.col("error").isNotNull()
    ).drop("error")


@query(
    "structure_compare",
    check_sql(
        f"""WITH {PROFILES}, deltas AS (
          SELECT s.doc_id, s.paragraphs <> t.paragraphs AS hard, s.tabs <> t.tabs AS soft
          FROM prof s JOIN prof t ON s.doc_id = t.doc_id AND s.side = 's' AND t.side = 't')
        SELECT cast(doc_id AS VARCHAR) AS doc_id, CASE WHEN hard THEN 'paragraphs' ELSE '' END
          AS hard_failures, CASE WHEN soft THEN 'tabs,text_elements' ELSE '' END AS warnings
        FROM deltas""",
        "units",
    ),
)
def structure_compare(spark, d):
    sides = [
        office.structure_profile(_archives(spark, d, c)).drop("error").withColumnRenamed("path", "doc_id")
        for c in ("source", "target")
    ]
    return S.structure_verdict(S.compare_structures(*sides))


@query(
    "bloat_gate",
    check_sql(
        """SELECT doc_id, stored, paragraphs, paragraphs > 20 AS bloat, paragraphs <= 20 AS eligible,
          (paragraphs > 20) <> stored AS flag_mismatch
        FROM (SELECT doc_id, count(*) AS paragraphs, doc_id % 4 = 0 AS stored
              FROM lines_fx GROUP BY doc_id)""",
        "lines",
    ),
)
def bloat_gate(spark, d):
    counts = fx.lines(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("paragraphs"))
    path = scratch_path(spark, "catalogue")
    counts.select(
        F.col("doc_id").cast("string").alias("case"), (F.col("doc_id") % 4 == 0).alias("bloat"),
        F.struct("paragraphs").alias("profile_original"),
    ).write.json(path)
    catalogue = tables.read_catalogue(spark, path).select(
        F.col("case").cast("long").alias("doc_id"), "bloat", "profile_original.paragraphs"
    )
    return S.bloat_gate(
        catalogue.select("doc_id", "bloat"), catalogue.select("doc_id", "paragraphs"), 20
    )


def _workbooks(spark, d):
    """One workbook per document; every fourth line a shared, inline, comment or shape text, and typed cells."""
    docs = fx.lines(spark, d).groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("unit_idx", "line"))).alias("cells")
    )

    def workbook(doc, cells):
        by = {k: [(c["unit_idx"], escape(c["line"])) for c in cells if c["unit_idx"] % 4 == k] for k in range(4)}
        half = lambda t: f"<r><t>{t[:0]}</t></r><r><t>{t}</t></r>"
        typed = "".join(
            f'<row><c r="C{i}" s="{i % 2}"><v>{i}</v></c><c r="D{i}" t="b"><v>{i % 2}</v></c>'
            f'<c r="E{i}" t="e"><v>#N/A</v></c><c r="F{i}"><f>C{i}+1</f><v>{i + 1}</v></c></row>'
            for i, _ in by[2]
        )
        parts = {
            "xl/styles.xml": '<numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/></numFmts>'
            '<cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs>',
            "xl/sharedStrings.xml": "".join(f"<si>{half(t)}</si>" for _, t in by[0]),
            "xl/worksheets/sheet1.xml": "".join(
                f'<c r="A{i}" t="inlineStr"><is><t>{t}</t></is></c>' for i, t in by[1])
            + "".join(f'<c r="G{i}" t="s"><v>{n}</v></c>' for n, (i, _) in enumerate(by[0])) + typed,
            "xl/comments1.xml": "".join(
                f'<comment ref="B{i}"><text><t>{t}</t><t>no</t></text></comment>' for i, t in by[2]),
            "xl/drawings/drawing1.xml": "".join(f"<a:sp><a:t>{t}</a:t></a:sp>" for _, t in by[3]),
            "xl/../evil.xml": "<t>bad</t>",
        }
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            for name, xml in parts.items():
                z.writestr(name, f'<root xmlns:a="a">{xml}</root>')
        return [(str(doc), held.getvalue())]

    return _files(docs, workbook)


SHEET = "xl/worksheets/sheet1.xml"


@query(
    "xlsx_texts",
    check_sql(
        f"""SELECT cast(doc_id AS VARCHAR) AS path, CASE unit_idx % 4
            WHEN 0 THEN 'ss_' || (row_number() OVER same - 1)
            WHEN 1 THEN 'ws_{SHEET}_cell_A' || unit_idx
            WHEN 2 THEN 'cm_xl/comments1.xml_B' || unit_idx
            ELSE 'shape_xl/drawings/drawing1.xml_' || substr(line, 1, 20) || '_' || (row_number() OVER same - 1)
          END AS id, CASE unit_idx % 4 WHEN 0 THEN 'shared_string'
            WHEN 1 THEN 'inline_string' WHEN 2 THEN 'comment' ELSE 'shape_text' END AS source_type,
          line AS text, 'text' AS category, true AS should_translate, CASE unit_idx % 4
            WHEN 0 THEN '{SHEET}!G' || unit_idx WHEN 1 THEN '{SHEET}!A' || unit_idx
            WHEN 2 THEN 'xl/comments1.xml!B' || unit_idx ELSE 'xl/drawings/drawing1.xml!sp > t' END AS locator
        FROM lines_fx WINDOW same AS (PARTITION BY doc_id, unit_idx % 4 ORDER BY unit_idx)""",
        "lines",
    ),
)
def xlsx_texts(spark, d):
    return office.xlsx_texts(_workbooks(spark, d)).select(
        "path", "id", "source_type", "text", "category", "should_translate", "locator"
    )


@query(
    "xlsx_cells",
    check_sql(
        f"""WITH c AS (SELECT cast(doc_id AS VARCHAR) AS path, unit_idx AS i,
            row_number() OVER (PARTITION BY doc_id, unit_idx % 4 ORDER BY unit_idx) - 1 AS n, line FROM lines_fx),
        typed AS (SELECT * FROM c WHERE i % 4 = 2)
        SELECT path, '{SHEET}!C' || i AS locator, CASE i % 2 WHEN 0 THEN 'number' ELSE 'date' END AS category,
          cast(i AS VARCHAR) AS value, false AS should_translate FROM typed
        UNION ALL SELECT path, '{SHEET}!D' || i, 'boolean', cast(i % 2 AS VARCHAR), false FROM typed
        UNION ALL SELECT path, '{SHEET}!E' || i, 'error', '#N/A', false FROM typed
        UNION ALL SELECT path, '{SHEET}!F' || i, 'formula', 'C' || i || '+1', false FROM typed
        UNION ALL SELECT path, '{SHEET}!A' || i, 'text', line, true FROM c WHERE i % 4 = 1
        UNION ALL SELECT path, '{SHEET}!G' || i, 'text', line, true FROM c WHERE i % 4 = 0""",
        "lines",
    ),
)
def xlsx_cells(spark, d):
    return office.xlsx_cells(_workbooks(spark, d)).select("path", "locator", "category", "value", "should_translate")


@query(
    "glossary_tables",
    check_sql("SELECT id, ru_word, en_word, sb_word, ch_word, collection_id FROM glossary_fx",
              "glossary"),
)
def glossary_tables(spark, d):
    g = fx.shared(spark, d, "glossary")
    named = {"default": "glossary", "cad": "glossary_cad", "legal": "glossary_legal"}
    return tables.glossary_from_tables(
        {t: g.filter(F.col("collection_id") == c) for c, t in named.items()}
    )


@query(
    "glossary_csv",
    check_sql("SELECT ru_word, en_word, sb_word, ch_word FROM glossary_fx", "glossary"),
)
def glossary_csv(spark, d):
    path = scratch_path(spark, "glossary")
    tables.write_glossary_csv(fx.shared(spark, d, "glossary"), path)
    return tables.read_glossary_csv(spark, path).drop("row_num")


@query(
    "journal_files",
    check_sql(
        """SELECT log_date, level, count(*) AS n FROM journal_fx
          WHERE log_date >= DATE '2024-01-10' GROUP BY ALL""",
        "journal",
    ),
)
def journal_files(spark, d):
    path = scratch_path(spark, "journal")
    tables.append_log(fx.shared(spark, d, "journal").drop("ts"), path)
    back = tables.read_log(
        spark, path,
        "event_id BIGINT, level STRING, stage STRING, message STRING, filename STRING, log_date DATE",
    )
    return back.filter("log_date >= DATE'2024-01-10'").groupBy("log_date", "level").agg(
        F.count(F.lit(1)).alias("n")
    )


def _write_days(frame, path: str, entry) -> None:
    """Documents of a day's entries, one file each, indented; the first of each day's third is cut off in the middle."""
    part = F.concat_ws("_", "log_date", F.col("event_id") % 3)
    days = frame.groupBy("log_date", part.alias("part")).agg(F.collect_list(entry).alias("entries"))
    whole = F.to_json(
        F.struct(F.col("log_date").cast("string").alias("date"), F.lit("").alias("created_at"), "entries"),
        {"pretty": "true"},
    )
    damaged = F.col("part").endswith("3_0")
    days.select(
        "part", F.when(damaged, F.substring(whole, F.lit(1), F.length(whole) - 20)).otherwise(whole).alias("value")
    ).write.partitionBy("part").text(path)


# Documents of the days ending in 3 lose their first third, which gives one error row each.
DAYS = """
    days_fx AS (SELECT *, log_date || '_' || (event_id % 3) AS part FROM {frame}),
    good_fx AS (SELECT * FROM days_fx WHERE NOT ends_with(part, '3_0')),
    bad_fx AS (SELECT DISTINCT part FROM days_fx WHERE ends_with(part, '3_0'))"""


@query(
    "journal_days",
    check_sql(
        f"""WITH {DAYS.format(frame='journal_fx')}
        SELECT cast(log_date AS VARCHAR) AS date, level, stage, message, false AS damaged, count(*) AS n FROM good_fx GROUP BY ALL
        UNION ALL SELECT substr(part, 1, 10), NULL, NULL, NULL, true, 1 FROM bad_fx""",
        "journal",
    ),
)
def journal_days(spark, d):
    path = scratch_path(spark, "days")
    _write_days(
        fx.shared(spark, d, "journal"), path,
        F.struct(F.col("ts").cast("string").alias("timestamp"), "level", "stage", "message", "filename"),
    )
    found = tables.journal_documents(spark, path, "*.txt")
    part = F.regexp_extract("file", "part=([^/]+)_", 1)
    return found.select(
        F.coalesce("date", part).alias("date"), "level", "stage", "message", F.col("error").isNotNull().alias("damaged")
    ).groupBy("date", "level", "stage", "message", "damaged").agg(F.count(F.lit(1)).alias("n"))


@query(
    "monitoring_days",
    check_sql(
        f"""WITH {DAYS.format(frame="(SELECT *, cast(ts AS DATE) AS log_date FROM monitoring_fx)")}
        SELECT cast(log_date AS VARCHAR) AS date, job_id, owner_id, filename, 'DOCX' AS format, status,
          false AS damaged, count(*) AS n FROM good_fx GROUP BY ALL
        UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, true, count(*) FROM bad_fx HAVING count(*) > 0""",
        "monitoring",
    ),
)
def monitoring_days(spark, d):
    """Documents read as a stream."""
    path = scratch_path(spark, "days")
    entry = F.struct(
        "job_id", "owner_id", "filename", F.lit("DOCX").alias("format"), "status", F.col("ts").cast("string").alias("timestamp")
    )
    _write_days(fx.shared(spark, d, "monitoring").withColumn("log_date", F.to_date("ts")), path, entry)
    found = run_available(tables.monitoring_documents(spark, path, "*.txt", streaming=True))
    return found.groupBy(
        "date", "job_id", "owner_id", "filename", "format", "status", F.col("error").isNotNull().alias("damaged")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "manifest_files",
    "SELECT s_suppkey AS file_no, length(s_name || ';' || s_nationkey) + 1 AS size, 'TXT' AS extension FROM supplier",
)
def manifest_files(spark, d):
    """One small file per supplier, listed without opening any."""
    path = scratch_path(spark, "submitted")
    line = F.concat_ws(";", "s_name", "s_nationkey")
    rows = fx.table(spark, d, "supplier").select("s_suppkey", line.alias("value"))
    # Every file is made and put in its place by its own task: neither a single task nor the driver handles them all.
    tasks = 4 * spark.sparkContext.defaultParallelism
    rows.repartition(tasks, "s_suppkey").write.partitionBy("s_suppkey").option(
        "mapreduce.fileoutputcommitter.algorithm.version", "2"
    ).text(path)
    return tables.read_manifest(spark, path).select(
        F.regexp_extract("path", r"s_suppkey=(\d+)", 1).cast("long").alias("file_no"), "size", "extension"
    )


@query(
    "corpus_report",
    check_sql(
        f"""WITH {GLUE_CTE}, {UNIT_TEXTS}, {TOKENS}, {_drift('doc_id, idx', 'at_')}
        SELECT doc_id, 'leaks' AS section, count(*) AS total FROM
          (SELECT doc_id, {q_reason('target')} AS reason FROM units_fx) WHERE reason IS NOT NULL
          GROUP BY doc_id
        UNION ALL SELECT doc_id, 'glue', count(*) FROM found GROUP BY doc_id
        UNION ALL SELECT doc_id, 'drift', count(*) FROM drift_fx GROUP BY doc_id
        UNION ALL SELECT doc_id, 'paragraphs', count(*) FROM units_fx GROUP BY doc_id""",
        "units",
    ),
)
def corpus_report(spark, d):
    u = fx.units(spark, d)
    path = scratch_path(spark, "report")
    report = S.corpus_report({
        "leaks": scan_leaks(u.select("doc_id", "target"), "target"),
        "glue": scan_glue(u.select("doc_id", "target"), "target"),
        "drift": numeric_drift(u.select("doc_id", "source", "target")),
        "paragraphs": u.select("doc_id"),
    })
    tables.write_report(report, path)
    return spark.read.schema("doc_id BIGINT, section STRING, total BIGINT").json(path)
