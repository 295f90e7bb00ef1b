"""Readers and writers over small files."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from bitextra.operators.joblog import validate_manifest
from bitextra.sources import office, tables
from bitextra.sources.pagetext import page_lines, read_page_text
from bitextra.sources.xliff import read_xliff


def test_page_text(spark, tmp_path):
    words = [{"text": "b", "block": 1, "line": 0}, {"text": "a", "block": 0, "line": 2},
             {"text": "c", "block": 1, "line": 0}, {"text": "d"}]
    records = [json.dumps({"page": 1, "pdf": "x", "text": "t", "words": words}), "", "{broken",
               json.dumps({"page": 2, "pdf": "x", "text": "one\ntwo", "words": []})]
    (tmp_path / "p.jsonl").write_text("\n".join(records))
    rows = page_lines(read_page_text(spark, str(tmp_path))).orderBy("page", "pos").collect()
    assert [(r.page, r.block, r.line, r.text) for r in rows] == [
        (1, 1, 0, "b c"), (1, 0, 2, "a"), (1, 0, 0, "d"), (2, None, None, "one"), (2, None, None, "two")
    ]


def test_xliff(spark, tmp_path):
    (tmp_path / "a.xlf").write_text(
        """<?xml version="1.0"?><xliff xmlns="urn:x"><file><body>
<trans-unit id="p1"><source>a &lt;b&gt; c &amp; d</source><target/></trans-unit>
<trans-unit id='p2' translate="no"><source>x <g id="1">y</g> <ph id="2">&lt;br/&gt;</ph>z
 &amp;amp; w</source></trans-unit>
<trans-unit id="p3"><target>q</target></trans-unit>
<trans-unit><source>no id</source></trans-unit>
<trans-unit id="p4"><source/><target>&lt;run1&gt;T&lt;/run1&gt;</target></trans-unit>
</body></file></xliff>""")
    got = {r.unit_id: (r.source, r.target, r.translate) for r in read_xliff(spark, str(tmp_path)).collect()}
    assert got == {
        "p1": ("a <b> c & d", "", True),
        "p2": ("x y z & w", None, False),
        "p4": ("", "T", True),
    }


def archive(path, members):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for name, xml in members.items():
            z.writestr(name, xml)
    path.write_bytes(held.getvalue())


def test_docx(spark, tmp_path):
    body = ('<w:document xmlns:w="w"><w:p><w:r><w:t>One &amp; </w:t><w:t>two</w:t></w:r></w:p><w:p/>'
            "<w:tbl><w:tr><w:p><w:r><w:tab/><w:t>cell</w:t></w:r></w:p></w:tr></w:tbl></w:document>")
    archive(tmp_path / "a.docx", {"word/document.xml": body, "word/media/i.png": "x",
                                  "word/_rels/d.xml.rels": "<p/>", "word/header1.xml": "<w:p xmlns:w='w'/>"})
    archive(tmp_path / "b.docx", {"other.xml": "<a/>"})
    (tmp_path / "c.docx").write_text("not an archive")
    every = office.read_docx_paragraphs(spark, str(tmp_path)).orderBy("idx").collect()
    rows = [r for r in every if r.error is None]
    assert [(r.idx, r.text) for r in rows] == [(0, "One & two"), (1, ""), (2, "cell")]
    assert {r.path[-6]: r.error for r in every if r.error} == {
        "b": "ValueError: no document part", "c": "not an archive"}
    files = office.archives(spark, str(tmp_path), "*.docx")
    prof = office.structure_profile(files).filter("path LIKE '%a.docx'").first()
    assert (prof.paragraphs, prof.tables, prof.rows, prof.media, prof.text_elements, prof.tabs) == (
        4, 1, 1, 1, 3, 1)
    flags = office.document_flags(files).select(
        F.col("path").alias("filename"), "has_document", F.lit(5).alias("size"),
        F.lit("ru").alias("source_language"), F.lit("en").alias("target_language"),
    )
    codes = {r.filename[-6]: r.error_code for r in validate_manifest(flags).collect()}
    assert codes == {"a": None, "b": "STRUCTURE_INVALID", "c": "STRUCTURE_BAD_ZIP"}


def test_xlsx(spark, tmp_path):
    archive(tmp_path / "a.xlsx", {
        "xl/sharedStrings.xml": "<sst><si><t>plain</t></si><si><r><t>ri</t></r><r><t>ch</t></r>"
                                "<rPh><t>no</t></rPh></si><si><t> </t></si><si><t>last</t></si></sst>",
        "xl/worksheets/sheet1.xml": '<s><c r="A1" t="inlineStr"><is><t>in</t></is></c>'
                                    '<c r="A2" t="s"><v>0</v></c></s>',
        "xl/comments1.xml": '<c><comment ref="B2"><text><r><t>note</t></r><r><t>x</t></r></text></comment></c>',
        "xl/charts/chart1.xml": '<c xmlns:a="a"><a:t>title</a:t></c>',
        "xl/drawings/drawing1.xml": '<c xmlns:a="a"><a:t>shape</a:t><a:t> </a:t></c>',
        "../xl/comments2.xml": '<c><comment ref="Z"><text><t>bad</t></text></comment></c>',
    })
    rows = office.read_xlsx_texts(spark, str(tmp_path)).collect()
    assert {(r.id, r.text) for r in rows} == {
        ("ss_0", "plain"), ("ss_1", "rich"), ("ss_3", "last"),
        ("ws_xl/worksheets/sheet1.xml_cell_A1", "in"), ("cm_xl/comments1.xml_B2", "note"),
        ("chart_xl/charts/chart1.xml_title_0", "title"),
        ("shape_xl/drawings/drawing1.xml_shape_0", "shape"),
    }


def test_xlsx_bad_members(spark, tmp_path, monkeypatch):
    long = "the same twenty letters and "
    archive(tmp_path / "a.xlsx", {
        "xl/sharedStrings.xml": "<sst><si><t>kept</t></si></sst>", "xl/comments1.xml": "<c><comment>",
        "xl/drawings/drawing1.xml": f"<c><t>{long}one</t><t>{long}two</t></c>"})
    (tmp_path / "b.xlsx").write_text("no archive")
    rows = office.read_xlsx_texts(spark, str(tmp_path)).collect()
    good = [r for r in rows if r.error is None]
    assert len({r.id for r in good}) == len(good) == 3
    assert {(r.path[-6], r.member) for r in rows if r.error} == {("a", "xl/comments1.xml"), ("b", None)}


def test_xliff_references(spark, tmp_path):
    (tmp_path / "a.xliff").write_text(
        "<xliff><!-- <trans-unit id='0'><source>hidden</source></trans-unit> -->"
        "<trans-unit id='1'><source>&#1046;&#x2013;&amp;#x41; <![CDATA[<b> & c]]><!-- no --></source></trans-unit>"
        "<trans-unit id='2'><source>a&#x1F600;&#xD800;</source></trans-unit></xliff>", encoding="utf-8")
    rows = read_xliff(spark, str(tmp_path)).orderBy("unit_id").collect()
    assert [(r.unit_id, r.source) for r in rows] == [("1", "Ж–A <b> & c"), ("2", "a😀&#xD800;")]


def test_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from bitextra.session import shared_root

    class Session:
        conf = SimpleNamespace(get=lambda *_: None)
        sparkContext = SimpleNamespace(
            getConf=lambda: SimpleNamespace(get=lambda *_: None), getCheckpointDir=lambda: None,
            master="spark://host:7077")

    with pytest.raises(ValueError, match="checkpoint"):
        shared_root(Session)


def test_glossary_csv(spark, tmp_path):
    path = tmp_path / "g.csv"
    path.write_text("ru_word,en_word,sb_word,ch_word,more\nа,a,\"b, c\",词,1\nб,,c,\n", encoding="utf-8-sig")
    rows = tables.read_glossary_csv(spark, str(path)).orderBy("row_num").collect()
    assert [tuple(r) for r in rows] == [(2, "а", "a", "b, c", "词"), (3, "б", "", "c", "")]
    path.write_text('ru_word,en_word,sb_word,ch_word\n"а\nб",a,"b ""q""",\nв,c,,\n', encoding="utf-8")
    rows = tables.read_glossary_csv(spark, str(path)).orderBy("row_num").collect()
    assert [tuple(r) for r in rows] == [(2, "а\nб", "a", 'b "q"', ""), (3, "в", "c", "", "")]
    path.write_text("ru_word,en_word\nа,a\n")
    with pytest.raises(ValueError):
        tables.read_glossary_csv(spark, str(path))


def test_glossary_tables(spark):
    row = lambda i: spark.createDataFrame(  # noqa: E731 - one-row frames
        [(i, "r", "e", "s", "c")], "id INT, ru_word STRING, en_word STRING, sb_word STRING, ch_word STRING")
    all_ = tables.glossary_from_tables({"glossary": row(1), "glossary_cad": row(2)})
    assert {(r.id, r.collection_id) for r in all_.collect()} == {(1, "default"), (2, "cad")}
    assert tables.collection_entries(all_, "cad").first()["id"] == 2
    assert tables.collection_entries(all_, "unknown").first()["id"] == 1


def test_day_documents(spark, tmp_path):
    entry = {"timestamp": "2026-01-02T00:00:00Z", "level": "ERROR", "stage": "save", "message": "m",
             "filename": "f", "details": {"a": "1"}}
    (tmp_path / "journal_2026-01-02.json").write_text(
        json.dumps({"date": "2026-01-02", "created_at": "", "entries": [entry, entry]}, indent=1))
    (tmp_path / "journal_2026-01-03.json").write_text("{oops")
    rows = tables.read_journal(spark, str(tmp_path)).collect()
    assert len(rows) == 2 and rows[0].level == "ERROR" and rows[0].details == {"a": "1"}


def test_manifest(spark, tmp_path):
    (tmp_path / "a.DOCX").write_text("12345")
    (tmp_path / "plain").write_text("1")
    got = {(r["size"], r.extension) for r in tables.read_manifest(spark, str(tmp_path)).collect()}
    assert got == {(5, "DOCX"), (1, "")}


def test_diagnostics_are_appended_once(spark, tmp_path):
    path, schema = str(tmp_path / "diagnostics"), "job_id string, batch long, attempt long, unit_idx long, preview string"
    first = spark.createDataFrame([("a", 1, 1, 0, "x"), ("a", 1, 1, 1, "y"), (None, 1, 1, 0, "z"), ("a", 1, 1, 0, "x")], schema)
    later = spark.createDataFrame([("a", 1, 1, 0, "x"), ("a", 1, 2, 0, "x"), (None, 1, 1, 0, "z")], schema)
    for rows, name in ((first, "1"), (first, "1"), (later, "2"), (first, "3"), (later, "2")):
        tables.append_diagnostics(rows, path, name)
    got = sorted(map(repr, map(tuple, tables.read_diagnostics(spark, path, first.schema).collect())))
    assert got == sorted(map(repr, [("a", 1, 1, 0, "x", "1"), ("a", 1, 1, 1, "y", "1"), (None, 1, 1, 0, "z", "1"), ("a", 1, 2, 0, "x", "2")]))


def test_workbook_references(spark):
    import io
    import zipfile

    parts = {
        "xl/styles.xml": '<s><cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><numFmts><numFmt numFmtId="170" formatCode="[Red]0&quot;days&quot;"/>'
        '<numFmt numFmtId="171" formatCode="[$-409]d\\-mmm"/></numFmts>'
        '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></s>',
        "xl/sharedStrings.xml": "<sst><si><t>unused</t></si><si><t>used</t></si></sst>",
        "xl/worksheets/sheet1.xml": '<w><row><c r="A1" t="s"><v>1</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" s="1"><v>45000</v></c>'
        '<c r="D1" s="2"><v>5</v></c><c r="E1" s="3"><v>6</v></c><c r="F1" t="str"><f>A1&amp;"x"</f><v>usedx</v></c><c r="G1"/>'
        '<c r="H1" t="inlineStr"><is><t>in</t></is></c><c r="I1" t="s"><v>99</v></c></row></w>',
        "xl/worksheets/sheet2.xml": "<w><c r='A1'>",
        "xl/charts/chart1.xml": "<c><title><tx><t>Chart</t></tx></title></c>",
    }
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for name, xml in parts.items():
            z.writestr(name, xml)
    files = spark.createDataFrame([("f", bytearray(held.getvalue())), ("bad", bytearray(b"no")), ("none", None)], "path string, content binary")
    cells = {(r.locator, r.category, r.value, r.should_translate) for r in office.xlsx_cells(files).filter("error is null").collect()}
    at = "xl/worksheets/sheet1.xml!"
    assert cells == {
        (at + "A1", "text", "used", True), (at + "B1", "text", "used", True), (at + "C1", "date", "45000", False),
        (at + "D1", "number", "5", False), (at + "E1", "date", "6", False), (at + "F1", "formula", 'A1&"x"', False),
        (at + "H1", "text", "in", True),
    }
    assert office.xlsx_cells(files).filter("error is not null").count() == 3
    texts = {(r.text, r.locator) for r in office.xlsx_texts(files).filter("error is null").collect()}
    assert texts == {("unused", "xl/sharedStrings.xml!0"), ("used", at + "A1"), ("in", at + "H1"), ("Chart", "xl/charts/chart1.xml!title > tx > t")}


def test_steps_are_dropped(spark):
    from bitextra import session

    session.drop_steps(spark)
    step = session.cut_lineage(spark.range(5))
    assert step.count() == 5
    unused = session.scratch_path(spark, "never-written")
    assert unused and session.drop_steps(spark) == 1 and session.drop_steps(spark) == 0
