"""Word-processor and spreadsheet archives, read one file per row.

Archives come from Spark's ``binaryFile`` source (or any frame with path and
content) and are parsed in Arrow batches, so files spread over the cluster.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Members scanned and the size of all members above which a file is refused.
DOCUMENT_MEMBER = "word/document.xml"
MAX_XML_BYTES = 512 * 1024 * 1024
COUNTED = {"p": "paragraphs", "tbl": "tables", "tr": "rows", "t": "text_elements", "tab": "tabs"}
PROFILE_FIELDS = ("paragraphs", "tables", "rows", "media", "text_elements", "tabs")
XLSX_MEMBERS = (
    ("inline_string", re.compile(r"xl/worksheets/sheet\d+\.xml$")),
    ("comment", re.compile(r"xl/comments\d+\.xml$")),
    ("chart_text", re.compile(r"xl/charts/chart\d+\.xml$")),
    ("shape_text", re.compile(r"xl/drawings/drawing\d+\.xml$")),
)


def archives(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """path and content of the matching files."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true").load(path).select("path", "content")
    )


# What a damaged, truncated or encrypted archive or member raises.
DAMAGE = (zipfile.BadZipFile, expat.ExpatError, zlib.error, EOFError, RuntimeError, NotImplementedError, ValueError, OSError, KeyError)


def _open(content):
    """The archive, or null when it is none."""
    try:
        return zipfile.ZipFile(io.BytesIO(memoryview(content) if content else b""))
    except DAMAGE:
        return None


def _guarded(content, read):
    """(what ``read`` makes of the archive, null) or (null, what is wrong with the file)."""
    archive = _open(content)
    if archive is None:
        return None, "not an archive"
    try:
        return read(archive), None
    except DAMAGE as exc:
        return None, f"{type(exc).__name__}: {exc}"


def _parse(archive, member, start=None, end=None, text=None) -> None:
    """Stream one member through callbacks taking local element names."""
    parser = expat.ParserCreate()
    parser.buffer_text = True
    local = lambda name: name.rsplit(":", 1)[-1]
    if start:
        parser.StartElementHandler = lambda name, attrs: start(local(name), attrs)
    if end:
        parser.EndElementHandler = lambda name: end(local(name))
    if text:
        parser.CharacterDataHandler = text
    with archive.open(member) as stream:
        parser.ParseFile(stream)


class _Paragraphs:
    """Collects paragraph texts; an index counts paragraph starts."""

    def __init__(self):
        self.rows, self.index, self.parts, self.inside, self.in_text = [], -1, [], False, False

    def start(self, name, _):
        if name == "p":
            self.index, self.parts, self.inside = self.index + 1, [], True
        self.in_text = name == "t" and self.inside

    def text(self, data):
        if self.in_text:
            self.parts.append(data)

    def end(self, name):
        self.in_text = False
        if name == "p" and self.inside:
            self.rows.append((self.index, "".join(self.parts)))
            self.inside = False


# Rows that leave a task together.
ROWS_PER_BATCH = 10_000


def _archive_rows(files: DataFrame, read_one, fields: str) -> DataFrame:
    """One row per item that ``read_one`` finds in an archive; path first, error last.

    A file that cannot be read gives one row with its error. Items of many
    small files leave together, those of a large one in pieces.
    """
    names, kinds = zip(*(f.split(" ") for f in fields.split(", ")), strict=True)
    arrow = {"STRING": pa.string(), "BIGINT": pa.int64(), "BOOLEAN": pa.bool_()}
    schema = pa.schema([(n, arrow[k]) for n, k in zip(names, kinds, strict=True)])

    def leave(held):
        columns = list(zip(*held, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
        )

    def read(batches):
        held: list[tuple] = []
        for batch in batches:
            for i in range(batch.num_rows):
                path = batch.column(0)[i].as_py()
                rows, error = _guarded(batch.column(1)[i].as_buffer(), read_one)
                rows = rows if error is None else [(*[None] * (len(names) - 2), error)]
                held += [(path, *r) for r in rows]
                while len(held) >= ROWS_PER_BATCH:
                    yield leave(held[:ROWS_PER_BATCH])
                    held = held[ROWS_PER_BATCH:]
        if held:
            yield leave(held)

    return files.select("path", "content").mapInArrow(read, fields)


def docx_paragraphs(files: DataFrame) -> DataFrame:
    """Ordered paragraphs of every archive (S4): path, idx, text, error.

    A file that cannot be read - no archive, no document part, damaged or
    encrypted - gives one row with its error and nothing else.
    """

    def paragraphs(archive):
        if DOCUMENT_MEMBER not in archive.namelist():
            raise ValueError("no document part")
        found = _Paragraphs()
        _parse(archive, DOCUMENT_MEMBER, found.start, found.end, found.text)
        return [(*row, None) for row in found.rows]

    return _archive_rows(files, paragraphs, "path STRING, idx BIGINT, text STRING, error STRING")


def read_docx_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    return docx_paragraphs(archives(spark, path, "*.docx"))


def structure_profile(files: DataFrame) -> DataFrame:
    """Structural counters of every archive (A1), one row per file, and an error for unreadable ones."""

    def profile(archive):
        counts = dict.fromkeys(PROFILE_FIELDS, 0)

        def start(name, _):
            if name in COUNTED:
                counts[COUNTED[name]] += 1

        for member in archive.namelist():
            if member.startswith("word/media/") and not member.endswith("/"):
                counts["media"] += 1
            elif re.match(r"word/(?!.*_rels/).*\.xml$", member):
                _parse(archive, member, start=start)
        return [(*counts.values(), None)]

    fields = ", ".join(f"{f} BIGINT" for f in PROFILE_FIELDS)
    return _archive_rows(files, profile, f"path STRING, {fields}, error STRING")


def document_flags(files: DataFrame) -> DataFrame:
    """has_document per archive for the submission check (P34); null: not an archive."""

    def read(batches):
        for pdf in batches:
            opened = [_open(c) for c in pdf["content"]]
            yield pdf[["path"]].assign(
                has_document=[None if a is None else DOCUMENT_MEMBER in a.namelist() for a in opened]
            )

    return files.select("path", "content").mapInPandas(read, "path STRING, has_document BOOLEAN")


SHARED_STRINGS = "xl/sharedStrings.xml"
SHEET_MEMBER = XLSX_MEMBERS[0][1]
# Number formats that show dates or times.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _outside(member: str) -> bool:
    """Whether a member points outside the archive."""
    return member.startswith("/") or ".." in member.split("/")


def _members(archive):
    """Names of the members that lie within the archive, if their XML is not too large."""
    infos = archive.infolist()
    if sum(i.file_size for i in infos if i.filename.endswith(".xml")) > MAX_XML_BYTES:
        raise ValueError(f"its XML exceeds {MAX_XML_BYTES} bytes")
    return [i.filename for i in infos if not _outside(i.filename)]


def _texts(archive, member, kind):
    """(id, text, place within the member) of one spreadsheet member."""
    state = {"item": 0, "parts": [], "on": False, "ref": "", "skip": 0, "inline": False, "first": True}
    rows, way = [], []

    def start(name, attrs):
        way.append(name)
        if kind == "shared_string":
            if name == "si":
                state.update(parts=[])
            elif name == "rPh":
                state["skip"] += 1
            state["on"] = name == "t" and not state["skip"]
        elif kind == "inline_string":
            if name == "c":
                state.update(ref=attrs.get("r", ""), inline=attrs.get("t") == "inlineStr",
                             parts=[], skip=0)
            elif name == "r":
                state["skip"] += 1
            state["on"] = name == "t" and state["inline"] and not state["skip"]
        elif kind == "comment":
            if name == "comment":
                state.update(ref=attrs.get("ref", ""), parts=[], first=True)
            state["on"] = name == "t" and state["first"]
        else:
            state["on"] = name == "t"
            if state["on"]:
                state["parts"] = []

    def text(data):
        if state["on"]:
            state["parts"].append(data)

    def end(name):
        joined = "".join(state["parts"])
        if kind == "shared_string":
            if name == "rPh":
                state["skip"] -= 1
            elif name == "si":
                if joined.strip():
                    rows.append((f"ss_{state['item']}", joined, str(state["item"])))
                state["item"] += 1
        elif kind == "inline_string":
            if name == "r":
                state["skip"] -= 1
            elif name == "c" and state["inline"] and joined:
                rows.append((f"ws_{member}_cell_{state['ref']}", joined, state["ref"]))
        elif kind == "comment":
            if name == "t":
                state["first"] = False
            elif name == "comment" and joined:
                rows.append((f"cm_{member}_{state['ref']}", joined, state["ref"]))
        elif name == "t" and joined.strip():
            prefix = "chart" if kind == "chart_text" else "shape"
            # The way from below the root down to the text.
            rows.append((f"{prefix}_{member}_{joined[:20]}_{len(rows)}", joined, " > ".join(way[1:])))
        way.pop()
        state["on"] = False

    _parse(archive, member, start, end, text)
    return rows


def _cells(archive, member):
    """(reference, type, style, formula, value) of the cells of one sheet."""
    state = {"cell": None, "part": None}
    rows = []

    def start(name, attrs):
        if name == "c":
            state["cell"] = {"r": attrs.get("r", ""), "t": attrs.get("t", "n"), "s": attrs.get("s", "0"), "f": None, "v": None}
        elif state["cell"] is not None and name in ("f", "v", "t"):
            state["part"] = "f" if name == "f" else "v"
            if state["cell"][state["part"]] is None:
                state["cell"][state["part"]] = ""

    def text(data):
        if state["cell"] is not None and state["part"]:
            state["cell"][state["part"]] += data

    def end(name):
        state["part"] = None
        if name == "c" and state["cell"] is not None:
            rows.append(tuple(state["cell"].values()))
            state["cell"] = None

    _parse(archive, member, start, end, text)
    return rows


def _first_uses(archive, members) -> dict[str, str]:
    """The first cell that shows each shared string: item number -> member!reference."""
    uses: dict[str, str] = {}
    for member in members:
        if SHEET_MEMBER.match(member):
            try:
                for ref, kind, _, _, value in _cells(archive, member):
                    if kind == "s" and value:
                        uses.setdefault(value, f"{member}!{ref}")
            except DAMAGE:
                continue  # its texts are reported with the error of the member
    return uses


def _date_styles(archive, members) -> set[str]:
    """Style numbers whose number format shows a date or a time."""
    if "xl/styles.xml" not in members:
        return set()
    own, styles, inside = {}, [], [False]

    def start(name, attrs):
        if name == "numFmt":
            own[attrs.get("numFmtId")] = attrs.get("formatCode", "")
        elif name == "cellXfs":
            inside[0] = True
        elif name == "xf" and inside[0]:
            styles.append(attrs.get("numFmtId", "0"))

    def end(name):
        if name == "cellXfs":
            inside[0] = False

    _parse(archive, "xl/styles.xml", start, end)

    def dated(number: str) -> bool:
        shown = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", own.get(number, ""))
        return (number.isdigit() and int(number) in DATE_FORMATS) or bool(re.search("[dmyhs]", shown, re.I))

    return {str(i) for i, number in enumerate(styles) if dated(number)}


def _sheet_rows(archive):
    """(member, locator, category, value, should_translate, error) of the cells with a value."""
    members = _members(archive)
    dates = _date_styles(archive, members)
    shared = {}
    if SHARED_STRINGS in members:
        shared = {place: text for _, text, place in _texts(archive, SHARED_STRINGS, "shared_string")}
    out = []
    for member in members:
        if not SHEET_MEMBER.match(member):
            continue
        try:
            for ref, kind, style, formula, value in _cells(archive, member):
                if formula:
                    category, value = "formula", formula
                elif kind == "s":
                    category, value = "text", shared.get(value or "")
                elif kind in ("inlineStr", "str"):
                    category = "text"
                else:
                    named = {"b": "boolean", "e": "error", "d": "date"}
                    category = named.get(kind) or ("date" if style in dates else "number")
                if value:
                    out.append((member, f"{member}!{ref}", category, value, category == "text", None))
        except DAMAGE as exc:
            out.append((member, None, None, None, None, f"{type(exc).__name__}: {exc}"))
    return out


def xlsx_texts(files: DataFrame) -> DataFrame:
    """Text-bearing content of spreadsheets (S6): path, member, id, text, source_type, category,
    should_translate, locator, error.

    Shared and inline strings, comments, chart and shape text, all of category
    ``text`` and to be translated. The locator is the place a reader sees: the
    first cell that shows a shared string (its number where no cell does), the
    cell of an inline string or comment, the way of elements to a chart or
    shape text. Members that point outside the archive are skipped. A file
    whose XML members together exceed the size limit, or that cannot be
    opened, gives one row with its error; so does a member that cannot be
    read, beside the rows of the others. Ids hold a running number where texts
    of a member may be equal.
    """

    def texts(archive):
        members = _members(archive)
        uses = _first_uses(archive, members) if SHARED_STRINGS in members else {}
        out = []
        for member in members:
            kinds = [k for k, pattern in XLSX_MEMBERS if pattern.match(member)]
            if member == SHARED_STRINGS:
                kinds = ["shared_string"]
            for kind in kinds:
                try:
                    for number, text, place in _texts(archive, member, kind):
                        locator = f"{member}!{place}"
                        if kind == "shared_string":
                            locator = uses.get(place, locator)
                        out.append((member, number, text, kind, "text", True, locator, None))
                except DAMAGE as exc:
                    out.append((member, None, None, kind, None, None, None, f"{type(exc).__name__}: {exc}"))
        return out

    return _archive_rows(
        files, texts,
        "path STRING, member STRING, id STRING, text STRING, source_type STRING, category STRING, "
        "should_translate BOOLEAN, locator STRING, error STRING",
    )


def xlsx_cells(files: DataFrame) -> DataFrame:
    """Cells that hold a value (S6): path, member, locator, category, value, should_translate, error.

    The category follows the workbook's references: shared and inline strings
    are ``text``, the only ones to translate; a cell with a formula is a
    ``formula`` and its value the formula; ``boolean`` and ``error`` are typed
    as such; numbers are a ``date`` where the cell's style shows one, else a
    ``number``. Unreadable files and sheets as in :func:`xlsx_texts`.
    """
    return _archive_rows(
        files, _sheet_rows,
        "path STRING, member STRING, locator STRING, category STRING, value STRING, should_translate BOOLEAN, error STRING",
    )


def read_xlsx_texts(spark: SparkSession, path: str) -> DataFrame:
    return xlsx_texts(archives(spark, path, "*.xlsx"))
