"""Numeric and reference tokens as array expressions (Column -> Column).

Everything stays inside one row, so verifying or repairing a unit never
shuffles. Tokens are taken per text handed in: a designation that spans two
paragraphs is not joined across them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bitextra.functions.text import interleave, let, runs

# Designation marks, unit names that turn a dotted number into a
# value, the shape of a date and the placeholder spelling.
REFERENCE_MARK = r"(?:№|No\.?|No)\s*"
UNIT_NAMES = (
    r"кПа|МПа|Па|MPa|kPa|кВт|kW|Вт|В|А|мм рт\.? ст\.?|\d+|%|°[CС]?|[мсдк]м|см|мм|км|м/с|т|кг|г|мг"
    r"|м\^?3|м\^?2|л|мл|с|ч|мин"
)
DATE_SHAPE = r"^\d{1,2}[./-]\d{1,2}[./-]\d{2,4}$"
PLACEHOLDER_OPEN, PLACEHOLDER_CLOSE = "⟦NUM", "⟧"

# Control characters set around a match and between its groups.
MATCH_EDGE, GROUP_EDGE = "\x01", "\x02"

_REF = rf"{REFERENCE_MARK}\d+(?:\.\d+)*\b"
_DOTTED = r"\d+(?:\.\d+)+(?:-\d+(?:\.\d+)*)*\b"
_BARE = r"(?<!\d)\d{2,}(?!\d)"
# The lookaheads only name the characters a match can begin with: elsewhere nothing is tried.
REF_PATTERN = rf"(?iuU)(?=[№N]){_REF}"
# groups: 1 designation mark, 2 dotted number, 3 unit that follows, 4 bare digits
SCAN_PATTERN = (
    rf"(?iuU)(?=[№N\d])(?:({REFERENCE_MARK})?\b({_DOTTED})(?:(?=(\s*(?:{UNIT_NAMES})\b))|)|{_REF}|"
    rf"(?<!\d)(\d{{2,}})(?!\d))"
)
SPAN_PATTERN = rf"(?iuU)(?=[№N\d])(?:{_REF}|\b{_DOTTED}|{_BARE})"
PLACEHOLDER_PATTERN = rf"{PLACEHOLDER_OPEN}(\d+){PLACEHOLDER_CLOSE}"

TOKEN_TYPE = "array<struct<kind:string,raw:string,value:string>>"
DRIFT_TYPE = "array<struct<kind:string,source:string,target:string,rank:int>>"


def _token(kind, raw, value) -> Column:
    return F.struct(kind.alias("kind"), raw.alias("raw"), value.alias("value"))


def _date_value(raw: Column) -> Column:
    return F.array_join(
        F.transform(
            F.split(raw, "[./-]"), lambda p: F.when(F.length(p) == 1, F.lpad(p, 2, "0")).otherwise(p)
        ),
        "-",
    )


def scan_groups(t: Column) -> Column:
    """Every match of the scan as struct(whole, mark, dotted, unit, bare).

    One pass sets the groups of each match between control characters and cuts
    them apart; a text that holds such a character has one pass per group.
    """
    names = ("whole", "mark", "dotted", "unit", "bare")
    groups = GROUP_EDGE.join(f"${i}" for i in range(5))
    pieces = F.split(F.regexp_replace(t, SCAN_PATTERN, MATCH_EDGE + groups + MATCH_EDGE), MATCH_EDGE, -1)
    cut = F.transform(F.filter(pieces, lambda _, i: i % 2 == 1), lambda m: F.split(m, GROUP_EDGE, -1))
    one_pass = F.transform(
        cut, lambda g: F.struct(*[F.get(g, F.lit(i)).alias(n) for i, n in enumerate(names)])
    )
    each = [F.regexp_extract_all(t, F.lit(SCAN_PATTERN), F.lit(i)).alias(n) for i, n in enumerate(names)]
    return F.when(t.contains(MATCH_EDGE) | t.contains(GROUP_EDGE), F.arrays_zip(*each)).otherwise(one_pass)


def _scan_kind(m: Column) -> Column:
    """Class of one scan match; null for references, which have their own scan."""
    return (
        F.when(m["bare"] != "", F.lit("num"))
        .when(m["dotted"] == "", F.lit(None).cast("string"))
        .when((m["mark"] != "") & ~m["dotted"].contains("-"), F.lit(None).cast("string"))
        .when(m["dotted"].rlike(DATE_SHAPE), F.lit("date"))
        .when(m["unit"] != "", F.lit("num"))
        .otherwise(F.lit("sub"))
    )


def numeric_tokens(c: Column) -> Column:
    """array<struct<kind, raw, value>> of ref, sub, num and date tokens.

    References come first, then the other kinds in text order. References
    compare by their digits only, dates are normalized to padded parts and
    never verified.
    """
    refs = F.transform(
        F.regexp_extract_all(c, F.lit(REF_PATTERN), F.lit(0)),
        lambda r: _token(F.lit("ref"), r, F.regexp_replace(r, r"(?U)\D", "")),
    )

    def other(m):
        kind = _scan_kind(m)
        raw = F.when(m["bare"] != "", m["bare"]).otherwise(m["dotted"])
        value = F.when(kind == "date", _date_value(raw)).otherwise(raw)
        return _token(kind, raw, value)

    rest = F.filter(F.transform(scan_groups(c), other), lambda x: x["kind"].isNotNull())
    empty = F.array().cast(TOKEN_TYPE)
    return F.when(c.rlike(r"\p{Nd}"), F.concat(refs, rest).cast(TOKEN_TYPE)).otherwise(empty)


def of_kind(tokens: Column, kind: str) -> Column:
    return F.filter(tokens, lambda x: x["kind"] == kind)


def values_of(tokens: Column, kind: str) -> Column:
    return F.transform(of_kind(tokens, kind), lambda x: x["value"])


def multiset_minus(left: Column, right: Column) -> Column:
    """Values of ``left`` not covered by ``right``: first-seen order, copies adjacent.

    Both sides are sorted together once; within the run of a value the copies
    of ``left`` beyond the number of those of ``right`` are left over.
    """
    def side(values: Column, number: int) -> Column:
        return F.transform(values, lambda v, i: F.struct(v.alias("v"), F.lit(number).alias("s"), i.alias("i")))

    def left_over(run: Column) -> Column:
        def copies(mine: Column) -> Column:
            covered = F.size(run) - mine
            numbers = F.when(mine > covered, F.sequence(covered + 1, mine)).otherwise(F.array().cast("array<int>"))
            first = F.get(run, F.lit(0))
            return F.transform(
                numbers, lambda n: F.struct(first["i"].alias("p"), n.alias("copy"), first["v"].alias("v"))
            )

        return let(F.size(F.filter(run, lambda x: x["s"] == 0)), copies)

    both = F.sort_array(F.concat(side(left, 0), side(right, 1)))
    rest = F.flatten(F.transform(runs(both, lambda x, y: x["v"] == y["v"]), left_over))
    return F.transform(F.sort_array(rest), lambda x: x["v"])


def drift_of(source_tokens: Column, target_tokens: Column) -> Column:
    """array<struct<kind, source, target, rank>>: lost values paired with extra ones.

    The i-th value lost from the source is paired with the i-th value the
    target holds in excess, or with an empty string (J9).
    """

    def pairs(kind: str, tokens: Column) -> Column:
        def joined(both: Column) -> Column:
            s, t = both["s"], both["t"]
            paired = let(
                multiset_minus(t, s),
                lambda extra: F.transform(
                    multiset_minus(s, t),
                    lambda v, i: F.struct(
                        F.lit(kind).alias("kind"),
                        v.alias("source"),
                        F.coalesce(F.get(extra, i), F.lit("")).alias("target"),
                        (i + 1).alias("rank"),
                    ),
                ),
            )
            return F.when(s != t, paired.cast(DRIFT_TYPE)).otherwise(F.array().cast(DRIFT_TYPE))

        both = F.struct(
            values_of(tokens["s"], kind).alias("s"), values_of(tokens["t"], kind).alias("t")
        )
        return let(both, joined)

    # Tokens are taken once for all kinds, also where they are not yet a column.
    return let(
        F.struct(source_tokens.alias("s"), target_tokens.alias("t")),
        lambda tokens: F.concat(*[pairs(kind, tokens) for kind in ("ref", "sub", "num")]),
    ).cast(DRIFT_TYPE)


def protect(c: Column) -> Column:
    """Replace numeric spans by placeholders ⟦NUM0⟧, ⟦NUM1⟧ …."""
    tokens = F.regexp_extract_all(c, F.lit(SPAN_PATTERN), F.lit(0))
    marks = F.transform(
        tokens,
        lambda _, i: F.concat(F.lit(PLACEHOLDER_OPEN), i.cast("string"), F.lit(PLACEHOLDER_CLOSE)),
    )
    return F.when(c.rlike(r"\p{Nd}"), interleave(F.split(c, SPAN_PATTERN, -1), marks)).otherwise(c)


def registry(c: Column) -> Column:
    """The spellings behind the placeholders, in placeholder order."""
    return F.regexp_extract_all(c, F.lit(SPAN_PATTERN), F.lit(0))


def restore(c: Column, spellings: Column) -> Column:
    """Put the spellings back; an index out of range stays as it is."""
    marks = F.regexp_extract_all(c, F.lit(PLACEHOLDER_PATTERN), F.lit(1))
    back = F.transform(
        marks,
        lambda m: F.coalesce(
            F.get(spellings, m.try_cast("int")),
            F.concat(F.lit(PLACEHOLDER_OPEN), m, F.lit(PLACEHOLDER_CLOSE)),
        ),
    )
    return F.when(
        c.contains(PLACEHOLDER_OPEN), interleave(F.split(c, PLACEHOLDER_PATTERN, -1), back)
    ).otherwise(c)


def _swap_first(matches: Column, hit: Column, gaps: Column, build) -> Column:
    """The text with its ``hit``-th match (1-based) rebuilt; null when there is none."""
    pieces = F.transform(
        matches, lambda m, i: F.when(i + 1 == hit, build(m)).otherwise(m["whole"])
    )
    return F.when(hit > 0, interleave(gaps, pieces))


def repair(target: Column, drift: Column, source_tokens: Column) -> Column:
    """struct<text, unresolved>: put source spellings back over drifted values.

    Only ref and sub values are repaired, each at its first occurrence; bare
    numbers and values that cannot be found count as unresolved.
    """
    mark = r"^(?:№|No\.?)\s*"

    def step(acc, mm):
        text = acc["text"]
        spelling = F.get(
            F.filter(
                source_tokens, lambda t: (t["kind"] == mm["kind"]) & (t["value"] == mm["source"])
            ),
            F.lit(0),
        )["raw"]
        refs = F.transform(
            F.regexp_extract_all(text, F.lit(REF_PATTERN), F.lit(0)),
            lambda r: F.struct(r.alias("whole"), F.regexp_replace(r, r"(?U)\D", "").alias("value")),
        )

        def with_mark(m):
            lead = F.regexp_extract(m["whole"], f"({mark})", 1)
            return F.concat(F.when(spelling.rlike(mark), F.lit("")).otherwise(lead), spelling)

        def in_refs(hits):
            at = F.array_position(F.transform(hits, lambda r: r["value"]), mm["target"])
            gaps = F.split(text, REF_PATTERN, -1)
            return let(at, lambda p: _swap_first(hits, p, gaps, with_mark))

        def in_scans(hits):
            subs = F.transform(
                hits, lambda m: F.when(_scan_kind(m) == "sub", m["dotted"]).otherwise(F.lit(""))
            )
            gaps = F.split(text, SCAN_PATTERN, -1)
            return let(
                F.array_position(subs, mm["target"]),
                lambda p: _swap_first(
                    hits, p, gaps, lambda m: F.concat(m["mark"], spelling)
                ),
            )

        paired = mm["target"] != ""
        fixed = F.when((mm["kind"] == "ref") & paired, let(refs, in_refs)).when(
            (mm["kind"] == "sub") & paired, let(scan_groups(text), in_scans)
        )
        return let(
            fixed,
            lambda new: F.struct(
                F.coalesce(new, text).alias("text"),
                (acc["unresolved"] + F.when(new.isNull(), F.lit(1)).otherwise(F.lit(0)))
                .alias("unresolved"),
            ),
        )

    start = F.struct(target.alias("text"), F.lit(0).alias("unresolved"))
    return F.when(F.size(drift) > 0, F.aggregate(drift, start, step)).otherwise(start)
