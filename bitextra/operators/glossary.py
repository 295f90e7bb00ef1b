"""Glossary matching, substitution, hints and import."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitextra.functions.text import COLUMN_LANGUAGE, language_mismatch, norm_ws, strip
from bitextra.operators.components import connected_components
from bitextra.operators.containment import containing, edit_contained, fits_broadcast, with_contained
from bitextra.operators.ranking import salted_lookup
from bitextra.session import cut_lineage

UNIT = ["doc_id", "unit_idx"]
WORD = r"(?U)\w+"


def match_terms(units: DataFrame, terms: DataFrame, text: str = "source") -> DataFrame:
    """Glossary terms contained in each unit, ignoring case.

    ``terms`` holds id, term, replacement. Returns doc_id, unit_idx and the
    term columns.
    """
    low = units.select(*UNIT, F.lower(text).alias("_text"))
    needles = terms.withColumn("_needle", F.lower("term"))
    return containing(low, needles, UNIT, "_text", "_needle").drop("_needle")


def _per_unit(matches: DataFrame) -> DataFrame:
    """The matches of a unit as one array in glossary order; bounded by the unit's own text."""
    return matches.groupBy(*UNIT).agg(
        F.array_sort(F.collect_list(F.struct("id", "term", "replacement"))).alias("_terms")
    )


def _replaced(row: dict, terms: list[dict]) -> tuple[str | None, int]:
    """The text with the first place of each term replaced, and how many were."""
    value, low, n = row["_value"], row["_text"], 0
    for t in terms:
        at = low.find(t["_needle"])
        if at >= 0:
            end = at + len(t["_needle"])
            value = value[:at] + t["replacement"] + value[end:]
            low = low[:at] + t["_new"] + low[end:]
            n += 1
    return value, n


def _folded(found: DataFrame) -> DataFrame:
    """The same edits as a fold over the terms of each text."""
    start = F.struct(
        F.col("_value").alias("text"), F.col("_text").alias("low"), F.lit(0).cast("long").alias("n")
    )

    def put(acc, t, at):
        def spliced(value, new):
            after = F.substring(value, at + F.length(t["_needle"]), F.length(value))
            return F.concat(F.substring(value, F.lit(1), at - 1), new, after)

        return F.when(
            at > 0,
            F.struct(
                spliced(acc["text"], t["replacement"]).alias("text"),
                spliced(acc["low"], t["_new"]).alias("low"),
                (acc["n"] + 1).alias("n"),
            ),
        ).otherwise(acc)

    def step(acc, t):
        # The place is found once and used throughout the edit.
        at = F.call_function("locate", t["_needle"], acc["low"])
        return F.get(F.transform(F.array(at), lambda x: put(acc, t, x)), F.lit(0))

    done = found.withColumn("_done", F.aggregate("_terms", start, step))
    return done.withColumn("modified", F.col("_done.text")).withColumn("applied", F.col("_done.n"))


def apply_glossary(units: DataFrame, terms: DataFrame, text: str = "source") -> DataFrame:
    """Replace the first occurrence of every matched term.

    Terms are matched on the original text and applied in id order to the
    running text. Adds ``applied`` (number of replacements) and ``modified``.
    Each edit depends on the one before: they are made within the pass that
    finds the terms or, for lists of terms that are no single automaton, as a
    fold over the terms gathered for one text.
    """
    usable = terms.select("id", "term", "replacement").filter(
        (F.length("term") > 0) & (F.length("replacement") > 0)
    )
    needles = usable.select("id", "term", "replacement", F.lower("term").alias("_needle"), F.lower("replacement").alias("_new"))
    low = units.withColumn("_value", F.col(text)).withColumn("_text", F.lower(text))
    # Only what the edits read goes through the pass, and the unit's own columns beside it.
    rest = F.struct(*units.columns).alias("_unit")
    fields = [T.StructField("modified", T.StringType()), T.StructField("applied", T.LongType())]
    edited = edit_contained(
        low.select(rest, "_value", "_text"), needles, "_text", "_needle", ["_value", "_text"], _replaced, fields
    )
    if edited is not None:
        return edited.select("_unit.*", "modified", "applied")
    found = with_contained(low, needles, UNIT, "_text", "_needle", "_terms")
    return _folded(found).drop("_done", "_terms", "_text", "_value")


def _words(c):
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0)))


def _word_candidates(vocab: DataFrame, terms: DataFrame) -> DataFrame:
    """Terms all of whose words occur in a unit's word set (vocab: ids, words).

    The join key is the term's longest word. A small glossary - measured - is
    broadcast, otherwise ids and words are shuffled.
    """
    longest = F.array_max(F.transform("_tw", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    keyed = terms.withColumn("_tw", _words("term")).filter(F.size("_tw") > 0)
    keyed = keyed.withColumn("_word", longest["w"])
    exploded = vocab.select(*UNIT, "_words", F.explode("_words").alias("_word"))
    if fits_broadcast(terms):
        pairs = exploded.join(F.broadcast(keyed), "_word")
    else:
        pairs = salted_lookup(exploded, keyed, ["_word"], UNIT, "inner")
    return (
        pairs.filter(F.size(F.array_except("_tw", "_words")) == 0)
        .select(*UNIT, "id", "term", "replacement")
    )


def substitute_terms(units: DataFrame, terms: DataFrame, text: str = "source") -> DataFrame:
    """Replace all whole-word occurrences of every term, in id order.

    A later term may match inside an earlier replacement. Candidates are
    therefore taken from the words of the text and, round by round, of the
    replacements already chosen, until none is added; where no replacement
    holds a term word one round is enough. Terms start and end with a word
    character.
    """
    usable = terms.filter((F.length("term") > 0) & (F.length("replacement") > 0))
    vocab = units.select(*UNIT, _words(text).alias("_words"))
    found = _word_candidates(vocab, usable)
    inserted = usable.select(F.explode(_words("replacement")).alias("_word")).distinct()
    term_words = usable.select(F.explode(_words("term")).alias("_word")).distinct()
    if not inserted.join(term_words, "_word", "left_semi").isEmpty():
        found = cut_lineage(found)
        n = found.count()
        while True:
            extra = found.groupBy(*UNIT).agg(
                F.array_distinct(F.flatten(F.collect_list(_words("replacement")))).alias("_more")
            )
            wider = vocab.join(extra, UNIT).withColumn(
                "_words", F.array_union("_words", "_more")
            )
            found = cut_lineage(_word_candidates(wider.drop("_more"), usable))
            grown = found.count()
            if grown == n:
                break
            n = grown

    def step(acc, t):
        quoted = F.concat(
            F.lit(r"(?iuU)\b\Q"), F.replace(t["term"], F.lit("\\E"), F.lit("\\E\\\\E\\Q")),
            F.lit(r"\E\b"),
        )
        literal = F.replace(
            F.replace(t["replacement"], F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$")
        )
        return F.regexp_replace(acc, quoted, literal)

    return (
        units.join(_per_unit(found), UNIT, "left")
        .withColumn(
            "modified",
            F.when(F.col("_terms").isNull(), F.col(text)).otherwise(
                F.aggregate("_terms", F.col(text), step)
            ),
        )
        .drop("_terms")
    )


def glossary_hints(matches: DataFrame, by: list[str]) -> DataFrame:
    """Distinct ``term → replacement`` lines per batch or unit, one per row."""
    return (
        matches.filter((F.length("term") > 0) & (F.length("replacement") > 0))
        .select(*by, F.concat("term", F.lit(" → "), "replacement").alias("hint"))
        .distinct()
    )


def locate(units: DataFrame, fragments: DataFrame) -> DataFrame:
    """Units whose source contains a fragment, ignoring case and white space.

    ``fragments`` holds fragment_id and fragment; adds ``is_translated``.
    """
    needles = fragments.select(
        "fragment_id", norm_ws(F.lower("fragment")).alias("_needle")
    )
    texts = units.select(
        *UNIT,
        norm_ws(F.lower("source")).alias("_text"),
        F.coalesce(F.length(strip(F.col("target"))) > 0, F.lit(False)).alias("is_translated"),
    )
    pairs = containing(texts, needles, UNIT, "_text", "_needle")
    return pairs.select(*UNIT, "fragment_id", "is_translated")


def units_for_findings(findings: DataFrame, units: DataFrame) -> DataFrame:
    """Glue tokens of a document and the units they sit in, one pair per row."""
    return (
        findings.select("doc_id", F.col("paragraph").alias("unit_idx"), "token")
        .join(units.select("doc_id", "unit_idx", "unit_id"), UNIT)
        .select("doc_id", "token", "unit_id")
        .distinct()
    )


COLUMNS = list(COLUMN_LANGUAGE)


def _values(rows: DataFrame) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("value")) for c in COLUMNS])
    return rows.select("row_num", F.inline(pairs))


# Parallel rounds before what is left is decided group by group.
ROUNDS = 3


def _in_turn(undecided: DataFrame) -> DataFrame:
    """Accepted row_num of rows decided in order, each group of rows that share values by itself.

    Groups are the connected components of "holds the same value"; a group is
    streamed through one task in the order of its rows, which remembers the
    values it has accepted. Rows that share no value are accepted as they are.
    """
    values = _values(undecided)
    shared = (
        values.groupBy("col", "value").agg(F.min("row_num").alias("_first"), F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") > 1).drop("_rows")
    )
    held = salted_lookup(values, shared, ["col", "value"], ["row_num"], "inner")
    edges = held.select(F.col("row_num").alias("a"), F.col("_first").alias("b"))
    groups = connected_components(edges).withColumnsRenamed({"id": "row_num", "component": "_group"})
    grouped = cut_lineage(undecided.join(groups, "row_num", "left"))
    alone = grouped.filter(F.col("_group").isNull()).select("row_num")
    queued = (
        grouped.filter(F.col("_group").isNotNull()).repartition("_group").sortWithinPartitions("_group", "row_num")
    )

    def decide(batches):
        current, taken = None, [set() for _ in COLUMNS]
        for batch in batches:
            rows, keys, *words = (column.to_pylist() for column in batch.columns)
            kept = []
            for row, key, *mine in zip(rows, keys, *words, strict=True):
                if key != current:
                    current, taken = key, [set() for _ in COLUMNS]
                if not any(v in t for v, t in zip(mine, taken, strict=True)):
                    kept.append(row)
                    for v, t in zip(mine, taken, strict=True):
                        t.add(v)
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64())], names=["row_num"])

    decided = queued.select(F.col("row_num").cast("long").alias("row_num"), "_group", *COLUMNS).mapInArrow(
        decide, "row_num long"
    )
    return alone.union(decided.select(F.col("row_num").cast(undecided.schema["row_num"].dataType)))


def accepted_rows(rows: DataFrame) -> DataFrame:
    """Rows whose four values repeat no value of an earlier accepted row.

    A value of a rejected row blocks nothing, so acceptance depends on earlier
    decisions. A few parallel rounds decide most rows: a row that is the first
    undecided holder of all its values is accepted, rows that share a value
    with an earlier accepted row are rejected, and the rest goes on. Every
    round is a few aggregations and one salted join; no value group is ever
    collected, and a value held by a third of the rows is settled at once.
    What is left are long chains of rows that hang on each other; they are
    decided in turn, chain by chain, so the number of rounds does not follow
    their length. Returns row_num of the accepted rows.
    """
    undecided = cut_lineage(rows.select("row_num", *COLUMNS))
    accepted: list[DataFrame] = []
    for _ in range(ROUNDS):
        if undecided.isEmpty():
            break
        values = _values(undecided)
        first = values.groupBy("col", "value").agg(F.min("row_num").alias("row_num"))
        leading = (
            first.groupBy("row_num").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") == len(COLUMNS)).select("row_num")
        )
        taken = cut_lineage(undecided.join(leading, "row_num", "left_semi"))
        accepted.append(taken.select("row_num"))
        taken_values = _values(taken).select("col", "value")
        hit = salted_lookup(values, taken_values, ["col", "value"], ["row_num"], "left_semi")
        undecided = cut_lineage(
            undecided.join(hit.select("row_num").distinct(), "row_num", "left_anti")
        )
    if not accepted:
        return rows.select("row_num").limit(0)
    if not undecided.isEmpty():
        accepted.append(_in_turn(undecided))
    return reduce(DataFrame.unionByName, accepted)


def import_glossary(rows: DataFrame, existing: DataFrame, force_language: bool = False) -> DataFrame:
    """Outcome of every row of an import file.

    ``rows``: row_num and the four word columns; ``existing``: the words the
    collection already holds. Outcomes: blank, repeated (with column and the
    earlier row), language, exists, imported. The duplicate checks are exact
    and also run when the language check is waived.
    """
    rows = rows.select("row_num", *[strip(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in COLUMNS])
    blank = reduce(lambda a, b: a | b, [F.length(c) == 0 for c in COLUMNS])
    filled = rows.filter(~blank)
    ok = accepted_rows(filled)
    owners = _values(filled.join(ok, "row_num", "left_semi")).select(
        "col", "value", F.col("row_num").alias("owner")
    )
    order = F.create_map(*[x for i, c in enumerate(COLUMNS) for x in (F.lit(c), F.lit(i))])
    repeats = (
        salted_lookup(_values(filled), owners, ["col", "value"], ["row_num"], "inner")
        .filter(F.col("owner") < F.col("row_num"))
        .groupBy("row_num")
        .agg(F.min(F.struct(order[F.col("col")].alias("i"), "col", "owner")).alias("_r"))
    )
    known = _values(existing.select(F.lit(0).alias("row_num"), *COLUMNS)).filter(
        F.length("value") > 0
    )
    taken = (
        salted_lookup(
            _values(filled), known.select("col", "value").distinct(), ["col", "value"], ["row_num"],
            "left_semi",
        )
        .select("row_num").distinct().withColumn("_taken", F.lit(True))
    )
    mismatch = reduce(
        lambda a, b: a | b, [language_mismatch(F.col(c), c) for c in COLUMNS]
    ) & F.lit(not force_language)
    return (
        rows.join(repeats, "row_num", "left").join(taken, "row_num", "left")
        .select(
            "row_num",
            F.when(blank, "blank").when(F.col("_r").isNotNull(), "repeated")
            .when(mismatch, "language").when(F.col("_taken"), "exists")
            .otherwise("imported").alias("outcome"),
            F.col("_r.col").alias("repeated_column"),
            F.col("_r.owner").alias("repeated_row"),
        )
    )
