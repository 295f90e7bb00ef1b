"""Document fingerprints: threshold-scaled sketches of word shingles.

A text's fingerprint holds every hash of its shingles below a fixed fraction
of the hash range, so its size follows the text. Whether a hash is kept does
not depend on the text it stands in: the fingerprint of two texts together is
the union of theirs, and the share of one fingerprint that the other holds
estimates the containment of the texts, however unequal they are. Hashes are
the leading 16 hexadecimal digits of md5, so any engine can repeat them.

A text of which no hash falls below the threshold keeps its smallest one: a
text with words never has an empty fingerprint, and equal short texts match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words of a shingle, and the sixteenths of the hash range that are kept.
SHINGLE_WORDS = 5
SIXTEENTHS = 2
HASH_DIGITS = 16
SPACE = r"[ \t\n\x0B\f\r]+"
BLANKS = " \t\n\x0b\x0c\r"
# Rows of a chunk of the id order, most chunks, and the cells whose bounds are estimated.
ROWS_PER_CHUNK = 2048
MOST_CHUNKS = 65536
CELLS = 256


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fingerprint(text: Column, words: int = SHINGLE_WORDS, sixteenths: int = SIXTEENTHS) -> Column:
    """The sorted distinct kept hashes of a text (null: empty) as an array.

    Words are parted by ASCII white space and lower-cased; a text of fewer
    words than a shingle is one shingle, one without words has no hash.
    """
    limit = f"{sixteenths:x}" if sixteenths < 16 else "g"

    def digest(shingle: Column) -> Column:
        return F.substring(F.md5(shingle.cast("binary")), 1, HASH_DIGITS)

    def hashes(found: Column) -> Column:
        last = F.greatest(F.size(found) - words, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: digest(F.array_join(F.slice(found, i + 1, words), " ")))

    def kept(every: Column) -> Column:
        low = F.sort_array(F.array_distinct(F.filter(every, lambda h: h < limit)))
        return F.when(F.size(low) > 0, low).otherwise(F.array(F.array_min(every)))

    body = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(BLANKS))
    none = F.array().cast("array<string>")
    return _let(body, lambda b: F.when(b == "", none).otherwise(_let(_let(F.split(b, SPACE), hashes), kept)))


def containment(a: Column, b: Column) -> Column:
    """Share of fingerprint ``a`` that ``b`` holds; of an empty one: whether both are empty."""
    share = F.size(F.array_intersect(a, b)) / F.size(a)
    return F.when(F.size(a) > 0, share).otherwise(F.when(F.size(b) == 0, 1.0).otherwise(0.0))


def merged(a: Column, b: Column, sixteenths: int = SIXTEENTHS) -> Column:
    """The fingerprint of two texts together, but for shingles across their seam.

    Hashes above the threshold, kept for lack of others, go where there are others.
    """
    limit = f"{sixteenths:x}" if sixteenths < 16 else "g"

    def held(every: Column) -> Column:
        low = F.filter(every, lambda h: h < limit)
        least = F.when(F.size(every) > 0, F.array(F.array_min(every))).otherwise(every)
        return F.when(F.size(low) > 0, F.sort_array(low)).otherwise(least)

    return _let(F.array_union(a, b), held)


def _chunks(keyed: DataFrame, rows_per_chunk: int) -> Column:
    """A chunk number that never decreases along (_null, _id descending, _salt).

    Bounds of equal row counts are estimated by one map-side combined
    aggregate; between two bounds ids are taken as evenly spread, and rows of
    one frequent id, like rows without any, are spread by their salt. What
    reaches the driver is CELLS numbers.
    """
    cells = F.percentile_approx("_id", [i / CELLS for i in range(CELLS + 1)], 100 * CELLS)
    facts = keyed.agg(F.count(F.lit(1)).alias("rows"), cells.alias("bounds")).first()
    chunks = max(1, min(MOST_CHUNKS, facts["rows"] // rows_per_chunk))
    unit = F.col("_salt") / F.lit(float(1 << 62))
    if not facts["bounds"]:
        return F.least(F.floor(unit * chunks), F.lit(chunks - 1)).cast("int")
    bounds = F.array(*[F.lit(int(b)).cast("long") for b in facts["bounds"]])

    def place(found: Column) -> Column:
        below, same, lo, hi = found["below"], found["same"], found["lo"], found["hi"]
        inside = (F.col("_id").cast("double") - lo) / F.greatest(hi.cast("double") - lo, F.lit(1.0))
        # Equal bounds: the salt runs against the id, which falls along the order.
        return F.when(same > 0, below + (same - 1) * (1 - unit)).otherwise(below - 1 + inside)

    below = F.size(F.filter(bounds, lambda b: b < F.col("_id")))
    found = F.struct(
        below.alias("below"),
        F.size(F.filter(bounds, lambda b: b == F.col("_id"))).alias("same"),
        F.coalesce(F.get(bounds, below - 1), F.col("_id")).alias("lo"),
        F.coalesce(F.get(bounds, below), F.col("_id")).alias("hi"),
    )
    rank = _let(found, place) / F.lit(CELLS + 1.0)
    falling = F.floor((1 - F.least(F.greatest(rank, F.lit(0.0)), F.lit(1.0))) * chunks)
    named = F.least(falling, F.lit(chunks - 1))
    unnamed = chunks + F.least(F.floor(unit * chunks), F.lit(chunks - 1))
    return F.when(F.col("_null") == 0, named).otherwise(unnamed).cast("int")


def with_next(
    keyed: DataFrame, derived: dict[str, Column], carried: list[str], rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """``next``: the struct of ``carried`` of the following row by descending ``_id``; the first follows the last.

    Rows without an id come last; ties go by salt and text. Rows are dealt out
    once, by chunks of the order; the first row of a chunk is also given to
    the chunk before it, so no chunk looks into another. ``derived`` columns
    are computed after that, so they are not shuffled.
    """
    chunk = _chunks(keyed, rows_per_chunk)
    order = ["_null", "_down", "_salt", "text"]
    cut = keyed.withColumns({"_chunk": chunk, "_down": -F.coalesce(F.col("_id"), F.lit(0)).cast("decimal(20,0)")})
    key = F.struct("_null", "_down", "_salt")
    # At most one row per chunk, of fixed width.
    firsts = cut.groupBy("_chunk").agg(F.min(key).alias("_first"))
    line = Window.orderBy("_chunk")
    before = F.coalesce(F.lag("_chunk").over(line), F.max("_chunk").over(Window.partitionBy(F.lit(0))))
    heads = firsts.select(
        F.col("_chunk"), F.col("_first"), before.alias("_before"), (F.lag("_chunk").over(line).isNull()).cast("int").alias("_wraps")
    )
    own = F.struct(F.col("_chunk").alias("c"), F.lit(0).alias("wraps"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("_before").alias("c"), F.col("_wraps").alias("wraps"), F.lit(True).alias("guest"))
    leads = F.col("_before").isNotNull() & (key == F.col("_first"))
    dealt = (
        cut.join(F.broadcast(heads), "_chunk", "left")
        .withColumn("_to", F.explode(F.when(leads, F.array(own, guest)).otherwise(F.array(own))))
        .select(*[c for c in keyed.columns], "_down", "_to.c", "_to.wraps", "_to.guest")
    )
    # The window finds its rows already dealt out and sorted.
    sorted_rows = dealt.repartition("c").sortWithinPartitions("c", "wraps", *order, "guest")
    ahead = Window.partitionBy("c").orderBy("wraps", *order, "guest")
    followed = sorted_rows.withColumns(derived).withColumn("next", F.lead(F.struct(*carried)).over(ahead))
    return followed.filter(~F.col("guest")).drop("_down", "c", "wraps", "guest")


def document_fingerprints(
    docs: DataFrame, text: str = "text", id_column: str = "doc_id", words: int = SHINGLE_WORDS,
    sixteenths: int = SIXTEENTHS, rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Each row by its id: n_chars, edited_text, fingerprint, edited_fingerprint (arrays), near_edited, near_next.

    The edited text is the text (null: empty) whose last third of code points,
    rounded down, gives way to as many first ones (or all) of the next text by
    descending id, the first after the last. ``near_edited`` is the share of
    the fingerprint that the edited text's holds, ``near_next`` the one that
    the next text's holds. Rows without an id come after all others, rows of
    equal ids in the order of a hash of their texts; equal texts have equal
    fingerprints; a single row follows itself; other columns are ignored; an
    empty table gives no rows.
    """
    body = docs.select(F.col(id_column).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = body.select(
        "_id", "text",
        F.col("_id").isNull().cast("int").alias("_null"),
        F.shiftrightunsigned(F.xxhash64("text"), 2).alias("_salt"),
    )
    prints = {"print": fingerprint(F.col("text"), words, sixteenths)}
    followed = with_next(keyed, prints, ["text", "print"], rows_per_chunk)
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), F.length("text") - third),
        F.substring(F.col("next.text"), F.lit(1), third),
    )
    whole = followed.select("_id", "text", "print", F.col("next.print").alias("next_print"), edited.alias("edited_text"))
    both = whole.withColumn("edited_print", fingerprint(F.col("edited_text"), words, sixteenths))
    return both.select(
        F.col("_id").alias(id_column),
        F.length("text").cast("long").alias("n_chars"),
        "edited_text",
        F.col("print").alias("fingerprint"),
        F.col("edited_print").alias("edited_fingerprint"),
        containment(F.col("print"), F.col("edited_print")).alias("near_edited"),
        containment(F.col("print"), F.col("next_print")).alias("near_next"),
    )
