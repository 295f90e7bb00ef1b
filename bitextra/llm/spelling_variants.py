"""Spelling variants: near words found by sorted rotations of terminator-marked words.

Every word is closed by a terminator and turned through all its rotations. An
edit at one place of a word is, in the rotation that ends at this place, an
edit of the last character. A word x c y with c skipped leaves the prefix
y $ x; a word x d y leaves the same prefix, so replacements meet; and the word
x y has y $ x as a whole rotation, so insertions and deletions meet there too.
Rotations are dealt out and sorted by that prefix and each range is scanned
once. A range holds one whole rotation at most and one skipped character of
the alphabet each, so its size is bounded by the alphabet, whatever the data.
A character is offered to shorter words at the first place of a run of equal
characters only: two words then meet in exactly one range, and neighbours are
counted without listing pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

WORD = r"[A-Za-zÀ-ÿ]+"
# Sorts before every character of a word and is none.
TERMINATOR = "$"
# Prefixes of longer words are compared by these leading characters and a digest of the whole.
PLAIN_PREFIX = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def count_words(
    docs: DataFrame, text: str = "text", id_column: str = "doc_id", slip: int = 97
) -> DataFrame:
    """(word, n): lower-cased runs of letters of all texts, some with one letter left out.

    Where ``slip`` divides the crc32 of ``<id>:<run>``, the run loses the code
    point at that crc32 modulo its length. A null id counts as an empty one; a
    run that loses its only letter is no word. Occurrences are summed before
    the shuffle, so a word that is a third of all is no hot key.
    """
    lowered = F.translate(F.col(text), UPPER, LOWER)
    runs = docs.select(
        F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("_id"),
        F.explode(F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))).alias("run"),
    )
    hashed = runs.select("run", F.crc32(F.concat("_id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.pmod("h", F.length("run").cast("long")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    slipped = hashed.select(F.when(F.col("h") % slip == 0, cut).otherwise(F.col("run")).alias("word"))
    return slipped.filter(F.col("word") != "").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _bounded(prefix: Column) -> Column:
    """The prefix itself, or its head and digest where it is long."""
    digest = F.concat(F.substring(prefix, 1, PLAIN_PREFIX), F.md5(prefix.cast("binary")))
    return F.when(F.length(prefix) <= PLAIN_PREFIX, prefix).otherwise(digest)


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, id, n, whole, first) of all rotations of (id, word, n).

    ``whole`` marks a rotation as such, else its last character is skipped;
    ``first`` tells whether that character begins a run of its kind.
    """

    def of(word: Column, size: Column) -> Column:
        def skipped(i: Column) -> Column:
            before, c = F.substring(word, 1, i), F.substring(word, i + 1, 1)
            rest = F.substring(word, i + 2, size)
            return F.struct(
                _bounded(F.concat(rest, F.lit(TERMINATOR), before)).alias("prefix"),
                F.lit(False).alias("whole"),
                ((i == 0) | (F.substring(word, i, 1) != c)).alias("first"),
            )

        def whole(i: Column) -> Column:
            turned = F.concat(F.substring(word, i + 1, size), F.lit(TERMINATOR), F.substring(word, 1, i))
            return F.struct(_bounded(turned).alias("prefix"), F.lit(True).alias("whole"), F.lit(False).alias("first"))

        return F.concat(
            F.transform(F.sequence(F.lit(0), size - 1), skipped), F.transform(F.sequence(F.lit(0), size), whole)
        )

    turned = words.select("id", "n", F.explode(of(F.col("word"), F.length("word"))).alias("r"))
    return turned.select(F.col("r.prefix").alias("prefix"), "id", "n", F.col("r.whole").alias("whole"), F.col("r.first").alias("first"))


def neighbours(words: DataFrame) -> DataFrame:
    """(id, n_near, best) of the words (id, word, n) that have near words.

    ``best`` is a struct of the negative n and the id of the most frequent
    word of the ranges, the word itself included; ids are in word order.
    """
    span = Window.partitionBy("prefix")
    skipped, whole = ~F.col("whole"), F.col("whole")
    me = F.struct((-F.col("n")).alias("m"), F.col("id").alias("id"))
    scanned = rotations(words).select(
        "id", "whole", "first",
        F.count(F.when(skipped, 1)).over(span).alias("skips"),
        F.count(F.when(F.col("first"), 1)).over(span).alias("firsts"),
        F.count(F.when(whole, 1)).over(span).alias("wholes"),
        F.min(F.when(skipped, me)).over(span).alias("best_skip"),
        F.min(F.when(F.col("first"), me)).over(span).alias("best_first"),
        F.min(F.when(whole, me)).over(span).alias("best_whole"),
    )
    near = (
        F.when(F.col("whole"), F.col("firsts"))
        .when(F.col("first"), F.col("skips") - 1 + F.col("wholes"))
        .otherwise(F.col("skips") - 1)
    )
    best = (
        F.when(F.col("whole"), F.col("best_first"))
        .when(F.col("first"), F.least("best_skip", "best_whole"))
        .otherwise(F.col("best_skip"))
    )
    met = scanned.select("id", near.alias("near"), best.alias("best")).filter(F.col("near") > 0)
    return met.groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def _last(forms: DataFrame) -> DataFrame:
    """(id, root) for (id, form): the end of each chain, by doubling its links.

    A form occurs at least twice as often as its word, so there are no cycles
    and a chain is no longer than the logarithm of the largest count.
    """
    links = cut_lineage(forms.select("id", F.col("form").alias("to")))
    while True:
        ahead = links.select(F.col("id").alias("to"), F.col("to").alias("beyond"))
        stepped = cut_lineage(links.join(ahead, "to", "left").select("id", "to", "beyond"))
        if stepped.filter(F.col("beyond").isNotNull()).isEmpty():
            return stepped.select("id", F.col("to").alias("root"))
        links = stepped.select("id", F.coalesce("beyond", "to").alias("to"))


def spelling_variants(
    docs: DataFrame, text: str = "text", id_column: str = "doc_id", least_length: int = 5,
    least_count: int = 3, slip: int = 97,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of enough letters and occurrences.

    Near words differ by exactly one inserted, deleted or replaced code point.
    The form of a word is its near word of the largest n (ties: the smallest
    in code-point order) if that is at least twice its own, else null; the
    root is the last form of the chain, the word itself without one. Null and
    empty texts hold no words, repeated rows count each time, rows without an
    id take part, other columns are ignored, and an empty table gives no rows.
    """
    counted = count_words(docs, text, id_column, slip).filter(
        (F.length("word") >= least_length) & (F.col("n") >= least_count)
    )
    # Ids follow the order of the words; written, so every reader sees the same ones.
    words = cut_lineage(counted.orderBy("word").withColumn("id", F.monotonically_increasing_id()))
    found = cut_lineage(neighbours(words))
    chosen = words.select("id", "n").join(found, "id").filter(-F.col("best.m") >= 2 * F.col("n"))
    forms = cut_lineage(chosen.select("id", F.col("best.id").alias("form"), (-F.col("best.m")).alias("form_n")))
    named = words.select(F.col("id").alias("form"), F.col("word").alias("form_word"))
    rooted = words.select(F.col("id").alias("root"), F.col("word").alias("root_word"))
    spelt = forms.join(_last(forms), "id").join(named, "form").join(rooted, "root")
    out = words.join(found.select("id", "n_near"), "id", "left").join(
        spelt.select("id", "form_word", "root_word", "form_n"), "id", "left"
    )
    return out.select(
        "word",
        F.col("form_word").alias("form"),
        F.coalesce("root_word", "word").alias("root"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        "form_n",
    )
