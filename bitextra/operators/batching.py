"""Batches, splitting and merging, and distribution of text over runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitextra.functions.markup import encode_format_codes, has_content
from bitextra.functions.text import let
from bitextra.operators.ranking import ROWS_PER_CHUNK, chunked_rank, join_null_safe

# Batch size and the limits of paragraph splitting.
BATCH_SIZE = 50
SPLIT_MIN_PARAGRAPHS = 3
SPLIT_MIN_CHARS = 300
PARAGRAPH_CODE = "\\P"
NO_LAYER = "0"


def assign_batches(
    units: DataFrame, size: int = BATCH_SIZE, by: str | None = None,
    keys: tuple[str, ...] = ("doc_id",), idx: str = "unit_idx",
) -> DataFrame:
    """1-based ``batch_id`` of ``size`` units each, in order.

    With ``by`` (a layer) batches never mix layers, and layers come in
    first-seen order (W2); a unit without layer is in layer "0". Ranks are chunked by index, so a document of any
    length is numbered by many tasks.
    """
    chunk = F.floor(F.col(idx) / ROWS_PER_CHUNK)
    if by is None:
        ranked = chunked_rank(units, list(keys), [F.col(idx)], chunk, "_rank")
        return ranked.withColumn(
            "batch_id", (F.floor((F.col("_rank") - 1) / size) + 1).cast("long")
        ).drop("_rank")
    given = units
    units = units.withColumn("_layer", F.coalesce(F.col(by).cast("string"), F.lit(NO_LAYER)))
    by = "_layer"
    layers = units.groupBy(*keys, by).agg(
        F.min(idx).alias("_first"), F.ceil(F.count(F.lit(1)) / size).alias("_n")
    )
    before = (
        Window.partitionBy(*keys).orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    )
    start = layers.select(
        *keys, by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    ranked = chunked_rank(units, [*keys, by], [F.col(idx)], chunk, "_rank")
    return (
        join_null_safe(ranked, start, [*keys, by])
        .withColumn(
            "batch_id",
            (F.col("_start") + F.floor((F.col("_rank") - 1) / size) + 1).cast("long"),
        )
        .select(*given.columns, "batch_id")
    )


def batch_payload(units: DataFrame, keys: tuple[str, ...] = ("doc_id", "batch_id")) -> DataFrame:
    """One JSON array of id, text and context per batch, in unit order.

    A batch holds at most the batch size, which bounds the collected group.
    """
    item = F.struct("unit_idx", F.col("unit_id").alias("id"), "text", "context")
    return units.groupBy(*keys).agg(
        F.array_sort(F.collect_list(item)).alias("_items"), F.count(F.lit(1)).alias("n_units")
    ).select(
        *keys, "n_units",
        F.to_json(
            F.transform(
                "_items", lambda x: F.struct(x["id"].alias("id"), x["text"].alias("text"),
                                             x["context"].alias("context"))
            )
        ).alias("payload"),
    )


def split_paragraphs(entities: DataFrame) -> DataFrame:
    """Long multi-paragraph texts become children ``id__pN``.

    Children and whole texts are encoded; those left with placeholders only
    are dropped. Adds split_parent and split_index (null for whole texts).
    """
    text = F.col("text")
    codes = F.size(F.split(text, r"\\P", -1)) - 1
    long_text = (codes >= SPLIT_MIN_PARAGRAPHS) & (F.length(text) >= SPLIT_MIN_CHARS)
    parts = F.when(long_text, F.split(text, r"\\P", -1)).otherwise(F.array(text))
    keep = [c for c in entities.columns if c not in ("unit_id", "text")]
    return (
        entities.withColumn("_split", long_text)
        .select("unit_id", *keep, "_split", F.posexplode(parts).alias("_i", "_part"))
        .select(
            F.when(F.col("_split"), F.concat("unit_id", F.lit("__p"), "_i"))
            .otherwise(F.col("unit_id")).alias("unit_id"),
            *keep,
            encode_format_codes(F.col("_part")).alias("text"),
            F.col("_part").alias("original"),
            F.when(F.col("_split"), F.col("unit_id")).alias("split_parent"),
            F.when(F.col("_split"), F.col("_i").cast("long")).alias("split_index"),
        )
        .filter(has_content(F.col("text")))
    )


def merge_paragraphs(entities: DataFrame, children: DataFrame) -> DataFrame:
    """Children joined back by split_index with the paragraph code (A10).

    ``children``: split_parent, split_index, translated. A paragraph without a
    translation - placeholder-only ones were never sent - keeps its original
    text. The group is the paragraphs of one text.
    """
    parts = entities.select(
        F.col("unit_id").alias("split_parent"),
        F.posexplode(F.split("text", r"\\P", -1)).alias("split_index", "_original"),
    ).withColumn("split_index", F.col("split_index").cast("long"))
    parents = children.select("split_parent").distinct()
    return (
        parts.join(parents, "split_parent", "left_semi")
        .join(children.select("split_parent", "split_index", "translated"),
              ["split_parent", "split_index"], "left")
        .groupBy("split_parent")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct("split_index", F.coalesce("translated", "_original").alias("t"))
                )
            ).alias("_parts")
        )
        .select(
            F.col("split_parent").alias("unit_id"),
            F.array_join(F.transform("_parts", lambda x: x["t"]), PARAGRAPH_CODE).alias("merged"),
        )
    )


def _is_blank(c: Column) -> Column:
    return ~c.rlike(r"(?U)\S")


def distribute_words(runs: Column, text: Column) -> Column:
    """Translated words over the runs of a paragraph, as an array of texts.

    Every run with content gets words in proportion to its length, the
    remainder going to the largest fractions (earlier runs first on a tie).
    White-space runs keep their text and take no words; a run keeps the white
    space it ended with. With no content run the first run takes everything.
    """
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")

    def counts_for(words: Column, lengths: Column) -> Column:
        n = F.size(words)
        total = F.aggregate(lengths, F.lit(0), lambda a, x: a + x)

        def finish(shares: Column) -> Column:
            base = F.transform(shares, lambda x: F.floor(x["exact"]).cast("int"))
            left = n - F.aggregate(base, F.lit(0), lambda a, x: a + x)
            order = F.array_sort(
                F.filter(
                    F.transform(
                        shares,
                        lambda x, i: F.struct(
                            (F.floor(x["exact"]) - x["exact"]).alias("r"), i.alias("i"),
                            x["n"].alias("n"),
                        ),
                    ),
                    lambda x: x["n"] > 0,
                )
            )
            lucky = F.transform(
                F.slice(order, F.lit(1), F.greatest(left, F.lit(0))), lambda x: x["i"]
            )
            return let(
                lucky,
                lambda chosen: F.transform(
                    base,
                    lambda b, i: b
                    + F.when(F.array_contains(chosen, i), F.lit(1)).otherwise(F.lit(0)),
                ),
            )

        def shares_of(t: Column) -> Column:
            return F.transform(
                lengths, lambda x: F.struct((x / t * n).alias("exact"), x.alias("n"))
            )

        return let(
            let(F.when(total > 0, total).otherwise(F.lit(1)), shares_of), finish
        )

    def spread(words: Column, lengths: Column) -> Column:
        def place(counts: Column) -> Column:
            def chunk(r, i):
                start = F.aggregate(F.slice(counts, F.lit(1), i), F.lit(0), lambda a, x: a + x)
                return F.when(_is_blank(r), r).otherwise(
                    F.concat(
                        F.array_join(F.slice(words, start + 1, F.get(counts, i)), " "),
                        F.regexp_extract(r, r"(?U)(\s*)$", 1),
                    )
                )

            return F.transform(runs, chunk)

        return let(counts_for(words, lengths), place)

    lengths = F.transform(runs, lambda r: F.when(_is_blank(r), F.lit(0)).otherwise(F.length(r)))
    alone = F.transform(runs, lambda r, i: F.when(i == 0, F.concat(r, text)).otherwise(r))
    return F.when(
        F.exists(runs, lambda r: ~_is_blank(r)),
        let(words, lambda w: let(lengths, lambda n: spread(w, n))),
    ).otherwise(alone)


def distribute_chars(runs: Column, text: Column) -> Column:
    """Translated characters over rich-text runs in proportion to length.

    Every run but the last takes at least one character while there are any;
    the last takes the rest. One run takes all, empty runs change nothing.
    """
    n = F.length(text)
    k = F.size(runs)
    lengths = F.transform(runs, lambda r: F.length(r))
    total = F.aggregate(lengths, F.lit(0), lambda a, x: a + x)
    safe = F.when(total > 0, total).otherwise(F.lit(1))
    wanted = F.transform(
        lengths, lambda x: F.greatest(F.lit(1), F.floor(n * (x / safe)).cast("int"))
    )

    def cut(wanted, i):
        start = F.least(F.aggregate(F.slice(wanted, F.lit(1), i), F.lit(0), lambda a, x: a + x), n)
        size = F.when(i < k - 1, F.least(F.get(wanted, i), n - start)).otherwise(n - start)
        return text.substr(start + 1, size)

    return (
        F.when(k == 1, F.array(text)).when(total == 0, runs)
        .otherwise(let(wanted, lambda w: F.transform(runs, lambda r, i: cut(w, i))))
    )
