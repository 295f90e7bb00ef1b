"""Near-duplicate groups: one-permutation MinHash, densified, with star-shaped candidates.

One pass hashes the shingles of every text; a single permutation fills BINS
bins with their minima and empty bins borrow from full ones by optimal
densification (every empty bin walks its own hashed sequence of bins). Texts
with the same set are one class. Bands of eight bins are buckets; each bucket
offers only the pairs (its centre, member), so a bucket of n classes costs
n - 1 pairs. Candidates whose sketches allow it are confirmed on the
full shingle sets. Linked classes are joined to components; buckets that still
hold several components then offer the pairs between classes outside their
largest component and the others, so no link is lost to the star shape and no
group is expanded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .components import connected_components
from .words import blocks, grams, mix, word_table

# A band is half a sketch word: eight bins, four bits each. A pair at similarity 0.8 misses all
# bands with probability (1 - 0.8125**8)**72 = 3e-7; one at 0.4 meets in a tenth of the cases.
BANDS = 72
BINS = 16 * BANDS
# Standard deviations of the sketches' disagreement that a true pair may lie off.
SKETCH_SLACK = 5.0
# Bits of the fixed bitmap that tells which texts may take part in a confirmation (2 MB).
FILTER_BITS = 24
# Texts sketched together: each holds BINS values, however short it is.
SKETCHED_TOGETHER = 128
# Bytes of text whose shingles are hashed together; the arrays take some fifty times as much.
HASHED_TOGETHER = 500_000
# Sketch words compared first; most false candidates end there.
FIRST_WORDS = 12

_SIGNED = "row_id long, n_shingles long, set_hi long, set_lo long, sketch array<long>"


def _densify(sets: list[np.ndarray]) -> np.ndarray:
    """Bins x documents minima, empty bins filled; every set holds at least one value."""
    lengths = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), lengths)
    cell = doc * BINS + ((values >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    at = np.flatnonzero(np.diff(cell[order], prepend=-1))
    low = np.full(len(sets) * BINS, np.iinfo(np.uint64).max, np.uint64)
    low[cell[order[at]]] = np.minimum.reduceat(mix(values[order]), at)
    full = np.zeros(len(sets) * BINS, bool)
    full[cell[order[at]]] = True
    low, full = low.reshape(-1, BINS), full.reshape(-1, BINS)
    out = low.copy()
    rows, bins = np.nonzero(~full)
    step = 0
    while len(rows):
        step += 1
        donor = (mix((bins.astype(np.uint64) << np.uint64(20)) + np.uint64(step)) % np.uint64(BINS)).astype(np.int64)
        hit = full[rows, donor]
        out[rows[hit], bins[hit]] = low[rows[hit], donor[hit]]
        rows, bins = rows[~hit], bins[~hit]
    return out


def _packed(sets: list[np.ndarray]) -> np.ndarray:
    """Sketches of 16 bins a word, four bits each."""
    bins = (_densify(sets) >> np.uint64(20)) & np.uint64(15)
    packed = np.zeros((len(sets), BANDS), np.uint64)
    for k in range(16):
        packed |= bins[:, k * BANDS : (k + 1) * BANDS] << np.uint64(4 * k)
    return packed.astype(np.int64)


def signatures(
    docs: DataFrame, words: int, percent: int, text: str = "text", row_id: str = "_row"
) -> DataFrame:
    """Set size, 128-bit set identity and sketch of every row; no text is shuffled.

    A set so small that one foreign shingle takes it below ``percent`` (under
    four shingles at 80) links with equal sets only, which its identity
    settles; its sketch is empty.
    """

    def run(batches):
        for batch in batches:
            texts = (batch.column(1)[i].as_py() for i in range(batch.num_rows))
            for first, last, data in blocks(texts, HASHED_TOGETHER):
                hashes, _, _, owner = word_table(data)
                shingles, inside = grams(hashes, owner, words)
                counts = np.bincount(owner, minlength=len(data))
                bounds = np.concatenate([[0], np.cumsum(counts)])
                sets = []
                for i in range(len(data)):
                    a, b = bounds[i], bounds[i + 1]
                    if b - a >= words:
                        sets.append(np.unique(shingles[a : b - words + 1]))
                    elif b > a:  # the whole sequence is the one shingle
                        sets.append(mix(np.array([np.bitwise_xor.reduce(mix(hashes[a:b] + np.arange(1, b - a + 1, dtype=np.uint64))) + np.uint64(b - a)], np.uint64)))
                    else:
                        sets.append(np.empty(0, np.uint64))
                some = [i for i, s in enumerate(sets) if len(s) and len(s) * (100 - percent) >= percent]
                sketch: list = [[] for _ in sets]
                for k in range(0, len(some), SKETCHED_TOGETHER):
                    part = some[k : k + SKETCHED_TOGETHER]
                    for i, row in zip(part, _packed([sets[i] for i in part]), strict=True):
                        sketch[i] = row
                hi = [int(np.bitwise_xor.reduce(mix(s)).astype(np.int64)) if len(s) else 0 for s in sets]
                lo = [int(np.add.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D))).astype(np.int64)) if len(s) else 0 for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(hi, pa.int64()),
                        pa.array(lo, pa.int64()),
                        pa.array(sketch, pa.list_(pa.int64())),
                    ],
                    names=["row_id", "n_shingles", "set_hi", "set_lo", "sketch"],
                )

    return docs.select(F.col(row_id).alias("row_id"), F.col(text).alias("text")).mapInArrow(run, _SIGNED)


def _set_of(text: str, words: int) -> set:
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return set()
    if len(tokens) < words:
        return {tuple(tokens)}
    return set(zip(*(tokens[k:] for k in range(words)), strict=False))


def confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach ``percent``; a is the shared centre."""
    left = texts.select(F.col("class").alias("b"), F.col("text").alias("text_b"))
    right = texts.select(F.col("class").alias("a"), F.col("text").alias("text_a"))
    joined = pairs.join(left, "b").join(right, "a").select("a", "b", "text_a", "text_b")

    def run(batches):
        centre, held = None, set()
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            kept = []
            for i in range(batch.num_rows):
                if a[i] != centre:
                    centre, held = a[i], _set_of(batch.column(2)[i].as_py(), words)
                other = _set_of(batch.column(3)[i].as_py(), words)
                both = len(held & other)
                if 100 * both >= percent * (len(held) + len(other) - both):
                    kept.append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array([a[i] for i in kept], pa.int64()), pa.array([b[i] for i in kept], pa.int64())],
                names=["a", "b"],
            )

    return joined.mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", id_column: str = "doc_id"
) -> DataFrame:
    """Every row of ``docs`` by its id: n_shingles, component_id, kept.

    Texts are split at ASCII white space, A-Z lower-cased; a text with fewer
    than ``words`` words is one shingle; null, empty and blank texts have an
    empty set and link with nothing. Rows with equal ids are one
    document: what links one of its texts links it. A row without an id is a
    document of its own that links with nothing (component_id null, kept).
    Other columns are not carried. An empty table gives an empty result.
    """
    source = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text")
    )
    rows = source.withColumn("_row", F.col("doc_id"))
    signed = cut_lineage(signatures(rows, words, percent))
    # A class is one distinct set, named by its smallest document.
    filled = signed.filter((F.col("n_shingles") > 0) & F.col("row_id").isNotNull())
    classes = cut_lineage(
        filled.groupBy("set_hi", "set_lo", "n_shingles").agg(
            F.min("row_id").alias("class"),
            F.min_by("sketch", "row_id").alias("sketch"),
        )
    )
    keys = classes.select("class", F.explode(_band_keys(F.col("sketch"))).alias("key"))
    shared = (
        classes.select(F.explode(_band_keys(F.col("sketch"))).alias("key"))
        .groupBy("key").agg(F.count(F.lit(1)).alias("members"))
        .filter(F.col("members") > 1)
    )
    facts = classes.select("class", F.col("n_shingles").alias("n"), "sketch")
    shared_keys = cut_lineage(keys.join(shared, "key"))
    buckets = shared_keys.select("key", "class")
    # The centre of a bucket is the class that meets most others in all its buckets: in a family of
    # copies that is the same one nearly everywhere, so a class has few centres.
    weight = shared_keys.groupBy("class").agg(F.sum("members").alias("weight"))
    crowded = shared_keys.filter(F.col("members") > 2).join(weight, "class")
    centres = (
        crowded.groupBy("key").agg(F.min_by("class", F.struct(-F.col("weight"), "class")).alias("a"))
        .union(shared_keys.filter(F.col("members") == 2).groupBy("key").agg(F.min("class").alias("a")))
    )
    pairs = buckets.join(centres, "key").filter(F.col("class") != F.col("a")).select("class", "a").distinct()
    centre = facts.select(F.col("class").alias("a"), F.col("n").alias("m"), F.col("sketch").alias("other_sketch"))
    stars = cut_lineage(
        pairs.join(facts, "class").join(centre, "a").filter(_may_link(percent))
        .select("a", F.col("class").alias("b"))
    )
    used = stars.select(F.col("a").alias("class")).union(stars.select(F.col("b").alias("class"))).distinct()
    by_class = rows.select(F.col("doc_id").alias("class"), "text")
    links = cut_lineage(confirm(stars, _texts(by_class, used), words, percent))
    found = connected_components(links)
    more = _between_components(buckets, facts, found, stars, percent)
    if not more.isEmpty():
        used = more.select(F.col("a").alias("class")).union(more.select(F.col("b").alias("class"))).distinct()
        extra = cut_lineage(confirm(more, _texts(by_class, used), words, percent))
        found = connected_components(links.union(extra))
    labels = found.select(F.col("id").alias("class"), "component")
    by_set = classes.join(labels, "class", "left").select(
        "set_hi", "set_lo", "n_shingles", F.coalesce("component", "class").alias("component_id")
    )
    named = signed.select("row_id", "n_shingles", "set_hi", "set_lo").join(
        by_set, ["set_hi", "set_lo", "n_shingles"], "left"
    )
    out = named.select(
        F.col("row_id").alias(id_column),
        "n_shingles",
        F.when(F.col("row_id").isNotNull(), F.coalesce("component_id", "row_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col(id_column) == F.col("component_id"), F.lit(True)))
    return out


def _band_keys(sketch: Column) -> Column:
    """One key per band: its number and the lower half of its sketch word."""
    return F.transform(
        sketch, lambda x, k: F.shiftleft(k.cast("long"), 32).bitwiseOR(x.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    )


def _differing(x: Column, y: Column) -> Column:
    """Bins of a sketch word in which two sets differ."""
    d = x.bitwiseXOR(y)
    d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
    d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
    return F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111).cast("long")))


def _may_link(percent: int) -> Column:
    """Sizes allow the similarity, and the sketches do not speak against it."""
    sizes = (F.col("n") * 100 >= F.col("m") * percent) & (F.col("m") * 100 >= F.col("n") * percent)
    same = percent / 100
    rate = (1 - same) * 15 / 16

    def at_most(bins: int) -> Column:
        # A sketch of more bins than shingles lists nearly all of them, weighted unevenly.
        variance = same * (1 - same) * F.greatest(0.2 / F.least("n", "m"), F.lit(1 / bins))
        return bins * (F.lit(rate) + SKETCH_SLACK * F.sqrt(variance))

    first = F.lit(0)
    for k in range(FIRST_WORDS):
        first = first + _differing(F.get("sketch", F.lit(k)), F.get("other_sketch", F.lit(k)))
    every = F.aggregate(F.zip_with("sketch", "other_sketch", _differing), F.lit(0), lambda p, q: p + q)
    return sizes & (first <= at_most(16 * FIRST_WORDS)) & (every <= at_most(BINS))


def _texts(by_class: DataFrame, used: DataFrame) -> DataFrame:
    """The texts of the classes that take part, written once.

    A bitmap of hashed ids, of fixed size whatever their number, is sent to
    the texts first; only those that may take part are shuffled for the join.
    """
    at = F.pmod(F.xxhash64(F.col("class")), F.lit(1 << FILTER_BITS))
    words = used.groupBy(F.shiftright(at, 6).alias("w")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(class), {1 << FILTER_BITS}) % 64 AS INT))")).alias("bits")
    ).toArrow()
    bitmap = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bitmap[words.column("w").to_numpy()] = words.column("bits").to_numpy()

    def run(batches):
        for batch in batches:
            where = batch.column(2).to_numpy()
            hit = (bitmap[where >> 6].view(np.uint64) >> (where & 63).astype(np.uint64)) & np.uint64(1)
            yield batch.filter(pa.array(hit.astype(bool))).select(["class", "text"])

    near = by_class.select("class", "text", at.alias("at")).filter("class IS NOT NULL").mapInArrow(
        run, "class long, text string"
    )
    return cut_lineage(near.join(used, "class", "left_semi"))


def _between_components(buckets, facts, found, stars, percent) -> DataFrame:
    """Untested pairs of bucket mates in different components, never within one.

    In every bucket the classes outside its largest component (few, as stars
    have joined the rest) meet the classes of other components. The sketches
    are compared within the join, and a pair comes out of its first common
    bucket only, so few pairs leave it however large the bucket.
    """
    labels = found.select(F.col("id").alias("class"), "component")
    held = buckets.join(labels, "class", "left").withColumn("component", F.coalesce("component", "class"))
    mixed = held.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high")
    ).filter(F.col("low") != F.col("high")).select("key")
    held = cut_lineage(held.join(mixed, "key"))
    largest = (
        held.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"))
        .groupBy("key").agg(F.max_by("component", F.struct("size", "component")).alias("largest"))
    )
    outside = held.join(largest, "key").filter(F.col("component") != F.col("largest")).join(facts, "class")
    mates = held.join(facts, "class").select(
        F.col("key").alias("other_key"), F.col("class").alias("other"), F.col("n").alias("m"),
        F.col("sketch").alias("other_sketch"), F.col("component").alias("oc"),
    )
    half = F.lit(0xFFFFFFFF).cast("long")
    agree = F.zip_with("sketch", "other_sketch", lambda x, y: x.bitwiseXOR(y).bitwiseAND(half) == 0)
    first = F.array_position(agree, F.lit(True)) - 1 == F.shiftright("key", 32)
    met = outside.join(
        mates,
        (F.col("key") == F.col("other_key")) & (F.col("component") != F.col("oc")) & _may_link(percent) & first,
    )
    pairs = met.select(F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b")).distinct()
    return cut_lineage(pairs.join(stars, ["a", "b"], "left_anti"))
