"""Repeated passages by sparse suffix arrays.

Of every window of MIN_WORDS words one position is retained, the one whose
GRAM words hash lowest; the same passage retains the same positions wherever it
stands. Retained suffixes are grouped by their first GRAM words. Few of one
group are sorted by what follows, and all of them are neighbours: each pair is
compared, its match extended to the right and to the left. Of larger groups
every window of MIN_WORDS words around each suffix is hashed and looked up.
Matches of MIN_WORDS words or more are the repeated passages; none is lost.

Suffixes with the same words around them (up to a whole window on either side)
are one class, kept as a count: the inside of a copied text never reaches the
sort, however many copies there are. What reaches it, the suffixes near the
edges of passages, is sorted in ranges, so a passage that many documents share
is spread over tasks; the ends of neighbouring ranges are compared afterwards.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import salted_lookup
from ..session import cut_lineage
from .words import blocks, grams, mix, word_table

MIN_WORDS = 50
GRAM = 10
# Words kept to the left and right of a retained position: all a window can hold.
LEFT = MIN_WORDS - GRAM
RIGHT = MIN_WORDS
# Neighbours compared on either side in sorted order; a key of more classes than
# that goes by its windows.
NEIGHBOURS = 8
# A window of more suffixes is spread over tasks.
HOT_WINDOW = 10_000


def retained(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Word positions that some window of MIN_WORDS words of one text retains, ascending."""
    keys, inside = grams(hashes, owner, GRAM)
    span = MIN_WORDS - GRAM + 1
    if len(keys) < span:
        return np.empty(0, np.int64)
    whole = owner[: len(keys) - span + 1] == owner[MIN_WORDS - 1 : MIN_WORDS + len(keys) - span]
    windows = np.lib.stride_tricks.sliding_window_view(keys, span)
    out = []
    for a in range(0, len(windows), 65536):
        at = np.flatnonzero(whole[a : a + 65536]) + a
        if len(at):
            out.append(np.unique(at + np.argmin(windows[at], axis=1)))
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.int64)


def _row_key(id_column: str, text: str):
    return F.xxhash64(F.col(id_column), F.coalesce(F.col(text), F.lit("")))


_SUFFIX = "row long, id long, key long, around long, pos int, l int, r int"


def _suffixes(docs: DataFrame) -> DataFrame:
    """The retained suffixes of every text: first words, identity of the surroundings, place."""

    def run(batches):
        for batch in batches:
            for first, last, data in blocks(batch.column(2).to_pylist()):
                hashes, _, _, owner = word_table(data)
                at = retained(hashes, owner)
                if not len(at):
                    continue
                keys, _ = grams(hashes, owner, GRAM)
                begin = np.searchsorted(owner, np.arange(len(data)), "left")
                end = np.searchsorted(owner, np.arange(len(data)), "right")
                doc = owner[at]
                left = np.minimum(at - begin[doc], LEFT)
                right = np.minimum(end[doc] - at, RIGHT)
                around = mix(left.astype(np.uint64) * np.uint64(1000) + right.astype(np.uint64))
                for k in range(-LEFT, RIGHT):
                    have = (-left <= k) & (k < right)
                    word = hashes[np.where(have, at + k, 0)]
                    around = np.where(have, mix(around * np.uint64(31) + word), around)
                rows = np.array(batch.column(0).slice(first, last - first).to_pylist(), np.int64)
                ids = batch.column(1).slice(first, last - first).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows[doc]), ids, pa.array(keys[at].astype(np.int64)),
                        pa.array(around.astype(np.int64)), pa.array((at - begin[doc]).astype(np.int32)),
                        pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32)),
                    ],
                    names=["row", "id", "key", "around", "pos", "l", "r"],
                )

    return docs.select("row", "id", "text").mapInArrow(run, _SUFFIX)


_CONTEXT = "key long, around long, low long, high long, right binary, left binary"


def _placed(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts of chosen suffixes, each with its suffixes."""
    per_row = wanted.groupBy("row").agg(
        F.collect_list(F.struct("key", "around", "low", "high", "pos")).alias("at")
    )
    return docs.select("row", "text").dropDuplicates(["row"]).join(per_row, "row").select("text", "at")


def _contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The words right and left of chosen suffixes, as byte strings that sort by word."""
    joined = _placed(docs, wanted)

    def run(batches):
        for batch in batches:
            for first, last, data in blocks(batch.column(0).to_pylist()):
                hashes, _, _, owner = word_table(data)
                short = (hashes >> np.uint64(16)).astype(">u8")
                begin = np.searchsorted(owner, np.arange(len(data)), "left")
                end = np.searchsorted(owner, np.arange(len(data)), "right")
                rows = []
                for i, at in enumerate(batch.column(1).slice(first, last - first).to_pylist()):
                    for p in at:
                        here = begin[i] + p["pos"]
                        right = short[here : min(end[i], here + RIGHT)].view(np.uint8).reshape(-1, 8)[:, 2:]
                        left = short[max(begin[i], here - LEFT) : here][::-1].copy().view(np.uint8).reshape(-1, 8)[:, 2:]
                        rows.append((p["key"], p["around"], p["low"], p["high"], right.tobytes(), left.tobytes()))
                if rows:
                    kinds = (pa.int64(),) * 4 + (pa.binary(),) * 2
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                        names=["key", "around", "low", "high", "right", "left"],
                    )

    return joined.mapInArrow(run, _CONTEXT)


def _windows(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(hash, check, key, around, low, high, l) of every window of MIN_WORDS words around chosen suffixes.

    ``hash`` and ``check`` name the words by 128 bits, so that at any size
    equal names are equal words; ``l`` words of the window stand before the suffix.
    """
    schema = "hash long, check long, key long, around long, low long, high long, l int"

    def run(batches):
        for batch in batches:
            for first, last, data in blocks(batch.column(0).to_pylist()):
                hashes, _, _, owner = word_table(data)
                keys, _ = grams(hashes, owner, MIN_WORDS)
                checks, _ = grams(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), owner, MIN_WORDS)
                lists = batch.column(1).slice(first, last - first)
                key, around, low, high, pos = lists.flatten().flatten()
                doc = np.repeat(np.arange(len(data)), lists.value_lengths().to_numpy())
                begin, end = np.searchsorted(owner, doc, "left"), np.searchsorted(owner, doc, "right")
                starts = (begin + pos.to_numpy())[:, None] - np.arange(LEFT + 1)
                whole = (starts >= begin[:, None]) & (starts + MIN_WORDS <= end[:, None])
                which, left = np.nonzero(whole)
                if len(which):
                    at = pa.array(which)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(keys[starts[whole]].astype(np.int64)),
                            pa.array(checks[starts[whole]].astype(np.int64)), key.take(at), around.take(at),
                            low.take(at), high.take(at), pa.array(left.astype(np.int32)),
                        ],
                        names=["hash", "check", "key", "around", "low", "high", "l"],
                    )

    return _placed(docs, wanted).mapInArrow(run, schema)


def _by_windows(windows: DataFrame) -> DataFrame:
    """(key, around, l, r) of suffixes in windows that another document holds.

    A window is one pre-aggregated row, however many hold it; what is shared
    as a whole takes part, but needs no extension of its own. Windows of many
    suffixes are spread over tasks.
    """
    name = ["hash", "check"]
    held = windows.groupBy(*name).agg(F.min("low").alias("a"), F.max("high").alias("b"))
    shared = cut_lineage(held.filter(F.col("a") != F.col("b")).select(*name))
    open_windows = windows.filter(F.col("low") == F.col("high")).select(*name, "key", "around", "l")
    met = salted_lookup(open_windows, shared, name, ["key", "around", "l"], "inner", hot_rows=HOT_WINDOW)
    return met.groupBy("key", "around").agg(
        F.max("l").alias("l"), F.max(MIN_WORDS - F.col("l")).alias("r")
    )


# Bytes of a word in a context.
_WORD = 6


def _common(a: bytes, b: bytes) -> int:
    """Words that two contexts have in common from their start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // _WORD
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int(np.argmax(x != y)) // _WORD


_MATCH = _CONTEXT + ", l int, r int, part int, edge boolean"


def _compare(ordered: DataFrame) -> DataFrame:
    """Best extensions of every suffix against its neighbours, and the ends of each task's range."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        ring: deque = deque(maxlen=NEIGHBOURS)
        seen = 0
        done: list = []

        def record(s, edge):
            return (*s[0], s[1], s[2], part, edge)

        def flush():
            kinds = (pa.int64(),) * 4 + (pa.binary(),) * 2 + (pa.int32(),) * 3 + (pa.bool_(),)
            names = ["key", "around", "low", "high", "right", "left", "l", "r", "part", "edge"]
            columns = list(zip(*done, strict=True)) or [()] * len(names)
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)
            done.clear()
            return out

        def leave(s):
            if s[1] or s[2]:
                done.append((*s[0][:4], b"", b"", s[1], s[2], part, False))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                here = [row, 0, 0]
                if seen < NEIGHBOURS:
                    done.append(record(here, True))
                seen += 1
                if len(ring) == NEIGHBOURS:
                    leave(ring[0])
                for other in ring:
                    _extend(here, other)
                ring.append(here)
            if done:
                yield flush()
        for s in ring:
            leave(s)
            done.append(record([s[0], 0, 0], True))
        if done:
            yield flush()

    return ordered.mapInArrow(run, _MATCH)


def _extend(x: list, y: list) -> None:
    """Extend the match of two suffixes of the same first words, from different documents, both ways."""
    (key, _, low, high, right, left), (okey, _, olow, ohigh, oright, oleft) = x[0], y[0]
    if key != okey or low == high == olow == ohigh:
        return
    r, left_words = _common(right, oright), _common(left, oleft)
    if r + left_words >= MIN_WORDS:
        for s in (x, y):
            s[1], s[2] = max(s[1], left_words), max(s[2], r)


def _neighbours(contexts: DataFrame) -> DataFrame:
    """(key, around, l, r) of matches between neighbours; every pair of a key of few classes is met."""
    n = max(1, contexts.sparkSession.sparkContext.defaultParallelism)
    tie = ["key", "right", "left", "around"]
    ordered = contexts.repartitionByRange(4 * n, *tie).sortWithinPartitions(*tie)
    found = cut_lineage(_compare(ordered))
    # The ends of the ranges: at most 2 * NEIGHBOURS rows of each task, whatever the size of the data.
    ends = found.filter("edge").select(*[c.split()[0] for c in _CONTEXT.split(", ")]).distinct()
    seams = _compare(ends.coalesce(1).sortWithinPartitions(*tie)).filter(~F.col("edge"))
    return found.filter(~F.col("edge")).unionByName(seams).select("key", "around", "l", "r")


def repeated_passages(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, start, end): maximal runs of words in passages that other documents hold too.

    Words are split at ASCII white space, A-Z lower-cased; start and end count
    words, end exclusive; every run is a union of matches of at least MIN_WORDS
    words. Null and short texts hold none. Rows of equal id and text are one
    document; equal texts under other ids are repeats of each other; rows
    without id take part. Other columns are not carried; an empty table gives
    an empty result.
    """
    source = docs.select(
        _row_key(id_column, text).alias("row"), F.col(id_column).cast("long").alias("id"), F.col(text).alias("text")
    )
    suffixes = cut_lineage(_suffixes(source))
    classes = suffixes.groupBy("key", "around").agg(
        F.min("row").alias("low"), F.max("row").alias("high"), F.min_by("pos", F.struct("row", "pos")).alias("pos")
    )
    # Keys with one class are settled: shared by documents as a whole, or alone.
    counted = cut_lineage(
        classes.withColumn("shared", F.col("low") != F.col("high"))
    )
    many = counted.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("low").alias("a"), F.max("high").alias("b")
    ).filter((F.col("n") > 1) & (F.col("a") != F.col("b"))).select("key", (F.col("n") > NEIGHBOURS + 1).alias("large"))
    edge = counted.join(many, "key").withColumn("row", F.col("low"))
    edge = cut_lineage(edge.select("row", "key", "around", "low", "high", "pos", "large"))
    contexts = cut_lineage(_contexts(source, edge.filter("NOT large")))
    windows = cut_lineage(_windows(source, edge.filter("large")))
    matched = _neighbours(contexts).unionByName(_by_windows(windows))
    extents = matched.groupBy("key", "around").agg(F.max("l").alias("ml"), F.max("r").alias("mr"))
    settled = counted.filter("shared").select("key", "around", F.lit(True).alias("shared"))
    known = settled.join(extents, ["key", "around"], "full")
    covered = suffixes.join(known, ["key", "around"]).select(
        "row", "id",
        (F.col("pos") - F.when(F.col("shared"), F.col("l")).otherwise(F.col("ml"))).alias("start"),
        (F.col("pos") + F.when(F.col("shared"), F.col("r")).otherwise(F.col("mr"))).alias("end"),
    )
    # Runs of one document are merged in the order of their starts.
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    opened = covered.withColumn("new", (F.col("start") > F.coalesce(F.max("end").over(before), F.lit(-1))).cast("int"))
    numbered = opened.withColumn(
        "run", F.sum("new").over(Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0))
    )
    return numbered.groupBy("row", "id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).select(
        F.col("id").alias(id_column), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")
    )
