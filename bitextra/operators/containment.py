"""Substring containment joins between texts and terms."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401 - workers call it as pa.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitextra.operators.ranking import join_null_safe, salted_lookup
from bitextra.session import cut_lineage

# Gram sizes tried as join keys; a term uses the largest one it can fill.
GRAM_SIZES = (6, 3, 2, 1)
BROADCAST_BYTES = 32 * 1024 * 1024
# Needle text of one automaton (about 50 bytes of memory each), and the most shards of that size.
SHARD_BYTES = 2 * 1024 * 1024
MOST_SHARDS = 8


def _bytes(df: DataFrame) -> Column:
    return sum(
        (F.coalesce(F.octet_length(F.col(n).cast("string")), F.lit(0)) for n in df.columns),
        F.lit(64),
    )


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the frame's text plus a row overhead stays below ``limit`` bytes."""
    total = df.agg(F.sum(_bytes(df)).alias("b")).first()["b"]
    return (total or 0) <= limit


# Bytes of text scanned together, and pairs that leave together.
SCANNED_BYTES = 1024 * 1024
PAIRS_PER_BATCH = 10_000

# Automata this worker has built, by the name of their shard; a task of another job makes room.
_BUILT: dict[str, tuple] = {}


def _automaton(name: str, needles: list[str]):
    """The automaton of a shard and, for each of its distinct needles, their rows."""
    import ahocorasick

    if name not in _BUILT:
        rows: dict[str, list[int]] = {}
        for row, needle in enumerate(needles):
            rows.setdefault(needle, []).append(row)
        machine = ahocorasick.Automaton()
        for number, needle in enumerate(rows):
            machine.add_word(needle, number)
        machine.make_automaton()
        _BUILT.clear()
        _BUILT[name] = (machine, list(rows.values()))
    return _BUILT[name]


def _pieces(batch: pa.RecordBatch, place: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about SCANNED_BYTES of text, so that one run's hits stay few."""
    sizes = pa.compute.binary_length(batch.column(place)).to_pylist()
    first = held = 0
    for i, size in enumerate(sizes):
        if held + (size or 0) > SCANNED_BYTES and i > first:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += size or 0
    yield batch.slice(first)


def _scan(batches: Iterator[pa.RecordBatch], sent, place: int) -> Iterator[tuple]:
    """(batch, text number of each hit, needle row of each hit): all needles of the shard in one pass."""
    name, table, needle = sent.value
    machine, rows = _automaton(name, table.column(needle).to_pylist())
    for batch in (piece for whole in batches for piece in _pieces(whole, place)):
        owner: list[int] = []
        hits: list[int] = []
        for i, text in enumerate(batch.column(place).to_pylist()):
            if text and rows:
                found = {number for _, number in machine.iter(text)}
                mine = sorted(row for number in found for row in rows[number])
                owner += [i] * len(mine)
                hits += mine
        yield batch, owner, hits


def _shards(needles: DataFrame, needle: str) -> list | None:
    """The needles in order, broadcast in shards of measured size; None if there are too many."""
    texts = needles.agg(F.sum(F.octet_length(needle)).alias("b")).first()["b"] or 0
    if texts > MOST_SHARDS * SHARD_BYTES or not fits_broadcast(needles):
        return None
    table = needles.orderBy(*needles.columns).toArrow()
    sizes = pa.compute.binary_length(table.column(needle)).to_pylist()
    cuts, held = [0], 0
    for row, size in enumerate(sizes):
        if held + size > SHARD_BYTES and held:
            cuts.append(row)
            held = 0
        held += size
    cuts.append(len(sizes))
    context = needles.sparkSession.sparkContext
    return [
        context.broadcast((uuid.uuid4().hex, table.slice(a, b - a).combine_chunks(), needle))
        for a, b in zip(cuts, cuts[1:], strict=False)
    ]


def _scanned_pairs(texts: DataFrame, needles: DataFrame, text: str, sent) -> DataFrame:
    """The pairs of one shard, without the text itself: it would come out once for each of its needles."""
    place = texts.columns.index(text)
    kept = [f for f in texts.schema.fields if f.name != text]
    schema = T.StructType([*kept, *needles.schema.fields])

    def run(batches):
        for batch, owner, hits in _scan(batches, sent, place):
            left = batch.select([f.name for f in kept])
            for k in range(0, len(hits), PAIRS_PER_BATCH):
                mine = left.take(pa.array(owner[k : k + PAIRS_PER_BATCH], pa.int64()))
                right = sent.value[1].take(pa.array(hits[k : k + PAIRS_PER_BATCH], pa.int64()))
                columns = [*mine.columns, *(c.combine_chunks() for c in right.columns)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return texts.mapInArrow(run, schema)


def _grams(c: Column, size: int) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def _gram_pairs(texts: DataFrame, needles: DataFrame, ids: list[str], text: str, needle: str) -> DataFrame:
    """Pairs of texts and needles by the needle's rarest gram, for needle lists of any size.

    A needle inside a text has all its grams among the text's, so an equi join
    on any one of them loses nothing; the one that fewest texts hold is taken.
    Grams are counted with map-side combining and carry ids only; frequent
    ones that no needle could avoid are salted. The texts come back to their
    candidates by id for the exact test.
    """
    size_of = F.lit(GRAM_SIZES[-1])
    for size in reversed(GRAM_SIZES):
        size_of = F.when(F.length(needle) >= size, F.lit(size)).otherwise(size_of)
    numbered = cut_lineage(needles.withColumn("_no", F.monotonically_increasing_id()).withColumn("_size", size_of))
    # At most one row per gram size comes back.
    sizes = sorted(r["_size"] for r in numbered.select("_size").distinct().collect())
    own = F.lit(None).cast("array<string>")
    for s in sizes:
        own = F.when(F.col("_size") == s, _grams(F.col(needle), s)).otherwise(own)
    offered = numbered.select("_no", F.explode(own).alias("_gram"))
    every = F.concat(*[_grams(F.col(text), s) for s in sizes]) if sizes else F.array().cast("array<string>")
    exploded = texts.select(*ids, F.explode(every).alias("_gram"))
    held = exploded.groupBy("_gram").agg(F.count(F.lit(1)).alias("_texts"))
    rarest = (
        offered.join(held, "_gram").groupBy("_no").agg(F.min(F.struct("_texts", "_gram")).alias("_r"))
        .select("_no", F.col("_r._gram").alias("_gram"))
    )
    keyed = cut_lineage(numbered.join(rarest, "_no").drop("_no", "_size"))
    pairs = salted_lookup(exploded, keyed, ["_gram"], ids, "inner").drop("_gram")
    back = join_null_safe(texts, pairs, ids)
    kept = [c for c in texts.columns if c != text]
    return back.filter(F.col(text).contains(F.col(needle))).select(*kept, *needles.columns)


def edit_contained(
    texts: DataFrame, needles: DataFrame, text: str, needle: str, reads: list[str], edit, fields: list[T.StructField]
) -> DataFrame | None:
    """``texts`` with the ``fields`` that ``edit`` makes of each row and the needles its text contains.

    ``edit`` gets the columns ``reads`` of a row as a dictionary and the
    contained needles, as dictionaries in their order, within the one pass that finds them. None
    where the needles are more than one automaton.
    """
    shards = _shards(needles.filter(F.length(needle) > 0), needle)
    if shards is None or len(shards) != 1:
        return None
    sent, place = shards[0], texts.columns.index(text)
    schema = T.StructType([*texts.schema.fields, *fields])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = [f.type for f in to_arrow_schema(T.StructType(fields))]
        every = sent.value[1].to_pylist()
        for batch, owner, hits in _scan(batches, sent, place):
            of: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for i, hit in zip(owner, hits, strict=True):
                of[i].append(every[hit])
            made = [edit(row, mine) for row, mine in zip(batch.select(reads).to_pylist(), of, strict=True)]
            columns = list(zip(*made, strict=True)) or [()] * len(fields)
            new = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)

    return texts.mapInArrow(run, schema)


def containing(
    texts: DataFrame, needles: DataFrame, ids: list[str], text: str, needle: str
) -> DataFrame:
    """Pairs where ``needle`` occurs in ``text`` (both compared as given): all columns of both but the text.

    A needle list whose measured size allows it is an automaton, or a few,
    and each text is passed over once for all needles of one; a larger list
    is joined by its rarest grams. ``ids`` name a text; null and empty texts
    and needles pair with nothing.
    """
    needles = needles.filter(F.length(needle) > 0)
    shards = _shards(needles, needle)
    if shards is None:
        return _gram_pairs(texts, needles, ids, text, needle)
    out = _scanned_pairs(texts, needles, text, shards[0])
    for sent in shards[1:]:
        out = out.unionByName(_scanned_pairs(texts, needles, text, sent))
    return out


def with_contained(
    texts: DataFrame, needles: DataFrame, ids: list[str], text: str, needle: str, out: str
) -> DataFrame:
    """``texts`` with the needles each contains, an array of structs in their order.

    The array is bounded by the text itself. One shard of needles fills it
    within the pass over the texts; several, or grams, pair first and are
    gathered by ``ids``, in which a null is a value like any other.
    """
    needles = needles.filter(F.length(needle) > 0)
    shards = _shards(needles, needle)
    kind = T.ArrayType(T.StructType(needles.schema.fields))
    if shards is not None and len(shards) == 1:
        sent, place = shards[0], texts.columns.index(text)
        schema = T.StructType([*texts.schema.fields, T.StructField(out, kind)])

        def run(batches):
            for batch, owner, hits in _scan(batches, sent, place):
                offsets = [0] * (batch.num_rows + 1)
                for i in owner:
                    offsets[i + 1] += 1
                for i in range(batch.num_rows):
                    offsets[i + 1] += offsets[i]
                taken = sent.value[1].take(pa.array(hits, pa.int64()))
                items = pa.StructArray.from_arrays(
                    [c.combine_chunks() for c in taken.columns], names=taken.column_names
                )
                found = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)
                yield pa.RecordBatch.from_arrays([*batch.columns, found], names=schema.names)

        return texts.mapInArrow(run, schema)
    narrow = texts.select(*ids, text)
    pairs = containing(narrow, needles, ids, text, needle)
    gathered = pairs.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct(*needles.columns))).alias(out))
    joined = join_null_safe(texts, gathered, ids, "left")
    return joined.withColumn(out, F.coalesce(out, F.array().cast(kind)))
