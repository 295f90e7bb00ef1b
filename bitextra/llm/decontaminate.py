"""Benchmark decontamination by pigeonhole edit matching.

A test item (or a segment of a long one) of m characters may differ in
k = m * ERROR_RATE edits. Cut into k + 1 pieces, at least one piece must occur
unchanged, so an automaton over all pieces finds every place worth looking at
in one pass over the text. Places of one item are merged to windows. Of 2k + 2
shorter pieces at least k + 2 must lie in the window (loses nothing either);
what passes is verified with Myers' bit-parallel distance.

Documents stay where they are: the distinct item texts travel as broadcast
blocks of bounded size, one scan per block; the driver holds one block at a
time. The size of the benchmark only adds scans.
"""

from __future__ import annotations

import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

ERROR_RATE = 0.1
# A longer item is cut into segments of about this many characters, each a test of its own.
SEGMENT = 400
# An item with fewer characters says too little to be told from chance: it must occur as a whole word run.
LEAST_CHARS = 32
# Characters of benchmark text sent to the executors at a time.
BLOCK_CHARS = 4_000_000

_SPACE = re.compile(r"\s")


def plain(text: str | None) -> str:
    """Lower case, any white space a blank; every character keeps its place."""
    text = text or ""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return _SPACE.sub(" ", low)


def cuts(length: int, parts: int) -> list[tuple[int, int]]:
    at = [length * i // parts for i in range(parts + 1)]
    return list(zip(at, at[1:], strict=False))


def segments(text: str) -> list[str]:
    text = plain(text).strip()
    return [text[a:b] for a, b in cuts(len(text), max(1, round(len(text) / SEGMENT)))]


def best_match(pattern: str, text: str, masks: dict[str, int]) -> tuple[int, int]:
    """(distance, end) of the best occurrence of ``pattern`` in ``text``, the earliest of equals.

    Myers' column recurrences on one integer per column; the pattern may begin anywhere.
    """
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = full, 0, m, m, 0
    get = masks.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = (down | ~(xh | up)) & full
        mh = up & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best, end = score, j + 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        up = (mh | ~(xv | ph)) & full
        down = ph & xv
    return best, end


def masks_of(pattern: str) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        out[c] |= 1 << i
    return dict(out)


class Matcher:
    """All segments of a block of items, ready to scan texts."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        import ahocorasick

        self.units = []
        self.parts: dict[int, int] = defaultdict(int)
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item, text in items:
            for s in segments(text):
                if not s:
                    continue
                k = int(len(s) * error_rate) if len(s) >= LEAST_CHARS else 0
                unit = len(self.units)
                self.parts[item] += 1
                self.units.append((item, s, k, masks_of(s), masks_of(s[::-1]), [s[a:b] for a, b in cuts(len(s), 2 * k + 2)]))
                for a, b in cuts(len(s), k + 1):
                    pieces[s[a:b]].append((unit, a))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """Per unit the merged stretches of ``text`` in which it may lie."""
        found: dict[int, list[int]] = defaultdict(list)
        for end, (length, places) in self.automaton.iter(text):
            for unit, offset in places:
                found[unit].append(end + 1 - length - offset)
        out: dict[int, list[list[int]]] = {}
        for unit, starts in found.items():
            _, s, k, *_ = self.units[unit]
            merged: list[list[int]] = []
            for at in sorted(starts):
                low, high = max(0, at - k), min(len(text), at + len(s) + k)
                if merged and low <= merged[-1][1] - len(s):
                    merged[-1][1] = max(merged[-1][1], high)
                else:
                    merged.append([low, high])
            out[unit] = merged
        return out

    def matches(self, text: str) -> list[tuple[int, int, int, int, int, int]]:
        """(item, distance, start, end, segments found, segments): the best segment's place of each item."""
        best: dict[int, tuple[int, int, int]] = {}
        units: dict[int, set[int]] = defaultdict(set)
        if self.empty:
            return []
        for unit, stretches in self.windows(text).items():
            item, s, k, masks, backward, short = self.units[unit]
            for low, high in stretches:
                window = text[low:high]
                at = window.find(s)
                if at >= 0:
                    if k == 0 and not _alone(text, low + at, low + at + len(s)):
                        continue
                    hit = (0, low + at, low + at + len(s))
                else:
                    if k == 0:
                        continue
                    if sum(map(window.__contains__, short)) < k + 2:
                        continue
                    distance, end = best_match(s, window, masks)
                    if distance > k:
                        continue
                    _, back = best_match(s[::-1], window[:end][::-1], backward)
                    hit = (distance, low + end - back, low + end)
                units[item].add(unit)
                if item not in best or hit < best[item]:
                    best[item] = hit
        return [(item, *hit, len(units[item]), self.parts[item]) for item, hit in sorted(best.items())]


def _alone(text: str, a: int, b: int) -> bool:
    return not (a and text[a - 1].isalnum()) and not (b < len(text) and text[b].isalnum())


def _distinct(benchmark: DataFrame, item_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The items (id, number of their text), and the distinct texts by number."""
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("t")).filter(
        F.trim(F.coalesce("t", F.lit(""))) != ""
    )
    texts = cut_lineage(items.select("t").distinct().withColumn("n", F.monotonically_increasing_id()))
    return items.join(texts, "t").select("item_id", "n").distinct(), texts


def _blocks(texts: DataFrame):
    """The texts as broadcast blocks of a bounded expected size; each is in the driver only while it is sent."""
    total = texts.agg(F.sum(F.length("t"))).first()[0] or 0
    n = -(-total // BLOCK_CHARS)
    for b in range(n):
        block = texts.filter(F.pmod(F.xxhash64("t"), F.lit(n)) == b).toArrow()
        rows = list(zip(block.column("n").to_pylist(), block.column("t").to_pylist(), strict=True))
        yield texts.sparkSession.sparkContext.broadcast(rows)


_HIT = "distance int, start long, end long, found_segments int, segments int"


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    id_column: str = "doc_id",
    item_id: str = "item_id",
    item_text: str = "text",
    error_rate: float = ERROR_RATE,
) -> DataFrame:
    """(id, item_id, distance, start, end, found_segments, segments) of every item found in every whole text.

    An item of up to about 600 characters is one segment, a longer one is cut
    into even segments of about SEGMENT characters. A segment is found where a
    tenth (``error_rate``) of its characters at most differs; one of under
    LEAST_CHARS characters must occur unchanged between other than letters and
    digits. An item is reported if any of its segments is found: distance and
    place are those of the segment of least distance, then of the first place;
    ``found_segments`` of ``segments`` tell how much of the item is there.
    Case and kinds of white space do not count. Null or blank texts and items
    match nothing; items without id or with equal ids are reported under that
    id, once for each different text, and equal texts under each of their ids;
    repeated documents are reported once per row. Empty tables give an empty result. Other columns are not carried.
    """
    schema = f"`{id_column}` long, n long, {_HIT}"
    source = docs.select(docs[id_column].cast("long").alias(id_column), docs[text].alias("text"))
    names, texts = _distinct(benchmark, item_id, item_text)
    parts = []
    for sent in _blocks(texts):

        def run(batches, sent=sent):
            matcher = Matcher(sent.value, error_rate)
            for batch in batches:
                rows = [
                    (batch.column(0)[i].as_py(), *hit)
                    for i in range(batch.num_rows)
                    for hit in matcher.matches(plain(batch.column(1)[i].as_py()))
                ]
                if rows:
                    cols = zip(*rows, strict=True)
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                        names=[id_column, "n", "distance", "start", "end", "found_segments", "segments"],
                    )

        parts.append(source.mapInArrow(run, schema))
    if not parts:
        return docs.sparkSession.createDataFrame([], f"`{id_column}` long, item_id long, {_HIT}")
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    hits = out.join(names, "n")
    return hits.select(id_column, "item_id", "distance", "start", "end", "found_segments", "segments")


def drop_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    error_rate: float = ERROR_RATE,
) -> DataFrame:
    """``docs`` with all columns, without the rows that hold any segment of any item."""
    place = docs.columns.index(text)
    for sent in _blocks(_distinct(benchmark, item_id, item_text)[1]):

        def run(batches, sent=sent):
            matcher = Matcher(sent.value, error_rate)
            for batch in batches:
                clean = [not matcher.matches(plain(t.as_py())) for t in batch.column(place)]
                yield batch.filter(pa.array(clean, pa.bool_())) if not all(clean) else batch

        docs = docs.mapInArrow(run, docs.schema)
    return docs
