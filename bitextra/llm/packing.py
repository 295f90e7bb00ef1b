"""Hierarchical packing of documents into context windows of several lengths.

Each task packs the documents of its own input split in one streamed pass, so
no row is shuffled and no key can be hot. A document longer than the longest
window fills whole windows; its rest, like every shorter document, is routed
to the smallest tier that holds it and waits there with a bounded number of
others. A window begins with the longest piece of its tier; its gap is filled
with the longest pieces that fit, from its own tier down to the shortest, and
only when none fits one piece is cut to close the gap. So windows are full and
most documents are whole. Windows go to step groups of equal token budget: the
next window comes from the tier in which most tokens wait and which the group
still has room for, so every group mixes the tiers as the documents do and
holds the same number of tokens, but for the last of a task. What remains at
the end of a task fills windows of falling powers of two, so at most one window
per task is padded.
"""

from __future__ import annotations

import base64
import bisect
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Context sizes, powers of two; the last is the longest window.
TIERS = (256, 512, 1024, 2048)
# Sequences of the longest window in one step group.
STEP_WINDOWS = 16
END_ID = 1
ROWS_PER_BATCH = 20_000
# Pieces that wait in a task before windows are closed, and their tokens.
WAITING_PIECES = 2048
WAITING_TOKENS = 2_000_000
# Leftovers below this many tokens go to one padded window.
LEAST_WINDOW = 64

PIECES = pa.schema(
    [
        ("row_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("window", pa.int32()),
        ("step_group", pa.int64()),
        ("ids", pa.list_(pa.uint32())),
    ]
)


def contract_tokenizer() -> str:
    """The file whose ids the queries give."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of a tokenizer file: found within texts, whatever stands around them."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    for token in added:
        if token["single_word"] or token["lstrip"] or token["rstrip"]:
            raise ValueError(f"added token {token['content']!r} looks at its surroundings")
    return {token["content"]: token["id"] for token in added}


@lru_cache(maxsize=2)
def load_encoding(ranks_path: str, pattern: str, added: tuple[tuple[str, int], ...] = ()):
    """The byte-level vocabulary; ``added`` are the strings that are one token wherever they stand."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(added))


class _Packer:
    """Waiting pieces of one task by tier. Sequence and group numbers start at ``base``."""

    def __init__(self, base: int, tiers: tuple[int, ...]):
        self.tiers = tiers
        # Of each tier: (length, arrival, row, start, ids, document's ids), shortest first.
        self.waiting: dict[int, list[tuple]] = {t: [] for t in tiers}
        self.tokens = {t: 0 for t in tiers}
        self.arrivals = 0
        self.sequence = base
        self.group, self.room = base, STEP_WINDOWS * tiers[-1]
        self.rows: list[tuple] = []

    def _wait(self, row: int, start: int, ids: np.ndarray, n: int) -> None:
        tier = next(t for t in self.tiers if t >= len(ids))
        self.arrivals += 1
        bisect.insort(self.waiting[tier], (len(ids), self.arrivals, row, start, ids, n))
        self.tokens[tier] += len(ids)

    def _take(self, tier: int, place: int) -> tuple:
        piece = self.waiting[tier].pop(place)
        self.tokens[tier] -= piece[0]
        return piece[2:]

    def add(self, row: int, ids: np.ndarray) -> None:
        longest, n = self.tiers[-1], len(ids)
        for at in range(0, n, longest):
            self._wait(row, at, ids[at : at + longest].copy(), n)
            if sum(map(len, self.waiting.values())) > WAITING_PIECES or sum(self.tokens.values()) > WAITING_TOKENS:
                self._close_windows(WAITING_PIECES // 2, WAITING_TOKENS // 2)

    def _close_windows(self, pieces: int, tokens: int) -> None:
        """Full windows until so few pieces and tokens wait, or no window can be filled."""
        while sum(map(len, self.waiting.values())) > pieces or sum(self.tokens.values()) > tokens:
            all_waiting = sum(self.tokens.values())
            open_tiers = [t for t in self.tiers if t <= self.room and t <= all_waiting]
            if not open_tiers:
                return
            tier = max(open_tiers, key=lambda t: self.tokens[t])
            self._emit(self._filled(tier), tier)

    def _filled(self, tier: int) -> list[tuple]:
        """Pieces that fill one window of a tier; as many tokens at least must wait."""
        room, taken = tier, []
        while room:
            fit = None
            for t in reversed(self.tiers[: self.tiers.index(tier) + 1]):
                place = bisect.bisect_right(self.waiting[t], (room, self.arrivals + 1)) - 1
                if place >= 0 and (fit is None or self.waiting[t][place][0] > self.waiting[fit[0]][fit[1]][0]):
                    fit = (t, place)
            if fit is not None:
                row, start, ids, n = self._take(*fit)
            else:  # every piece that waits is longer: the longest of the tier, or of a longer one, is cut
                below = [t for t in self.tiers if t <= tier and self.waiting[t]]
                t = below[-1] if below else next(t for t in self.tiers if self.waiting[t])
                row, start, ids, n = self._take(t, len(self.waiting[t]) - 1)
                self._wait(row, start + room, ids[room:], n)
                ids = ids[:room]
            taken.append((row, start, ids, n))
            room -= len(ids)
        return taken

    def _emit(self, pieces: list, window: int) -> None:
        offset = 0
        for row, start, ids, n in pieces:
            self.rows.append(
                (row, start, len(ids), zlib.crc32(ids), n, self.sequence, offset, window, self.group, ids)
            )
            offset += len(ids)
        self.sequence += 1
        self.room -= window
        if self.room <= 0:
            self.group, self.room = self.group + 1, STEP_WINDOWS * self.tiers[-1]

    def finish(self) -> None:
        """Full windows as long as they can be filled, then falling powers of two."""
        self._close_windows(0, 0)
        rest = [self._take(t, len(self.waiting[t]) - 1) for t in reversed(self.tiers) for _ in range(len(self.waiting[t]))]
        left = sum(len(p[2]) for p in rest)
        window = self.tiers[-1]
        while left:
            while window > left and window > LEAST_WINDOW:
                window //= 2
            if window > left:  # the one padded window of this task
                window = self.tiers[-1]
            room, taken = window, []
            while rest and room:
                row, start, ids, n = rest.pop(0)
                taken.append((row, start, ids[:room], n))
                if len(ids) > room:
                    rest.insert(0, (row, start + room, ids[room:], n))
                room -= len(taken[-1][2])
            left -= window - room
            self._emit(taken, window)

    def flush(self, with_ids: bool) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * len(PIECES)
        arrays = [pa.array(c, f.type) for c, f in zip(columns[:-1], PIECES, strict=False)]
        if with_ids:
            arrays.append(pa.array(list(columns[-1]), PIECES.field("ids").type))
        self.rows = []
        return pa.RecordBatch.from_arrays(arrays, names=PIECES.names[: len(arrays)])


def _pack(batches, ranks_path, pattern, added, tiers, with_ids) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    encoding = load_encoding(ranks_path, pattern, added)
    packer = _Packer(TaskContext.get().partitionId() << 33, tiers)
    end = np.array([END_ID], "<u4")
    for batch in batches:
        rows, texts = batch.column(0), batch.column(1)
        for i in range(batch.num_rows):
            body = texts[i].as_py() or ""
            some = any(token in body for token, _ in added)
            # encode() parts the text at its added tokens, as the tokenizer file does.
            found = encoding.encode(body, allowed_special="all") if some else encoding.encode_ordinary(body)
            ids = np.array(found, "<u4")
            packer.add(rows[i].as_py(), np.concatenate([ids, end]))
            if len(packer.rows) >= ROWS_PER_BATCH:
                yield packer.flush(with_ids)
    packer.finish()
    yield packer.flush(with_ids)


def pack(
    docs: DataFrame,
    ranks_path: str | None = None,
    pattern: str | None = None,
    text: str = "text",
    id_column: str = "doc_id",
    tiers: tuple[int, ...] = TIERS,
    with_ids: bool = True,
    tokenizer_path: str | None = None,
) -> DataFrame:
    """One row per piece of a document: where it starts, its ids and its place.

    With ``tokenizer_path`` ids are those of that file at its defaults: its
    added tokens are one id wherever a text holds them. Without it there are
    no added tokens, and their strings are ordinary text.
    A document is the ids of its text (null: empty) and then END_ID, so every
    row has at least one id; an empty table gives no rows. Rows with equal or
    null document ids are documents of their own. Other columns of ``docs`` are
    not carried. ``window`` is the length a sequence is padded to, ``step_group``
    numbers groups of equal token budget (STEP_WINDOWS of the longest window;
    the last group of a task holds what is left). Sequence numbers combine the task's
    number and a running number; a task that runs again gives the same rows.
    """
    import public_tokenizers

    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    shape = pattern or public_tokenizers.PATTERN
    added = tuple(sorted(added_tokens(tokenizer_path).items())) if tokenizer_path else ()
    types = [T.LongType()] * 7 + [T.IntegerType(), T.LongType(), T.ArrayType(T.IntegerType())]
    fields = [T.StructField(n, t) for n, t in zip(PIECES.names, types, strict=True)]
    if not with_ids:
        fields.pop()
    fields[0] = T.StructField(id_column, T.LongType())

    def run(batches):
        for batch in _pack(batches, path, shape, added, tiers, with_ids):
            arrays = list(batch.columns)
            if with_ids:
                arrays[-1] = arrays[-1].cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])

    body = docs.select(docs[id_column].cast("long").alias(id_column), docs[text].alias(text))
    return body.mapInArrow(run, T.StructType(fields))
