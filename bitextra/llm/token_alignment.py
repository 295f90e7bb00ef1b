"""Alignment of two tokenizers over the same bytes, by divide and conquer at shared cuts.

Both tokenizers spell the same bytes; a byte offset at which tokens of both
end is a cut. An interval of tokens is parted at a cut near its middle, found
by trying the ends around the middle and bisecting the other side's ends for
each; both halves are treated alike, and an interval without an inner cut is a
leaf group. The intervals of one level, of all texts of a block, are handled
together, so a text of any length takes about logarithmic many steps.

A group links each of its tokens of one side with each of the other. Linked id
pairs are counted by documents over the whole corpus: sums within a task, then
one shuffle. Each text's links are then looked up: the most frequent pairs, a
fixed number whatever the corpus, travel to the texts; the links of all other
pairs are shuffled to their counts, and none of those is a hot key.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path
from .words import blocks

# Pairs whose counts travel to the texts (16 bytes each); links of all others are shuffled.
HOT_PAIRS = 1 << 18
# Ends tried around the middle before the whole interval is bisected.
PROBES = (0, 1, -1, 2, -2)
# A group of more links is linked by its distinct ids and their numbers.
WIDE_GROUP = 4096
# Link codes counted together, and distinct ones held by a task.
CODES_AT_ONCE = 2_000_000
CODES_HELD = 2_000_000

_ALIGNED = (
    "row_no long, row_id long, n_a long, n_b long, n_groups long, n_links long, "
    "groups_sha256 string, groups string, pairs binary, times binary"
)


def _byte_level() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def byte_level_tokens(path: str) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary file."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    table = _byte_level()
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, number in vocabulary.items():
        if all(c in table for c in token):
            out[number] = bytes(table[c] for c in token)
    return out


def piece_tokens(model) -> list[bytes]:
    """The bytes of every id of a piece model: blanks restored, <0xHH> as its byte."""
    out = []
    for number in range(model.get_piece_size()):
        piece = model.id_to_piece(number)
        if model.is_byte(number):
            out.append(bytes([int(piece[3:5], 16)]))
        else:
            out.append(piece.replace("▁", " ").encode())
    return out


class Pair:
    """Both tokenizers, the bytes of their ids and the printed ids."""

    def __init__(self, byte_path: str, ranks_path: str | None, pattern: str | None, piece_path: str):
        import sentencepiece

        self.piece = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.a_bytes, self.b_bytes = byte_level_tokens(byte_path), piece_tokens(self.piece)
        if ranks_path:  # the same vocabulary as ranks, which encodes faster
            from .packing import load_encoding

            self.plain = load_encoding(ranks_path, pattern).encode_ordinary
        else:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(byte_path)
            whole.encode_special_tokens = True  # their strings within texts are plain text
            self.plain = lambda text: whole.encode(text, add_special_tokens=False).ids
        self.a_length = np.array([len(x) for x in self.a_bytes])
        self.b_length = np.array([len(x) for x in self.b_bytes])
        # Printed ids with what follows them: A within and at the end of its side, then B.
        self.printed = [f"{i}{s}" for s, n in ((",", "a"), ("|", "a"), (",", "b"), (";", "b"))
                        for i in range(len(self.a_bytes if n == "a" else self.b_bytes))]

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """The ids of both sides, or None where they do not spell the text after a blank."""
        spelt_a, spelt_b = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        for text, b in zip(texts, self.piece.encode(texts, num_threads=1), strict=True):
            a, data = self.plain(" " + text), (" " + text).encode()
            if b"".join(map(spelt_a, a)) == data and b"".join(map(spelt_b, b)) == data:
                yield np.array(a, np.int64), np.array(b, np.int64)
            else:
                yield None


@lru_cache(maxsize=2)
def load_pair(byte_path: str, ranks_path: str | None, pattern: str | None, piece_path: str) -> Pair:
    return Pair(byte_path, ranks_path, pattern, piece_path)


def leaf_groups(
    ends_a: np.ndarray, ends_b: np.ndarray, starts_a: np.ndarray, starts_b: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """First tokens (A, B) of the leaf groups of one or several texts.

    ``ends`` rise through all texts; ``starts`` number each text's first token
    and, at last, the tokens there are. Both sides of a text have the same last end.
    """
    lo, hi, blo, bhi = starts_a[:-1], starts_a[1:], starts_b[:-1], starts_b[1:]
    leaves = []

    def cut_at(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        other = np.searchsorted(ends_b, ends_a[at])
        return other, ends_b[other] == ends_a[at]

    while len(lo):
        whole = (hi - lo < 2) | (bhi - blo < 2)
        leaves.append((lo[whole], blo[whole]))
        lo, hi, blo, bhi = lo[~whole], hi[~whole], blo[~whole], bhi[~whole]
        middle = lo + (hi - lo) // 2 - 1
        cut, there = np.full(len(lo), -1), np.zeros(len(lo), np.int64)
        open_ = np.arange(len(lo))
        for probe in PROBES:
            at = middle[open_] + probe
            inside = (at >= lo[open_]) & (at < hi[open_] - 1)
            tried, at = open_[inside], at[inside]
            other, hit = cut_at(at)
            cut[tried[hit]], there[tried[hit]] = at[hit], other[hit]
            open_ = open_[cut[open_] < 0]
            if not len(open_):
                break
        # Those not tried to their ends: every end is bisected, the cut next to the middle taken.
        for k in open_[hi[open_] - lo[open_] - 1 > len(PROBES)]:
            at = np.arange(lo[k], hi[k] - 1)
            other, hit = cut_at(at)
            if hit.any():
                best = np.flatnonzero(hit)[np.argmin(np.abs(at[hit] - middle[k]))]
                cut[k], there[k] = at[best], other[best]
        none = cut < 0
        leaves.append((lo[none], blo[none]))
        lo, hi, blo, bhi, cut, there = (x[~none] for x in (lo, hi, blo, bhi, cut, there))
        lo, hi = np.concatenate([lo, cut + 1]), np.concatenate([cut + 1, hi])
        blo, bhi = np.concatenate([blo, there + 1]), np.concatenate([there + 1, bhi])
    first_a = np.concatenate([x for x, _ in leaves]) if leaves else np.empty(0, np.int64)
    first_b = np.concatenate([x for _, x in leaves]) if leaves else np.empty(0, np.int64)
    order = np.argsort(first_a)
    return first_a[order], first_b[order]


def _links(a, b, first_a, first_b, doc, width) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, code, times) of the links of all groups, in that order, each code once a document."""
    size_a = np.diff(first_a, append=len(a))
    size_b = np.diff(first_b, append=len(b))
    number = size_a * size_b
    wide = number > WIDE_GROUP
    docs, codes, times = [], [], []
    narrow = np.flatnonzero(~wide)
    count = number[narrow]
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    group = np.repeat(narrow, count)
    codes.append(a[first_a[group] + at // size_b[group]] * width + b[first_b[group] + at % size_b[group]])
    docs.append(doc[group])
    times.append(np.ones(len(group), np.int64))
    for g in np.flatnonzero(wide):
        ids_a, n_a = np.unique(a[first_a[g] : first_a[g] + size_a[g]], return_counts=True)
        ids_b, n_b = np.unique(b[first_b[g] : first_b[g] + size_b[g]], return_counts=True)
        codes.append((ids_a[:, None] * width + ids_b).ravel())
        times.append((n_a[:, None] * n_b).ravel())
        docs.append(np.full(len(codes[-1]), doc[g]))
    key = (np.concatenate(docs) << 40) | np.concatenate(codes)
    order = np.argsort(key, kind="stable")
    key, n = key[order], np.concatenate(times)[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    key = key[first]
    n = np.add.reduceat(n, first) if len(first) else n
    return key >> 40, key & ((1 << 40) - 1), n


def _printed(pair: Pair, a, b, first_a, first_b) -> str:
    """``a1,a2|b1;a3|b2,b3`` of one text whose groups begin at ``first``."""
    na, nb = len(pair.a_bytes), len(pair.b_bytes)
    last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    next_a, next_b = np.append(first_a[1:], len(a)), np.append(first_b[1:], len(b))
    last_a[next_a - 1] = 1
    last_b[next_b - 1] = 1
    out = np.empty(len(a) + len(b), np.int64)
    out[np.arange(len(a)) + np.repeat(first_b, next_a - first_a)] = a + na * last_a
    out[np.arange(len(b)) + np.repeat(next_a, next_b - first_b)] = b + 2 * na + nb * last_b
    return "".join(map(pair.printed.__getitem__, out.tolist()))[:-1]


def _aligned_block(pair: Pair, texts: list[str | None], code_type: str, with_groups: bool) -> list[list]:
    """Columns from n_a on for each text of a block."""
    some = [i for i, t in enumerate(texts) if t]
    found = [(i, x) for i, x in zip(some, pair.encode([texts[i] for i in some]), strict=True) if x] if some else []
    n = len(texts)
    out = [[0] * n, [0] * n, [0] * n, [0] * n, [""] * n, [""] * n, [b""] * n, [b""] * n]
    if not found:
        return out
    width = len(pair.b_bytes)
    a, b = np.concatenate([x[0] for _, x in found]), np.concatenate([x[1] for _, x in found])
    starts_a = np.cumsum([0] + [len(x[0]) for _, x in found])
    starts_b = np.cumsum([0] + [len(x[1]) for _, x in found])
    first_a, first_b = leaf_groups(np.cumsum(pair.a_length[a]), np.cumsum(pair.b_length[b]), starts_a, starts_b)
    doc = np.searchsorted(starts_a, first_a, "right") - 1
    groups = np.searchsorted(doc, np.arange(len(found) + 1))
    owner, codes, times = _links(a, b, first_a, first_b, doc, width)
    links = np.searchsorted(owner, np.arange(len(found) + 1))
    for k, (i, _) in enumerate(found):
        ga, gb = slice(starts_a[k], starts_a[k + 1]), slice(starts_b[k], starts_b[k + 1])
        mine = slice(groups[k], groups[k + 1])
        text = _printed(pair, a[ga], b[gb], first_a[mine] - starts_a[k], first_b[mine] - starts_b[k])
        own = slice(links[k], links[k + 1])
        out[0][i], out[1][i] = ga.stop - ga.start, gb.stop - gb.start
        out[2][i], out[3][i] = mine.stop - mine.start, int(times[own].sum())
        out[4][i] = hashlib.sha256(text.encode()).hexdigest()
        out[5][i] = text if with_groups else ""
        out[6][i] = codes[own].astype(code_type).tobytes()
        out[7][i] = times[own].astype("<u4").tobytes()
    return out


def _counted(batches, code_type: str) -> Iterator[pa.RecordBatch]:
    """(code, n): in how many rows a code stands, summed within the task as far as it holds."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merge() -> tuple[np.ndarray, np.ndarray]:
        codes = np.concatenate([c for c, _ in held])
        counts = np.concatenate([n for _, n in held])
        order = np.argsort(codes, kind="stable")
        codes = codes[order]
        first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        return codes[first], np.add.reduceat(counts[order], first)

    def rows(codes, counts):
        return pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(counts)], names=["code", "n"])

    for batch in batches:
        parts, size = [], 0
        column = batch.column(0)
        for i in range(batch.num_rows + 1):
            if i < batch.num_rows:
                parts.append(np.frombuffer(column[i].as_buffer(), code_type))
                size += len(parts[-1])
            if size and (size > CODES_AT_ONCE or i == batch.num_rows):
                codes, counts = np.unique(np.concatenate(parts), return_counts=True)
                held.append((codes, counts.astype(np.int64)))
                parts, size = [], 0
                if sum(len(c) for c, _ in held) > 2 * CODES_HELD:
                    held = [merge()]
                    if len(held[0][0]) > CODES_HELD:
                        yield rows(*held.pop())
    if held:
        yield rows(*merge())


def _looked_up(batches, code_type: str, hot, best, width: int) -> Iterator[pa.RecordBatch]:
    """Sums over the links of each row whose pairs travelled, and the other links."""
    hot_codes, hot_counts = hot
    for batch in batches:
        sums, hits, rest_codes, rest_times = [], [], [], []
        for i in range(batch.num_rows):
            codes = np.frombuffer(batch.column(1)[i].as_buffer(), code_type).astype(np.int64)
            times = np.frombuffer(batch.column(2)[i].as_buffer(), "<u4").astype(np.int64)
            at = np.searchsorted(hot_codes, codes)
            at[at == len(hot_codes)] = 0
            known = hot_codes[at] == codes if len(hot_codes) else np.zeros(len(codes), bool)
            count = hot_counts[at[known]]
            sums.append(int(count @ times[known]))
            hits.append(int(times[known][count == best[codes[known] // width]].sum()))
            rest_codes.append(codes[~known])
            rest_times.append(times[~known])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(hits, pa.int64()), pa.array(sums, pa.int64()),
             pa.array(rest_codes, pa.list_(pa.int64())), pa.array(rest_times, pa.list_(pa.int64()))],
            names=["row_no", "n_best", "count_sum", "codes", "times"],
        )


def align(
    docs: DataFrame, text: str = "text", id_column: str = "doc_id", byte_path: str | None = None,
    ranks_path: str | None = None, pattern: str | None = None, piece_path: str | None = None,
    with_groups: bool = True, hot_pairs: int = HOT_PAIRS,
) -> DataFrame:
    """Each row by its id: n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups.

    A is a byte-level vocabulary over a blank and the text, B a piece model over
    the text, to which it adds the blank; strings of special tokens are plain
    text. ``ranks_path`` is A's vocabulary as ranks, encoded faster, to the
    same ids. ``groups`` prints the ids of each group (``a1,a2|b1;a3|b2,b3``),
    empty if not ``with_groups``. The count of an id pair is the number of rows
    in which it is linked; ``n_best`` counts the links whose pair has the
    highest count of its A id, ties included, ``count_sum`` adds the counts of
    all links. Texts that are null or empty, and those which either side does
    not spell byte by byte, have no tokens, zeros and empty strings. Rows of
    equal or null ids are rows of their own; other columns are ignored; an
    empty table gives no rows.
    """
    import public_tokenizers as P

    spark = docs.sparkSession
    own = byte_path is None
    files = (
        byte_path or P.path("byte_bpe_50k.json"),
        ranks_path or (P.path("byte_bpe_50k.tiktoken") if own else None),
        pattern or (P.PATTERN if own else None),
        piece_path or P.path("piece_bpe_32k.model"),
    )
    pair = load_pair(*files)
    width = len(pair.b_bytes)
    code_type = "<u4" if len(pair.a_bytes) * width <= 1 << 32 else "<i8"
    if len(pair.a_bytes) * width > 1 << 40:
        raise ValueError("the two vocabularies have too many pairs of ids")

    def aligned(batches):
        from pyspark import TaskContext

        both, row = load_pair(*files), TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for first, last, _ in blocks(texts):
                columns = _aligned_block(both, texts[first:last], code_type, with_groups)
                n = last - first
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.binary()] * 2
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + n)), batch.column(0).slice(first, n),
                     *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                    names=[x.split()[0] for x in _ALIGNED.split(", ")],
                )
                row += n

    body = docs.select(F.col(id_column).cast("long").alias("row_id"), F.col(text).alias("text"))
    # The links of every text, written once; both later passes read them.
    path = scratch_path(spark, "links")
    body.mapInArrow(aligned, _ALIGNED).write.option("compression", "zstd").parquet(path)
    rows = spark.read.schema(_ALIGNED).parquet(path)

    partial = rows.select("pairs").mapInArrow(lambda it: _counted(it, code_type), "code long, n long")
    counts = cut_lineage(partial.groupBy("code").agg(F.sum("n").alias("n")))
    a_id = F.floor(F.col("code") / width)
    # One number per id of A: bounded by its vocabulary.
    highest = counts.groupBy(a_id.alias("a")).agg(F.max("n").alias("top"))
    tops = highest.toArrow()
    best = np.zeros(len(pair.a_bytes), np.int64)
    best[tops.column("a").to_numpy()] = tops.column("top").to_numpy()
    # Steps of counts, a few hundred rows: from which step on do hot_pairs pairs suffice?
    step = F.floor(F.log2("n") * 8)
    steps = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("pairs")).orderBy(F.desc("step")).collect()
    least, total = None, 0
    for s in steps:
        total += s["pairs"]
        if total > hot_pairs:
            break
        least = s["step"]
    all_hot = total <= hot_pairs
    # Never more than hot_pairs rows.
    top = counts.filter(step >= least).orderBy("code").toArrow() if least is not None else None
    hot = (top.column("code").to_numpy(), top.column("n").to_numpy()) if top else (np.empty(0, np.int64),) * 2
    sent = spark.sparkContext.broadcast((hot, best))

    def looked_up(batches):
        return _looked_up(batches, code_type, *sent.value, width)

    known = rows.select("row_no", "pairs", "times").mapInArrow(
        looked_up, "row_no long, n_best long, count_sum long, codes array<long>, times array<long>"
    )
    known = cut_lineage(known)
    sums = known.select("row_no", "n_best", "count_sum")
    if not all_hot:
        loose = known.select("row_no", F.explode(F.arrays_zip("codes", "times")).alias("x"))
        rest = counts if least is None else counts.filter(step < least)
        met = loose.select("row_no", F.col("x.codes").alias("code"), F.col("x.times").alias("times")).join(rest, "code")
        rated = met.withColumn("a", a_id).join(highest, "a")
        more = rated.groupBy("row_no").agg(
            F.sum(F.when(F.col("n") == F.col("top"), F.col("times")).otherwise(0)).alias("n_best"),
            F.sum(F.col("n") * F.col("times")).alias("count_sum"),
        )
        sums = sums.union(more).groupBy("row_no").agg(
            F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")
        )
    return rows.join(sums, "row_no").select(
        F.col("row_id").alias(id_column), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
        "groups_sha256", "groups",
    )
