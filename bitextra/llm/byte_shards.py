"""Byte-balanced sharding by histogram sort, in DataFrame operations only.

Rows are ordered by (hash of the text, row number). Candidate boundaries are
cells of the hash: each round counts the exact bytes of every cell around the
open boundaries, keeps the cell in which each wanted byte position falls and
cuts it finer, until the boundary is within the tolerance or the hash is used
up. A text whose copies alone are larger than the tolerance is then cut by row
number in the same way. Only cell totals reach the driver: at most
``(shards - 1) * 2**BITS`` rows a round, whatever the size of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

# Bits of the order key that one round resolves: 2**BITS probes per open boundary.
BITS = 10
HASH_BITS = 60
ROW_BITS = 60
ROW_OVERHEAD = 16


def _cell(key: Column, used: int) -> Column:
    """The leading ``used`` bits of a non-negative key of HASH_BITS bits."""
    return F.shiftright(key, HASH_BITS - used)


def find_splitters(keys: DataFrame, shards: int, tolerance: float = 0.001) -> list[tuple[int, int]]:
    """Lower bounds (h, rid) of the shards 1 .. shards - 1.

    ``keys`` holds h and rid (both 0 .. 2**60 - 1) and size. A boundary is
    final when the bytes before it differ from its target by at most
    ``tolerance`` of a shard, or when a single row is all that is left to cut.
    An empty table gives boundaries past every key.
    """
    total = keys.agg(F.sum("size").alias("n")).first()["n"] or 0
    top = (1 << HASH_BITS, 0)
    if total == 0:
        return [top] * (shards - 1)
    slack = tolerance * total / shards
    # One open boundary: wanted byte position, fixed hash or None, prefix, bits used, bytes before.
    open_ = {k: (total * k / shards, None, 0, 0, 0) for k in range(1, shards)}
    found: dict[int, tuple[int, int]] = {}
    while open_:
        groups: dict[tuple, list[int]] = {}
        for k, (_, h, prefix, used, _) in open_.items():
            groups.setdefault((h, prefix, used), []).append(k)
        parts = []
        by_kind: dict[tuple, list[tuple]] = {}
        for h, prefix, used in groups:
            by_kind.setdefault((h is None, used), []).append((h, prefix))
        for (on_hash, used), members in by_kind.items():
            key = F.col("h") if on_hash else F.col("rid")
            fixed = F.lit(-1).cast("long") if on_hash else F.col("h")
            rows = keys
            if on_hash and used:
                rows = keys.filter(_cell(key, used).isin([p for _, p in members]))
            elif not on_hash:
                hit = F.lit(False)
                for h, p in members:
                    hit = hit | ((F.col("h") == h) & (_cell(key, used) == p))
                rows = keys.filter(hit)
            parts.append(
                rows.groupBy(
                    fixed.alias("fixed"), F.lit(used).alias("used"), _cell(key, used + BITS).alias("cell")
                ).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
            )
        cells = parts[0]
        for more in parts[1:]:
            cells = cells.unionByName(more)
        tables: dict[tuple, list[tuple[int, int, int]]] = {}
        for r in cells.collect():
            h = None if r["fixed"] < 0 else r["fixed"]
            tables.setdefault((h, r["cell"] >> BITS, r["used"]), []).append((r["cell"], r["bytes"], r["rows"]))
        for group, members in groups.items():
            table = sorted(tables.get(group, []))
            for k in members:
                want, h, prefix, used, before = open_.pop(k)
                for cell, size, rows in table:
                    if before + size > want:
                        break
                    before += size
                else:  # only by rounding: everything lies before
                    cell, size, rows = ((prefix + 1) << BITS), 0, 0
                bits = used + BITS
                low = cell << (HASH_BITS - bits)
                high = (cell + 1) << (HASH_BITS - bits)
                after = before + size
                if want - before <= slack or (rows == 1 and want - before <= after - want):
                    found[k] = (low, 0) if h is None else (h, low)
                elif after - want <= slack or rows == 1:
                    found[k] = (high, 0) if h is None else (h, high)
                elif bits < HASH_BITS:
                    open_[k] = (want, h, cell, bits, before)
                elif h is None:  # one text holds more than the slack: cut by row
                    open_[k] = (want, cell, 0, 0, before)
                else:  # a single row
                    found[k] = (h, low)
    out = [found[k] for k in range(1, shards)]
    return [max(out[: i + 1]) for i in range(len(out))]


def assign_shards(
    docs: DataFrame,
    shards: int = 40,
    tolerance: float = 0.001,
    text: str = "text",
    keep_text: bool = False,
) -> DataFrame:
    """``docs`` with size, text_crc32, shard and slot; its text only if asked for.

    Law ``bytes``: size is the UTF-8 length of the text (null: none) plus 16,
    and the shards differ by about ``tolerance`` of a shard or one row. Rows of
    equal text lie next to each other, hence in one shard unless a boundary has
    to cut the group. Slots run from 0 within a shard without gaps. Null and
    empty texts are ordinary (equal) texts; repeated rows keep a row each; an
    empty table gives an empty result. Other columns are kept; helper names
    start with ``_shard_`` and an input column of a result's name is replaced.
    """
    body = F.col(text)
    size = (F.coalesce(F.octet_length(body), F.lit(0)) + F.lit(ROW_OVERHEAD)).cast("long")
    mask = F.lit((1 << HASH_BITS) - 1).cast("long")
    dropped = set() if keep_text else {text}
    kept = [c for c in docs.columns if c not in dropped | {"size", "text_crc32", "law", "shard", "slot", "grown_shard"}]
    keyed = docs.select(
        *kept,
        size.alias("size"),
        F.when(body.isNull(), F.crc32(F.lit(b""))).otherwise(F.crc32(body)).alias("text_crc32"),
        F.xxhash64(F.coalesce(body, F.lit(""))).bitwiseAND(mask).alias("_shard_h"),
        F.monotonically_increasing_id().alias("_shard_rid"),
    )
    # Written once: row numbers stay what they are when a task runs again.
    keyed = cut_lineage(keyed)
    keys = keyed.select(F.col("_shard_h").alias("h"), F.col("_shard_rid").alias("rid"), "size")
    splitters = find_splitters(keys, shards, tolerance)
    # Splitters are few: the shard is the number of lower bounds at or below the row.
    bounds = F.array(
        *[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in splitters]
    ) if splitters else None
    here = F.struct(F.col("_shard_h").alias("a"), F.col("_shard_rid").alias("b"))
    shard = F.size(F.filter(bounds, lambda x: x <= here)) if splitters else F.lit(0)
    return _with_slots(keyed.withColumn("shard", shard.cast("int")))


def _with_slots(rows: DataFrame) -> DataFrame:
    """Gapless slots by (hash, row) although a shard is far more than one task.

    A shard is cut into cells of the hash; a cell that one text fills is cut
    further by the file split its rows came from. Offsets of the cells are a
    running sum over the cell totals.
    """
    cell = F.shiftright(F.col("_shard_h"), HASH_BITS - 16)
    total = rows.groupBy(cell.alias("_shard_cell")).agg(F.count(F.lit(1)).alias("n"))
    n = total.agg(F.sum("n").alias("n")).first()["n"] or 0
    # A share of all rows bounds the number of hot cells by itself.
    hot = [r["_shard_cell"] for r in total.filter(F.col("n") > max(2000, n // 2000)).collect()]
    split = F.when(cell.isin(hot), F.shiftright(F.col("_shard_rid"), 33)).otherwise(F.lit(-1)) if hot else F.lit(-1)
    h = F.when(cell.isin(hot), F.col("_shard_h")).otherwise(F.lit(-1)) if hot else F.lit(-1)
    cut = rows.withColumns(
        {"_shard_cell": cell, "_shard_hot": h.cast("long"), "_shard_split": split.cast("long")}
    )
    keys = ["shard", "_shard_cell", "_shard_hot", "_shard_split"]
    counts = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("_shard_n"))
    before = Window.partitionBy("shard").orderBy(*keys[1:]).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, F.coalesce(F.sum("_shard_n").over(before), F.lit(0)).alias("_shard_start"))
    inner = Window.partitionBy(*keys).orderBy("_shard_h", "_shard_rid")
    ranked = cut.withColumn("_shard_at", F.row_number().over(inner) - 1)
    return (
        ranked.join(starts, keys)
        .withColumn("slot", (F.col("_shard_start") + F.col("_shard_at")).cast("long"))
        .drop(*keys[1:], "_shard_h", "_shard_rid", "_shard_start", "_shard_at")
    )
