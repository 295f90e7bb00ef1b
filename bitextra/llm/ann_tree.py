"""Nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on a bounded sample and travels to the executors; every
vector is assigned to a leaf. A query walks the tree through a priority queue,
nearest bin first, and visits as many leaves as a calibration against brute
force over all vectors asks for. Leaves and the queries that visit them are cut
into blocks, so neither a full leaf nor a popular one lands in one task. Equal
vectors are one entry that keeps its smallest ids: no others can be among the
nearest, so a vector with a third of all rows costs as much as any other.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import first_n
from ..session import cut_lineage

# Vectors the tree is fitted on at most, and their bytes at most.
SAMPLE_ROWS = 20_000
SAMPLE_BYTES = 64_000_000
BRANCH = 16
# Vectors a leaf should hold, and the fewest sample vectors that may form one.
LEAF_ROWS = 256
LEAF_SAMPLE = 24
# Queries whose exact neighbours set the number of leaf visits, and the recall they must reach.
CALIBRATION = 200
TARGET_RECALL = 0.98
BLOCK_ROWS = 4096


@dataclass
class Tree:
    """Inner nodes: their children's centres and numbers (a leaf is -1 - number)."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaves: int = 0

    def assign(self, unit: np.ndarray) -> np.ndarray:
        """The leaf of every row, by descent to the nearest centre."""
        out = np.zeros(len(unit), np.int32)
        if not self.centres:
            return out
        todo = [(0, np.arange(len(unit)))]
        while todo:
            node, rows = todo.pop()
            near = np.argmax(unit[rows] @ self.centres[node].T, axis=1)
            for k, child in enumerate(self.children[node]):
                mine = rows[near == k]
                if len(mine):
                    if child < 0:
                        out[mine] = -1 - child
                    else:
                        todo.append((child, mine))
        return out

    def visits(self, query: np.ndarray, wanted: int, sizes: np.ndarray, least: int) -> list[int]:
        """Leaves in best-bin-first order: ``wanted`` of them, more while they hold under ``least`` vectors."""
        if not self.centres:
            return [0]
        queue, held, out = [(-np.inf, 0)], 0, []
        while queue and (len(out) < wanted or held < least):
            _, node = heapq.heappop(queue)
            if node < 0:
                out.append(-1 - node)
                held += int(sizes[-1 - node])
                continue
            for near, child in zip(self.centres[node] @ query, self.children[node], strict=True):
                heapq.heappush(queue, (-float(near), child))
        return out


def _kmeans(unit: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    centres = unit[rng.choice(len(unit), k, replace=False)]
    near = np.zeros(len(unit), int)
    for _ in range(rounds):
        near = np.argmax(unit @ centres.T, axis=1)
        for j in range(k):
            members = unit[near == j]
            if len(members):
                mean = members.mean(0)
                norm = np.linalg.norm(mean)
                centres[j] = mean / norm if norm > 0 else members[0]
    return centres, near


def fit_tree(unit: np.ndarray, leaves: int, seed: int = 7) -> Tree:
    """A tree of about ``leaves`` leaves over unit vectors."""
    tree, rng = Tree(), np.random.default_rng(seed)

    def grow(rows: np.ndarray, share: float) -> int:
        k = int(min(BRANCH, round(share), len(rows) // LEAF_SAMPLE))
        if k < 2:
            tree.leaves += 1
            return -tree.leaves
        centres, near = _kmeans(unit[rows].copy(), k, rng)
        groups = [rows[near == j] for j in range(k)]
        full = [j for j in range(k) if len(groups[j])]
        if len(full) < 2:
            tree.leaves += 1
            return -tree.leaves
        node = len(tree.centres)
        tree.centres.append(centres[full])
        tree.children.append([])
        kids = [grow(groups[j], share * len(groups[j]) / len(rows)) for j in full]
        tree.children[node] = kids
        return node

    if len(unit):
        grow(np.arange(len(unit)), float(leaves))
    tree.leaves = max(1, tree.leaves)
    return tree


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    # Scaled by the largest component first, so that squares neither overflow nor vanish.
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component to at most 1; nothing is rounded
    but what lies 1e300 times below it, and a cosine does not change."""
    _, exponent = np.frexp(np.abs(vectors).max(1, keepdims=True))
    # Two steps, as one factor alone may lie outside the range of numbers.
    half = exponent // 2
    return np.ldexp(np.ldexp(vectors, -half), half - exponent)


def usable(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(vec_id, v) of the rows that take part, each pair once.

    Vectors null, empty, zero or holding null or non-finite components and rows
    without id take no part, nor do vectors of another than the most frequent length.
    """
    v = F.col("v")
    rows = vectors.select(
        F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")
    ).filter(
        F.col("vec_id").isNotNull() & v.isNotNull()
        & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
        & F.exists(v, lambda x: x != 0)
    )
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if size is None:
        return rows
    return cut_lineage(rows.filter(F.size("v") == size["d"]).dropDuplicates(["vec_id", "v"]))


_FOUND = "query_id long, vec_id long, score double"


def nearest(
    vectors: DataFrame,
    queries: DataFrame | None = None,
    k: int = 5,
    id_column: str = "vec_id",
    vector: str = "embedding",
    target_recall: float = TARGET_RECALL,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, by cosine.

    ``queries`` (default: all rows) has the same columns; a query's own id is
    no candidate. Ties go to the smaller id; fewer rows come back only where
    there are fewer candidates. Repeated (id, vector) rows count once; other
    columns are ignored; an empty table gives an empty result.
    """
    base = usable(vectors, id_column, vector)
    asked = base if queries is None else usable(queries, id_column, vector)
    spark = vectors.sparkSession
    # Equal vectors are one entry with its k + 1 smallest ids (one may be the query's own).
    ids = first_n(base, ["v"], [F.col("vec_id")], k + 1, F.col("vec_id"))
    entries = cut_lineage(ids.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    n = entries.count()
    schema = T._parse_datatype_string("query_id long, rank int, vec_id long, score double")
    if n == 0:
        return spark.createDataFrame([], schema)

    dimension = len(entries.first()["v"])
    rows = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dimension)))
    picked = entries.orderBy(F.xxhash64("v"), "v").limit(rows).select("v").toArrow()
    sample = _unit(_matrix(picked.column("v")))
    tree = fit_tree(sample, max(1, n // LEAF_ROWS))

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                leaf = tree.assign(_unit(_matrix(batch.column(0))))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(leaf, pa.int32())], names=["v", "ids", "leaf"]
                )

    index = cut_lineage(entries.mapInArrow(place, "v array<double>, ids array<long>, leaf int"))
    # One row per leaf: bounded by the sample, whatever the number of vectors.
    sizes = np.zeros(tree.leaves, np.int64)
    for r in index.groupBy("leaf").count().collect():
        sizes[r["leaf"]] = r["count"]
    wanted = _calibrate(index, asked, tree, sizes, k, target_recall)

    def route(batches):
        for batch in batches:
            if batch.num_rows:
                unit = _unit(_matrix(batch.column(1)))
                leaves = [tree.visits(q, wanted, sizes, k + 1) for q in unit]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(leaves, pa.list_(pa.int32()))], names=["vec_id", "v", "leaves"]
                )

    routed = asked.select("vec_id", "v").mapInArrow(route, "vec_id long, v array<double>, leaves array<int>")
    visits = cut_lineage(
        routed.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.explode("leaves").alias("leaf"))
    )
    found = _search(index, visits, sizes, k)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _calibrate(index, asked, tree: Tree, sizes, k: int, target: float) -> int:
    """Leaf visits after which sampled queries have found ``target`` of their exact neighbours."""
    table = asked.orderBy(F.xxhash64(F.lit(3), "vec_id"), "vec_id").limit(CALIBRATION).select("v").distinct().toArrow()
    if not table.num_rows or tree.leaves == 1:
        return 1
    queries = _unit(_matrix(table.column("v")))

    def exact(batches):
        best: list = [[] for _ in queries]
        for batch in batches:
            if not batch.num_rows:
                continue
            near = _unit(_matrix(batch.column(0))) @ queries.T
            leaf = batch.column(1).to_numpy()
            top = np.argsort(-near, axis=0, kind="stable")[: k + 1]
            for j in range(len(queries)):
                best[j] = heapq.nlargest(k + 1, best[j] + [(float(near[i, j]), int(leaf[i])) for i in top[:, j]])
        rows = [(j, s, leaf) for j, b in enumerate(best) for s, leaf in b]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.float64(), pa.int32()), strict=True)],
                names=["q", "s", "leaf"],
            )

    found = index.select("v", "leaf").mapInArrow(exact, "q int, s double, leaf int")
    order = Window.partitionBy("q").orderBy(F.desc("s"), "leaf")
    true = found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1).collect()
    rank = [{leaf: i for i, leaf in enumerate(tree.visits(q, tree.leaves, sizes, 0))} for q in queries]
    needed = np.array([rank[r["q"]][r["leaf"]] + 1 for r in true])
    # Widen until enough of the exact neighbours lie in visited leaves.
    wanted = 1
    while (needed <= wanted).mean() < target and wanted < tree.leaves:
        wanted += 1
    return wanted


def _search(index, visits, sizes: np.ndarray, k: int) -> DataFrame:
    """The k best of every (query, leaf block); both sides of a leaf are cut into blocks."""
    spark = index.sparkSession
    asked = {r["leaf"]: r["count"] for r in visits.groupBy("leaf").count().collect()}
    plan = spark.createDataFrame(
        [(i, max(1, -(-int(s) // BLOCK_ROWS)), max(1, -(-asked.get(i, 0) // BLOCK_ROWS))) for i, s in enumerate(sizes)],
        "leaf int, vs int, qs int",
    )
    # One row per leaf, bounded by the sample the tree was fitted on.
    plan = F.broadcast(plan)
    left = index.join(plan, "leaf").withColumns(
        {"vb": F.pmod(F.xxhash64("v"), "vs").cast("int"), "qb": F.explode(F.sequence(F.lit(0), F.col("qs") - 1))}
    )
    right = visits.join(plan, "leaf").withColumns(
        {"qb": F.pmod(F.xxhash64("query_id"), "qs").cast("int"), "vb": F.explode(F.sequence(F.lit(0), F.col("vs") - 1))}
    )

    def match(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        ids, scores, asked_by = [], [], []
        if vectors.num_rows and queries.num_rows:
            v, q = _matrix(vectors.column("v")), _matrix(queries.column("q"))
            owned = vectors.column("ids").to_pylist()
            query_ids = queries.column("query_id").to_pylist()
            unit = _unit(v)
            near = _unit(q) @ unit.T
            v, q = _scaled(v), _scaled(q)
            keep = min(k + 1, len(v))
            edge = np.partition(near, len(v) - keep, axis=1)[:, len(v) - keep]
            norms = np.sqrt(np.einsum("ij,ij->i", v, v))
            for i, query in enumerate(query_ids):
                # Entries within rounding of the last place stay in; the score below decides.
                at = np.flatnonzero(near[i] >= edge[i] - 1e-12)
                exact = np.einsum("ij,j->i", v[at], q[i]) / (norms[at] * np.sqrt(np.einsum("i,i->", q[i], q[i])))
                pairs = [(-s, x) for s, e in zip(exact.tolist(), at, strict=True) for x in owned[e] if x != query]
                for s, x in heapq.nsmallest(k, pairs):
                    asked_by.append(query)
                    ids.append(x)
                    scores.append(-s)
        return pa.table(
            {"query_id": pa.array(asked_by, pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.float64())}
        )

    keys = ("leaf", "vb", "qb")
    return (
        left.select(*keys, "v", "ids").groupBy(*keys)
        .cogroup(right.select(*keys, "query_id", "q").groupBy(*keys))
        .applyInArrow(match, _FOUND)
    )
