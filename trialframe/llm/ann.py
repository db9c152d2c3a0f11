"""Approximate nearest neighbours: a forest of random-projection trees.

The forest is fitted on a bounded sample; then every row is put into one leaf of each tree. A query walks all
trees through one priority queue, the nearest side of a split first, until it has visited enough leaves. Leaves
and visits meet in a join, and the rows of a leaf are ranked by their exact inner products.

Inner products become angles: a row of norm r gets one more component sqrt(R * R - r * r), where R is the
largest norm, and a query, scaled to the norm R too, gets 0. How many leaves a query visits is measured: so many
that rows of the sample, searched for each other, find enough of their true neighbours. Data with structure need
few; where near neighbours are hardly nearer than others, as in 64 dimensions without clusters, most are needed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import small_batches, written
from .topk import best, matrix, usable

#: Rows that the forest is fitted on at most; trees, and leaves of each, of LEAF_ROWS rows or more. What a query
#: visits does not depend on the size of the table; only the leaves grow.
FIT_ROWS = 32_768
TREES = 10
LEAVES = 64
LEAF_ROWS = 32
#: Recall that rows of the sample must reach among each other, and how many of them are searched for.
RECALL = 0.93
PROBES = 128
#: Rows of a leaf that one task holds.
HELD_ROWS = 4096


@dataclass
class Tree:
    """Inner nodes 0.. have a direction, a threshold and two children; a child ~i is the leaf i."""

    directions: np.ndarray
    thresholds: np.ndarray
    children: np.ndarray
    leaves: int


def grow(sample: np.ndarray, leaf: float, seed: int) -> Tree:
    """A tree over ``sample`` whose leaves hold at most ``leaf`` of its rows.

    A split's direction is the difference of two random rows, its threshold the median. Equal rows that no
    direction parts stay together.
    """
    rng = np.random.default_rng(seed)
    directions, thresholds, children, leaves = [], [], [], 0
    stack: list[tuple[np.ndarray, tuple[int, int] | None]] = [(np.arange(len(sample)), None)]
    while stack:
        rows, parent = stack.pop()
        split = None
        for _ in range(4 if len(rows) > leaf else 0):
            a, b = rng.choice(rows, 2, replace=False)
            direction = sample[a] - sample[b]
            norm = float(np.linalg.norm(direction))
            if norm > 1e-12:
                at = sample[rows] @ (direction / norm)
                threshold = float(np.median(at))
                right = at > threshold
                if 0 < right.sum() < len(rows):
                    split = direction / norm, threshold, right
                    break
        if split is None:
            name, leaves = ~leaves, leaves + 1
        else:
            name = len(directions)
            directions.append(split[0])
            thresholds.append(split[1])
            children.append([0, 0])
            stack += [(rows[~split[2]], (name, 0)), (rows[split[2]], (name, 1))]
        if parent:
            children[parent[0]][parent[1]] = name
    width = sample.shape[1]
    return Tree(np.array(directions).reshape(-1, width), np.array(thresholds), np.array(children, np.int64).reshape(-1, 2), leaves)


def leaf_of(tree: Tree, rows: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    at = np.zeros(len(rows), np.int64) if len(tree.thresholds) else np.full(len(rows), -1)
    while (inner := np.flatnonzero(at >= 0)).size:
        node = at[inner]
        right = np.einsum("ij,ij->i", rows[inner], tree.directions[node]) > tree.thresholds[node]
        at[inner] = tree.children[node, right.astype(np.int64)]
    return ~at


def visits(forest: list[Tree], query: np.ndarray, leaves: int) -> list[tuple[int, int]]:
    """The first ``leaves`` leaves (tree, leaf) of a query over all trees, by the sum of the squared margins that their paths cross."""
    queue = [(0.0, i, 0 if len(t.thresholds) else -1) for i, t in enumerate(forest)]
    heapq.heapify(queue)
    out = []
    while queue and len(out) < leaves:
        far, i, node = heapq.heappop(queue)
        if node < 0:
            out.append((i, ~node))
            continue
        tree = forest[i]
        margin = float(tree.directions[node] @ query) - tree.thresholds[node]
        left, right = tree.children[node]
        heapq.heappush(queue, (far + max(0.0, -margin) ** 2, i, int(right)))
        heapq.heappush(queue, (far + max(0.0, margin) ** 2, i, int(left)))
    return out


def _extended(vectors: list[np.ndarray], width: int, reach: float) -> np.ndarray:
    """Rows filled up to ``width`` with one more component."""
    out = np.zeros((len(vectors), width + 1))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    if len(out):
        out[:, width] = np.sqrt(np.maximum(0.0, reach * reach - np.einsum("ij,ij->i", out, out)))
    return out


def _aimed(vectors: list[np.ndarray], width: int, reach: float) -> np.ndarray:
    """Queries scaled to the norm ``reach``, so that they lie on the sphere of the rows; the component added is 0."""
    out = np.zeros((len(vectors), width + 1))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    largest = np.abs(out).max(axis=1, keepdims=True)
    out /= largest
    return out * (reach / np.linalg.norm(out, axis=1, keepdims=True))


def _vectors(column: pa.ListArray) -> list[np.ndarray]:
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _placed(shared, width: int, reach: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _extended(_vectors(batch.column("vector")), width, reach)
            for i, tree in enumerate(shared.value):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), i, np.int32)), pa.array(leaf_of(tree, rows)), batch.column("vec_id"), batch.column("vector")], names=["tree", "leaf", "vec_id", "vector"])

    return run


def _visited(shared, width: int, reach: float, leaves: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                rows = _aimed(_vectors(part.column("vector")), width, reach)
                found = [(i, tree, leaf) for i, row in enumerate(rows) for tree, leaf in visits(shared.value, row, leaves)]
                at, trees, names = (np.array(x, np.int64) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(trees.astype(np.int32)), pa.array(names), part.column("vec_id").take(pa.array(at)), part.column("vector").take(pa.array(at))], names=["tree", "leaf", "vec_id", "vector"])

    return run


def summed(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products, summed component by component, so that equal vectors have equal scores."""
    width = min(len(query), rows.shape[1])
    return np.cumsum(query[:width] * rows[:, :width], axis=1)[:, -1]


def contenders(queries: np.ndarray, rows: np.ndarray, k: int) -> list[np.ndarray]:
    """For each query the places of the rows that may be among its ``k`` best.

    A matrix product rounds in another order than ``summed``; rows within the error of the k-th are kept.
    """
    width = min(queries.shape[1], rows.shape[1])
    everything = np.arange(len(rows))
    if len(rows) <= k:
        return [everything] * len(queries)
    with np.errstate(over="ignore", invalid="ignore"):
        scores = queries[:, :width] @ rows[:, :width].T
        error = 1e-14 * width * np.linalg.norm(queries, axis=1) * np.linalg.norm(rows, axis=1).max()
    least = np.partition(scores, len(rows) - k, axis=1)[:, len(rows) - k] - error
    return [np.flatnonzero(own >= low) if np.isfinite(own).all() and np.isfinite(low) else everything for own, low in zip(scores, least, strict=True)]


def _ranked(k: int):
    """Rows come sorted by (tree, leaf, part, kind, vec_id): the rows of a leaf, then the queries that visit it."""

    def flush(ids: list, rows: list, queries: list, vectors: list) -> list[tuple]:
        names, found = np.array(ids, np.int64), []
        table = matrix(rows, np.float64)
        # a query's own rows do not count
        own_rows = int(np.unique(names, return_counts=True)[1].max()) if len(names) else 0
        for first in range(0, len(queries), 64):
            aims = matrix(vectors[first : first + 64], np.float64)
            for query, aim, near in zip(queries[first : first + 64], aims, contenders(aims, table, k + own_rows), strict=True):
                near = near[names[near] != query]
                own = summed(aim, table[near])
                top = best(own, k)
                found.append((np.full(len(top), query), names[near][top], own[top]))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, rows = None, [], []
        for batch in batches:
            found: list[tuple] = []
            queries, vectors = [], []
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("tree", "leaf", "part")), strict=True))
            kinds, numbers = batch.column("kind").to_pylist(), batch.column("vec_id").to_pylist()
            for i, vector in enumerate(_vectors(batch.column("vector"))):
                if key != keys[i]:
                    found += flush(ids, rows, queries, vectors)
                    key, ids, rows, queries, vectors = keys[i], [], [], [], []
                if kinds[i] == 0:
                    ids.append(numbers[i])
                    rows.append(vector.copy())
                else:
                    queries.append(numbers[i])
                    vectors.append(vector)
            found += flush(ids, rows, queries, vectors)
            columns = [np.concatenate(x) for x in zip(*found, strict=True)] or [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0].astype(np.int64)), pa.array(columns[1].astype(np.int64)), pa.array(columns[2])], names=["query_id", "vec_id", "score"])

    return run


def forest_over(sample: list[np.ndarray], width: int, reach: float, rows: int) -> list[Tree]:
    table = _extended(sample, width, reach)
    leaf = max(LEAF_ROWS * len(table) / max(1, rows), len(table) / LEAVES)
    return [grow(table, leaf, seed) for seed in range(TREES)]


def leaves_for(forest: list[Tree], sample: list[np.ndarray], width: int, reach: float, k: int) -> int:
    """How many leaves rows of the ``sample`` must visit to find RECALL of their ``k`` nearest others in it."""
    if len(sample) < 2:
        return 0
    table = _extended(sample, width, reach)
    probes = np.linspace(0, len(sample) - 1, min(PROBES, len(sample))).astype(np.int64)
    places = np.stack([leaf_of(tree, table) for tree in forest])
    total = sum(t.leaves for t in forest)
    aimed, needed = _aimed([sample[i] for i in probes], width, reach), []
    for i, query in zip(probes, aimed, strict=True):
        scores = table[:, :width] @ query[:width]
        scores[i] = -np.inf
        top = np.argpartition(-scores, min(k, len(sample) - 1) - 1)[: min(k, len(sample) - 1)]
        at = [np.zeros(t.leaves, np.int64) for t in forest]
        for n, (tree, leaf) in enumerate(visits(forest, query, total), 1):
            at[tree][leaf] = n
        needed.append(np.min([own[leaves[top]] for own, leaves in zip(at, places, strict=True)], axis=0))
    return int(np.quantile(np.concatenate(needed), RECALL, method="higher"))


def nearest(vectors: DataFrame, k: int = 20, query_every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the ``k`` largest inner products found, in double precision.

    ``vectors`` is (vec_id, embedding). The queries are the rows whose vec_id is divisible by ``query_every``, the
    candidates all rows with another vec_id; all of them are in the index. Ties go to the smaller vec_id. A query
    visits leaves of 2 (k + 1) rows a tree at least, so that it finds ``k`` candidates if there are as many.

    Rows without a vec_id, null or zero vectors and those with null or non-finite components take no part.
    Vectors of different lengths are filled up with 0. Rows that repeat a vec_id are candidates one by one, of
    which a result names the best; as a query, the least of its vectors counts. Other columns are not read.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    kind = "float" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "double"
    rows = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("vector"))
    rows = written(rows.filter(F.exists("vector", lambda x: x != 0)), "vectors")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width"), F.max(norm).alias("reach")).first()
    n, width, reach = facts["n"], facts["width"] or 0, facts["reach"] or 0.0
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("vector").toArrow()  # at most FIT_ROWS
    sample = _vectors(sample.column("vector").combine_chunks()) if n else []
    forest = forest_over(sample, width, reach, n)
    shared = spark.sparkContext.broadcast(forest)
    leaves = sum(t.leaves for t in forest)
    # a leaf holds n * TREES / leaves rows, and so many leaves hold 2 (k + 1) rows a tree
    wanted = max(TREES, -(-2 * (k + 1) * leaves // max(1, n)), leaves_for(forest, sample, width, reach, k))

    queries = rows.filter(F.pmod("vec_id", F.lit(query_every)) == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    schema = f"tree int, leaf bigint, vec_id bigint, vector array<{kind}>"
    placed = written(rows.mapInArrow(_placed(shared, width, reach), schema), "placed")
    parts = placed.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / F.lit(HELD_ROWS)).cast("int").alias("parts"))
    visited = queries.mapInArrow(_visited(shared, width, reach, wanted), schema)
    held = placed.join(parts, ["tree", "leaf"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts").cast("int")).withColumn("kind", F.lit(0)).drop("parts")
    passed = visited.join(parts, ["tree", "leaf"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("kind", F.lit(1)).drop("parts")
    found = (
        held.unionByName(passed)
        .repartition("tree", "leaf", "part")
        .sortWithinPartitions("tree", "leaf", "part", "kind", "vec_id")
        .mapInArrow(_ranked(k), "query_id bigint, vec_id bigint, score double")
    )
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
