"""Exact top-k search by term-at-a-time accumulation.

A vector's component is the weight of a term. Candidates are dealt into blocks, of which each has a posting
list for each term; every query meets every block. A query's row scatters its weighted postings into a dense
array of scores, one term after another, partition selection takes the best of the block, and the blocks'
results are merged. Neither side is held whole: a task holds one block and streams the queries past it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import small_batches, written

#: Candidates of a block, and queries that are streamed past it in one task.
BLOCK_ROWS = 16_384
SLICE_ROWS = 65_536

_LONG = (-(1 << 63), (1 << 63) - 1)


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, in no order; of equal ones the first."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    return np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])


def matrix(rows: list[np.ndarray], kind: type = np.int64) -> np.ndarray:
    """Rows of any lengths as a matrix; what is missing is 0."""
    out = np.zeros((len(rows), max(map(len, rows), default=0)), kind)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


class Postings:
    """A block: its ids, and for each term the places and weights of those that hold it."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids = ids
        self.terms = []
        for column in vectors.T:
            at = np.flatnonzero(column)
            # a term that nearly all hold needs no places
            self.terms.append((slice(None), column.copy()) if 4 * len(at) > 3 * len(column) else (at, column[at]))
        self.most = [int(np.abs(w.astype(object)).max()) if len(w) else 0 for _, w in self.terms]

    def scores(self, query: np.ndarray) -> np.ndarray:
        terms = [d for d in np.flatnonzero(query) if d < len(self.terms)]
        exact = sum(abs(int(query[d])) * self.most[d] for d in terms) < 1 << 62
        out = np.zeros(len(self.ids), np.int64 if exact else object)
        for d in terms:
            at, weights = self.terms[d]
            out[at] += int(query[d]) * (weights if exact else weights.astype(object))
        return out if exact else np.clip(out, *_LONG).astype(np.int64)


def _accumulate(k: int):
    """Rows come sorted by (block, slice, kind, vec_id): a block's candidates, then the queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, rows, block = None, [], [], None
        for batch in batches:
            found: list[tuple[np.ndarray, ...]] = []
            blocks, slices, kinds, numbers = (batch.column(c).to_numpy() for c in ("block", "slice", "kind", "vec_id"))
            vectors = batch.column("vector")
            offsets, values = vectors.offsets.to_numpy(), vectors.values.to_numpy()
            for i in range(batch.num_rows):
                if key != (blocks[i], slices[i]):
                    key, ids, rows, block = (blocks[i], slices[i]), [], [], None
                vector = values[offsets[i] : offsets[i + 1]]
                if kinds[i] == 0:
                    ids.append(numbers[i])
                    rows.append(vector.copy())
                    continue
                if block is None:
                    block = Postings(np.array(ids, np.int64), matrix(rows))
                    rows = []
                scores = block.scores(vector)
                others = block.ids != numbers[i]
                if not others.all():
                    names, scores = block.ids[others], scores[others]
                else:
                    names = block.ids
                top = best(scores, k)
                found.append((np.full(len(top), numbers[i]), names[top], scores[top]))
            columns = [np.concatenate(x) for x in zip(*found, strict=True)] or [np.zeros(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["query_id", "vec_id", "score"])

    return run


def exact_top_k(vectors: DataFrame, k: int = 20, query_every: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest integer inner products.

    ``vectors`` is (vec_id, embedding). A component x becomes floor(scale * x); the queries are the rows whose
    vec_id is divisible by ``query_every``, the candidates all rows with another vec_id. Ties go to the smaller
    vec_id, and a query has fewer than ``k`` rows only if there are no more candidates.

    Rows without a vec_id, null vectors and those with null or non-finite components take no part. Vectors of
    different lengths are filled up with 0. Rows that repeat a vec_id are candidates one by one; as a query,
    the least of its vectors counts. Scores beyond a long stop at its ends. Other columns are not read.
    """
    small_batches(vectors.sparkSession)
    long = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = written(vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), long.alias("vector")), "vectors")
    queries = rows.filter(F.pmod("vec_id", F.lit(query_every)) == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    slices = max(1, -(-queries.count() // SLICE_ROWS))
    some = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = rows.select(some(blocks).alias("block"), every(slices).alias("slice"), F.lit(0).alias("kind"), "vec_id", "vector")
    passed = queries.select(every(blocks).alias("block"), some(slices).alias("slice"), F.lit(1).alias("kind"), "vec_id", "vector")
    found = (
        held.unionByName(passed)
        .repartition("block", "slice")
        .sortWithinPartitions("block", "slice", "kind", "vec_id")
        .mapInArrow(_accumulate(k), "query_id bigint, vec_id bigint, score bigint")
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


TOP_K_SQL = """
with rows as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null
    and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
scored as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score
  from rows q, rows c where q.vec_id % 20 = 0 and q.vec_id <> c.vec_id)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from scored qualify rank <= 20
"""
