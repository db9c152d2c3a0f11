"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every source's documents are shuffled by a hash of their id and queued. A copy of a document finishes at the
virtual time (words of its source queued so far) / (target of its source), so all sources reach their
target at time 1. All copies are range-sorted by finish time, and the mix takes them until the next one would
exceed the total budget. A source is queued again from its start while its target exceeds its size.

Running sums are taken in two steps, over the ranges and inside each, so no source and no stretch of
virtual time is sorted in one task. Only the total comes to the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import removed, written

WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"


def document_size(text: Column) -> Column:
    """The number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """``sources`` (source, source_size) with place, weight and target.

    Sources by code point, null last, weigh ``weights``, repeating. They share the sum of all sizes by weight;
    a target stops at ``most`` times its source's size, and the excess is shared anew. In the order of
    size / weight the sources that stop come first, so running sums find the level of the others.
    """
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    placed = sources.withColumn("place", F.row_number().over(by_source)).withColumns(
        {"weight": F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("long"), "cap": F.col("source_size") * most}
    )
    level = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    everything = Window.partitionBy()
    sums = placed.withColumns(
        {
            "rank": F.row_number().over(level),
            "left": F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "weights": F.sum("weight").over(level.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        }
    )
    free = F.when(F.col("cap") * F.col("weights") > F.col("left") * F.col("weight"), F.struct("rank", (F.col("left").cast("double") / F.col("weights")).alias("share")))
    first = sums.withColumn("free", F.min(free).over(everything))
    stops = F.col("free").isNull() | (F.col("rank") < F.col("free.rank"))
    target = F.when(stops, F.col("cap").cast("double")).otherwise(F.col("free.share") * F.col("weight"))
    return first.select("source", "source_size", "place", "weight", target.alias("target"))


def _summed(rows: DataFrame, count: int, by: list[str], order: list[str], name: str) -> DataFrame:
    """``rows``, about ``count`` of them, with ``name``: the sum of ``size`` so far in ``order`` within ``by``, and the row's ``range``.

    The rows are range-sorted by (``by``, ``order``) into ranges of some thousand rows, and their sums are added up
    over the ranges and inside each.
    """
    ranges = max(1, count // max(4096, math.isqrt(count)))
    ranged = written(rows.repartitionByRange(ranges, *by, *order).withColumn("range", F.spark_partition_id()), "ranged")
    before = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*by, "range").agg(F.sum("size").alias("words_of"))
    starts = sums.select(*[F.col(c).alias(f"{c}_of") for c in (*by, "range")], F.coalesce(F.sum("words_of").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy(*by, "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = ranged.withColumn("inside", F.sum("size").over(inside)).join(starts, [F.col(c) == F.col(f"{c}_of") for c in (*by, "range")])
    found = written(found.select(*rows.columns, "range", (F.col("start") + F.col("inside")).alias(name)), name)
    removed(ranged)
    return found


def _mix(docs: DataFrame, weights: tuple[int, ...], most: int) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, source, size, hash, source_size, target) of all documents, and (row, copy, range, position) of the mix."""
    ids = [F.col(c).alias(c) for c in ("doc_id", "source")]
    sized = written(docs.select(*ids, document_size(F.col("text")).alias("size"), F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row")), "sized")
    count = sized.count()
    targets = written(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "targets")
    budget = targets.agg(F.sum("source_size")).first()[0] or 0

    aims = targets.select(F.col("source").alias("of"), "source_size", "place", "target")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    queued = sized.join(aims, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("key", key)
    # rows with one doc_id, source and size are alike in the mix; their row only splits them over ranges
    queued = _summed(queued, count, ["place"], ["key", "doc_id", "size", "row"], "words").drop("range")
    removed(sized)

    copies = queued.filter("target > 0 and size > 0").select("row", "place", "size", "words", "source_size", "target", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("copy"))
    at = (F.col("copy") * F.col("source_size") + F.col("words")).cast("double") / F.col("target")
    copies = copies.select("row", "place", "copy", "words", "size", at.alias("at"))
    after = _summed(copies, count * most, [], ["at", "place", "copy", "words"], "after")
    mix = after.filter(F.col("after") <= budget).select("row", "copy", "range", (F.col("after") - F.col("size")).alias("position"))
    return queued.select("row", "doc_id", "source", "size", "hash", "source_size", "target"), mix


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """What a mix takes of each document: (doc_id, source, size, source_size, target, taken, copies, position).

    ``size`` counts words, ``taken`` is ``size`` times the ``copies`` that the mix takes, ``most`` at most, and
    ``position`` the words of the mix before the first of them (null if it takes none). The mix has as many words
    as all documents together, or fewer by less than one document; each source comes within a document or two
    of its target. Reruns agree, whatever the order of the rows.

    Null and empty texts have size 0 and are not taken. A null source is a source, and a null doc_id is
    shuffled like any other. Repeated rows are documents of their own. Other columns are not read.
    """
    queued, mix = _mix(docs, weights, most)
    picks = mix.groupBy(F.col("row").alias("of")).agg(F.count("*").alias("copies"), F.min("position").alias("position"))
    found = queued.join(picks, F.col("row") == F.col("of"), "left").withColumn("copies", F.coalesce("copies", F.lit(0)))
    return found.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "position")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """``docs`` with all their columns, each row as often as the mix takes it, in the order of the mix.

    Partitions are the ranges of the mix. Rows with one doc_id, source, size and text take each other's places.
    """
    queued, mix = _mix(docs, weights, most)
    places = mix.groupBy(F.col("row").alias("of")).agg(F.collect_list(F.struct("range", "position")).alias("places"))
    names = ("id", "source", "size", "hash")
    picks = queued.withColumnRenamed("doc_id", "id").join(places, F.col("row") == F.col("of"), "left").select(*names, "places")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    rows = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("source"), document_size(F.col("text")).alias("size"), F.xxhash64("text").alias("hash"), whole)
    # the nth pick of those alike meets the nth row; both sides are shuffled as one, so that texts move once for it
    both = rows.unionByName(picks, allowMissingColumns=True).withColumns({"alike": F.xxhash64(*names), "pick": F.col("whole").isNull()}).repartition("alike")
    both = both.withColumn("nth", F.row_number().over(Window.partitionBy("alike", "pick").orderBy(*names)))
    met = F.first("places").over(Window.partitionBy("alike", "nth").orderBy(F.col("pick").desc()))
    mixed = both.withColumn("places", met).filter("not pick and places is not null").select("whole", F.explode("places").alias("place"))
    ranges = (mix.agg(F.max("range")).first()[0] or 0) + 1
    return mixed.repartitionById(ranges, F.col("place.range")).sortWithinPartitions("place.position").select("whole.*")


#: The same in one step per running sum.
MIX_SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5(coalesce(doc_id::varchar, '')) as key from documents),
sources as (select source, sum(size)::bigint as source_size from sized group by source),
placed as (
  select *, row_number() over (order by source nulls last) as place from sources),
weighed as (
  select *, [5, 2, 1][((place - 1) % 3 + 1)::int]::bigint as weight, source_size * 3 as cap from placed),
sums as (
  select *, row_number() over w as rank,
         (sum(source_size) over () - coalesce(sum(cap) over (w rows between unbounded preceding and 1 preceding), 0))::bigint as remains,
         (sum(weight) over (w rows between current row and unbounded following))::bigint as weights
  from weighed window w as (order by cap / weight::double, place)),
free as (
  select min(rank) as rank, arg_min(remains::double / weights, rank) as share from sums where cap * weights > remains * weight),
targets as (
  select s.source, source_size, place,
         case when f.rank is null or s.rank < f.rank then cap::double else f.share * weight end as target
  from sums s left join free f on true),
queued as (
  select doc_id, s.source, size, key, source_size, place, target,
         sum(size) over (partition by s.source order by key, doc_id, size rows unbounded preceding) as words
  from sized s join targets t on s.source is not distinct from t.source),
copies as (
  select *, (copy * source_size + words)::double / target as finish
  from queued, (select unnest([0, 1, 2]) as copy) where target > 0 and size > 0),
running as (
  select *, sum(size) over (order by finish, place, copy, words rows unbounded preceding) as run from copies),
picked as (
  select doc_id, source, size, words, count(*) as n, min(run - size)::bigint as position from running
  where run <= (select sum(source_size) from sources) group by all)
select q.doc_id, q.source, q.size, q.source_size, q.target, (q.size * coalesce(p.n, 0))::bigint as taken, coalesce(p.n, 0)::bigint as copies, p.position
from queued q left join picked p
  on q.doc_id is not distinct from p.doc_id and q.source is not distinct from p.source and q.size = p.size and q.words = p.words
"""
