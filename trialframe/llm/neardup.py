"""Near-duplicate groups by bottom-k sketches.

A document's sketch holds the ``SKETCH`` smallest hashes of its shingle set, under one hash function. Two
sets of similarity 0.8 or more share most of their sketches, so they also share one of the few rarest values
of each sketch; inverted lists of these values generate candidates. The sketch of a pair's union estimates its
similarity and drops most of the others, and the full sets decide.

No list is expanded into all of its pairs. Documents with equal sets are one node from the start. In each
list the members are first compared with one pivot, and those that may yet have links with four others. A link
inside a group changes nothing, so what is left to find are links between members of a list that are in different
groups; a bit mask of each sketch tells whether a member may have any. Those that may, mostly documents that hold
a common passage, are listed anew by the rarest fifth of their full sets, which is exact. There the likeliest pair
of each two groups is compared first; what then still is in different groups, and may be similar by the places of
the shared values and by masks of the full sets, is compared pair by pair. The groups are those of all links.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import removed, small_batches, written
from .words import mix, shingle_sets

#: Values kept of each set. A pair at similarity 0.8 shares fewer than SHARED of 64 with probability 1e-6.
SKETCH = 64
SHARED = 36
#: 64-bit words of the mask of a sketch, and of a full set.
MASK_WORDS = 4
FULL_MASK_WORDS = 16
#: Turns of the pivots that members which may yet have links are compared with.
MORE_PIVOTS = (1, 2, 3, 4)
_FULL_MASK = [f"mask_{i}" for i in range(FULL_MASK_WORDS)]
#: Members of a group that meet other groups of a list first.
SPEAKERS = 2
#: Members of a list that are sent to one task beside the set they are compared with.
RUN = 4096

#: Bits of the filter that keeps texts which are not compared out of the shuffles.
FILTER_BITS = 1 << 24

_SIGNED = "doc_id bigint, fp binary, n int, sketch array<bigint>, mask array<bigint>, row bigint"


def _fingerprint(values: np.ndarray) -> bytes:
    """128 bits for a whole set."""
    if not len(values):
        return b""
    x = values.view(np.uint64)
    a = np.add.reduce(mix(x ^ np.uint64(0x5851F42D4C957F2D)))
    b = np.add.reduce(mix(x * np.uint64(0x2545F4914F6CDD1D) + np.uint64(1)))
    return a.tobytes() + b.tobytes() + len(values).to_bytes(4, "little")


def _mask(values: np.ndarray, words: int) -> np.ndarray:
    """``words`` times 64 bits, of which each value sets one."""
    bits = np.zeros(64 * words, bool)
    bits[values & (64 * words - 1)] = True
    return np.packbits(bits, bitorder="little").view(np.int64)


def _arrays(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int64)
    np.cumsum([len(x) for x in arrays], out=offsets[1:])
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    if pa.types.is_large_binary(kind):
        return pa.LargeBinaryArray.from_buffers(kind, len(arrays), [None, pa.py_buffer(offsets * 8), pa.py_buffer(values.tobytes())])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def _sign(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, sizes, sketches, masks = [], [], [], []
            for values in shingle_sets(batch.column("text"), shingle):
                prints.append(_fingerprint(values))
                sizes.append(len(values))
                sketches.append(values[:SKETCH].copy())
                masks.append(_mask(sketches[-1], MASK_WORDS))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(prints, pa.binary()), pa.array(sizes, pa.int32()), _arrays(sketches, pa.list_(pa.int64())), _arrays(masks, pa.list_(pa.int64())), batch.column("row")],
                names=["doc_id", "fp", "n", "sketch", "mask", "row"],
            )

    return run


def _full_sets(shingle: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(shared.value, bitorder="little").view(bool)
        for batch in batches:
            batch = batch.filter(pa.array(wanted[batch.column("bit").to_numpy()]))
            prints, sets = [], []
            for values in shingle_sets(batch.column("text"), shingle):
                prints.append(_fingerprint(values))
                sets.append(values)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.binary()), _arrays(sets, pa.large_binary()).cast(pa.binary())], names=["of", "print", "members"])

    return run


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int, repeated: bool) -> DataFrame:
    """(rid, members): the full sets of the nodes ``wanted`` (rid, doc_id, fp).

    A filter of fixed size tells the scan which documents may be wanted; the join then decides.
    """
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    marked = wanted.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits")).toPandas()
    words = np.zeros(FILTER_BITS // 64, np.int64)
    words[marked["word"]] = marked["bits"]
    shared = docs.sparkSession.sparkContext.broadcast(words.view(np.uint8))
    found = docs.withColumn("bit", bit).mapInArrow(_full_sets(shingle, shared), "of bigint, print binary, members binary")
    sets = wanted.join(found, (F.col("fp") == F.col("print")) & F.col("doc_id").eqNullSafe(F.col("of"))).select("rid", "members")
    return written(sets.dropDuplicates(["rid"]) if repeated else sets, "sets")


def _confirmed(percent: int):
    """Rows come sorted by (a, salt, b), the set of ``a`` itself first (b null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, np.zeros(0, np.int64)
        for batch in batches:
            out_a, out_b = [], []
            for a, salt, b, members in zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "b", "members")), strict=True):
                values = np.frombuffer(members, np.int64)
                if b is None:
                    key, held = (a, salt), values
                elif key == (a, salt):
                    both = len(np.intersect1d(held, values, assume_unique=True))
                    if 100 * both >= percent * (len(held) + len(values) - both):
                        out_a.append(a)
                        out_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return run


def _similar_sketches(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose union sketch estimates enough similarity; exact while the sketches are whole sets."""
    left = nodes.select(F.col("rid").alias("a"), F.col("sketch").alias("sa"))
    right = nodes.select(F.col("rid").alias("b"), F.col("sketch").alias("sb"))
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, SKETCH)
    both = F.size(F.array_intersect(F.array_intersect("sa", "sb"), F.col("u")))
    common = F.size(F.array_intersect("sa", "sb"))
    whole = (F.size("sa") < SKETCH) & (F.size("sb") < SKETCH)
    exact = common * 100 >= (F.size("sa") + F.size("sb") - common) * percent
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .select("a", "b", "sa", "sb", union.alias("u"))
        .filter(F.when(whole, exact).otherwise(both * SKETCH >= F.size("u") * SHARED))
        .select("a", "b")
    )


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs linked by their full sets.

    A set that is compared with many others is sent once for each part of them, of some RUN members; there are
    never more such copies than pairs.
    """
    most = pairs.groupBy("a").count().agg(F.max("count")).first()[0] or 1
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(-(-most // RUN))))
    own = salted.select("a", "salt").distinct().join(sets.withColumnRenamed("rid", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "members")
    other = salted.join(sets.withColumnRenamed("rid", "b"), "b").select("a", "salt", "b", "members")
    return (
        own.unionByName(other)
        .repartition("a", "salt")
        .sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
        .mapInArrow(_confirmed(percent), "a bigint, b bigint")
    )


def components(links: DataFrame) -> DataFrame:
    """(rid, label): for each node of ``links`` (a, b) the smallest node that it reaches.

    Each round takes the least label around a node, then the label of that label; both roughly double the
    distance covered. Only whether a label changed comes to the driver.
    """
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("rid")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        around = edges.join(labels.select(F.col("rid").alias("b"), "label"), "b").groupBy(F.col("a").alias("rid")).agg(F.min("label").alias("near"))
        step = labels.select("rid", F.col("label").alias("was")).join(around, "rid").select("rid", F.least("was", "near").alias("label"), "was")
        jump = labels.select(F.col("rid").alias("label"), F.col("label").alias("next"))
        after = written(step.join(jump, "label").select("rid", F.col("next").alias("label"), "was"), "labels")
        done = not after.filter("label <> was").head(1)
        removed(labels)
        labels = after
        if done:
            removed(edges)
            return labels.select("rid", "label")


def _stars(groups: DataFrame) -> DataFrame:
    """As few links (a, b) as hold the same groups together."""
    return groups.filter("rid <> label").select(F.col("label").alias("a"), F.col("rid").alias("b"))


def _lists(nodes: DataFrame) -> DataFrame:
    """(value, rid, n, misses, mask): the rarest values of each sketch that some other sketch holds too.

    If two sketches share at least ``o`` values, then so do their len - o + 1 rarest. Sets of fewer than 52
    shingles can only be linked where both sketches are whole sets, hence o = ceil(0.8 n); else o = SHARED.
    ``misses`` is len - o.
    """
    postings = nodes.select("rid", F.explode("sketch").alias("value"))
    often = postings.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    by_rid = Window.partitionBy("rid")
    size = F.least("n", F.lit(SKETCH))
    least = F.when(F.col("n") < 52, F.ceil(F.col("n") * 4 / F.lit(5))).otherwise(SHARED)
    ranked = postings.join(often, "value").withColumns({"rank": F.row_number().over(by_rid.orderBy("df", "value")), "shared": F.count("*").over(by_rid)})
    return (
        ranked.join(nodes.select("rid", "n", "mask", (size - least).cast("int").alias("misses"), size.alias("size")), "rid")
        .filter("size - shared + rank <= misses + 1")
        .select("value", "rid", "n", "misses", "mask")
    )


def _against_pivots(lists: DataFrame, turns: Sequence[int]) -> DataFrame:
    """Pairs (a, b) of a member and a pivot of its list, if their groups differ.

    A list has a pivot for each turn and each range of set sizes by a factor 1.5625. A node's rank is the same
    in all lists, so lists that hold much the same nodes have one pivot, and a node meets it once.
    """
    members = lists.withColumn("band", F.floor(F.log(F.col("n")) / F.log(F.lit(1.5625)) + F.lit(0.5 * (turns[0] % 2))))
    firsts = [F.min(F.struct(F.xxhash64("rid", F.lit(turn)).alias("h"), "rid", "n", "label")) for turn in turns]
    pivots = members.groupBy("value", "band").agg(F.array_distinct(F.array(*firsts)).alias("ps"), F.count("*").alias("size")).filter("size > 1")
    return (
        members.join(pivots, ["value", "band"])
        .withColumn("p", F.explode("ps"))
        .filter("label <> p.label and 5 * least(n, p.n) >= 4 * greatest(n, p.n)")
        .select(F.least("rid", "p.rid").alias("a"), F.greatest("rid", "p.rid").alias("b"))
        .distinct()
    )


def _missing(x: Sequence[Column], y: Sequence[Column]) -> Column:
    """How many bits of mask ``x`` the mask ``y`` lacks."""
    return sum((F.bit_count(a.bitwiseAND(F.bitwise_not(b))) for a, b in zip(x, y, strict=True)), F.lit(0))


def _unsettled(lists: DataFrame) -> DataFrame:
    """(rid, n, misses, mask, label) of members that, by size and mask, may have a link into another group of their list."""
    several = lists.groupBy("value").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("value")
    left = lists.join(several, "value")
    other = left.select(F.col("value").alias("v"), *(F.col(c).alias(f"other_{c}") for c in ("n", "misses", "mask", "label")))
    # linked sets of n and m values share at least 4/9 (n + m), so the one lacks at most (5 n - 4 m) / 9 of the other
    mask, other_mask = ([F.col(c)[i] for i in range(MASK_WORDS)] for c in ("mask", "other_mask"))
    whole = F.greatest("n", "other_n") <= SKETCH
    most = F.when(whole, F.expr("5 * n - 4 * other_n")).otherwise(9 * F.col("misses"))
    other_most = F.when(whole, F.expr("5 * other_n - 4 * n")).otherwise(9 * F.col("other_misses"))
    may = F.expr("label <> other_label and 5 * least(n, other_n) >= 4 * greatest(n, other_n)") & (_missing(mask, other_mask) * 9 <= most) & (_missing(other_mask, mask) * 9 <= other_most)
    return left.join(other, (F.col("value") == F.col("v")) & may, "left_semi").select("rid", "n", "misses", "mask", "label").dropDuplicates(["rid"])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(x, np.int64) for x in batch.column("members").to_pylist()]
        masks = [_mask(x, FULL_MASK_WORDS) for x in sets]
        yield pa.RecordBatch.from_arrays([batch.column("rid"), _arrays(sets, pa.list_(pa.int64())), _arrays(masks, pa.list_(pa.int64()))], names=["rid", "members", "full_mask"])


def _deep_lists(unsettled: DataFrame, sets: DataFrame) -> DataFrame:
    """(value, rid, n, place, masks): unsettled nodes by the rarest values of their full sets.

    Of each set the n - ceil(0.8 n) + 1 rarest values are listed; ``place`` counts from the rarest.
    """
    read = sets.mapInArrow(_members, "rid bigint, members array<bigint>, full_mask array<bigint>")
    values = read.select("rid", F.explode("members").alias("value"))
    often = values.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    by_rid = Window.partitionBy("rid")
    ranked = values.join(often, "value").withColumns({"rank": F.row_number().over(by_rid.orderBy("df", "value")), "shared": F.count("*").over(by_rid)})
    listed = (
        ranked.join(unsettled.select("rid", "n"), "rid")
        .withColumn("place", F.expr("n - shared + rank"))
        .filter("place <= n - ceil(n * 4 / 5) + 1")
        .join(read.select("rid", *(F.col("full_mask")[i].alias(c) for i, c in enumerate(_FULL_MASK))), "rid")
        .select("value", "df", "rid", "n", "place", *_FULL_MASK)
    )
    every = written(listed, "listed")
    # the first of values with the same list stands at the lowest place in each of its sets, so the others add no pair
    lists = every.groupBy("value", "df").agg(F.count("*").alias("size"), *(F.bit_xor(F.xxhash64("rid", F.lit(i))).alias(f"of_{i}") for i in (0, 1)))
    first = lists.filter("size > 1").groupBy("size", "of_0", "of_1").agg(F.min(F.struct("df", "value"))["value"].alias("value"))
    kept = written(every.join(first, "value", "left_semi").drop("df"), "deep")
    removed(every)
    return kept


def _across(listed: DataFrame, groups: DataFrame, best: bool) -> DataFrame:
    """Pairs (a, b) of listed nodes in different groups that may be similar; with ``best`` the likeliest one of each two groups.

    Sets of n <= m values share at least 4/9 (n + m), so 8/9 n, of them: the smaller set's value is then among
    its n - ceil(8/9 n) + 1 rarest, and enough values follow the first shared one in both. Masks of the full sets
    drop most pairs before they are formed: of n values a linked set lacks at most (5 n - 4 m) / 9.
    """
    listed = listed.join(groups, "rid", "left").withColumn("label", F.coalesce("label", "rid"))
    if best:  # a few of each group are enough to find most links, and what they miss the other turn finds
        turn = F.row_number().over(Window.partitionBy("value", "label").orderBy(F.xxhash64("rid"), "rid"))
        listed = listed.withColumn("turn", turn).filter(F.col("turn") <= SPEAKERS)
    right = listed.select("value", *(F.col(c).alias(f"other_{c}") for c in ("rid", "n", "label", "place", *_FULL_MASK)))
    lacks = _missing([F.col(c) for c in _FULL_MASK], [F.col(f"other_{c}") for c in _FULL_MASK]) * 9
    may_lack = F.expr("5 * n - 4 * other_n")
    found = (
        listed.filter("place <= n - ceil(8 * n / 9) + 1")
        .join(right, "value")
        .filter("label <> other_label and 5 * n >= 4 * other_n and (n < other_n or n = other_n and rid < other_rid)")
        .filter(F.expr("9 * (1 + least(n - place, other_n - other_place)) >= 4 * (n + other_n)") & (lacks <= may_lack))
    )
    pair = (F.least("rid", "other_rid").alias("a"), F.greatest("rid", "other_rid").alias("b"))
    if not best:
        return found.select(*pair).distinct()
    likeliest = F.min(F.struct(((lacks - may_lack) / F.col("n")).alias("over"), *pair)).alias("p")
    return found.groupBy(F.least("label", "other_label"), F.greatest("label", "other_label")).agg(likeliest).select("p.a", "p.b").distinct()


def _grouped(docs: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of ``docs`` (doc_id, text, row) each row's sketch, and (fp, label, component_id) of each set: its group, and the least doc_id of that."""
    if percent < 80:
        raise ValueError("sketches are made for a similarity of 0.8 or more")
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "row")
    signed = written(docs.mapInArrow(_sign(shingle), _SIGNED), "signed")
    nodes = signed.filter("n > 0").groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("mask").alias("mask"))
    nodes = written(nodes.withColumn("rid", F.monotonically_increasing_id()), "nodes")
    lists = written(_lists(nodes), "lists")

    repeated = bool(signed.groupBy("doc_id").count().filter("count > 1").head(1))
    named = nodes.select("rid", "doc_id", "fp")

    def similar(found: DataFrame) -> DataFrame:
        pairs = written(found, "pairs")
        out = written(_similar_sketches(pairs, nodes, percent), "similar")
        removed(pairs)
        return out

    pairs = similar(_against_pivots(lists.withColumn("label", F.col("rid")), [0]))
    compared = pairs.select(F.col("a").alias("rid")).unionByName(pairs.select(F.col("b").alias("rid"))).distinct()
    sets = _sets(docs, named.join(compared, "rid"), shingle, repeated)
    groups = components(_confirm(pairs, sets, percent))
    removed(pairs, sets)

    plain, lists = lists, written(lists.join(groups, "rid", "left").withColumn("label", F.coalesce("label", "rid")), "lists")
    unsettled = written(_unsettled(lists), "unsettled")
    sets = _sets(docs, named.join(unsettled.select("rid"), "rid"), shingle, repeated)
    pairs = similar(_against_pivots(lists.join(unsettled.select("rid"), "rid"), MORE_PIVOTS))
    groups = components(_stars(groups).unionByName(_confirm(pairs, sets, percent)))
    removed(plain, lists, pairs)

    listed = _deep_lists(unsettled, sets)
    for best in (True, False):  # most groups meet by their likeliest pair, which leaves few pairs to the second turn
        pairs = similar(_across(listed, groups, best))
        groups = components(_stars(groups).unionByName(_confirm(pairs, sets, percent)))
        removed(pairs)
    removed(listed, unsettled, sets)

    labelled = nodes.join(groups, "rid", "left").select("fp", F.coalesce("label", "rid").alias("label"), "doc_id")
    least = labelled.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return signed, labelled.join(least, "label").select("fp", "label", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Groups of near-duplicate documents: (doc_id, n_shingles, component_id, kept).

    Two documents are linked if 100 * intersection >= percent * union of their sets of distinct
    ``shingle``-word shingles (A-Z lower-cased; a shorter text is one shingle). ``component_id`` is the
    smallest doc_id that links reach, ``kept`` marks that document. ``percent`` must be at least 80, for
    which the sketches are made.

    Null and empty texts and texts of spaces have an empty set and are linked with nothing. Rows that repeat
    a doc_id keep a row each: with the same text they are one document and both kept, with other texts they
    are grouped by text. A null doc_id counts only in a group that has no other; it is kept there. Columns
    other than doc_id and text are not read.
    """
    signed, of_print = _grouped(docs.select("doc_id", "text", F.lit(None).cast("long").alias("row")), shingle, percent)
    empty = signed.filter("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    full = signed.filter("n > 0").join(of_print, "fp").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    return full.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with all their columns, one row of each near-duplicate group: of its least doc_id, null being the last.

    Texts without shingles are linked with nothing; of those, equal doc_ids count as one, null ones each.
    """
    row = "row"
    while row.lower() in (c.lower() for c in docs.columns):
        row += "_"
    # written, so that a row has one number whenever it is read
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    signed, groups = _grouped(numbered.select("doc_id", "text", F.col(row).alias("row")), shingle, percent)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))["row"].alias("kept_row")
    full = signed.filter("n > 0").select("fp", "doc_id", "row").join(groups, "fp").groupBy("label").agg(first).select("kept_row")
    empty = signed.filter("n = 0").groupBy("doc_id", F.when(F.col("doc_id").isNull(), F.col("row")).alias("own")).agg(F.min("row").alias("kept_row")).select("kept_row")
    return numbered.join(full.unionByName(empty), F.col(row) == F.col("kept_row"), "left_semi").drop(row)
