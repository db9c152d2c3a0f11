"""Proposals and source items to criteria: reconciling, parsing, duplicates, ids and validation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import columns as C
from ..functions.terms import Terminology
from .parse import constraints, constraints_of_all, criterion, parse_all
from .segment import with_items
from .validate import ISSUES, issue, issues, with_readiness

_TEXT = ("criterion_type", "domain", "entity", "comparator", "value", "unit", "temporal", "repetition", "qualifier", "logical_operator", "extraction_confidence")
_NUMBERS = ("lower_bound", "upper_bound")
_FLAGS = ("lower_inclusive", "upper_inclusive")
_FIELDS = {**dict.fromkeys(_TEXT, "string"), **dict.fromkeys(_NUMBERS, "double"), **dict.fromkeys(_FLAGS, "boolean")}
_ORDER = {"phase": "int", "item_no": "int", "seq": "bigint"}
_PARENT = ("parent_statement_id", "parent_statement", "surrounding_context")


def _row(**values: Column) -> Column:
    """A struct of the order and all proposal fields; null where no value is given."""
    return F.struct(*[values.get(c, F.lit(None)).cast(t).alias(c) for c, t in {**_ORDER, **_FIELDS}.items()])


def _squeezed(value: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"(?U)\s+", ""))


def _by_sentence(proposals: DataFrame, items: DataFrame, parent: tuple[str, ...] = ()) -> DataFrame:
    """(protocol_id, source, last, rows): what becomes of each sentence of a protocol, and its last item.

    Items and proposals meet in one grouping, to which each brings the columns it has; of items, those named by ``parent``
    beside number and type. Protocols share sentences, but the groups are those of one protocol.
    """
    given = _given(proposals)
    item = items.select("protocol_id", "source", F.struct("item_no", "criterion_type", *parent).alias("item"), F.lit(None).alias("proposal"))
    proposal = proposals.select("protocol_id", C.strip("source").alias("source"), F.lit(None).alias("item"), _proposal(given).alias("proposal"))
    met = item.unionByName(proposal).groupBy("protocol_id", "source").agg(F.array_sort(F.collect_list("item")).alias("items"), F.array_sort(F.collect_list("proposal")).alias("proposals"))
    # a proposal that quotes no item was invented
    met = met.filter(F.size("items") > 0).withColumn("written", constraints("source"))
    return met.select("protocol_id", "source", F.element_at("items", -1).alias("last"), _rows(given, F.col("items"), F.col("proposals"), F.col("written")).alias("rows"))


def _given(proposals: DataFrame) -> list[str]:
    """The proposal fields that there are."""
    return [c for c in _FIELDS if c in proposals.columns]


def _proposal(given: list[str]) -> Column:
    return F.struct(F.col("ord").cast(_ORDER["seq"]).alias("seq"), *[F.col(c).cast(_FIELDS[c]).alias(c) for c in given])


def _rows(given: list[str], items: Column, proposals: Column, written: Column) -> Column:
    """What becomes of one sentence: an array of ``_row`` of its items and proposals, in order, and of what it writes out."""
    first, last = F.get(items, F.lit(0)), F.element_at(items, -1)
    of = lambda x: F.struct(x["comparator"], _squeezed(x["value"]))
    rest = [c for c in given if c != "criterion_type"]
    proposed = F.transform(proposals, lambda p: _row(phase=F.lit(0), item_no=F.lit(0), seq=p["seq"], criterion_type=last["criterion_type"], **{c: p[c] for c in rest}))
    known = F.transform(F.filter(proposed, lambda p: ~C.missing(p["comparator"])), of)
    new = F.filter(written, lambda c, at: ~F.exists(known, lambda k: k == of(c)) & ~F.exists(F.slice(written, F.lit(1), at), lambda c1: of(c1) == of(c)))
    constant = {"domain": F.lit("measurement"), "qualifier": F.lit("deterministically parsed written comparison"), "extraction_confidence": F.lit("1.0")}
    made = F.transform(new, lambda c, at: _row(phase=F.lit(1), item_no=first["item_no"], seq=at, criterion_type=first["criterion_type"], **constant, **{x: c[x] for x in ("comparator", "value", "unit", "entity", "logical_operator")}))
    bare = F.transform(items, lambda x: _row(phase=F.lit(1), item_no=x["item_no"], seq=F.lit(1 << 30), criterion_type=x["criterion_type"]))
    unseen = F.when(F.size(proposals) == 0, bare).otherwise(F.slice(bare, 1, 0))
    return F.concat(proposed, made, unseen)


def reconcile(proposals: DataFrame, items: DataFrame) -> DataFrame:
    """Proposals that quote a source item, written constraints, and items that no proposal mentions.

    ``proposals`` is (protocol_id, ord, ...), ``items`` what ``segment`` returns. Sentences match by their exact
    text within a protocol, never on text alone. Order is (phase, item_no, seq). A sentence under both headings
    gives proposals its last item's type.
    """
    return _by_sentence(proposals, items).select("protocol_id", "source", F.explode("rows").alias("r")).select("protocol_id", "source", "r.*")


def _signature(of: Callable[[str], Column]) -> list[Column]:
    text = [F.lower(C.strip(F.coalesce(of(c).cast("string"), F.lit("")))).alias(f"s_{c}") for c in ("entity", "value", "unit", "temporal", "repetition", "qualifier")]
    return [*[of(c).alias(c) for c in ("parent_statement_id", "criterion_type", "comparator", "lower_bound", "lower_inclusive", "upper_bound", "upper_inclusive")], F.coalesce(of("negated"), F.lit(False)).alias("negated"), *text]


def signature() -> list[Column]:
    """The columns that make an atomic criterion distinct in its protocol; domain and logic are not among them."""
    return _signature(F.col)


def drop_duplicates(rows: DataFrame) -> DataFrame:
    """Of rows with one signature the best: constrained measurements first, then confidence, then order.

    It takes the place (``place``) of the first of them. ``rows`` has protocol_id and the order columns.
    """
    constrained = (F.col("comparator").isNotNull() | F.col("interval").isNotNull()) & (F.col("domain") == "measurement")
    same = Window.partitionBy("protocol_id", *signature())
    best = same.orderBy(constrained.cast("int").desc(), F.col("extraction_confidence").desc(), "phase", "item_no", "seq")
    place = F.min(F.struct("phase", "item_no", "seq")).over(same)
    return rows.withColumns({"best": F.row_number().over(best), "place": place}).filter("best = 1").drop("best")


def normalize(proposals: DataFrame, items: DataFrame, protocols: DataFrame, terminology: Terminology | None = None) -> DataFrame:
    """Criteria of ``protocols`` from their source items and what was proposed for these.

    Items and proposals are shuffled once, to their protocols; where the items are all that ``segment`` finds in
    ``protocols``, ``criteria`` gives the same without moving them.
    """
    item = F.struct("source", "item_no", "criterion_type", *_PARENT)
    held = items.groupBy("protocol_id").agg(F.collect_list(item).alias("items")).join(_provenance(protocols), "protocol_id")
    return _exploded(_by_protocol(proposals, held, terminology))


def criteria(proposals: DataFrame, protocols: DataFrame, terminology: Terminology | None = None) -> DataFrame:
    """Criteria of ``protocols`` from their texts and what was proposed for these.

    Only proposals are moved, to their protocols, which are moved too unless they lie by protocol_id; what is made of a
    text stays in its row. ``protocol_id`` is theirs alone.
    """
    return _exploded(criteria_by_protocol(proposals, protocols, terminology))


def criteria_by_protocol(proposals: DataFrame, protocols: DataFrame, terminology: Terminology | None = None) -> DataFrame:
    """``criteria`` before they become rows: those of a protocol in order, in the array ``criteria`` of its one row."""
    return _by_protocol(proposals, _provenance(protocols, "protocol_text"), terminology)


def _provenance(protocols: DataFrame, *more: str) -> DataFrame:
    return protocols.select("protocol_id", *[F.col(c).cast("string").alias(c) for c in ("trial_id", "source_version", "source_uri", "source_retrieved_at", "protocol_hash")], *more)


def _runs(rows: DataFrame, values: str, key: Callable[[Column], Column]) -> DataFrame:
    """``rows`` with ``runs``, the stretches of equal keys in an array that is sorted by them; of an empty one, none."""
    differs = lambda i: (i == 0) | ~key(F.get(values, i)).eqNullSafe(key(F.get(values, i - 1)))
    places = F.when(F.size(values) > 0, F.sequence(F.lit(0), F.size(values) - 1)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("starts", F.filter(places, differs))
    run = lambda start, k: F.slice(values, start + 1, F.coalesce(F.get("starts", k + 1), F.size(values)) - start)
    return rows.withColumn("runs", F.transform("starts", run)).drop("starts")


def _sentences(proposals: DataFrame, held: DataFrame) -> DataFrame:
    """``held`` with ``sentences``: of each sentence that is an item's its items and the proposals that quote it, both in order."""
    given = _given(proposals)
    quoting = proposals.select("protocol_id", F.struct(C.strip("source").alias("source"), _proposal(given).alias("proposal")).alias("p")).groupBy("protocol_id").agg(F.collect_list("p").alias("proposals"))
    held = held.join(quoting, "protocol_id", "left")
    if "items" not in held.columns:
        held = with_items(held)
    item, proposal = (held.schema[c].dataType.elementType for c in ("items", "proposals"))
    said = [c for c in item.names if c != "source"]
    no_item = F.lit(None).cast(StructType([x for x in item if x.name != "source"]))
    no_proposal = F.lit(None).cast(proposal["proposal"].dataType)
    entry = lambda source, item, proposal: F.struct(source.alias("source"), item.alias("item"), proposal.alias("proposal"))
    entries = F.concat(
        F.transform("items", lambda x: entry(x["source"], F.struct(*[x[c].alias(c) for c in said]), no_proposal)),
        F.transform(F.coalesce("proposals", F.array().cast(held.schema["proposals"].dataType)), lambda x: entry(x["source"], no_item, x["proposal"])),
    )
    rows = held.withColumn("entries", F.sort_array(entries)).drop("items", "proposals")
    of = lambda run, c: F.transform(F.filter(run, lambda x: x[c].isNotNull()), lambda x: x[c]).alias(f"{c}s")
    met = F.transform("runs", lambda run: F.struct(run[0]["source"].alias("source"), of(run, "item"), of(run, "proposal")))
    # a proposal that quotes no item was invented
    return _runs(rows, "entries", lambda x: x["source"]).withColumn("sentences", F.filter(met, lambda x: F.size(x["items"]) > 0)).drop("entries", "runs")


def _reconciled(given: list[str], rows: DataFrame) -> DataFrame:
    """``rows`` with ``proposed``: what is to be parsed of all sentences, in structs with their parents."""
    rows = rows.withColumn("written", constraints_of_all(F.transform("sentences", lambda x: x["source"])))
    made = F.zip_with("sentences", "written", lambda s, w: F.struct(s["source"].alias("source"), F.element_at(s["items"], -1).alias("last"), _rows(given, s["items"], s["proposals"], w).alias("rows")))
    logic = lambda r: F.lower(F.coalesce(r["logical_operator"], F.lit("standalone")))
    shared = lambda s: F.when(C.says(s["source"], r"\bor\b"), "or").otherwise("and")

    def row(s: Column, r: Column) -> Column:
        changed = {"logical_operator": F.when((F.size(s["rows"]) > 1) & (logic(r) == "standalone"), shared(s)).otherwise(logic(r)), "extraction_confidence": C.confidence(r["extraction_confidence"])}
        return F.struct(s["source"].alias("source"), *[s["last"][c].alias(c) for c in _PARENT], *[changed.get(c, r[c]).alias(c) for c in (*_ORDER, *_FIELDS)])

    rows = rows.withColumn("made", made).drop("sentences", "written")
    return rows.withColumn("proposed", F.flatten(F.transform("made", lambda s: F.transform(s["rows"], lambda r: row(s, r))))).drop("made")


def _compared(x: Column) -> Column:
    return x["comparator"].isNotNull() | x["lower_bound"].isNotNull() | x["upper_bound"].isNotNull()


def _distinct(rows: DataFrame) -> DataFrame:
    """``rows`` with ``parents``, from their ``atoms``: those of each parent statement in order, without duplicates, as ``drop_duplicates`` tells them."""
    place = lambda x: F.struct(*[x[c].alias(c) for c in _ORDER])
    loose = lambda x: ~_compared(x) | ~F.coalesce(x["domain"] == "measurement", F.lit(False))
    ranked = lambda x: F.struct(F.struct(*_signature(lambda c: x[c])).alias("signature"), loose(x).alias("loose"), (-x["extraction_confidence"]).alias("doubt"), place(x).alias("place"), x.alias("atom"))
    rows = _runs(rows.withColumn("ranked", F.sort_array(F.transform("atoms", ranked))).drop("atoms"), "ranked", lambda x: x["signature"])
    best = lambda run: F.struct(run[0]["atom"]["parent_statement_id"].alias("parent"), F.array_min(F.transform(run, lambda x: x["place"])).alias("place"), run[0]["atom"].alias("atom"))
    rows = rows.withColumn("kept", F.sort_array(F.transform("runs", best))).drop("ranked", "runs")
    return _runs(rows, "kept", lambda x: x["parent"]).withColumn("parents", F.transform("runs", lambda run: F.transform(run, lambda x: x["atom"]))).drop("kept", "runs")


def _by_protocol(proposals: DataFrame, held: DataFrame, terminology: Terminology | None) -> DataFrame:
    """Protocols with their ``criteria``, whose ``items`` lie in their rows or are found in their text.

    All that belongs to a protocol meets in its row, in sorted arrays; rows of criteria are made at the end and not moved
    again. No array is larger than a protocol. Atom indexes are contiguous in each parent statement, ids are hashes of
    content, and reruns agree.
    """
    words = terminology or Terminology.of_session(held.sparkSession)
    rows = _reconciled(_given(proposals), _sentences(proposals, held))
    kept = ("extraction_confidence", *_PARENT, *_ORDER)
    atoms = F.zip_with("proposed", "said", lambda r, p: F.struct(*[r[c].alias(c) for c in kept], *[x.alias(c) for c, x in criterion(r, p).items()]))
    rows = _distinct(rows.withColumn("said", parse_all(words, F.col("proposed"))).withColumn("atoms", atoms).drop("proposed", "said"))
    parents = F.transform("parents", lambda g: F.struct(g.alias("atoms"), F.exists(g, _compared).alias("covered")))
    placed = lambda p: F.transform(p["atoms"], lambda x, i: F.struct(x.alias("atom"), (i + 1).alias("atom_index"), F.size(p["atoms"]).alias("parent_atom_count"), p["covered"].alias("covered")))
    return rows.withColumn("criteria", F.flatten(F.transform(parents, placed))).drop("parents")


def criterion_id(parent: Column | str, atom_index: Column | str) -> Column:
    """A criterion's id, which is of its protocol alone."""
    return C.stable_id("criterion", "protocol_id", "source_version", parent, atom_index)


def trial_of_protocol() -> Column:
    return F.coalesce(C.blank_to_null("trial_id"), F.col("protocol_id").cast("string"))


def _exploded(rows: DataFrame) -> DataFrame:
    """A row of each criterion, with its ids, group logic, validation and readiness."""
    # an inner explode would have Spark filter by the array's size, below what makes it and with all that written out again
    one = rows.select("*", F.explode_outer("criteria").alias("c")).filter("c is not null").drop("criteria")
    provenance = [c for c in one.columns if c not in ("protocol_id", "c")]
    parsed = [x for x in one.schema["c"].dataType["atom"].dataType.names if x not in (*_PARENT, "extraction_confidence", *_ORDER)]
    rows = one.select("protocol_id", *[F.col(f"c.atom.{x}").alias(x) for x in (*_PARENT, "extraction_confidence", *parsed)], "c.atom_index", "c.parent_atom_count", "c.covered", *provenance)
    ident = criterion_id("parent_statement_id", "atom_index")
    group = F.when(C.says("parent_statement", r"\bor\b"), "or").otherwise("and")
    rows = rows.withColumns(
        {
            "interval": C.interval_notation("lower_bound", "lower_inclusive", "upper_bound", "upper_inclusive"),
            "criterion_id": ident,
            "row_id": ident,
            "source_id": F.col("parent_statement_id"),
            "boolean_group_id": F.col("parent_statement_id"),
            "trial_id": trial_of_protocol(),
            "human_review_status": F.lit("pending"),
            "reviewed_at": F.lit(None).cast("string"),
            "logical_operator": F.when((F.col("parent_atom_count") > 1) & (F.col("logical_operator") == "standalone"), group).otherwise(F.col("logical_operator")),
        }
    )
    rows = rows.withColumn("relations", C.criterion_relations()).withColumn("validation_issues", issues())
    # no two of a protocol's criteria are equal: duplicates are gone
    return with_readiness(rows.withColumn("validation_issues", _uncovered())).drop("covered")


def _uncovered() -> Column:
    rest = F.filter("validation_issues", lambda x: x["code"] != "COMPARISON_NOT_STRUCTURED")
    return F.when(F.col("covered"), rest).otherwise(F.col("validation_issues"))


def with_group_issues(rows: DataFrame) -> DataFrame:
    """Findings that need the whole parent: a sibling's comparison covers all; equal criteria are errors."""
    parent = Window.partitionBy("protocol_id", "parent_statement_id")
    covered = F.bool_or(F.col("comparator").isNotNull() | F.col("lower_bound").isNotNull() | F.col("upper_bound").isNotNull()).over(parent)
    equal = F.count("*").over(Window.partitionBy("protocol_id", *signature())) > 1
    rows = rows.withColumns({"covered": covered, "equal": equal})
    more = F.when(F.col("equal"), F.array(issue("DUPLICATE_ATOMIC_CRITERION", "error", "entity"))).otherwise(F.array()).cast(ISSUES)
    return with_readiness(rows.withColumn("validation_issues", F.concat(_uncovered(), more)).drop("covered", "equal"))


def duplicate_ids(rows: DataFrame) -> DataFrame:
    """The ids of criteria whose signature occurs more than once in their protocol."""
    counted = rows.withColumn("n", F.count("*").over(Window.partitionBy("protocol_id", *signature())))
    return counted.filter("n > 1").select(F.coalesce("criterion_id", "row_id").alias("criterion_id")).distinct()
