"""The library of reviewed criteria: union, upsert, legacy upgrade, search and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.terms import Terminology
from .parse import parse
from .validate import export_violations, validate

#: The columns of the analysis table, in order.
ANALYSIS_COLUMNS = (
    "library_source trial_id protocol_id source_version criterion_id parent_statement_id source_id row_id criterion_type domain entity comparator value unit value_kind lower_bound lower_inclusive "
    "upper_bound upper_inclusive interval negated temporal repetition qualifier logical_operator relations source surrounding_context extraction_confidence human_review_status validation_issues "
    "export_ready readiness_blockers reviewed_at"
).split()
#: What an upsert replaces by: the earlier rule, by which atoms of one sentence replace each other, or the id.
LIBRARY_KEY = ("trial_id", "source", "criterion_type")


def library_union(base: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Both parts, with their origin."""
    return base.withColumn("library_source", F.lit("immutable_base")).unionByName(reviewed.withColumn("library_source", F.lit("reviewed")), allowMissingColumns=True)


def upsert(current: DataFrame, rows: DataFrame, key: tuple[str, ...] = LIBRARY_KEY, order: str = "seq") -> DataFrame:
    """``current`` with ``rows`` (ordered by ``order``) put in by key, the last row of a key winning.

    The rows are shuffled by the key, which begins with trial_id; a library that is partitioned by trial needs to
    pass only the affected trials here.
    """
    both = current.withColumns({"newer": F.lit(0), order: F.lit(None).cast(rows.schema[order].dataType) if order not in current.columns else F.col(order)}).unionByName(rows.withColumn("newer", F.lit(1)), allowMissingColumns=True)
    last = Window.partitionBy(*key).orderBy(F.col("newer").desc(), F.col(order).desc_nulls_last())
    return both.withColumn("n", F.row_number().over(last)).filter("n = 1").drop("n", "newer", order)


def in_library_order(entries: DataFrame) -> DataFrame:
    return entries.orderBy("trial_id", "criterion_type", "entity")


def reset(entries: DataFrame) -> DataFrame:
    """A reviewed part without rows, to be written as the next snapshot; earlier ones and the base stay as they are."""
    return entries.limit(0)


def search(entries: DataFrame, words: str, columns: list[str] | None = None) -> DataFrame:
    """Entries that hold ``words`` in the text of any column, whatever the case."""
    text = F.concat_ws(" ", *[F.col(c).cast("string") for c in columns or entries.columns])
    return entries.filter(F.lower(text).contains(words.lower()))


def natural_key(text: Column | str) -> Column:
    """A key by which text is sorted as people read it: runs of digits as numbers, of any length, and other runs whatever the case.

    Numbers come before other runs. Leading zeros count only between keys that are equal without them, and so does case.
    """
    raw = F.col(text).cast("string") if isinstance(text, str) else text.cast("string")
    runs = F.regexp_extract_all(F.lower(raw), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    digits = lambda x: F.ltrim(x, F.lit("0"))
    key = F.transform(runs, lambda x: F.when(x.rlike("^[0-9]"), F.struct(F.lit(0).alias("kind"), F.length(digits(x)).alias("size"), digits(x).alias("run"))).otherwise(F.struct(F.lit(1).alias("kind"), F.lit(0).alias("size"), x.alias("run"))))
    return F.when(raw.isNotNull(), F.struct(key.alias("runs"), raw.alias("raw")))


def sorted_by(entries: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """By a column in natural order, so that 9 mg comes before 10 mg; what is absent comes last."""
    key = natural_key(column)
    return entries.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last())


def analysis_table(library: DataFrame) -> DataFrame:
    """The library as flat columns, arrays as text."""
    flat = library.withColumns(
        {
            "relations": F.array_join("relations", " | "),
            "validation_issues": F.array_join(F.transform("validation_issues", lambda x: x["code"]), " | "),
            "readiness_blockers": F.array_join("readiness_blockers", " | "),
            "export_ready": F.coalesce("export_ready", F.lit(False)),
        }
    )
    return flat.select(*ANALYSIS_COLUMNS)


def validated_export(entries: DataFrame) -> DataFrame:
    """The entries that are ready for export, with what in them breaks the contract."""
    return entries.filter("export_ready").withColumn("violations", export_violations())


def latest_snapshot(files: DataFrame) -> DataFrame:
    """Of snapshot files (name) the one to read: current names before legacy ones, then the last by name."""
    current = F.col("name").startswith("criteriaLibrary_")
    known = files.filter(current | F.col("name").startswith("eavLibrary_"))
    return known.agg(F.max_by("name", F.struct(current, "name")).alias("name")).filter("name is not null")


_DEFAULTS = {
    "comparator": "string", "value": "string", "unit": "string", "lower_bound": "double", "upper_bound": "double", "lower_inclusive": "boolean", "upper_inclusive": "boolean",
    "temporal": "string", "repetition": "string", "qualifier": "string", "value_kind": "string", "interval": "string", "relations": "array<string>", "negated": "boolean",
    "logical_operator": "string", "criterion_id": "string", "row_id": "string", "source_id": "string", "parent_statement_id": "string", "parent_statement": "string",
    "parent_atom_count": "int", "atom_index": "int", "boolean_group_id": "string", "protocol_id": "string", "source_version": "string", "source_uri": "string",
    "source_retrieved_at": "string", "protocol_hash": "string", "surrounding_context": "string", "extraction_confidence": "double", "human_review_status": "string", "reviewed_at": "string",
}


def upgrade(entries: DataFrame, terminology: Terminology | None = None) -> DataFrame:
    """Entries of any age in the present shape; a null counts as absent.

    Entries with a ``domain`` get defaults and are validated again; those without are parsed anew from their
    source, with the old ``attribute`` as comparator.
    """
    for name, kind in {**_DEFAULTS, "domain": "string", "attribute": "string", "entity": "string", "source": "string", "criterion_type": "string", "trial_id": "string"}.items():
        entries = entries.withColumn(name, F.col(name).cast(kind) if name in entries.columns else F.lit(None).cast(kind))
    old = parse(entries.filter("domain is null").drop("comparator").withColumn("comparator", F.col("attribute")), terminology)
    both = entries.filter("domain is not null").unionByName(old, allowMissingColumns=True)
    bounded = F.col("lower_bound").isNotNull() & F.col("upper_bound").isNotNull()
    first = lambda *xs: F.coalesce(*[C.blank_to_null(x) if isinstance(x, str) else x for x in xs])
    both = both.withColumns(
        {
            "value_kind": first("value_kind", F.when(bounded, "interval").when(F.col("comparator").isNotNull(), "numerical").otherwise("categorical")),
            "negated": F.coalesce("negated", F.lit(False)),
            "logical_operator": first("logical_operator", F.lit("standalone")),
            "criterion_id": first("criterion_id", "row_id", C.stable_id("legacy", "trial_id", "criterion_type", "entity", "value", "source")),
            "parent_statement": first("parent_statement", "source", F.lit("")),
            "surrounding_context": first("surrounding_context", "source", F.lit("")),
            "protocol_id": first("protocol_id", "trial_id", F.lit("LEGACY")),
            "source_version": first("source_version", F.lit("legacy-unversioned")),
            "extraction_confidence": F.coalesce("extraction_confidence", F.lit(0.5)),
            "human_review_status": first("human_review_status", F.when(~C.missing("reviewed_at"), "accepted").otherwise("pending")),
            "parent_atom_count": F.coalesce("parent_atom_count", F.lit(1)),
            "atom_index": F.coalesce("atom_index", F.lit(1)),
            "source_id": first("source_id", "row_id"),
        }
    )
    both = both.withColumn("parent_statement_id", first("parent_statement_id", "source_id", "criterion_id"))
    both = both.withColumns(
        {
            "boolean_group_id": first("boolean_group_id", "parent_statement_id"),
            "interval": first("interval", C.interval_notation("lower_bound", "lower_inclusive", "upper_bound", "upper_inclusive")),
            "relations": F.coalesce("relations", C.criterion_relations()),
        }
    )
    return validate(both.drop("attribute"))


def _ends(criteria: DataFrame, *keys: str) -> DataFrame:
    """(entity, unit, lo, lo_open, hi, hi_open, keys): the intervals of measurements; those that hold no number are left out.

    An end that says nothing of its inclusion is closed, and one without a bound is open at infinity.
    """
    low, high = F.coalesce("lower_bound", F.lit(float("-inf"))), F.coalesce("upper_bound", F.lit(float("inf")))
    opened = lambda bound, inclusive: F.col(bound).isNull() | ~F.coalesce(F.col(inclusive), F.lit(True)) if inclusive in criteria.columns else F.col(bound).isNull()
    own = criteria.filter("lower_bound is not null or upper_bound is not null").select(
        *keys, "entity", F.coalesce("unit", F.lit("")).alias("unit"), low.alias("lo"), opened("lower_bound", "lower_inclusive").alias("lo_open"), high.alias("hi"), opened("upper_bound", "upper_inclusive").alias("hi_open")
    )
    return own.filter("lo < hi or lo = hi and not lo_open and not hi_open").distinct()


_ENDS = ("lo", "lo_open", "hi", "hi_open")


def _relation() -> Column:
    """How an interval relates to the other one: ends compare by value, and at one value an open lower end lies above a closed one, an open upper end below."""
    lo, other_lo = F.struct("lo", "lo_open"), F.struct("other_lo", "other_lo_open")
    hi, other_hi = F.struct("hi", ~F.col("hi_open")), F.struct("other_hi", ~F.col("other_hi_open"))
    apart = lambda hi, hi_open, lo, lo_open: (F.col(hi) < F.col(lo)) | (F.col(hi) == F.col(lo)) & (F.col(hi_open) | F.col(lo_open))
    return (
        F.when((lo == other_lo) & (hi == other_hi), "equal")
        .when(apart("hi", "hi_open", "other_lo", "other_lo_open") | apart("other_hi", "other_hi_open", "lo", "lo_open"), "disjoint")
        .when((lo >= other_lo) & (hi <= other_hi), "subset")
        .when((lo <= other_lo) & (hi >= other_hi), "superset")
        .otherwise("overlap")
    )


def interval_counts(criteria: DataFrame) -> DataFrame:
    """(entity, unit, lo, lo_open, hi, hi_open, other_..., relation, trial_pairs): how intervals of equal measurements relate.

    A row is two distinct intervals (or one with itself) of a measurement, the lesser first, and the pairs of different
    trials that hold the one and the other. Trials are counted before intervals meet, so a measurement that all
    trials have makes as many rows as it has distinct intervals, squared, however many trials there are.
    """
    own = _ends(criteria, "trial_id")
    held = own.groupBy("entity", "unit", *_ENDS).agg(F.count("*").alias("n"))
    other = held.select(F.col("entity").alias("e"), F.col("unit").alias("u"), *[F.col(c).alias(f"other_{c}") for c in (*_ENDS, "n")])
    first = F.struct(*_ENDS) <= F.struct(*[f"other_{c}" for c in _ENDS])
    met = held.join(other, (F.col("entity") == F.col("e")) & (F.col("unit") == F.col("u")) & first)
    # pairs of a trial with itself do not count
    trial = own.groupBy("entity", "unit", "trial_id").agg(F.array_sort(F.collect_list(F.struct(*_ENDS))).alias("xs")).filter("size(xs) > 1")
    twice = trial.select("entity", "unit", F.posexplode("xs").alias("i", "x"), "xs").select("entity", "unit", "x", F.explode(F.slice("xs", F.col("i") + 2, F.size("xs"))).alias("y"))
    twice = twice.groupBy("entity", "unit", *[F.col(f"x.{c}").alias(c) for c in _ENDS], *[F.col(f"y.{c}").alias(f"other_{c}") for c in _ENDS]).agg(F.count("*").alias("both"))
    one = F.struct(*_ENDS) == F.struct(*[f"other_{c}" for c in _ENDS])
    pairs = F.when(one, (F.col("n") * (F.col("n") - 1) / 2).cast("long")).otherwise(F.col("n") * F.col("other_n") - F.coalesce("both", F.lit(0)))
    keys = ["entity", "unit", *_ENDS, *[f"other_{c}" for c in _ENDS]]
    return met.join(twice, keys, "left").select(*keys, _relation().alias("relation"), pairs.alias("trial_pairs")).filter("trial_pairs > 0")


def interval_relations(criteria: DataFrame) -> DataFrame:
    """(entity, unit, trial_a, trial_b, relation): how the intervals of two trials' equal measurements relate.

    Intervals are first reduced to distinct ones per trial; the join is on entity and unit. The output has a row for
    each pair of trials: for measurements that many trials have, take ``interval_counts``.
    """
    own = _ends(criteria, "trial_id")
    other = own.select("entity", "unit", *[F.col(c).alias(f"other_{c}") for c in ("trial_id", *_ENDS)])
    return own.join(other, ["entity", "unit"]).filter("trial_id < other_trial_id").select("entity", "unit", F.col("trial_id").alias("trial_a"), F.col("other_trial_id").alias("trial_b"), _relation().alias("relation"))
