"""Validation of criteria: issues, readiness and the export contract."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import language as L
from ..functions import patterns as P
from ..functions.columns import missing
from ..functions.texts import by_text

ISSUES = "array<struct<code:string,severity:string,field:string,message:string>>"

#: What each code says.
MESSAGES = {
    "ENTITY_MISSING": "A normalized entity is required.",
    "SOURCE_MISSING": "Verbatim source evidence is required.",
    "CRITERION_TYPE_INVALID": "Criterion type must be inclusion or exclusion.",
    "COMPARATOR_WITHOUT_VALUE": "Comparator requires a value.",
    "COMPARISON_NOT_STRUCTURED": "Source contains comparison language but no comparator or interval.",
    "INTERVAL_REVERSED": "Lower interval bound exceeds upper bound.",
    "LOWER_INCLUSIVITY_WITHOUT_BOUND": "Lower inclusivity requires a lower bound.",
    "UPPER_INCLUSIVITY_WITHOUT_BOUND": "Upper inclusivity requires an upper bound.",
    "NEGATION_UNCAPTURED": "Source contains negation whose scope should be checked.",
    "NEGATION_VALUE_CONFLICT": "Check whether the numerical expression qualifies a negated entity.",
    "UNIT_UNCAPTURED": "Source contains a measurement unit that is not represented.",
    "TEMPORAL_UNCAPTURED": "Source contains a temporal restriction that is not represented.",
    "REPETITION_UNCAPTURED": "Source contains repetition that is not represented.",
    "COMPOUND_SCOPE_MISSING": "Multiple atoms require an AND or OR scope.",
    "POSSIBLE_UNSPLIT_COMPOUND": "Source may contain more than one clinical requirement.",
    "DUPLICATE_ATOMIC_CRITERION": "This parent statement produced an identical structured criterion more than once.",
}


def issue(code: str, severity: Column | str, field: str) -> Column:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return F.struct(F.lit(code).alias("code"), level.alias("severity"), F.lit(field).alias("field"), F.lit(MESSAGES[code]).alias("message"))


def _said() -> Callable[[str | None], dict[str, bool]]:
    return L.said


def issues() -> Column:
    """The row-level findings of a criterion's columns, in fixed order; a source that repeats is read once by a worker."""
    c = F.col
    said = by_text("said", _said, pa.struct([(name, pa.bool_()) for name in L.SAID]), f"struct<{', '.join(f'{name}:boolean' for name in L.SAID)}>", c("source"))
    has_op = ~missing("comparator")
    no_bound = c("lower_bound").isNull() & c("upper_bound").isNull()
    negated = F.coalesce(c("negated"), F.lit(False))
    size = F.coalesce(c("parent_atom_count"), F.lit(1))
    logic = F.coalesce(c("logical_operator"), F.lit("standalone"))
    unset = lambda x: F.coalesce(c(x), F.lit("")) == ""
    rules = [
        (missing("entity"), "ENTITY_MISSING", "error", "entity"),
        (missing("source"), "SOURCE_MISSING", "error", "source"),
        (~F.coalesce(c("criterion_type").isin("inclusion", "exclusion"), F.lit(False)), "CRITERION_TYPE_INVALID", "error", "criterion_type"),
        (has_op & unset("value"), "COMPARATOR_WITHOUT_VALUE", "error", "value"),
        (said["comparison"] & ~has_op & no_bound, "COMPARISON_NOT_STRUCTURED", "error", "comparator"),
        (c("lower_bound") > c("upper_bound"), "INTERVAL_REVERSED", "error", "lower_bound"),
        (c("lower_bound").isNull() & c("lower_inclusive").isNotNull(), "LOWER_INCLUSIVITY_WITHOUT_BOUND", "error", "lower_inclusive"),
        (c("upper_bound").isNull() & c("upper_inclusive").isNotNull(), "UPPER_INCLUSIVITY_WITHOUT_BOUND", "error", "upper_inclusive"),
        (said["negation"] & ~negated & ~said["not_due_to"], "NEGATION_UNCAPTURED", "warning", "negated"),
        (negated & ~F.lower(F.coalesce(c("value"), F.lit("none"))).isin("absent", "0", "false", "no"), "NEGATION_VALUE_CONFLICT", F.when(has_op, "warning").otherwise("error"), "value"),
        (has_op & said["unit"] & missing("unit"), "UNIT_UNCAPTURED", "error", "unit"),
        (said["temporal"] & unset("temporal"), "TEMPORAL_UNCAPTURED", "error", "temporal"),
        (said["repetition"] & unset("repetition"), "REPETITION_UNCAPTURED", "error", "repetition"),
        ((size > 1) & ~logic.isin("and", "or"), "COMPOUND_SCOPE_MISSING", "error", "logical_operator"),
        ((size == 1) & said["compound"] & (logic == "standalone"), "POSSIBLE_UNSPLIT_COMPOUND", "warning", "source"),
    ]
    return F.array_compact(F.array(*[F.when(when, issue(code, level, field)) for when, code, level, field in rules])).cast(ISSUES)


def blockers() -> Column:
    """Why a criterion may not be exported: its errors, a missing review, incomplete provenance."""
    errors = F.transform(F.filter("validation_issues", lambda x: x["severity"] == "error"), lambda x: x["code"])
    unreviewed = ~F.coalesce(F.col("human_review_status").isin(*P.REVIEWED), F.lit(False))
    empty = lambda x: F.coalesce(F.col(x), F.lit("")) == ""
    loose = empty("protocol_id") | empty("source_version") | empty("source_retrieved_at") | empty("protocol_hash")
    more = F.array_compact(F.array(F.when(unreviewed, F.lit("HUMAN_REVIEW_REQUIRED")), F.when(loose, F.lit("PROVENANCE_INCOMPLETE"))))
    return F.array_distinct(F.concat(errors, more))


def with_readiness(criteria: DataFrame) -> DataFrame:
    return criteria.withColumn("readiness_blockers", blockers()).withColumn("export_ready", F.size("readiness_blockers") == 0)


def validate(criteria: DataFrame) -> DataFrame:
    """``criteria`` with validation_issues, readiness_blockers and export_ready. One projection; no shuffle."""
    return with_readiness(criteria.withColumn("validation_issues", issues()))


def proposal_violations() -> Column:
    """What in a proposed row breaks its contract."""
    c = F.col
    out = lambda x, values: ~F.coalesce(c(x).isin(*values), F.lit(False))
    rules = [
        (out("criterion_type", ("inclusion", "exclusion")), "criterion_type"),
        (out("domain", P.DOMAINS), "domain"),
        (c("entity").isNull() | (c("entity") == ""), "entity"),
        (c("comparator").isNotNull() & ~c("comparator").isin(*P.COMPARATORS), "comparator"),
        (c("negated").isNull(), "negated"),
        (out("logical_operator", P.LOGIC), "logical_operator"),
        (~F.coalesce(c("extraction_confidence").between(0, 1), F.lit(False)), "extraction_confidence"),
        (c("source").isNull() | (c("source") == ""), "source"),
    ]
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for bad, name in rules]))


_FILLED = ("criterion_id", "source_id", "parent_statement_id", "parent_statement", "boolean_group_id", "trial_id", "protocol_id", "source_version", "entity", "source")


def export_violations() -> Column:
    """What in a criterion breaks the validated export's contract."""
    c = F.col
    within = lambda x, values: F.coalesce(c(x).isin(*values), F.lit(False))
    rules = [(F.coalesce(c(x), F.lit("")) == "", x) for x in _FILLED]
    rules += [(~F.coalesce(c(x) >= 1, F.lit(False)), x) for x in ("atom_index", "parent_atom_count")]
    rules += [
        (~within("criterion_type", ("inclusion", "exclusion")), "criterion_type"),
        (~within("domain", P.DOMAINS), "domain"),
        (c("comparator").isNotNull() & ~within("comparator", P.COMPARATORS), "comparator"),
        (~within("value_kind", ("categorical", "numerical", "interval")), "value_kind"),
        (c("negated").isNull(), "negated"),
        (~within("logical_operator", P.LOGIC), "logical_operator"),
        (~F.coalesce(c("extraction_confidence").between(0, 1), F.lit(False)), "extraction_confidence"),
        (~within("human_review_status", ("pending", *P.REVIEWED)), "human_review_status"),
        (c("relations").isNull(), "relations"),
        (c("surrounding_context").isNull(), "surrounding_context"),
        (c("reviewed_at").isNull(), "reviewed_at"),
    ]
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for bad, name in rules]))
