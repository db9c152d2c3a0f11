"""Human review: the review table, the gate that applies decisions, and what it rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import patterns as P
from .normalize import signature
from .validate import issues, with_readiness

#: The columns of the review table, in order.
REVIEW_COLUMNS = (
    "source parent_statement criterion_type domain entity comparator value unit value_kind lower_bound lower_inclusive upper_bound upper_inclusive negated temporal repetition qualifier "
    "logical_operator review_status validation_issues readiness_blockers extraction_confidence export_ready trial_id protocol_id source_uri source_version source_retrieved_at protocol_hash "
    "surrounding_context job_id criterion_id row_id source_id parent_statement_id parent_atom_count atom_index boolean_group_id"
).split()


def review_table(criteria: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """Criteria, with job_id, as rows to review: nested columns as text, status pending."""
    flat = criteria.withColumns(
        {
            "validation_issues": F.array_join(F.transform("validation_issues", lambda x: x["code"]), " | "),
            "readiness_blockers": F.array_join("readiness_blockers", " | "),
            "review_status": F.lit("pending"),
        }
    )
    if manifest is not None:
        flat = flat.join(manifest, "trial_id").orderBy("pos", "parent_statement_id", "atom_index")
    return flat.select(*REVIEW_COLUMNS)


def reviewed_cells(sheet: DataFrame) -> DataFrame:
    """A sheet's text cells as typed columns; rows without a job are left out, bad cells are told in ``cell_errors``."""
    absent = [c for c in REVIEW_COLUMNS if c not in sheet.columns]
    if absent:
        raise ValueError(f"the sheet lacks columns: {', '.join(absent)}")
    flags, numbers = ("lower_inclusive", "upper_inclusive", "negated"), ("lower_bound", "upper_bound", "extraction_confidence")
    errors = F.array_compact(F.array(*[F.when(C.bad_boolean_cell(c), F.lit(c)) for c in flags], *[F.when(~C.missing(c) & C.optional_number(c).isNull(), F.lit(c)) for c in numbers]))
    typed = {c: C.boolean_cell(c) for c in flags} | {c: C.optional_number(c) for c in numbers} | {c: F.col(c).try_cast("int") for c in ("parent_atom_count", "atom_index")}
    return sheet.filter(~C.missing("job_id")).withColumn("cell_errors", errors).withColumns(typed)


def completeness(reviewed: DataFrame, expected: DataFrame) -> DataFrame:
    """Per job of ``expected`` (job_id, row_id): rows, reviewed rows, and whether all are accepted or corrected."""
    rows = expected.groupBy("job_id").agg(F.count("*").alias("expected"))
    done = reviewed.groupBy("job_id").agg(F.count("*").alias("supplied"), F.bool_and(F.coalesce(F.col("review_status").isin(*P.REVIEWED), F.lit(False))).alias("settled"))
    found = rows.join(done, "job_id", "left")
    return found.select("job_id", "expected", F.coalesce("supplied", F.lit(0)).alias("supplied"), (F.coalesce("settled", F.lit(False)) & (F.col("expected") == F.col("supplied"))).alias("complete"))


def id_differences(reviewed: DataFrame, expected: DataFrame) -> DataFrame:
    """(job_id, row_id, side): ids that only one of the two has; a null is like no other. Both meet in one grouping."""
    side = lambda rows, has: rows.select("job_id", "row_id", F.lit(not has).alias("expected"), F.lit(has).alias("reviewed"))
    met = side(expected, False).unionByName(side(reviewed, True)).groupBy("job_id", "row_id").agg(F.max("expected").alias("expected"), F.max("reviewed").alias("reviewed"))
    unlike = F.col("job_id").isNull() | F.col("row_id").isNull()
    sides = F.array_compact(F.array(F.when(F.col("expected") & (~F.col("reviewed") | unlike), F.lit("missing")), F.when(F.col("reviewed") & (~F.col("expected") | unlike), F.lit("unexpected"))))
    return met.select("job_id", "row_id", F.explode(sides).alias("side"))


def group_faults(rows: DataFrame, job: str = "job_id") -> DataFrame:
    """Per job and parent statement: whether declared counts, atom indexes and operators are consistent."""
    groups = rows.groupBy(job, "parent_statement_id").agg(
        F.count("*").alias("n"),
        F.min("parent_atom_count").alias("lo"),
        F.max("parent_atom_count").alias("hi"),
        F.min("atom_index").alias("first"),
        F.max("atom_index").alias("last"),
        F.count_distinct("atom_index").alias("indexes"),
        F.min("logical_operator").alias("operator"),
        F.max("logical_operator").alias("other"),
    )
    members = (F.col("lo") != F.col("n")) | (F.col("hi") != F.col("n")) | (F.col("first") != 1) | (F.col("last") != F.col("n")) | (F.col("indexes") != F.col("n"))
    # one operator is the least and the greatest; a second distinct count would make three rows of each
    logic = (F.col("n") > 1) & F.coalesce((F.col("operator") != F.col("other")) | (F.col("operator") == "standalone"), F.lit(True))
    return groups.select(job, "parent_statement_id", "n", members.alias("bad_members"), logic.alias("bad_operator"))


def reviewed_rows(reviewed: DataFrame, jobs: DataFrame) -> DataFrame:
    """Reviewed rows with job provenance, recomputed fields, validation and ``reject_reasons``.

    ``jobs`` is (job_id, status, trial_id, protocol_id, source_version, source_uri, source_retrieved_at, protocol_hash,
    reviewed_at).
    """
    own = ("trial_id", "protocol_id", "source_version", "source_uri", "source_retrieved_at", "protocol_hash", "status", "reviewed_at")
    rows = reviewed.drop(*[c for c in own if c in reviewed.columns])
    clean = {
        "criterion_type": F.lower(F.coalesce("criterion_type", F.lit(""))),
        "domain": F.lower(C.strip(F.coalesce("domain", F.lit("")))),
        "entity": C.strip(F.coalesce("entity", F.lit(""))),
        "value": C.strip(F.coalesce("value", F.lit(""))),
        "comparator": C.blank_to_null("comparator"),
        "unit": C.blank_to_null("unit"),
        "temporal": C.blank_to_null("temporal"),
        "repetition": C.blank_to_null("repetition"),
        "qualifier": C.blank_to_null("qualifier"),
        "source": C.strip(F.coalesce("source", F.lit(""))),
        "logical_operator": F.lower(F.coalesce(C.blank_to_null("logical_operator"), F.lit("standalone"))),
        "negated": F.coalesce("negated", F.lit(False)),
        "lower_inclusive": F.when(F.col("lower_bound").isNotNull(), F.coalesce("lower_inclusive", F.lit(False))),
        "upper_inclusive": F.when(F.col("upper_bound").isNotNull(), F.coalesce("upper_inclusive", F.lit(False))),
        "human_review_status": F.col("review_status"),
        "extraction_confidence": F.coalesce("extraction_confidence", F.lit(0.5)),
        "parent_atom_count": F.coalesce("parent_atom_count", F.lit(1)),
        "atom_index": F.coalesce("atom_index", F.lit(1)),
    }
    rows = rows.withColumns(clean)
    both = F.col("lower_bound").isNotNull() & F.col("upper_bound").isNotNull()
    rows = rows.withColumns(
        {
            "value_kind": F.when(both, "interval").otherwise(F.coalesce(C.blank_to_null("value_kind"), F.lit("categorical"))),
            "interval": C.interval_notation("lower_bound", "lower_inclusive", "upper_bound", "upper_inclusive"),
            "relations": C.criterion_relations(),
        }
    )
    # texts are read before rows are dealt to their jobs: what comes out of Python has lost its partitions
    rows = rows.withColumn("validation_issues", issues()).repartition("job_id").join(jobs.select("job_id", *own), "job_id")
    rows = with_readiness(rows.withColumns({"protocol_id": F.coalesce(C.blank_to_null("protocol_id"), F.col("trial_id")), "source_version": F.coalesce(C.blank_to_null("source_version"), F.lit("legacy-unversioned"))}))
    no = lambda x, values: ~F.coalesce(F.col(x).isin(*values), F.lit(False))
    rules = [
        (F.coalesce(F.col("status"), F.lit("")) != "completed", "JOB_NOT_COMPLETED"),
        (no("review_status", P.REVIEWED), "NOT_REVIEWED"),
        (no("criterion_type", ("inclusion", "exclusion")), "TYPE"),
        (no("domain", P.DOMAINS), "DOMAIN"),
        ((F.col("entity") == "") | ((F.col("value") == "") & F.col("lower_bound").isNull() & F.col("upper_bound").isNull()), "ENTITY_OR_VALUE"),
        (no("logical_operator", P.LOGIC), "OPERATOR"),
        (F.col("comparator").isNotNull() & no("comparator", P.COMPARATORS), "COMPARATOR"),
        (~F.col("export_ready"), "NOT_READY"),
    ]
    return rows.withColumn("reject_reasons", F.array_compact(F.array(*[F.when(bad, F.lit(name)) for bad, name in rules])))


def _group_reasons() -> Column:
    """Faults of a row's Boolean group, over the rows of its job and parent statement."""
    group = Window.partitionBy("job_id", "parent_statement_id")
    n = F.count("*").over(group)
    spread = lambda c: (F.min(c).over(group), F.max(c).over(group))
    (lo, hi), (first, last), (operator, other) = spread("parent_atom_count"), spread("atom_index"), spread("logical_operator")
    members = (lo != n) | (hi != n) | (first != 1) | (last != n) | (F.size(F.collect_set("atom_index").over(group)) != n)
    logic = (n > 1) & ((operator != other) | (operator == "standalone"))
    return F.array_compact(F.array(F.when(members, F.lit("GROUP_MEMBERS")), F.when(logic, F.lit("GROUP_OPERATOR"))))


def apply_review(reviewed: DataFrame, jobs: DataFrame, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejects (job_id, reason)): a job is applied whole or not at all.

    All checks are windows whose keys begin with job_id, so the rows are shuffled by it once; no group is larger
    than a job. The longest keys come first, and each window reads what the one before it told: their order then stays,
    and one sort serves all.
    """
    told = lambda *rules: F.array_compact(F.array(*[F.when(bad, F.lit(name)) for bad, name in rules]))
    job, group = Window.partitionBy("job_id"), Window.partitionBy("job_id", "parent_statement_id")
    ids = expected.groupBy("job_id").agg(F.array_sort(F.collect_set("row_id")).alias("expected_ids"))
    rows = reviewed_rows(reviewed, jobs).join(ids, "job_id", "left")
    rows = rows.withColumn("equal", F.count("*").over(Window.partitionBy("job_id", *signature())) > 1)
    rows = rows.withColumn("own_reasons", F.concat("reject_reasons", told((F.col("equal"), "DUPLICATE"))))
    rows = rows.withColumns({"group_reasons": _group_reasons(), "most": F.max(F.size("own_reasons")).over(group)})
    rows = rows.withColumns({"bad": F.max(F.col("most") + F.size("group_reasons")).over(job), "ids": F.collect_set("row_id").over(job)})
    rows = rows.withColumn("job_reasons", told((~F.coalesce(F.array_sort("ids") == F.col("expected_ids"), F.lit(False)), "ROW_IDS")))
    good = (F.col("bad") == 0) & (F.size("job_reasons") == 0)
    accepted = rows.filter(good).drop("equal", "own_reasons", "group_reasons", "most", "bad", "ids", "job_reasons", "expected_ids")
    rejects = rows.filter(~good).select("job_id", F.explode(F.concat("own_reasons", "group_reasons", "job_reasons")).alias("reason"))
    unknown = reviewed.select("job_id").distinct().join(jobs.select("job_id"), "job_id", "left_anti").select("job_id", F.lit("UNKNOWN_JOB").alias("reason"))
    return accepted, rejects.unionByName(unknown).distinct()
