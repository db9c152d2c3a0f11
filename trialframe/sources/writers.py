"""Sinks: snapshots of the library and the validated export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.library import in_library_order, validated_export

#: The columns of a snapshot's flat file, in order.
SNAPSHOT_COLUMNS = (
    "criterion_id row_id parent_statement_id parent_statement parent_atom_count atom_index boolean_group_id source_id trial_id protocol_id source_version source_uri source_retrieved_at protocol_hash "
    "criterion_type domain entity comparator value unit value_kind lower_bound lower_inclusive upper_bound upper_inclusive interval negated temporal repetition qualifier logical_operator relations "
    "source surrounding_context extraction_confidence human_review_status validation_issues export_ready readiness_blockers reviewed_at"
).split()


def write_snapshot(entries: DataFrame, folder: str, snapshot_id: str) -> None:
    """A cumulative snapshot: Parquet in its own partition by snapshot_id, and a flat text form with nested columns as JSON.

    A snapshot that is written again replaces itself and no other.
    """
    entries.write.mode("overwrite").parquet(f"{folder}/parquet/snapshot_id={snapshot_id}")
    flat = in_library_order(entries).select(*[F.to_json(c).alias(c) if entries.schema[c].dataType.typeName() == "array" else F.col(c) for c in SNAPSHOT_COLUMNS])
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{folder}/csv/{snapshot_id}")


def write_validated_export(entries: DataFrame, path: str) -> None:
    """The entries that are ready, as JSON lines, in place of an earlier export; raises if any breaks the export's contract."""
    rows = validated_export(entries)
    bad = rows.filter(F.size("violations") > 0).select("criterion_id", "violations").head(1)
    if bad:
        raise ValueError(f"{bad[0]['criterion_id']} breaks the export contract: {', '.join(bad[0]['violations'])}")
    rows.drop("violations").write.mode("overwrite").json(path)
