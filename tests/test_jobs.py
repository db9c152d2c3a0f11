"""Cohort jobs, the library's files, and the table forms of criteria."""

import json

import pytest
from pyspark.sql import functions as F

from trialframe.functions import columns as C
from trialframe.operators import cohort, library
from trialframe.operators.normalize import duplicate_ids, with_group_issues
from trialframe.operators.validate import validate
from trialframe.sources import readers, writers

JOB = "job_id string, trial_id string, status string, updated_at string, checkpoint_rows array<string>"


@pytest.fixture
def jobs(spark):
    return spark.createDataFrame([("j1", "T1", "completed", "2024-01-03", ["x"]), ("j2", "T2", "completed", "2024-01-02", []), ("j3", "T3", "failed", "2024-01-01", ["y"]), ("j4", "T9", "completed", "2024-01-04", ["z"])], JOB)


@pytest.fixture
def manifest(spark):
    return spark.createDataFrame([("T3", 0), ("T1", 1), ("T2", 2), ("T4", 3)], "trial_id string, pos long")


def test_jobs_of_a_manifest(spark, jobs, manifest):
    assert [r.job_id for r in cohort.jobs_in_order(manifest, jobs).collect()] == ["j3", "j1", "j2"]
    assert {r.job_id for r in cohort.completed_jobs(manifest, jobs).collect()} == {"j1", "j2"}
    studies = spark.createDataFrame([("T1", "a"), ("T7", "b")], "trial_id string, protocol_text string")
    assert [(r.trial_id, r.pos) for r in cohort.study_protocols(manifest, studies).collect()] == [("T1", 1)]


def test_renormalizing(spark, jobs):
    ready = cohort.renormalizable(jobs)
    assert {r.job_id for r in ready.collect()} == {"j1", "j4"}
    criteria = spark.createDataFrame([("j1",), ("j1",), ("j4",)], "job_id string")
    assert [tuple(r) for r in cohort.renormalize_summary(jobs, criteria).select("jobs", "rows", "skipped").collect()] == [(2, 3, 2)]


def test_summaries_of_recent_jobs(jobs):
    rows = cohort.recent_jobs(jobs, 2).collect()
    assert [r.job_id for r in rows] == ["j4", "j1"] and rows[0].asDict().keys() == set(cohort.SUMMARY) and rows[0].error is None and len(cohort.SUMMARY) == 11


def criteria(spark):
    row = dict(criterion_id="a", row_id="a", protocol_id="P", trial_id="T", source_version="v1", source_retrieved_at="t", protocol_hash="h", parent_statement_id="s", criterion_type="inclusion", domain="measurement", entity="ANC", comparator=">", value="5", unit="mg", lower_bound=5.0, lower_inclusive=False, negated=False, logical_operator="and", source="ANC > 5 mg", parent_atom_count=2, human_review_status="accepted")
    rows = [row, row | {"criterion_id": "b", "row_id": "b", "entity": " anc "}, row | {"criterion_id": "c", "row_id": "c", "comparator": None, "lower_bound": None, "lower_inclusive": None, "value": "present"}]
    kinds = {"lower_bound": "double", "lower_inclusive": "boolean", "negated": "boolean", "parent_atom_count": "int"}
    made = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{c} {kinds.get(c, 'string')}" for c in row))
    return made.withColumns({"upper_bound": F.lit(None).cast("double"), "upper_inclusive": F.lit(None).cast("boolean"), **{c: F.lit(None).cast("string") for c in ("temporal", "repetition", "qualifier")}})


def test_equal_criteria_and_covered_ones(spark):
    rows = criteria(spark)
    assert {r.criterion_id for r in duplicate_ids(rows).collect()} == {"a", "b"}
    alone = {r.criterion_id: [i.code for i in r.validation_issues] for r in validate(rows).collect()}
    assert alone["c"] == ["COMPARISON_NOT_STRUCTURED"]
    found = {r.criterion_id: r for r in with_group_issues(validate(rows)).collect()}
    codes = {k: [i.code for i in r.validation_issues] for k, r in found.items()}
    assert codes == {"a": ["DUPLICATE_ATOMIC_CRITERION"], "b": ["DUPLICATE_ATOMIC_CRITERION"], "c": []}
    assert [found[k].export_ready for k in "abc"] == [False, False, True] and found["a"].readiness_blockers == ["DUPLICATE_ATOMIC_CRITERION"]


def whole(spark):
    rows = library.upgrade(criteria(spark)).withColumn("reviewed_at", F.lit("2024-02-02T00:00:00Z"))
    return rows.withColumns({c: F.lit(None).cast("string") for c in writers.SNAPSHOT_COLUMNS if c not in rows.columns})


def test_a_snapshot_written_again_replaces_itself(spark, tmp_path):
    rows = whole(spark)
    for name in ("one", "two", "one"):
        writers.write_snapshot(rows, f"file://{tmp_path}", name)
    assert {(r.snapshot_id, r["count"]) for r in spark.read.parquet(f"{tmp_path}/parquet").groupBy("snapshot_id").count().collect()} == {("one", 3), ("two", 3)}
    flat = spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/csv/one")
    assert flat.columns == list(writers.SNAPSHOT_COLUMNS) and flat.count() == 3


def test_validated_export(spark, tmp_path):
    rows = whole(spark)
    writers.write_validated_export(rows, f"file://{tmp_path}/good")
    assert spark.read.json(f"{tmp_path}/good").count() == rows.filter("export_ready").count() > 0
    with pytest.raises(ValueError, match="domain"):
        writers.write_validated_export(rows.withColumn("domain", F.lit("lab")), f"file://{tmp_path}/bad")


def test_library_files(spark, tmp_path):
    entry = {"row_id": "r1", "trial_id": "T", "criterion_type": "inclusion", "domain": "person", "entity": "Age", "value": "5", "source": "Age"}
    (tmp_path / "base.json").write_text(json.dumps({"entries": [entry]}))
    folder = tmp_path / "library"
    folder.mkdir()
    for name, ident in (("criteriaLibrary_1", "old"), ("criteriaLibrary_2", "new"), ("eavLibrary_9", "legacy")):
        (folder / f"{name}.json").write_text(json.dumps({"entries": [entry | {"row_id": ident}]}))
    assert [r.row_id for r in readers.read_library(spark, f"file://{folder}").collect()] == ["new"]
    both = readers.read_whole_library(spark, f"file://{folder}", f"file://{tmp_path}/base.json")
    assert {(r.library_source, r.row_id) for r in both.collect()} == {("immutable_base", "r1"), ("reviewed", "new")}
    table = library.analysis_table(both)
    assert table.columns == library.ANALYSIS_COLUMNS and table.filter("readiness_blockers like '%HUMAN_REVIEW_REQUIRED%'").count() == 2
    assert library.reset(both).count() == 0 and library.reset(both).columns == both.columns


def test_sorting_reads_numbers_as_numbers(spark):
    rows = spark.createDataFrame([("10",), ("9",), ("x",), (None,)], "value string")
    assert [r.value for r in library.sorted_by(rows, "value").collect()] == ["9", "10", "x", None]


def test_pasted_protocols(spark):
    rows = [("manual", " ", "\tText \n", None), ("nct", "nct0001", None, None), ("pdf", "x1", "  ", None), ("fax", "x2", "t", None)]
    got = readers.pasted_protocols(spark.createDataFrame(rows, "input_mode string, trial_id string, protocol_text string, protocol_label string")).collect()
    assert [r.error for r in got] == [None, "bad registry id", "no protocol text", "unknown input mode"]
    assert (got[0].trial_id, got[0].protocol_text) == ("MANUAL", "Text") and got[0].protocol_id.startswith("MANUAL-")


def test_job_records(spark, tmp_path):
    (tmp_path / "j.json").write_text(json.dumps({"job_id": "j", "rows": [{"entity": "a"}, {"entity": "b"}], "events": []}, indent=1))
    jobs = readers.read_jobs(spark, f"file://{tmp_path}/j.json")
    assert [(r.job_id, r.ord, r.entity) for r in readers.job_children(jobs, "rows").collect()] == [("j", 0, "a"), ("j", 1, "b")]


def test_ids_strip_texts_and_drop_the_number_zero_only(spark):
    row = spark.createDataFrame([("\t a \n", 0, "0", 0.0)], "a string, n int, t string, d double")
    ids = row.select(C.stable_id("x", "a", "n"), C.stable_id("x", F.lit("a"), F.lit("")), C.stable_id("x", F.lit("a"), "t"), C.stable_id("x", "a", "d"), C.confidence(F.lit(None)), C.confidence(F.lit("7"))).first()
    assert ids[0] == ids[1] == ids[3] != ids[2] and tuple(ids[4:]) == (0.5, 1.0)


def test_records_that_cannot_be_read_are_kept_with_their_fault(spark, tmp_path):
    texts = {
        "good": '{"job_id": "J1", "progress": 5, "events": [{"timestamp": "t", "stage": "queued", "message": "m"}], "rows": [{"entity": "ALT", "upper_bound": 40}], "new_field": 1}',
        "list": '[{"job_id": "J2"}, {"job_id": "J3", "progress": "much"}]',
        "fine": '[{"job_id": "J5"}]',
        "broken": '{"job_id": "J4", "progress": 5',
        "none": '{"trial_id": "NCT00000001"}',
        "cut": "",
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    jobs = readers.read_jobs(spark, f"file://{tmp_path}")
    assert jobs.columns[:3] == ["job_id", "trial_id", "input_mode"] and jobs.columns[-3:] == ["file", "fault", "raw"]
    assert sorted((r.job_id, r.progress) for r in jobs.filter("fault is null").collect()) == [("J1", 5), ("J2", None), ("J5", None)]
    faults = sorted((r.file.rsplit("/", 1)[1], r.fault, r.key) for r in readers.record_faults(jobs, "job_id").collect())
    assert [f[:2] for f in faults] == [("broken.json", "unreadable"), ("list.json", "unreadable"), ("none.json", "no job_id")]
    good = jobs.filter("fault is null")
    assert [(r.ord, r.stage) for r in readers.job_children(good, "events").collect()] == [(0, "queued")]
    assert [(r.entity, r.upper_bound) for r in readers.job_children(good, "rows").collect()] == [("ALT", 40.0)]


def test_studies_that_cannot_be_read(spark, tmp_path):
    study = '{"protocolSection": {"identificationModule": {"nctId": "nct01234567"}, "eligibilityModule": {"eligibilityCriteria": "Inclusion"}}}'
    (tmp_path / "1.json").write_text(study)
    (tmp_path / "2.json").write_text(study[:40])
    (tmp_path / "3.json").write_text('{"protocolSection": {"identificationModule": "x"}}')
    found = {r.file.rsplit("/", 1)[1]: (r.trial_id, r.error) for r in readers.read_studies(spark, f"file://{tmp_path}").collect()}
    assert found == {"1.json": ("NCT01234567", None), "2.json": (None, "unreadable record"), "3.json": (None, "unreadable record")}


def test_natural_order(spark):
    rows = spark.createDataFrame([(x,) for x in ("10 mg", "9 mg", "x", None, "9 MG", "009 mg", "123456789012345678901", "123456789012345678900", "a10b2", "a10b10", "a9", "")], "value string")
    assert [r.value for r in library.sorted_by(rows, "value").collect()] == ["", "009 mg", "9 MG", "9 mg", "10 mg", "123456789012345678900", "123456789012345678901", "a9", "a10b2", "a10b10", "x", None]
    assert [r.value for r in library.sorted_by(rows, "value", descending=True).limit(3).collect()] == ["x", "a10b10", "a10b2"]
