"""Jobs on small tables."""

from pyspark.sql import functions as F

from trialframe.functions import columns as C
from trialframe.operators import cohort, cost, extract, library, review
from trialframe.operators.normalize import normalize
from trialframe.operators.segment import labelled_parts, segment, statements
from trialframe.operators.validate import validate
from trialframe.sources import readers, writers

PROTOCOL = "protocol_id string, trial_id string, source_version string, source_uri string, source_retrieved_at string, protocol_hash string, protocol_text string"


def protocol(spark, text, name="P1"):
    return spark.createDataFrame([(name, name, "v1", None, "2024-01-01", "sha256:1", text)], PROTOCOL)


def test_statements():
    text = "Ignored before\r\nKey Inclusion Criteria:\n* Age >= 18 years;\n  able to consent\n1) HIV negative\nLabs:\nALT < 40 U/L\nExclusion criteria for all participants\n- Pregnant\n2.1 Next section"
    assert statements(text) == [("inclusion", "Age >= 18 years; able to consent"), ("inclusion", "HIV negative"), ("inclusion", "ALT < 40 U/L"), ("exclusion", "Pregnant")]
    assert statements("one\n\ntwo") == [("inclusion", "one"), ("inclusion", "two")]
    assert statements(None) == []
    assert labelled_parts("x Age: 18 and over, Renal: normal, Other: none.") == ["Age: 18 and over", "Renal: normal", "Other: none"]


def test_segments_and_context(spark):
    rows = segment(protocol(spark, "Inclusion Criteria\n* a; b\n* c\nExclusion Criteria\n* d")).orderBy("item_no").collect()
    assert [(r.source, r.criterion_type, r.parent_source_index, r.fragment_no) for r in rows] == [("a", "inclusion", 1, 1), ("b", "inclusion", 1, 2), ("c", "inclusion", 2, 1), ("d", "exclusion", 3, 1)]
    assert rows[0].surrounding_context == "a; b\nc" and rows[2].surrounding_context == "a; b\nc\nd" and rows[0].source_id == rows[1].source_id != rows[2].source_id


def test_normalize(spark):
    protocols = protocol(spark, "Inclusion Criteria\n* ANC >= 1500 and platelets >= 90000\n* At least 2 prior visits\nExclusion Criteria\n* Pregnant")
    items = segment(protocols)
    proposals = spark.createDataFrame(
        [("P1", 1, "ANC >= 1500 and platelets >= 90000", "exclusion", "ANC", "1500", 0.9), ("P1", 2, "ANC >= 1500 and platelets >= 90000", "inclusion", "platelets", "90000", 0.8), ("P1", 3, "ANC >= 1500 and platelets >= 90000", "inclusion", "anc", "1500", 0.95), ("P1", 4, "Invented", "inclusion", "x", None, 0.5)],
        "protocol_id string, ord int, source string, criterion_type string, entity string, value string, extraction_confidence double",
    )
    rows = {(r.parent_statement, r.atom_index): r for r in normalize(proposals, items, protocols).collect()}
    first, second = rows["ANC >= 1500 and platelets >= 90000", 1], rows["ANC >= 1500 and platelets >= 90000", 2]
    assert (first.entity, first.lower_bound, first.extraction_confidence, first.criterion_type) == ("Absolute Neutrophil Count", 1500.0, 0.95, "inclusion")
    assert (second.entity, second.lower_bound, second.logical_operator) == ("Platelet Count", 90000.0, "and")
    assert first.parent_atom_count == 2 and not first.export_ready and "HUMAN_REVIEW_REQUIRED" in first.readiness_blockers
    written = [r for k, r in rows.items() if k[0] == "At least 2 prior visits"]
    assert {r.comparator for r in written} == {">=", None} and len(rows) == 5
    # a sibling's comparison covers the categorical atom
    assert all("COMPARISON_NOT_STRUCTURED" not in [i.code for i in r.validation_issues] for r in written)
    again = {r.criterion_id for r in normalize(proposals, items, protocols).collect()}
    assert again == {r.criterion_id for r in rows.values()}


def test_validation_codes(spark):
    rows = spark.createDataFrame(
        [("a", "inclusion", "", "x", ">", None, None, 5.0, True, 3.0, None, False, None, None, "standalone", 1), ("b", "other", "e", "no e before 2 visits and > 3 mg/dL", ">", "3", None, None, None, None, True, False, None, None, "standalone", 2), ("c", "exclusion", "e", "without e", None, "5", None, None, None, None, None, True, None, None, "or", 2)],
        "criterion_id string, criterion_type string, entity string, source string, comparator string, value string, unit string, lower_bound double, lower_inclusive boolean, upper_bound double, upper_inclusive boolean, negated boolean, temporal string, repetition string, logical_operator string, parent_atom_count int",
    )
    for c in ("protocol_id", "source_version", "source_retrieved_at", "protocol_hash", "human_review_status"):
        rows = rows.withColumn(c, F.lit("accepted"))
    got = {r.criterion_id: [i.code for i in r.validation_issues] for r in validate(rows).collect()}
    assert got["a"] == ["ENTITY_MISSING", "COMPARATOR_WITHOUT_VALUE", "INTERVAL_REVERSED"]
    assert got["b"] == ["CRITERION_TYPE_INVALID", "UPPER_INCLUSIVITY_WITHOUT_BOUND", "NEGATION_UNCAPTURED", "UNIT_UNCAPTURED", "TEMPORAL_UNCAPTURED", "REPETITION_UNCAPTURED", "COMPOUND_SCOPE_MISSING"]
    assert got["c"] == ["NEGATION_VALUE_CONFLICT"]


def test_manifest_and_retries(spark):
    texts = spark.createDataFrame([('{"cohort_id": "c", "trials": [{"trial_id": " nct00000001 "}, "NCT00000002", {"trial_id": "", "status": "TBD"}, {"trial_id": "NCT00000001"}, {"trial_id": " "}]}',), ('["x1"]',)], "value string")
    entries = readers.manifest_entries(texts)
    assert sorted(r.trial_id for r in cohort.manifest_trials(entries).collect()) == ["", "NCT00000001", "NCT00000002", "X1"]
    assert cohort.blank_slots(entries).count() == 1
    attempts = spark.createDataFrame([("a", True, "x"), ("a", True, "x"), ("b", True, "No criteria segmented"), ("c", False, None), *[("d", True, "x")] * 3], "trial_id string, failed boolean, error string")
    assert {r.trial_id: r.next_action for r in cohort.retry_actions(attempts).collect()} == {"a": "retry", "b": "stop", "c": "done", "d": "stop"}


def test_costs(spark):
    usage = spark.createDataFrame([("r", 1, "m", 1_000_000, 0), ("r", 2, "m", 1_000_000, 0), ("r", 3, "odd", 5, 5)], "run_id string, seq int, model string, input_tokens long, output_tokens long")
    priced = cost.priced(usage, spark.createDataFrame([("m", 1.0, 2.0)], "model string, input_per_1m double, output_per_1m double"))
    assert {r.model: (r.cost, r.warn) for r in cost.cost_summary(priced, 2.0).collect()} == {"m": (2.0, True), "odd": (0.0, False)}
    assert cost.running_cost(priced, 1.0).first().seq == 2 and cost.running_cost(priced, 2.0).count() == 0


def test_review_is_all_or_nothing(spark):
    protocols = protocol(spark, "Inclusion Criteria\n* Age >= 18 years\n* Weight >= 40 %").unionByName(protocol(spark, "Inclusion Criteria\n* Age >= 21 years", "P2"))
    items = segment(protocols)
    criteria = normalize(items.limit(0).select("protocol_id", F.lit(0).alias("ord"), "source"), items, protocols).withColumn("job_id", F.concat(F.lit("J"), "protocol_id"))
    sheet = review.review_table(criteria).select(*[F.col(c).cast("string").alias(c) for c in review.REVIEW_COLUMNS])
    bad = (F.col("job_id") == "JP1") & (F.col("entity") == "WEIGHT")
    sheet = sheet.withColumn("review_status", F.when(bad, "pending").otherwise("accepted"))
    jobs = protocols.select(F.concat(F.lit("J"), "protocol_id").alias("job_id"), F.lit("completed").alias("status"), "trial_id", "protocol_id", "source_version", "source_uri", "source_retrieved_at", "protocol_hash", F.lit("2024-02-02T00:00:00Z").alias("reviewed_at"))
    accepted, rejects = review.apply_review(review.reviewed_cells(sheet), jobs, criteria.select("job_id", "row_id"))
    assert {r.job_id for r in accepted.collect()} == {"JP2"}
    assert {(r.job_id, r.reason) for r in rejects.collect()} >= {("JP1", "NOT_REVIEWED"), ("JP1", "NOT_READY")}
    exported = library.validated_export(accepted).select("violations").first()
    assert exported.violations == []


def test_snapshots_round_trip(spark, tmp_path):
    protocols = protocol(spark, "Inclusion Criteria\n* Age >= 18 years")
    items = segment(protocols)
    rows = normalize(items.limit(0).select("protocol_id", F.lit(0).alias("ord"), "source"), items, protocols)
    writers.write_snapshot(rows, str(tmp_path), "s1")
    assert spark.read.parquet(f"{tmp_path}/parquet").count() == 1
    flat = spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/csv/s1")
    assert flat.columns == writers.SNAPSHOT_COLUMNS and flat.first().entity == "Age"
    files = spark.createDataFrame([("eavLibrary_9.json",), ("criteriaLibrary_1.json",), ("criteriaLibrary_2.json",)], "name string")
    assert library.latest_snapshot(files).first().name == "criteriaLibrary_2.json"


def test_pages_and_model_text(spark):
    pages = spark.createDataFrame([(1, 1, "Key inclusion criteria\n......"), (1, 2, "intro\n5.1 Inclusion criteria\n* Age >= 18\nPage 2 of 9"), (1, 3, "5.2 Exclusion criteria\n* Pregnant\n6.1 Design\nlater"), (2, 1, "nothing")], "doc_id int, page_no int, text string")
    got = {r.doc_id: r.protocol_text for r in readers.pages_to_eligibility(pages).collect()}
    assert got == {1: "5.1 Inclusion criteria\n* Age >= 18\n5.2 Exclusion criteria\n* Pregnant", 2: None}
    texts = spark.createDataFrame([('say ```json\n{"a": 1}\n``` ok',), ('x {"b": {"c": 2}} y',), ("none",)], "t string")
    assert [r.j for r in texts.select(C.model_json("t").alias("j")).collect()] == ['{"a": 1}', '{"b": {"c": 2}}', None]


def test_extractor_failures_are_rows(spark):
    items = segment(protocol(spark, "\n".join(f"line {i}" for i in range(45))))

    def odd(rows):
        if rows[0]["item_no"] == 21:
            raise RuntimeError("down")
        return [{"source": r["source"]} for r in rows]

    got = {r.batch: r for r in extract.extract(items, odd).collect()}
    assert sorted(got) == [0, 1, 2] and got[1].error == "RuntimeError: down" and got[1].attempts == 2 and got[0].error is None


def test_legacy_entries(spark):
    old = spark.createDataFrame([("t", "1", "inclusion", "age", ">=", "18", "Age 18 or over", None), ("t", "2", "exclusion", "x", None, "present", "x", "drug")], "trial_id string, row_id string, criterion_type string, entity string, attribute string, value string, source string, domain string")
    rows = {r.row_id: r for r in library.upgrade(old).collect()}
    assert rows["1"].comparator == ">=" and rows["1"].lower_bound == 18.0 and rows["2"].domain == "drug" and rows["2"].human_review_status == "pending"


def test_intervals_with_open_and_closed_ends(spark):
    """All pairs of small intervals, against what numbers they hold."""
    import itertools

    ends = [None, 1.0, 2.0]
    shapes = [(a, i, b, j) for a, i, b, j in itertools.product(ends, (True, False), ends, (True, False)) if (a is not None or b is not None) and not (a and b and (a > b or a == b and not (i and j)))]
    rows = [(f"T{k}", "ALT", "U/L", a, i if a else None, b, j if b else None) for k, (a, i, b, j) in enumerate(shapes)]
    criteria = spark.createDataFrame(rows, "trial_id string, entity string, unit string, lower_bound double, lower_inclusive boolean, upper_bound double, upper_inclusive boolean")
    points = [0.5, 1.0, 1.5, 2.0, 2.5]

    def held(k):
        a, i, b, j = shapes[k]
        return {x for x in points if (a is None or x > a or i and x == a) and (b is None or x < b or j and x == b)}

    def relation(x, y):
        return "equal" if x == y else "disjoint" if not x & y else "subset" if x < y else "superset" if x > y else "overlap"

    found = {(r.trial_a, r.trial_b): r.relation for r in library.interval_relations(criteria).collect()}
    names = sorted(r[0] for r in rows)
    assert found == {(x, y): relation(held(int(x[1:])), held(int(y[1:]))) for x, y in itertools.combinations(names, 2)}
    pairs = {r.relation: r.n for r in library.interval_counts(criteria).groupBy(F.when(F.col("relation").isin("subset", "superset"), "within").otherwise(F.col("relation")).alias("relation")).agg(F.sum("trial_pairs").alias("n")).collect()}
    counted = {}
    for x in found.values():
        counted["within" if x in ("subset", "superset") else x] = counted.get("within" if x in ("subset", "superset") else x, 0) + 1
    assert pairs == counted


def test_wrapped_lines_are_glued_in_linear_time():
    import time

    def took(n):
        text = "Inclusion Criteria:\n* first\n" + "wrapped line\n" * n
        began = time.process_time()
        assert len(statements(text)) == 1
        return time.process_time() - began

    took(100)
    assert took(80_000) < 24 * max(took(10_000), 0.02)
