"""Answers of a model, their table, library snapshots, and streams into them."""

import json

import pytest
from pyspark.sql import functions as F

from trialframe.operators import extract, intake
from trialframe.operators.segment import segment
from trialframe.sources import readers, storage
from trialframe.sources.snapshots import Conflict, LibrarySnapshots
from trialframe.streaming import jobs

PROTOCOL = "protocol_id string, trial_id string, source_version string, source_uri string, source_retrieved_at string, protocol_hash string, protocol_text string"


def proposal(source, **other):
    row = dict.fromkeys(intake.PROPOSAL_FIELDS) | {"criterion_type": "inclusion", "domain": "measurement", "entity": "ALT", "comparator": "<", "value": 40, "unit": "U/L", "negated": False, "logical_operator": "standalone", "upper_bound": 40, "extraction_confidence": 0.9, "source": source}
    return row | other


def protocols(spark, n=1, text="Inclusion Criteria:\n* ALT < 40 U/L\n* Able to consent"):
    return spark.createDataFrame([(f"P{i}", f"P{i}", "v1", None, "2024-01-01", "sha256:1", text) for i in range(n)], PROTOCOL)


def read(spark, *answers):
    rows = spark.createDataFrame([("P0", i, x) for i, x in enumerate(answers)], "protocol_id string, batch long, answer string")
    return {(r.batch, r.place): r for r in intake.read_answers(rows).collect()}


def test_answers_that_cannot_be_read_are_told(spark):
    found = read(spark, None, "", "no", '{"rows": [', '{"rows": [1,]}', '{"row": []}', '{"rows": [], "x": 1}', '{"rows": {}}', '{"rows": []}', "[]", '{"rows": null}')
    assert {k[0]: r.faults for k, r in found.items()} == {0: ["no answer"], 1: ["no JSON object"], 2: ["no JSON object"], 3: ["no JSON object"], 4: ["broken JSON"], 5: ["no rows"], 6: ["unknown fields"], 7: ["rows are no list"], 9: ["no JSON object"], 10: ["rows are no list"]}
    assert all(k[1] is None for k in found) and found[4, None].raw == '{"rows": [1,]}'


def test_rows_are_judged_one_by_one(spark):
    good, wrong = proposal("a"), proposal("b", extraction_confidence=1.5, domain="lab")
    bare = {"source": "c"}
    rows = [good, wrong, bare, proposal("d", negated="no"), proposal("e", temporal=3), proposal("f") | {"more": 1}, 7, None, proposal("g", value="4 to 5"), proposal("h", lower_bound="4")]
    found = read(spark, "Well:\n```json\n" + json.dumps({"rows": rows}) + "\n```")
    faults = {k[1]: r.faults for k, r in found.items()}
    assert [i for i, x in faults.items() if not x] == [0, 8] and found[0, 0].value == "40" and found[0, 8].value == "4 to 5"
    assert faults[1] == ["against the contract: domain", "against the contract: extraction_confidence"]
    assert "missing: entity" in faults[2] and faults[3] == ["wrong types"] and faults[4] == ["wrong type: temporal"] and faults[5] == ["unknown: more"] and faults[6] == faults[7] == ["no object"] and faults[9] == ["wrong types"]


def test_the_first_attempt_that_can_be_read_counts(spark):
    rows = [("P", 0, 1, "?"), ("P", 0, 2, json.dumps({"rows": [proposal("a")]})), ("P", 0, 3, json.dumps({"rows": [proposal("b")]})), ("P", 1, 1, "?")]
    answers = spark.createDataFrame(rows, "protocol_id string, batch long, attempt int, answer string")
    assert sorted((r.batch, r.source, r.faults) for r in intake.read_answers(answers).collect()) == [(0, "a", []), (1, None, ["no JSON object"])]


def test_criteria_of_answers(spark):
    given = protocols(spark)
    answer = json.dumps({"rows": [proposal("ALT < 40 U/L", qualifier="twice"), proposal("invented"), proposal("Able to consent", domain="none")]})
    answers = spark.createDataFrame([("P0", 0, answer)], "protocol_id string, batch long, answer string")
    found = {r.source: r for r in intake.criteria_of_answers(answers, segment(given), given).collect()}
    assert found.keys() == {"ALT < 40 U/L", "Able to consent"}
    assert found["ALT < 40 U/L"].qualifier == "twice" and found["ALT < 40 U/L"].upper_bound == 40 and found["Able to consent"].qualifier is None
    assert intake.rejected(intake.read_answers(answers)).select("place").collect() == [(2,)]


def count_asked(log):
    return len(list(log.iterdir())) if log.exists() else 0


def asker(log, fail_on=None):
    """Answers a prompt with no rows, and notes each prompt as a file; fails for good on some prompts."""
    folder = str(log)

    def ask(prompt):
        import os
        import uuid

        os.makedirs(folder, exist_ok=True)
        open(os.path.join(folder, uuid.uuid4().hex), "w").close()
        if fail_on and fail_on in prompt:
            os._exit(1)  # the worker dies, and with it the job
        return '{"rows": []}'

    return ask


def test_a_run_that_failed_asks_only_for_the_rest(spark, tmp_path):
    items = segment(protocols(spark, 6, "Inclusion Criteria:\n" + "\n".join(f"* item {i}" for i in range(5)))).withColumn("source", F.concat("source", F.lit(" of "), "protocol_id"))
    folder = f"file://{tmp_path}/kept"
    with pytest.raises(Exception, match=r".+"):
        extract.answer_batches(items, asker(tmp_path / "one", "item 4 of P3"), folder, size=2, wave=1)
    kept = extract.kept_answers(items, folder).count()
    assert 0 < kept < 18
    found = extract.answer_batches(items, asker(tmp_path / "two"), folder, size=2, wave=4)
    assert found.count() == 18 and count_asked(tmp_path / "two") == 18 - kept
    assert extract.answer_batches(items, asker(tmp_path / "three"), folder, size=2).count() == 18 and count_asked(tmp_path / "three") == 0
    changed = items.withColumn("source", F.when((F.col("protocol_id") == "P1") & (F.col("item_no") == 1), "new").otherwise(F.col("source")))
    assert extract.answer_batches(changed, asker(tmp_path / "four"), folder, size=2).count() == 18 and count_asked(tmp_path / "four") == 1
    assert [x for x in storage.names(spark, folder) if x.startswith("waiting")] == []


def test_answers_that_stay_bad_are_asked_for_again(spark, tmp_path):
    items, folder = segment(protocols(spark)), f"file://{tmp_path}/kept"
    (row,) = extract.answer_batches(items, lambda prompt: "nothing", folder).collect()
    assert (row.attempts, row.answer, row.error) == (2, "nothing", "no JSON object")
    (row,) = extract.answer_batches(items, lambda prompt: '{"rows": []}', folder).collect()
    assert (row.attempts, row.error) == (1, None)


# --- snapshots -------------------------------------------------------------------------------------------------

ENTRY = "trial_id string, source string, criterion_type string, entity string"


def entries(spark, *rows, seq=None):
    found = spark.createDataFrame(list(rows), ENTRY)
    return found if seq is None else found.withColumn("seq", F.lit(seq))


def held(library, number=None):
    return sorted((r.trial_id, r.source, r.entity) for r in library.read(number=number).collect())


def test_snapshots(spark, tmp_path):
    library = LibrarySnapshots(spark, f"file://{tmp_path}/library", parts=8)
    with pytest.raises(FileNotFoundError):
        library.read()
    assert library.replace(entries(spark, *[(f"T{i}", "s", "inclusion", "old") for i in range(40)])) == 1
    assert library.upsert(entries(spark, ("T3", "s", "inclusion", "new"), ("T3", "more", "inclusion", "x"), seq=1), batch=("reviews", 7)) == 2
    assert held(library, 1) == sorted((f"T{i}", "s", "old") for i in range(40))
    assert held(library) == sorted([*((f"T{i}", "s", "old") for i in range(40) if i != 3), ("T3", "s", "new"), ("T3", "more", "x")])
    first, second = library.record(1)["data"], library.record(2)["data"]
    assert sum(first[k] != second[k] for k in second) == 1  # one part of eight was written
    # a batch that is run again, or an earlier one, changes nothing
    assert library.upsert(entries(spark, ("T3", "s", "inclusion", "late"), seq=1), batch=("reviews", 7)) == 2 == library.upsert(entries(spark, ("T4", "s", "inclusion", "late"), seq=1), batch=("reviews", 6))
    plan = library.read(["T3"])._jdf.queryExecution().toString()
    assert plan.count("part_of=") <= 2 * 1 or "part_of=" in plan
    assert len(library.read(["T3"]).inputFiles()) == 1 and library.read(["T3"]).count() == 2
    assert library.reset() == 3 and held(library) == [] and library.read().columns == ENTRY.replace(" string", "").split(", ") and len(held(library, 2)) == 41
    assert library.upsert(entries(spark, ("T9", "s", "inclusion", "again"), seq=1)) == 4 and held(library) == [("T9", "s", "again")]
    library.remove_before(4)
    assert library.numbers() == [4] and held(library) == [("T9", "s", "again")] and len(storage.names(spark, f"file://{tmp_path}/library/data")) == 1


def test_a_failed_write_leaves_the_snapshot_before(spark, tmp_path):
    library = LibrarySnapshots(spark, f"file://{tmp_path}/library", parts=4)
    library.replace(entries(spark, ("T1", "s", "inclusion", "old")))
    broken = entries(spark, ("T1", "s", "inclusion", "new"), seq=1).withColumn("entity", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        library.upsert(broken)
    assert held(library) == [("T1", "s", "old")] and library.numbers() == [1]
    other = LibrarySnapshots(spark, f"file://{tmp_path}/library")
    before = other.record()
    library.replace(entries(spark, ("T1", "s", "inclusion", "mine")))
    with pytest.raises(Conflict):
        other._publish(before, other.read().schema, {}, {})
    assert held(library) == [("T1", "s", "mine")]


# --- streams ---------------------------------------------------------------------------------------------------


def test_reviews_reach_the_library_once(spark, tmp_path, monkeypatch):
    library = LibrarySnapshots(spark, f"file://{tmp_path}/library", parts=8)
    library.replace(entries(spark, *[(f"T{i}", "s", "inclusion", "old") for i in range(20)]))
    monkeypatch.setattr(jobs, "reviewed_cells", lambda sheet: sheet)
    monkeypatch.setattr(jobs, "apply_review", lambda sheet, of, expected: (sheet, None))
    sheets = tmp_path / "sheets"
    sheets.mkdir()
    (sheets / "1.json").write_text('{"trial_id": "T5", "source": "s", "criterion_type": "inclusion", "entity": "reviewed"}\n')

    def run(checkpoint):
        jobs.stream_reviews(spark.readStream.schema(ENTRY).json(str(sheets)), None, None, library, str(tmp_path / checkpoint)).awaitTermination()

    run("a")
    assert ("T5", "s", "reviewed") in held(library) and library.numbers() == [1, 2]
    run("b")  # the stream starts anew and brings its batch 0 again
    assert library.numbers() == [1, 2] and len(held(library)) == 20
    (sheets / "2.json").write_text('{"trial_id": "T6", "source": "s", "criterion_type": "inclusion", "entity": "reviewed"}\n')
    run("a")
    assert ("T6", "s", "reviewed") in held(library) and library.numbers() == [1, 2, 3]


def test_protocols_with_a_model(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    row = {"protocol_id": "P0", "trial_id": "P0", "source_version": "v1", "source_retrieved_at": "2024-01-01", "protocol_hash": "sha256:1", "protocol_text": "Inclusion Criteria:\n* ALT < 40 U/L"}
    (landing / "1.json").write_text(json.dumps(row))
    answer = json.dumps({"rows": [proposal("ALT < 40 U/L", qualifier="twice"), 7]})
    jobs.stream_protocols(spark, str(landing), PROTOCOL, str(tmp_path / "out"), str(tmp_path / "c"), ask=lambda prompt: answer).awaitTermination()
    assert [r.qualifier for r in spark.read.parquet(str(tmp_path / "out" / "batch=0")).collect()] == ["twice"]
    assert [r.faults for r in spark.read.parquet(str(tmp_path / "out" / "rejected" / "batch=0")).collect()] == [["no object"]]


def test_job_states_expire(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        source = tmp_path / "events"
        source.mkdir()
        events = spark.readStream.schema("event_id string, job_id string, ts timestamp, stage string").option("maxFilesPerTrigger", 1).json(str(source))
        parts = [
            [("e1", "J1", "2024-01-01T00:00:00Z", "queued"), ("e2", "J1", "2024-01-01T00:10:00Z", "completed"), ("e2", "J1", "2024-01-01T00:10:00Z", "completed"), ("e3", "J2", "2024-01-01T00:05:00Z", "queued")],
            [("e4", "J1", "2024-01-01T00:02:00Z", "extraction"), ("e5", "J2", "2024-01-01T00:20:00Z", "extraction")],
            [("e6", "J2", "2024-01-05T00:00:00Z", "extraction")],
            [("e7", "J2", "2024-01-05T01:00:00Z", "failed")],
            [("e8", "J3", "2024-01-20T00:00:00Z", "queued")],
            [("e9", "J3", "2024-01-20T02:00:00Z", "queued")],
        ]
        rows = {}
        sizes = []
        for i, part in enumerate(parts):
            (source / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("event_id", "job_id", "ts", "stage"), x, strict=True))) for x in part))
            query = jobs.job_states(events).writeStream.outputMode("append").foreachBatch(lambda df, _: rows.update({r.event_id: r for r in df.collect()})).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            query.awaitTermination()
            sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert {k: (r.applied, r.stage, r.events) for k, r in rows.items()} == {
        "e1": (True, "queued", 1), "e2": (True, "completed", 2), "e3": (True, "queued", 1), "e4": (False, "completed", 3), "e5": (True, "extraction", 2),
        "e6": (True, "extraction", 3), "e7": (True, "failed", 4), "e8": (True, "queued", 1), "e9": (True, "queued", 2),
    }
    assert sizes[1] >= 2 and sizes[-1] < max(sizes)


def test_read_review_sheet(spark, tmp_path):
    (tmp_path / "sheet.csv").write_text('job_id,source,entity\nJ1,"two\nlines, ""quoted""",ALT\n,x,\n')
    rows = readers.read_review_sheet(spark, f"file://{tmp_path}/sheet.csv").collect()
    assert [(r.job_id, r.source, r.entity) for r in rows] == [("J1", 'two\nlines, "quoted"', "ALT"), (None, "x", None)]


def test_a_proposed_row_is_read_once_for_all_its_rules(spark):
    rows = intake.read_answers(spark.createDataFrame([("p", 0, '{"rows": [{}]}')], "protocol_id string, batch long, answer string"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("jsonObjectKeys(") == 2 and plan.count("parseJson(") == 2  # of the answer, and of its rows


def test_objects_of_odd_answers_are_those_of_the_plain_pattern(spark):
    import re

    from trialframe.functions.columns import model_json

    texts = ["````json\n{1}\n````", "```{1}``` ```{2}```", "``` {1} x ``` {2} \n```", "```json{1```", "```x``` ```json\n{a}```", "} {", "{", "}", "a { b } c } d {", "```{a}", "```json\n{ '```' }\n```", "", "é{\U0001f600}}x", "```\n{1}\n```}"]

    def plain(x):
        m = re.search(r"```(?:json)?\s*(\{.*?\})\s*```", x, re.DOTALL) or re.search(r"(\{.*\})", x, re.DOTALL)
        return m[1] if m else None

    found = spark.createDataFrame([(x,) for x in [*texts, None]], "t string").select("t", model_json("t").alias("j")).collect()
    assert [r.j for r in found] == [*map(plain, texts), None]
