import json

from trialframe.streaming.jobs import job_status, stream_protocols

SCHEMA = "protocol_id string, trial_id string, source_version string, source_uri string, source_retrieved_at string, protocol_hash string, protocol_text string"


def test_protocols_are_read_once(spark, tmp_path):
    landing, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    (tmp_path / "in").mkdir()

    def land(name):
        (tmp_path / "in" / f"{name}.json").write_text(json.dumps({"protocol_id": name, "trial_id": name, "source_version": "v", "protocol_text": "Inclusion Criteria\n* Age >= 18 years"}) + "\n")
        stream_protocols(spark, landing, SCHEMA, out, checkpoint).awaitTermination()

    land("a")
    land("b")
    assert sorted(r.protocol_id for r in spark.read.parquet(f"{out}/batch=*").collect()) == ["a", "b"]


def test_status_drops_replays(spark, tmp_path):
    rows = [(1, "j", "2024-01-01 00:00:00", "queued"), (2, "j", "2024-01-01 00:01:00", "done"), (2, "j", "2024-01-01 00:01:00", "done")]
    spark.createDataFrame(rows, "event_id int, job_id string, ts string, stage string").selectExpr("event_id", "job_id", "cast(ts as timestamp) as ts", "stage").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("event_id int, job_id string, ts timestamp, stage string").parquet(str(tmp_path / "e"))
    job_status(stream).writeStream.outputMode("complete").format("memory").queryName("status").trigger(availableNow=True).start().awaitTermination()
    row = spark.table("status").first()
    assert (row.stage, row.events) == ("done", 2)
