"""Streams: protocols as they land, job status, and reviews into the library."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.extract import answer_batches
from ..operators.intake import accepted, read_answers, rejected
from ..operators.normalize import normalize
from ..operators.review import apply_review, reviewed_cells
from ..operators.segment import segment
from ..sources.snapshots import LibrarySnapshots


def stream_protocols(spark: SparkSession, landing: str, schema: str, output: str, checkpoint: str, ask: Callable[[str], str] | None = None) -> StreamingQuery:
    """Criteria of protocols (JSON lines) as they land, once each; work that is done survives restarts.

    With ``ask``, a callable that answers prompts, its proposals are taken in. Answers are kept under ``output``, so
    a micro-batch that is run again asks only for what was not answered; what breaks the contract is written beside the criteria.
    """
    landed = spark.readStream.schema(schema).json(landing)

    def append(batch: DataFrame, batch_id: int) -> None:
        items = segment(batch)
        if ask is None:
            proposals = items.limit(0).select("protocol_id", F.lit(0).alias("ord"), "source")
        else:
            rows = read_answers(answer_batches(items, ask, f"{output}/asked"))
            rejected(rows).write.mode("overwrite").parquet(f"{output}/rejected/batch={batch_id}")
            proposals = accepted(rows)
        # a batch that is run again replaces its own rows
        normalize(proposals, items, batch).write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    return landed.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def job_status(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """The latest stage of each job from a stream of (event_id, job_id, ts, stage), replays dropped."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy("job_id").agg(F.max_by("stage", F.struct("ts", "event_id")).alias("stage"), F.max("ts").alias("ts"), F.count("*").alias("events"))


class _JobState(StatefulProcessor):
    """The latest stage of one job; a job that has ended is forgotten some time after its last event."""

    def __init__(self, ended: tuple[str, ...], keep_ms: int):
        self.ended, self.keep_ms = ended, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "stage string, ts timestamp, event_id string, events long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        stage, ts, event_id, events = self.latest.get() if self.latest.exists() else (None, None, None, 0)
        out = []
        for event in sorted((x for part in rows for x in part[["ts", "event_id", "stage"]].itertuples(index=False)), key=lambda x: (x.ts, str(x.event_id))):
            events += 1
            at = event.ts.to_pydatetime()
            applied = ts is None or (at.timestamp(), str(event.event_id)) > (ts.timestamp(), event_id)
            if applied:
                stage, ts, event_id = event.stage, at, str(event.event_id)
            out.append((key[0], event.event_id, event.stage, event.ts, applied, stage, events))
        self.latest.update((stage, ts, event_id, events))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if stage in self.ended:
            self.handle.registerTimer(int(ts.timestamp() * 1000) + self.keep_ms)
        yield pd.DataFrame(out, columns=_JOB_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.latest.clear()
        yield pd.DataFrame([], columns=_JOB_COLUMNS)

    def close(self) -> None:
        pass


_JOB_COLUMNS = ["job_id", "event_id", "event_stage", "ts", "applied", "stage", "events"]
#: The stages in which a job ends.
ENDED = ("completed", "failed")


def job_states(events: DataFrame, late: str = "1 hour", keep_hours: int = 24, ended: tuple[str, ...] = ENDED) -> DataFrame:
    """Each event of a stream (event_id, job_id, ts, stage) with the stage in which it leaves its job; an append stream.

    (job_id, event_id, event_stage, ts, applied, stage, events). Replays within ``late`` are dropped. An event that is older
    than the latest one of its job leaves it as it is: ``applied`` is false, so that a filter sends such rows to a table
    of their own. State is a row for each job, and ``keep_hours`` after a job ended, by event time, it goes; a job that
    has not ended keeps it. The session needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    schema = f"job_id {kinds['job_id']}, event_id {kinds['event_id']}, event_stage string, ts timestamp, applied boolean, stage string, events long"
    return once.groupBy("job_id").transformWithStateInPandas(_JobState(ended, keep_hours * 3_600_000), schema, "Append", "EventTime")


def stream_reviews(sheets: DataFrame, jobs: DataFrame, expected: DataFrame, library: LibrarySnapshots, checkpoint: str, name: str = "reviews") -> StreamingQuery:
    """Review sheets as micro-batches: jobs that pass the gate are put into the library.

    Only the parts of the library that hold the reviewed trials are rewritten. The snapshot's record keeps the last batch of
    the stream ``name``, so a batch that is run again changes nothing.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        accepted_rows, _ = apply_review(reviewed_cells(batch), jobs, expected)
        library.upsert(accepted_rows.withColumn("seq", F.lit(batch_id)), batch=(name, batch_id))

    return sheets.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
