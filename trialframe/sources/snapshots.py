"""The library in snapshots: tables by hash of the trial, and one small record that says which of them count.

A change writes the touched parts of the library to a folder of its own, and then publishes a record that names, for
each part, the folder where it lies. Records are numbered; the last one counts. Readers see either the snapshot
before a change or the one after it, whatever fails in between, and earlier snapshots stay readable.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.library import LIBRARY_KEY, upsert
from . import storage

#: Parts of a library. A change reads and writes those that its trials fall into.
PARTS = 256


class Conflict(RuntimeError):
    """Another writer published first."""


class LibrarySnapshots:
    """A library at ``folder``; ``parts`` counts only when the first snapshot is made."""

    def __init__(self, spark: SparkSession, folder: str, parts: int = PARTS):
        self.spark, self.folder, self.parts = spark, folder.rstrip("/"), parts

    # --- records ---

    def numbers(self) -> list[int]:
        return sorted(int(x.removesuffix(".json")) for x in storage.names(self.spark, f"{self.folder}/snapshots") if x.endswith(".json") and not x.startswith("."))

    def record(self, number: int | None = None) -> dict | None:
        """The record of a snapshot, of the last one by default; none before the first."""
        if number is None:
            known = self.numbers()
            if not known:
                return None
            number = known[-1]
        return json.loads(storage.read_text(self.spark, f"{self.folder}/snapshots/{number:012d}.json"))

    def _publish(self, after: dict | None, schema: StructType, data: dict[str, str], applied: dict[str, int]) -> int:
        number = 1 + (after["number"] if after else 0)
        record = {"number": number, "parts": after["parts"] if after else self.parts, "schema": schema.jsonValue(), "data": data, "applied": applied}
        if not storage.write_new_text(self.spark, f"{self.folder}/snapshots/{number:012d}.json", json.dumps(record)):
            raise Conflict(f"snapshot {number} was published by another writer")
        return number

    # --- reading ---

    def _part(self, record: dict | None) -> Column:
        return F.pmod(F.xxhash64(F.col("trial_id").cast("string")), F.lit(record["parts"] if record else self.parts)).cast("int")

    def _rows(self, record: dict, parts: list[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(record["schema"])
        paths = [f"{self.folder}/data/{name}/part_of={part}" for part, name in record["data"].items() if parts is None or part in parts]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, trials: list[str] | None = None, number: int | None = None) -> DataFrame:
        """The library's rows; with ``trials`` only those, from the parts that hold them."""
        record = self.record(number)
        if record is None:
            raise FileNotFoundError(f"no snapshot in {self.folder}")
        if trials is None:
            return self._rows(record)
        asked = self.spark.createDataFrame([(x,) for x in trials], "trial_id string")
        parts = [str(r.part) for r in asked.select(self._part(record).alias("part")).distinct().collect()]  # no more than were asked for
        return self._rows(record, parts).filter(F.col("trial_id").isin(trials))

    # --- writing ---

    def _written(self, rows: DataFrame, record: dict | None) -> dict[str, str]:
        """Writes ``rows`` to a new folder, a file for each part; which parts there are."""
        name = uuid.uuid4().hex
        path = f"{self.folder}/data/{name}"
        rows.withColumn("part_of", self._part(record)).repartition("part_of").write.partitionBy("part_of").parquet(path)
        return {x.removeprefix("part_of="): name for x in storage.names(self.spark, path) if x.startswith("part_of=")}

    def replace(self, entries: DataFrame) -> int:
        """A snapshot of ``entries`` alone; its number."""
        record = self.record()
        return self._publish(record, entries.schema, self._written(entries, record), record["applied"] if record else {})

    def reset(self) -> int:
        """An empty snapshot with the columns of the last; earlier ones stay readable by number."""
        record = self.record()
        if record is None:
            raise FileNotFoundError(f"no snapshot in {self.folder}")
        return self._publish(record, StructType.fromJson(record["schema"]), {}, record["applied"])

    def upsert(self, rows: DataFrame, key: tuple[str, ...] = LIBRARY_KEY, order: str = "seq", batch: tuple[str, int] | None = None) -> int:
        """Puts ``rows`` in by ``key`` and publishes the result; the number of the snapshot that counts then.

        Only the parts that hold the rows' trials are read and written. ``batch`` names a stream and its batch: the record
        keeps the last one of each stream together with its data, so a batch that is run again changes nothing.
        ``key`` has to begin with trial_id, or rows that replace each other might lie in other parts.
        """
        if key[0] != "trial_id":
            raise ValueError("the key has to begin with trial_id")
        record = self.record()
        applied = dict(record["applied"]) if record else {}
        if batch and applied.get(batch[0], -1) >= batch[1]:
            return record["number"]
        if batch:
            applied[batch[0]] = batch[1]
        touched = [str(r.part) for r in rows.select(self._part(record).alias("part")).distinct().collect()]  # at most one row a part
        current = self._rows(record, touched) if record else self.spark.createDataFrame([], StructType([f for f in rows.schema if f.name != order]))
        merged = upsert(current, rows, key, order)
        data = self._written(merged, record) if touched else {}
        return self._publish(record, merged.schema, {**(record["data"] if record else {}), **data}, applied)

    def remove_before(self, number: int) -> None:
        """Removes snapshots before ``number`` and the folders that no later one names."""
        kept = [n for n in self.numbers() if n >= number]
        named = {name for n in kept for name in self.record(n)["data"].values()}
        if not kept:
            raise ValueError(f"no snapshot from {number} on")
        for n in [n for n in self.numbers() if n < number]:
            gone = set(self.record(n)["data"].values()) - named
            storage.delete(self.spark, f"{self.folder}/snapshots/{n:012d}.json")
            for name in gone:
                storage.delete(self.spark, f"{self.folder}/data/{name}")
