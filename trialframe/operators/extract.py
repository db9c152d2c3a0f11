"""Batched extraction by a callable of the user's: prompts out, answers in.

``answer_batches`` keeps each answer in a table as soon as its wave of batches ends, under the batch's place and the hash of
its items. A run that failed, or one over protocols some of which changed, asks only for what the table lacks.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import storage
from .cohort import batches

BATCH_ITEMS = 20
ATTEMPTS = 2
#: Batches that are asked for before their answers are kept.
WAVE = 10_000
#: What a prompt asks for, before the items.
INSTRUCTION = (
    "Return structured eligibility criteria for the items below as a JSON object with a list 'rows'. Copy each source text exactly and give one row per clinical concept, "
    "with the comparator, value, unit, bounds, timing, repetition, qualifier, negation and and/or logic in fields of their own. State only what the text states. Items:\n"
)


def prompts(items: DataFrame, size: int = BATCH_ITEMS) -> DataFrame:
    """(protocol_id, batch, prompt, items) of each batch of ``size`` source items in order."""
    order = F.struct("item_no", "criterion_type", "source", "source_id", "parent_statement", "surrounding_context")
    listed = batches(items, size).groupBy("protocol_id", "batch").agg(F.array_sort(F.collect_list(order)).alias("items"))
    return listed.withColumn("prompt", F.concat(F.lit(INSTRUCTION), F.to_json("items")))


def extract(items: DataFrame, generate: Callable[[list[dict]], list[dict]], size: int = BATCH_ITEMS, parallel: int | None = None) -> DataFrame:
    """(protocol_id, batch, attempts, proposals, error): what ``generate`` proposes for each batch, as JSON.

    Each batch is tried ATTEMPTS times; a failure becomes a row. ``parallel`` bounds the number of batches at
    work. Write the result before using it, so that nothing is asked again.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for protocol_id, batch, listed in zip(part["protocol_id"], part["batch"], part["listed"], strict=True):
                found, error, tries = None, None, 0
                while found is None and tries < ATTEMPTS:
                    tries += 1
                    try:
                        found = json.dumps(generate(json.loads(listed)), ensure_ascii=False)
                    except Exception as problem:  # the user's callable may fail in any way; the row says how
                        error = f"{type(problem).__name__}: {problem}"
                rows.append((protocol_id, batch, tries, found, None if found is not None else error))
            yield pd.DataFrame(rows, columns=["protocol_id", "batch", "attempts", "proposals", "error"])

    work = prompts(items, size).select("protocol_id", "batch", F.to_json("items").alias("listed"))
    if parallel:
        work = work.repartition(parallel, "protocol_id", "batch")
    kind = items.schema["protocol_id"].dataType.simpleString()
    return work.mapInPandas(run, f"protocol_id {kind}, batch long, attempts int, proposals string, error string")


_ANSWERS = "protocol_id {0}, batch long, items_hash string, attempts int, answer string, error string"
_KEY = ["protocol_id", "batch", "items_hash"]
_OBJECT = re.compile(r"\{.*\}", re.DOTALL)


def _readable(answer: str) -> bool:
    """Whether an answer holds a JSON object, in a fence or among other words."""
    found = _OBJECT.search(answer)
    return bool(found) and isinstance(json.loads(found[0]), dict)


def _asked(ask: Callable[[str], str]):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for *key, prompt in part[[*_KEY, "prompt"]].itertuples(index=False):
                answer, error, tries, good = None, None, 0, False
                while not good and tries < ATTEMPTS:
                    tries += 1
                    try:
                        answer = ask(prompt)
                        good = _readable(answer)
                        error = None if good else "no JSON object"
                    except Exception as problem:  # the user's callable may fail in any way; the row says how
                        error = f"{type(problem).__name__}: {problem}"
                rows.append((*key, tries, answer, error))
            yield pd.DataFrame(rows, columns=[*_KEY, "attempts", "answer", "error"])

    return run


def kept_answers(items: DataFrame, folder: str) -> DataFrame:
    """All answers that are kept in ``folder``, of whatever run: (protocol_id, batch, items_hash, attempts, answer, error)."""
    spark, schema = items.sparkSession, _ANSWERS.format(items.schema["protocol_id"].dataType.simpleString())
    path = f"{folder}/answers"
    return spark.read.schema(schema).parquet(path) if storage.exists(spark, path) else spark.createDataFrame([], schema)


def answer_batches(items: DataFrame, ask: Callable[[str], str], folder: str, size: int = BATCH_ITEMS, wave: int = WAVE, parallel: int | None = None) -> DataFrame:
    """(protocol_id, batch, items_hash, attempts, answer, error): what ``ask`` answers to the prompt of each batch of ``items``.

    Answers are kept in ``folder``, which has to be in a store that all executors share. Batches whose items are
    as they were when a good answer was kept are not asked for again; failed ones are. About ``wave`` batches are
    asked for before their answers are kept, so that a failure costs that many at most. Each batch is tried ATTEMPTS
    times; an answer that stays without a JSON object, and an ``ask`` that raises, is a row with an error.
    """
    spark = items.sparkSession
    asked = prompts(items, size).withColumn("items_hash", F.sha2(F.to_json("items"), 256)).select(*_KEY, "prompt")
    good = kept_answers(items, folder).filter("error is null").select(*_KEY)
    waiting = f"{folder}/waiting-{uuid.uuid4().hex}"
    pending = asked.join(good, _KEY, "left_anti")
    pending.withColumn("turn", F.pmod(F.xxhash64(*_KEY), F.lit(1 << 30))).write.parquet(waiting)
    try:
        rows = spark.read.parquet(waiting)
        waves = -(-rows.count() // wave)
        for turn in range(waves):
            part = rows.filter(F.col("turn") % waves == turn)
            part = part.repartition(parallel, *_KEY) if parallel else part
            part.drop("turn").mapInPandas(_asked(ask), _ANSWERS.format(items.schema["protocol_id"].dataType.simpleString())).write.mode("append").parquet(f"{folder}/answers")
    finally:
        storage.delete(spark, waiting)
    # of the answers to a batch the good one, if there is any; two runs at once may have kept two
    last = F.max_by(F.struct("attempts", "answer", "error"), F.struct(F.col("error").isNull(), "answer")).alias("x")
    found = kept_answers(items, folder).join(asked.select(*_KEY), _KEY, "left_semi")
    return found.groupBy(*_KEY).agg(last).select(*_KEY, "x.*")


def no_proposals(items: list[dict]) -> list[dict]:
    """The extractor that proposes nothing; literal parsing still makes criteria of all items."""
    return []
