"""A quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

The features of a text are its word 1- and 2-grams and its word-shape 1- to 3-grams, hashed to ``1 << BITS``
places. A word that repeats the one before is written as a back reference, so that repetition is a feature
whatever the word. A shape tells which classes of characters a word holds and how it ends. A feature's value
is its share of the text's n-grams, so a score is a sparse dot product divided by a count.

Training reads a bounded sample of the labelled rows. It runs in shards, each a task of its own that makes
FTRL-proximal updates row by row; the shards' weights are averaged, and the next round starts from them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import small_batches, written
from .words import Words, joined, mix, text_words, word_hashes

BITS = 18
#: Labelled rows read for training at most, the shards they are dealt to, and the rounds of averaging.
SAMPLE_ROWS = 16_000
SHARDS = 8
ROUNDS = 2
EPOCHS = 3
#: FTRL-proximal's rates and penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
#: A text's shares are multiplied by this, which makes its features about as large as single words' counts.
SCALE = 16.0

_CLASS = np.full(256, 4, np.uint8)  # lower, upper, digit, beyond ASCII, other
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 3


def _shapes(words: Words) -> np.ndarray:
    """Which classes each word holds, how many bytes up to 12, and its last character unless a letter."""
    kinds = np.left_shift(1, _CLASS[words.data]).astype(np.uint8)
    held = np.bitwise_or.reduceat(kinds, np.stack([words.starts, np.minimum(words.ends, len(kinds) - 1)], 1).ravel())[::2] if len(words.starts) else np.zeros(0, np.uint8)
    if len(words.starts) and words.ends[-1] == len(kinds):  # reduceat cannot end at the end
        held[-1] = np.bitwise_or.reduce(kinds[words.starts[-1] :])
    last = words.data[words.ends - 1]
    last = np.where(_CLASS[last] == 4, last, 0).astype(np.uint64)
    size = np.minimum(words.ends - words.starts, 12).astype(np.uint64) // np.uint64(3)
    return mix(held.astype(np.uint64) | last << np.uint64(8) | size << np.uint64(16) | np.uint64(1 << 40))


def text_features(column: pa.Array) -> Iterator[np.ndarray]:
    """For each row the places of its features, one for each n-gram."""
    shift = np.uint64(64 - BITS)
    for words in text_words(column):
        hashes, shapes = word_hashes(words), _shapes(words)
        again = np.zeros(len(hashes), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (words.row[1:] == words.row[:-1])
        hashes[again] = np.uint64(0x7265706561746564)
        grams = [mix(hashes), joined(hashes, 2), mix(shapes), joined(shapes, 2), joined(shapes, 3)]
        places = [(x >> shift).astype(np.int32) for x in grams]
        bounds = words.bounds
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield np.concatenate([p[a : max(a, b - k)] for p, k in zip(places, (0, 1, 0, 1, 2), strict=True)])


def _score(places: np.ndarray, weights: np.ndarray, bias: float) -> float:
    at = bias + (SCALE * float(weights[places].sum()) / len(places) if len(places) else 0.0)
    return float(1.0 / (1.0 + np.exp(-np.clip(at, -30, 30))))


class Ftrl:
    """FTRL-proximal logistic regression; the last place is the bias, which has no penalty."""

    def __init__(self, start: np.ndarray):
        size = len(start)
        self.w, self.n = start.copy(), np.zeros(size)
        # z such that the first weights are ``start``
        self.z = -start * (BETA / ALPHA + L2) - np.sign(start) * L1
        self.z[-1] = -start[-1] * BETA / ALPHA

    def update(self, places: np.ndarray, values: np.ndarray, label: int) -> None:
        at = np.append(places, len(self.w) - 1)
        x = np.append(values, 1.0)
        w, n = self.w[at], self.n[at]
        g = (1.0 / (1.0 + np.exp(-np.clip(float(w @ x), -30, 30))) - label) * x
        more = n + g * g
        z = self.z[at] + g - (np.sqrt(more) - np.sqrt(n)) / ALPHA * w
        rate = (BETA + np.sqrt(more)) / ALPHA
        new = -np.sign(z) * np.maximum(0.0, np.abs(z) - L1) / (rate + L2)
        new[-1] = -z[-1] / rate[-1]
        self.w[at], self.z[at], self.n[at] = new, z, more


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.unique(x, return_counts=True) for x in text_features(batch.column("text"))]
        places, counts = (pa.array([x[i].astype(np.int32).tobytes() for x in found], pa.binary()) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("turn"), batch.column("label"), places, counts], names=["shard", "turn", "label", "places", "counts"])


def train(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Weights for ``1 << BITS`` places and the bias.

    ``labels`` is (doc_id, label 0 or 1); of its rows the SAMPLE_ROWS first by a hash of doc_id are read, with the
    whole text of those documents. Null labels and ids are skipped; a doc_id with several labels takes the
    least, and one with several rows the text that comes first by its hash. Without any row all weights are 0. Of each
    text only the distinct places of its features and their counts are kept, 1 << BITS at most.
    """
    small_batches(docs.sparkSession)
    clean = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("label").cast("int").alias("label")).filter("label_id is not null and label in (0, 1)")
    sample = clean.groupBy("label_id").agg(F.min("label").alias("label")).withColumn("turn", F.xxhash64("label_id")).orderBy("turn", "label_id").limit(SAMPLE_ROWS)
    # at most SAMPLE_ROWS narrow rows
    rows = docs.join(F.broadcast(sample), docs["doc_id"] == sample["label_id"]).select("turn", "label_id", "label", F.col("text").cast("string").alias("text"))
    first = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text")
    rows = rows.groupBy("turn", "label_id", "label").agg(first).select(F.pmod("turn", F.lit(SHARDS)).alias("shard"), "turn", "label", "text")
    rows = written(rows.mapInArrow(_features, "shard bigint, turn bigint, label int, places binary, counts binary"), "features")
    weights = np.zeros((1 << BITS) + 1)
    spark = docs.sparkSession
    total = rows.count()
    for _ in range(ROUNDS if total else 0):
        learned = rows.groupBy("shard").applyInPandas(_shard(spark.sparkContext.broadcast(weights)), "place int, weight double")
        mean = learned.groupBy("place").agg((F.sum("weight") / F.lit(total)).alias("weight")).toPandas()  # at most one row a place
        weights = np.zeros((1 << BITS) + 1)
        weights[mean["place"]] = mean["weight"]
    return weights


def _shard(start):
    """One shard's share of the next weights, from the weights broadcast as ``start``."""

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["turn", "label"])
        examples = []
        for at, counts in zip(part["places"], part["counts"], strict=True):
            at, counts = np.frombuffer(at, np.int32), np.frombuffer(counts, np.int32)
            examples.append((at, SCALE * counts / max(1, counts.sum())))
        model = Ftrl(start.value)
        for _ in range(EPOCHS):
            for (at, values), label in zip(examples, part["label"], strict=True):
                model.update(at, values, label)
        at = np.flatnonzero(model.w)
        return pd.DataFrame({"place": at, "weight": model.w[at] * len(part)})

    return learn


def score_quality(docs: DataFrame, weights: np.ndarray) -> Column:
    """A column for ``docs``: the probability, from 0 to 1, that a row's label is 1.

    Null and empty texts score by the bias alone. Every row is scored by its whole text. Nothing is shuffled;
    the weights that are sent to the executors have a fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w, bias = shared.value[:-1], float(shared.value[-1])
        for part in parts:
            yield pd.Series([_score(x, w, bias) for x in text_features(pa.array(part, pa.string()))], dtype=float)

    return F.pandas_udf(score, "double")(F.col("text").cast("string"))


def held_out_rows(doc_id: str) -> Column:
    """Whether a row's label may not be learned: crc32 of the id's text is divisible by 5. Null ids may not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, for ``labels.quality``.

    Labels of held-out documents are not learned. ``predicted`` is 1 from ``threshold`` on. A null doc_id counts
    as held out; repeated rows are scored one by one. Other columns are not read.
    """
    known = labels.filter(~held_out_rows("doc_id")).select("doc_id", F.col("quality").alias("label"))
    docs = docs.select("doc_id", "text")
    scored = docs.select("doc_id", score_quality(docs, train(docs, known)).alias("score"))
    return scored.select("doc_id", held_out_rows("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``docs`` with all their columns, without those that score below ``threshold``."""
    known = labels.filter(~held_out_rows("doc_id")).select("doc_id", F.col("quality").alias("label"))
    return docs.filter(score_quality(docs, train(docs.select("doc_id", "text"), known)) >= threshold)
