"""Scores of texts under a language model of mixed contexts, and under plain token counts.

A text is coded as units: a word with the white space behind it, and an end. A unit's bytes are predicted bit by bit.
Each of six predictors hashes a context (the last one to four bytes of the unit, all of them, all with what came before
the unit) and the bits of the byte so far to a place in its table, which keeps how often a 0 and a 1 followed in
training. Their predictions are mixed in the logistic domain: the weight of each is chosen by how much it has seen,
and by how many of the long contexts are known (the gate). The mix is refined by a table of its own prediction and
the byte so far. Weights and that table are learned online, pass after pass over the units, each unit as if its own
occurrences had been seen once less; shards learn apart and are averaged. The score is the log10 probability of the
whole text, and its bits per byte are those of a code that can be decoded.

Contexts over units predict segments, which are runs of some eight units, cut where a hash of the last three units says so.
The near context is the three units before, the far one these with all of the segment before and what that followed. The
longer one that training knows foresees the segment that it saw most; how often each context was right about that one is
mixed in the logistic domain, by weights learned online like the others. A segment has the chance of being the one
foreseen, and in what is left the chance of its units. What contexts saw of a segment of a training text is always taken
without one occurrence of it, in scores too: else each such text would foresee itself.

Alone, a unit's probability does not depend on the text around it, so each distinct unit is scored once, and so is each token. A
slice of texts keeps a list of its distinct units and tokens, and one of its distinct contexts with their segments; these lists
meet in counts of all the corpus, which grow with it, and what is found goes back to the slice, where it is added up for
each text. Only the predictors' tables, which have a fixed size, are broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import removed, small_batches, written
from .words import LOWER, Words, byte_hashes, mix, text_words

#: Bytes of text in a slice (a longer text is a slice of its own), and of a unit; a longer unit is cut, and goes on.
SLICE_BYTES = 12 << 20
#: Bytes of keys that are counted together; a range of them is one row.
RANGE_BYTES = 8 << 20
UNIT_BYTES = 48
#: Places of each predictor's table, as a power of two; their states are a byte each.
TABLE_BITS = 22
BLOCK_BITS = 16
#: Bytes of distinct units that a task counts; the parts of the tables that it makes then repeat few places.
COUNT_BYTES = 6 << 20
#: Rounds in which mixing weights are learned and averaged, units that are learned at once.
ROUNDS = 2
STEP_UNITS = 1024

#: Bytes that UTF-8 never holds: the end of a unit, and of a text.
_STOP, _END = b"\xfe", b"\xff"
#: What came before a unit: nothing, a line's end, a sentence's end, other words, the unit's own first part.
_START, _LINE, _SENTENCE, _WORD, _INSIDE = b"0nswi"

#: Predictors: the last 1 to 4 bytes, all of the unit, and all with what came before it.
PREDICTORS = 6
_LONG = (2, 3, 4, 5)  # those that the gate counts
_GATES = len(_LONG) + 1


# --- states: how often a place saw 0 and 1, in a byte -------------------------------------------------------------

_EXACT = 8
_SIZES = np.array([9, 13, 21, 41, 101, 401, 2001])
_LEVELS = 30
_EDGES = np.linspace(-7.0, 7.0, _LEVELS - 1)


def _stretch(p):
    return np.log(p / (1.0 - p))


def _chance(n0, n1):
    return (n1 + 0.4) / (n0 + n1 + 0.8)


def states(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """The states of counts; up to _EXACT they are kept as they are, then by size and by level."""
    n = n0 + n1
    few = np.minimum(n, _EXACT)
    small = (few * (few + 1) // 2 + np.minimum(n1, few)).astype(np.int64)
    level = np.searchsorted(_EDGES, _stretch(_chance(n0, n1)))
    size = np.searchsorted(_SIZES, n, "right") - 1
    first = (_EXACT + 1) * (_EXACT + 2) // 2
    return np.where(n <= _EXACT, small, first + size * _LEVELS + level).astype(np.uint8)


def _state_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each state: its stretched prediction, how sure it is, and the state before it last saw 0 or 1."""
    guess, sure, less = np.zeros(256), np.zeros(256, np.int64), np.tile(np.arange(256, dtype=np.uint8), (2, 1))
    for n in range(_EXACT + 1):
        for n1 in range(n + 1):
            at = n * (n + 1) // 2 + n1
            guess[at] = _stretch(_chance(n - n1, n1)) if n else 0.0
            sure[at] = 0 if n == 0 else 1 + (n > 1) + (n > 2) + (n > 4)
            for bit, left in ((0, n - n1), (1, n1)):
                if left:
                    less[bit, at] = (n - 1) * n // 2 + n1 - bit
    first = (_EXACT + 1) * (_EXACT + 2) // 2
    middles = np.concatenate([[-7.5], (_EDGES[:-1] + _EDGES[1:]) / 2, [7.5]])
    for size in range(len(_SIZES)):
        at = first + size * _LEVELS
        guess[at : at + _LEVELS] = middles
        sure[at : at + _LEVELS] = 5 + size
    return guess, sure, less


_GUESS, _SURE, _LESS = _state_tables()
_SURES = 5 + len(_SIZES)
_CELLS = _GATES * PREDICTORS * _SURES
_STEPS = 33


# --- bits of units ------------------------------------------------------------------------------------------------

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Bits:
    """The bits of units: each byte's unit, and for each bit its value and the places it has in the tables."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray, before: np.ndarray):
        """Of units' bytes one behind the other, how many each has, and the byte that tells what came before it."""
        self.sizes, self.before = sizes, before
        self.data = data.astype(np.uint64)
        self.unit = np.repeat(np.arange(len(sizes)), sizes)  # of each byte
        self.first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.place = np.arange(len(data)) - self.first
        self.bits = (data >> _STEPS_DOWN & np.uint8(1)).astype(np.int64)  # (8, bytes)
        self.node = (np.int64(256) | data) >> (_STEPS_DOWN + np.int64(1))  # (8, bytes): the byte so far, behind a leading 1
        self._spread = _NODES[self.node]
        self._last: list[np.ndarray] = []
        self._whole: np.ndarray | None = None

    def _context(self, predictor: int) -> np.ndarray:
        """A hash of each byte's context."""
        if predictor >= 4:
            if self._whole is None:
                sums = np.zeros(len(self.data) + 1, np.uint64)
                np.cumsum((self.data + np.uint64(1)) * _POWERS[self.place], out=sums[1:])
                whole = (sums[:-1] - sums[self.first]) * _M1
                self._whole = whole ^ (whole >> np.uint64(32))
            return (self._whole if predictor == 4 else self._whole + np.repeat(self.before.astype(np.uint64), self.sizes)) * _M2
        while len(self._last) <= predictor:
            back = len(self._last) + 1
            x = np.zeros(len(self.data), np.uint64)
            x[back:] = self.data[: max(0, len(self.data) - back)] + np.uint64(1)
            x *= self.place >= back
            if back == 1:
                starts = self.place == 0
                x[starts] = self.before[self.unit[starts]].astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)
            else:
                x += self._last[-1]
            x *= _M1
            self._last.append(x ^ (x >> np.uint64(31)))
        return self._last[predictor]

    def places(self, predictor: int) -> np.ndarray:
        return (self._context(predictor) * self._spread >> np.uint64(64 - TABLE_BITS)).view(np.int64)


_STEPS_DOWN = np.arange(7, -1, -1, dtype=np.uint8)[:, None]
#: What a byte so far multiplies the hash of a context by.
_NODES = mix(np.arange(256, dtype=np.uint64)) | np.uint64(1)
_POWERS = np.concatenate([[np.uint64(1)], np.cumprod(np.full(UNIT_BYTES, 0x5851F42D4C957F2D, np.uint64))])


def _joined(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units, given as what came before (one byte) and their bytes, as ``Bits`` takes them: with their stops."""
    parts = [k[1:] if k[1:] == _END or len(k) > UNIT_BYTES else k[1:] + _STOP for k in keys]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.frombuffer(b"".join(parts), np.uint8), sizes, np.frombuffer(b"".join([k[:1] for k in keys]), np.uint8)


def unit_bits(keys: list[bytes]) -> Bits:
    """The bits of units, given as what came before (one byte) and their bytes."""
    return Bits(*_joined(keys))


# --- the mix ------------------------------------------------------------------------------------------------------


@dataclass
class Model:
    """The predictors' states, the mixing weights, and the table that refines the mix."""

    tables: np.ndarray  # (PREDICTORS, places), uint8
    weights: np.ndarray  # of each gate, predictor and sureness
    refined: np.ndarray  # (256, _STEPS): of each byte so far and step of the mix

    @classmethod
    def new(cls, tables: np.ndarray) -> Model:
        start = 1.0 / (1.0 + np.exp(-np.linspace(-8, 8, _STEPS)))
        return cls(tables, np.full(_CELLS, 0.3), np.tile(start, (256, 1)))

    def mixed(self, of: Bits, states: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """The stretched mix, its probability of a 1, and each predictor's gate, number and state as one number."""
        known = np.zeros(of.bits.shape, np.uint8)
        for k in _LONG:
            known += states[k] > 0
        gate = known.astype(np.int64) * (PREDICTORS << 8)
        worth = (self.weights.reshape(_GATES * PREDICTORS, _SURES)[:, _SURE] * _GUESS).ravel()
        cells = [(gate + s) + (k << 8) if k else gate + s for k, s in enumerate(states)]
        dot = worth.take(cells[0])
        for cell in cells[1:]:
            dot += worth.take(cell)
        np.clip(dot, -8, 8, out=dot)
        return dot, 1.0 / (1.0 + np.exp(-dot)), cells

    def refine(self, node: np.ndarray, dot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        high = (dot + 8) * ((_STEPS - 1) / 16)
        low = np.minimum(high.astype(np.int64), _STEPS - 2)
        high -= low
        at = node * _STEPS + low
        table = self.refined.ravel()
        below = table.take(at)
        return below + (table.take(at + 1) - below) * high, at, high

    def log2(self, keys: list[bytes]) -> np.ndarray:
        """The log2 probability of each unit."""
        of = unit_bits(keys)
        states = [self.tables[k].take(of.places(k)) for k in range(PREDICTORS)]
        dot, p, _ = self.mixed(of, states)
        p = (p + self.refine(of.node, dot)[0]) / 2
        p = np.abs(p - (1 - of.bits))
        return np.bincount(of.unit, np.log2(p.prod(0)), len(keys))  # of eight bits no product is too small


class Learner:
    """Learns a model's weights and refining table online."""

    def __init__(self, model: Model, rate: float = 0.3):
        self.model, self.rate = model, rate
        self.squares = np.full(_CELLS, 1e-3)

    def step(self, keys: list[bytes], counts: np.ndarray) -> None:
        """Learns from units that occur so often, each as if it had occurred once less."""
        model, of = self.model, unit_bits(keys)
        less, of_bit = _LESS.ravel(), of.bits << 8
        states = [less.take(of_bit + model.tables[k].take(of.places(k))) for k in range(PREDICTORS)]
        dot, p, cells = model.mixed(of, states)
        seen = counts.astype(float)[of.unit]
        off = ((of.bits - p) * (seen / counts.sum())).ravel()
        gradient = np.zeros(_GATES * PREDICTORS << 8)
        for cell in cells:
            gradient += np.bincount(cell.ravel(), off, len(gradient))
        # states that are as sure share a weight
        gradient = gradient.reshape(-1, 256) * _GUESS
        gradient = np.stack([gradient[:, _SURE == x].sum(1) for x in range(_SURES)], 1).ravel()
        self.squares += gradient**2
        model.weights += self.rate * gradient / np.sqrt(self.squares)
        _, at, high = model.refine(of.node, dot)
        # of each step the counts of 0 and of 1
        near = (at + (high > 0.5)) * 2 + of.bits
        zeros, ones = np.bincount(near.ravel(), np.broadcast_to(seen, of.bits.shape).ravel(), 512 * _STEPS).reshape(-1, 2).T
        total = zeros + ones
        table = model.refined.ravel()
        table += (ones - total * table) / (total + 200.0)


def _learned(shared, weights: np.ndarray, refined: np.ndarray):
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = Learner(Model(shared.value, weights.copy(), refined.copy()))
        total = 0
        for batch in _trained_units(batches):
            keys, counts = batch.column("key").to_pylist(), batch.column("c").to_numpy()
            for i in range(0, len(keys), STEP_UNITS):
                learner.step([k[1:] for k in keys[i : i + STEP_UNITS]], counts[i : i + STEP_UNITS])
                total += min(STEP_UNITS, len(keys) - i)
        if total:
            found = np.concatenate([learner.model.weights, learner.model.refined.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(found))), pa.array(found * total), pa.array(np.full(len(found), float(total)))], names=["place", "value", "total"])

    return learn


def _small(x: np.ndarray) -> bytes:
    """Whole numbers from 0 in as few bytes as the largest takes, compressed."""
    size = next(size for size in (1, 2, 4, 8) if size == 8 or not len(x) or x.max() < 1 << 8 * size)
    return bytes([size]) + len(x).to_bytes(4, "little") + pa.compress(x.astype(f"u{size}").tobytes(), "zstd", asbytes=True)


def _whole(x: bytes) -> np.ndarray:
    size, n = x[0], int.from_bytes(x[1:5], "little")
    return np.frombuffer(pa.decompress(x[5:], size * n, "zstd"), f"u{size}").astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch], least: int = 2) -> Iterator[pa.RecordBatch]:
    """(predictor, block, places, zeros, ones): what units add to the tables, part by part of each.

    To the tables of whole units only those add that occur ``least`` times. ``train`` counts all: a unit that is seen once
    still tells how others with its first bytes go on, and learning takes one occurrence of it from these tables too.
    """
    held: list[tuple[tuple[np.ndarray, ...], np.ndarray]] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for k in range(PREDICTORS):
            seen = np.zeros(2 << TABLE_BITS)
            for (data, sizes, before), counts in held:
                if k >= 4 and least > 1:
                    often = counts >= least
                    data, sizes, before, counts = data[np.repeat(often, sizes)], sizes[often], before[often], counts[often]
                of = Bits(data, sizes, before)
                np.add.at(seen, (of.places(k) * 2 + of.bits).ravel(), np.broadcast_to(counts.astype(float)[of.unit], of.bits.shape).ravel())
            zeros, ones = seen[::2], seen[1::2]
            at = np.flatnonzero(zeros + ones)
            blocks = np.searchsorted(at, np.arange((1 << (TABLE_BITS - BLOCK_BITS)) + 1) << BLOCK_BITS)
            rows = [(k, b, _small(np.diff(at[i:j], prepend=b << BLOCK_BITS)), _small(zeros[at[i:j]]), _small(ones[at[i:j]])) for b, (i, j) in enumerate(zip(blocks[:-1], blocks[1:], strict=True)) if j > i]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), *(pa.array(x, pa.binary()) for x in columns[2:])], names=["predictor", "block", "places", "zeros", "ones"])

    for batch in batches:
        keys = [k[1:] for k in batch.column("key").to_pylist()]
        counts = batch.column("c").to_numpy()
        held += [(_joined(keys[i : i + 4096]), counts[i : i + 4096]) for i in range(0, len(keys), 4096)]
        size += sum(map(len, keys))
        if size > 4 * COUNT_BYTES:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(predictor, block, states); rows come sorted by (predictor, block)."""
    key, zeros, ones = None, None, None

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([states(zeros, ones).tobytes()], pa.binary())], names=["predictor", "block", "states"])

    for batch in batches:
        for predictor, block, places, n0, n1 in zip(*(batch.column(c).to_pylist() for c in ("predictor", "block", "places", "zeros", "ones")), strict=True):
            if key != (predictor, block):
                if key is not None:
                    yield made()
                key, zeros, ones = (predictor, block), np.zeros(1 << BLOCK_BITS), np.zeros(1 << BLOCK_BITS)
            at = np.cumsum(_whole(places))
            zeros[at] += _whole(n0)
            ones[at] += _whole(n1)
    if key is not None:
        yield made()


def _trained_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, c) of the units that occur in training, a range at a time and in no order of theirs."""
    for batch in batches:
        for listed in batch.column("keys").to_pylist():
            keys, counts = _keys_unpacked(listed)
            keys = keys.cast(pa.binary())
            kept = np.flatnonzero((pc.binary_slice(keys, 0, 1).to_numpy(zero_copy_only=False) == b"u") & (counts > 0))
            kept = np.random.default_rng(len(kept)).permutation(kept)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(kept)), pa.array(counts[kept])], names=["key", "c"])


def train(met: DataFrame, size: int) -> Model:
    """A model of the units in ``met`` (ranges of keys with their counts in training), which have ``size`` bytes.

    Tables of a fixed size come to the driver, 1 << TABLE_BITS bytes for each predictor; all units take part. Ranges are of
    hashes, so those of a task are a shard like any other, and units need not be moved.
    """
    spark, keys = met.sparkSession, met.select("keys")
    parts = keys.coalesce(1 + size // COUNT_BYTES).mapInArrow(lambda batches: _counted(_trained_units(batches), least=1), "predictor int, block int, places binary, zeros binary, ones binary")
    made = parts.repartition("predictor", "block").sortWithinPartitions("predictor", "block").mapInArrow(_summed, "predictor int, block int, states binary")
    tables = np.zeros((PREDICTORS, 1 << TABLE_BITS), np.uint8)
    for row in made.collect():  # at most PREDICTORS << (TABLE_BITS - BLOCK_BITS) rows of 1 << BLOCK_BITS bytes
        tables[row.predictor, row.block << BLOCK_BITS : (row.block + 1) << BLOCK_BITS] = np.frombuffer(row.states, np.uint8)
    model = Model.new(tables)
    shared = spark.sparkContext.broadcast(tables)
    for _ in range(ROUNDS):
        mean = keys.mapInArrow(_learned(shared, model.weights, model.refined), "place long, value double, total double").groupBy("place").agg((F.sum("value") / F.sum("total")).alias("value")).toPandas()  # a row for each weight
        found = np.concatenate([model.weights, model.refined.ravel()])
        found[mean["place"]] = mean["value"]
        model.weights, model.refined = found[:_CELLS], found[_CELLS:].reshape(256, _STEPS)
    return model


# --- what came before a unit --------------------------------------------------------------------------------------

#: A text's segments end where a hash of the last three units is divisible by this, behind its third unit, and after so many units.
CUT_BY, CUT_AT = 8, 32
#: Entries (context, segment) that are counted together.
FOLLOW_ROWS = 1 << 19
_UNKNOWN, _NEAR, _FAR = 0, 1, 2
_INPUTS = 3  # near context, far context, and what is always there
_FOLLOW_CELLS = 2 * _INPUTS * _SURES
_ODD = np.cumprod(np.full(CUT_AT + 3, 0x2545F4914F6CDD1D, np.uint64))


def _segments(hashes: np.ndarray, is_unit: np.ndarray, per_row: np.ndarray) -> dict[str, np.ndarray]:
    """The segments of texts, given as hashes of entries: how many entries each has and how many each text; what each
    is (``segment``), the three units before it (``near``, 0 at a text's start), and these with the segment before and what it followed (``far``).

    Where a segment ends is told by the units before its end, so that equal passages are cut alike wherever they stand.
    """
    x, at = hashes[is_unit], np.flatnonzero(is_unit)
    row = np.repeat(np.arange(len(per_row)), per_row)[is_unit]
    last = np.append(row[1:] != row[:-1], True)
    place = np.arange(len(x)) - np.append(0, np.flatnonzero(last)[:-1] + 1)[row]
    three = x.copy()
    three[1:] += x[:-1] * _ODD[0]
    three[2:] += x[:-2] * _ODD[1]
    three = mix(three)
    end = last | (place == 2) | (place > 2) & (three % np.uint64(CUT_BY) == 0)
    start = np.append(0, np.flatnonzero(end)[:-1] + 1)
    inside = np.arange(len(x)) - np.repeat(start, np.diff(np.append(start, len(x))))
    end |= inside % CUT_AT == CUT_AT - 1
    start = np.append(0, np.flatnonzero(end)[:-1] + 1)
    inside = np.arange(len(x)) - np.repeat(start, np.diff(np.append(start, len(x))))
    segment = mix(np.add.reduceat(x * _ODD[inside], start))
    near = np.where(place[start] > 0, mix(three[start - 1] + _ODD[2]) | np.uint64(1), np.uint64(0))
    far = mix(near[1:] * _ODD[0] + segment[:-1] * _ODD[1] + near[:-1])
    return {"per_segment": np.diff(at[end], prepend=-1), "segments": np.bincount(row[start], minlength=len(per_row)), "near": near, "far": np.append(np.uint64(0), far), "segment": segment}


@dataclass
class _Follow:
    """Entries: what came near before a segment (40 bits), what came far before it (24), the segment (24), and how often it did in
    training; 0 if the texts are held out. They stand by ``near``."""

    near: np.ndarray
    far: np.ndarray
    segment: np.ndarray
    count: np.ndarray

    @classmethod
    def distinct(cls, near: np.ndarray, far: np.ndarray, segment: np.ndarray, trained: np.ndarray) -> tuple[_Follow, np.ndarray]:
        """Of segments' hashes, and of each segment the number of its entry, or -1 if nothing is before it."""
        of, numbers = np.flatnonzero(near), np.full(len(near), -1)
        near, far, segment = (x[of] >> np.uint64(64 - bits) for x, bits in ((near, 40), (far, 24), (segment, 24)))
        trained = trained[of]
        codes, found = pd.factorize(mix(mix(near << np.uint64(24) | far) + (segment << np.uint64(1)) + trained))
        first = _first_places(codes, len(found))
        order = np.argsort(near[first], kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        numbers[of] = rank[codes]
        first = first[order]
        return cls(*(x[first].astype(np.int64) for x in (near, far, segment)), np.where(trained[first], np.bincount(codes, minlength=len(order))[order], 0)), numbers

    def packed(self) -> bytes:
        high = self.near >> 8
        whole = _planes(np.diff(high, prepend=0)) + (self.near & 255).astype(np.uint8).tobytes() + _planes(self.far)[: 3 * len(high)] + _planes(self.segment)[: 3 * len(high)]
        whole, counts = _squeezed(whole), _small(self.count)
        return len(high).to_bytes(4, "little") + len(whole).to_bytes(4, "little") + whole + counts

    @classmethod
    def unpacked(cls, x: bytes) -> _Follow:
        n, size = int.from_bytes(x[:4], "little"), int.from_bytes(x[4:8], "little")
        planes = np.frombuffer(_unsqueezed(x[8 : 8 + size]), np.uint8).reshape(11, n).astype(np.int64)
        delta, far, segment = ((p << (8 * np.arange(len(p)))[:, None]).sum(0) for p in (planes[:4], planes[5:8], planes[8:]))
        return cls(np.cumsum(delta) << 8 | planes[4], far, segment, _whole(x[8 + size :]))

    def part(self, i: int, j: int) -> _Follow:
        return _Follow(self.near[i:j], self.far[i:j], self.segment[i:j], self.count[i:j])


def _split_follow(ranges: int):
    """(range, slice, follow): a slice's entries by ``ranges`` ranges of what came near before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, listed in zip(*(batch.column(c).to_pylist() for c in ("slice", "follow")), strict=True):
                entries = _Follow.unpacked(listed)
                if not len(entries.near):
                    continue
                of = (entries.near >> 8) * ranges >> 32
                starts = np.flatnonzero(np.diff(of, prepend=-1))
                parts = list(zip(starts.tolist(), np.append(starts[1:], len(of)).tolist(), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(of[starts]), pa.array([number] * len(parts)), pa.array([entries.part(i, j).packed() for i, j in parts], pa.binary())], names=["range", "slice", "follow"])

    return run


class _Seen:
    """How often contexts occur in training, how often with each segment, and with which two the most."""

    def __init__(self, context: np.ndarray, segment: np.ndarray, count: np.ndarray):
        self.of, found = pd.factorize(context)
        self.pair, pairs = pd.factorize(mix(mix(context) + segment.astype(np.uint64)))
        self.count, self.pairs = (np.bincount(x, count, n).astype(np.int64) for x, n in ((self.of, len(found)), (self.pair, len(pairs))))
        first = _first_places(self.pair, len(pairs))
        order = np.lexsort((segment[first], -self.pairs, self.of[first]))
        of = self.of[first[order]]
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        more = np.append(starts[1:], len(of)) - starts > 1
        self.best, self.second = np.empty((2, len(found)), np.int64)
        self.best[of[starts]] = first[order[starts]]
        self.second[of[starts]] = np.where(more, first[order[np.minimum(starts + 1, len(of) - 1)]], -1)

    def foreseen(self, segment: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each entry, without one occurrence of its own if it has any: how often its context is left, and an entry with the segment that it then saw most."""
        best, second = self.best[self.of], self.second[self.of]
        left = self.pairs[self.pair[best]] - own
        other = np.where(second >= 0, self.pairs[self.pair[second]], 0)
        gives_way = (segment == segment[best]) & ((left < other) | (left == other) & (segment[best] > segment[second]) & (second >= 0))
        return self.count[self.of] - own, np.where(gives_way, second, best)


def followed(entries: _Follow) -> np.ndarray:
    """(3, entries) bytes: whether contexts are known and the segment is the one foreseen, and the states of near and far context for that one.

    A segment that training holds is taken as if it had been seen once less there, so that a text does not foresee itself.
    """
    own, segment = (entries.count > 0).astype(np.int64), entries.segment
    near = _Seen(entries.near.astype(np.uint64), segment, entries.count)
    far = _Seen(entries.near.astype(np.uint64) << np.uint64(24) | entries.far.astype(np.uint64), segment, entries.count)
    (near_left, by_near), (far_left, by_far) = near.foreseen(segment, own), far.foreseen(segment, own)
    gate = np.where(far_left > 0, _FAR, np.where(near_left > 0, _NEAR, _UNKNOWN))
    foreseen = np.where(gate == _FAR, by_far, by_near)
    hit = (segment == segment[foreseen]) & (gate > 0)
    found = [(gate | hit << 2).astype(np.uint8)]
    for seen, left, known in ((near, near_left, gate > 0), (far, far_left, gate == _FAR)):
        ones = np.where(known, seen.pairs[seen.pair[foreseen]] - (own & hit), 0)
        found.append(states((np.where(known, left, 0) - ones).astype(float), ones.astype(float)))
    return np.stack(found)


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slice, range, codes, counts); rows come sorted by (range, slice)."""
    now, slices, held = None, [], []

    def made() -> pa.RecordBatch:
        whole = _Follow(*(np.concatenate([getattr(x, c) for x in held]) for c in ("near", "far", "segment", "count")))
        bounds = np.cumsum([len(x.near) for x in held])[:-1]
        codes = [_squeezed(x.tobytes()) for x in np.split(followed(whole), bounds, 1)]
        return pa.RecordBatch.from_arrays([pa.array(slices, pa.int64()), pa.array([now] * len(slices), pa.int64()), pa.array(codes, pa.binary()), pa.array([_small(x.count) for x in held], pa.binary())], names=["slice", "range", "codes", "counts"])

    for batch in batches:
        for of, number, listed in zip(*(batch.column(c).to_pylist() for c in ("range", "slice", "follow")), strict=True):
            if of != now:
                if held:
                    yield made()
                now, slices, held = of, [], []
            slices.append(number)
            held.append(_Follow.unpacked(listed))
    if held:
        yield made()


def _codes(x: bytes) -> np.ndarray:
    return np.frombuffer(_unsqueezed(x), np.uint8).reshape(3, -1)


def _cells(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(inputs, entries): the weights' places of the known contexts' inputs, and the inputs."""
    far = (codes[0] & 3) == _FAR
    cells = (far * _INPUTS + np.arange(_INPUTS)[:, None]) * _SURES + np.stack([_SURE[codes[1]], _SURE[codes[2]], _SURE[codes[1]]])
    return cells, np.stack([_GUESS[codes[1]], _GUESS[codes[2]] * far, np.ones(len(far))])


def foreseen_chances(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The chance that a segment is the one that its contexts foresee: their predictions mixed in the logistic domain."""
    cells, inputs = _cells(codes)
    return 1.0 / (1.0 + np.exp(-np.clip((weights[cells] * inputs).sum(0), -8, 8)))


def _follow_learned(weights: np.ndarray, rate: float = 0.3):
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, squares, total = weights.copy(), np.full(_FOLLOW_CELLS, 1e-3), 0
        for batch in batches:
            for packed, often in zip(*(batch.column(c).to_pylist() for c in ("codes", "counts")), strict=True):
                codes, counts = _codes(packed), _whole(often)
                use = ((codes[0] & 3) > 0) & (counts > 0)
                codes, counts = codes[:, use], counts[use]
                total += len(counts)
                for i in range(0, len(counts), STEP_UNITS):
                    some, n = codes[:, i : i + STEP_UNITS], counts[i : i + STEP_UNITS]
                    cells, inputs = _cells(some)
                    p = 1.0 / (1.0 + np.exp(-np.clip((mine[cells] * inputs).sum(0), -8, 8)))
                    off = ((some[0] >> 2) - p) * (n / n.sum())
                    gradient = np.bincount(cells.ravel(), (inputs * off).ravel(), _FOLLOW_CELLS)
                    squares += gradient**2
                    mine += rate * gradient / np.sqrt(squares)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(_FOLLOW_CELLS)), pa.array(mine * total), pa.array(np.full(_FOLLOW_CELLS, float(total)))], names=["place", "value", "total"])

    return learn


def train_followed(found: DataFrame, entries: int) -> np.ndarray:
    """The weights of contexts over units, of all entries (range, slice, codes, counts)."""
    weights = np.tile(np.repeat([0.3, 0.3, 0.0], _SURES), 2)
    shards = found.repartition(1 + entries // (2 * FOLLOW_ROWS), "range").sortWithinPartitions("range", "slice").select("codes", "counts")
    for _ in range(ROUNDS):
        mean = shards.mapInArrow(_follow_learned(weights), "place long, value double, total double").groupBy("place").agg((F.sum("value") / F.sum("total")).alias("value")).toPandas()  # a row for each weight
        weights = weights.copy()
        weights[mean["place"]] = mean["value"]
    return weights


# --- slices -------------------------------------------------------------------------------------------------------


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SENTENCE_END = np.zeros(256, bool)
_SENTENCE_END[list(b".!?")] = True
#: Entries of a text: a unit or a part of one, the token of a unit that is cut, the text's end.
_UNIT, _TOKEN, _TEXT_END = 0, 1, 2
_HEADS = np.array([list(b"u" + bytes([c])) for c in range(256)], np.uint8)


_SEGMENTS = ("per_segment", "segments", "near", "far", "segment")


def _entries(words: Words) -> dict[str, np.ndarray]:
    """The entries of some texts in order, and in ``per_row`` how many each text has.

    A unit of UNIT_BYTES or more is cut into parts of that size and a shorter one, even if that is empty: a part of
    UNIT_BYTES has no stop, and another follows. Its token is an entry of its own, before the parts.
    """
    data, offsets = words.data, words.offsets
    rows = np.arange(len(offsets) - 1)
    lead = offsets[:-1][offsets[:-1] < offsets[1:]]
    lead = lead[_SPACE[data[lead]]]
    start, word_end = np.concatenate([lead, words.starts]), np.concatenate([lead, words.ends])
    order = np.argsort(start, kind="stable")
    start, word_end = start[order], word_end[order]
    row = np.searchsorted(offsets, start, "right") - 1
    last = np.append(row[1:] != row[:-1], True)[: len(row)]
    end = np.where(last, offsets[row + 1], np.append(start[1:], 0)[: len(row)])
    lines = np.zeros(len(data) + 1, np.int32)
    np.cumsum(data == 10, out=lines[1:])
    sentence = (word_end > start) & _SENTENCE_END[data[np.maximum(word_end - 1, 0)]] if len(data) else np.zeros(0, bool)
    after = np.where(lines[end] > lines[word_end], _LINE, np.where(sentence, _SENTENCE, _WORD))
    # units, and behind each text's units its end
    size, units = len(start) + len(rows), np.bincount(row, minlength=len(rows))
    at, at_end = np.arange(len(start)) + row, np.cumsum(units) + rows

    def with_ends(values: np.ndarray, of_ends: np.ndarray) -> np.ndarray:
        out = np.empty(size, np.int64)
        out[at], out[at_end] = values, of_ends
        return out

    unit_start, unit_end, unit_word = (with_ends(x, offsets[1:]) for x in (start, end, word_end))
    before = np.append(_START, with_ends(after, np.full(len(rows), _START)))[:-1]
    is_end = with_ends(np.zeros(len(start)), np.ones(len(rows))) > 0
    cut = unit_end - unit_start >= UNIT_BYTES
    lone = cut & (unit_word > unit_start)
    times = np.where(cut, (unit_end - unit_start) // UNIT_BYTES + 1 + lone, 1)
    of = np.repeat(np.arange(size), times)
    part = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times) - lone[of]
    kind = np.where(is_end[of], _TEXT_END, np.where(part < 0, _TOKEN, _UNIT))
    piece = np.maximum(part, 0) * UNIT_BYTES + unit_start[of]
    piece_end = np.minimum(piece + UNIT_BYTES, unit_end[of])
    came = np.where(part > 0, _INSIDE, before[of])
    token = byte_hashes(data, lower=True)(unit_start[of], unit_word[of])
    of_part = byte_hashes(data)(piece, piece_end) + (came.astype(np.uint64) << np.uint64(8))
    hashes = mix(np.where(kind == _TOKEN, token + np.uint64(1), np.where(kind == _TEXT_END, came.astype(np.uint64), of_part)))
    per_row = np.add.reduceat(times, np.append(0, at_end[:-1] + 1))
    return {
        "kind": kind.astype(np.uint8),
        "before": came.astype(np.uint8),
        "start": piece,
        "end": piece_end,
        "word_end": unit_word[of],
        "has_token": (kind == _TEXT_END) | (kind == _TOKEN) | ~cut[of] & (unit_word[of] > unit_start[of]),
        "hash": hashes,
        "token": np.where(kind == _TEXT_END, np.uint64(0), token),
        "per_row": per_row,
        **_segments(hashes, kind != _TOKEN, per_row),
    }


def _cut_out(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The bytes from each start to each end."""
    order = np.argsort(start, kind="stable")
    bounds = np.empty(2 * len(start) + 1, np.int64)
    bounds[:-1:2], bounds[1::2], bounds[-1] = start[order], end[order], len(data)
    if (bounds[1:] < bounds[:-1]).any():  # some lie in others
        return pa.array([data[a:b].tobytes() for a, b in zip(start.tolist(), end.tolist(), strict=True)], pa.binary())
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    back = np.empty(len(order), np.int64)
    back[order] = 2 * np.arange(len(order))
    return pieces.take(pa.array(back)).cast(pa.binary())


def _first_places(codes: np.ndarray, n: int) -> np.ndarray:
    out = np.empty(n, np.int64)
    out[codes[::-1]] = np.arange(len(codes))[::-1]
    return out


class _Slice:
    """The distinct units and tokens of some texts, and the texts as lists of entries.

    Within a slice they are told apart by hashes of 64 bits, and beyond it by their bytes.
    """

    def __init__(self):
        self.parts: list[dict[str, np.ndarray]] = []
        self.data: list[np.ndarray] = []
        self.doc_ids: list[int | None] = []
        self.held_out: list[bool] = []
        self.n_bytes: list[np.ndarray] = []
        self.size = 0

    def add(self, words: Words, doc_ids: list[int | None], held_out: list[bool]) -> None:
        part = _entries(words)
        for name in ("start", "end", "word_end"):
            part[name] = (part[name] + self.size).astype(np.int32 if self.size + len(words.data) < 1 << 31 else np.int64)
        self.parts.append(part)
        self.data.append(words.data.copy())
        self.doc_ids += doc_ids
        self.held_out += held_out
        self.n_bytes.append(np.diff(words.offsets))
        self.size += len(words.data)

    def rows(self, number: int) -> Iterator[pa.RecordBatch]:
        data = np.concatenate(self.data)
        of = {name: np.concatenate([p.pop(name) for p in self.parts]) for name in list(self.parts[0])}
        self.data, self.parts = [], []
        sizes = of.pop("per_row")
        per_segment, segments, near, far, segment = (of.pop(c) for c in _SEGMENTS)
        follow, segment_key = _Follow.distinct(near, far, segment, np.repeat(~np.array(self.held_out, bool), segments))
        ids, distinct = pd.factorize(of["hash"])
        first = _first_places(ids, len(distinct))
        of = {name: x[first] for name, x in of.items()}  # each distinct entry as it first stands
        is_unit, text_end = of["kind"] != _TOKEN, of["kind"] == _TEXT_END
        units = pc.binary_join_element_wise(
            _strings(_HEADS[of["before"][is_unit]].ravel(), np.full(is_unit.sum(), 2)),
            _cut_out(data, of["start"][is_unit], of["end"][is_unit]),
            _strings(np.full(text_end.sum(), _END[0], np.uint8), text_end[is_unit]),
            b"",
        )
        unit_key = np.where(is_unit, np.cumsum(is_unit) - 1, -1).astype(np.int32)
        with_token = np.flatnonzero(of["has_token"])
        codes, tokens = pd.factorize(of["token"][with_token])
        where = with_token[_first_places(codes, len(tokens))]
        token_key = np.full(len(first), -1, np.int32)
        token_key[with_token] = len(units) + codes
        start, end = of["start"][where], np.where(text_end[where], of["start"][where], of["word_end"][where])
        names, long = _cut_out(LOWER[data], start, end), end - start >= UNIT_BYTES
        kinds = np.where(text_end[where], ord("e"), np.where(long, ord("h"), ord("t"))).astype(np.uint8)
        if long.any():  # a long token by its hash
            names = pa.array([hashlib.sha256(x).digest() if is_long else x for x, is_long in zip(names.to_pylist(), long, strict=True)], pa.binary())
        keys = pa.concat_arrays([units, pc.binary_join_element_wise(_strings(kinds, np.ones(len(kinds))), names, b"")])
        often = np.bincount(ids[np.repeat(~np.array(self.held_out, bool), sizes)], minlength=len(first))
        counts = sum(np.bincount(x[x >= 0], often[x >= 0], len(keys)) for x in (unit_key, token_key)).astype(np.int64)
        # keys stand by a hash of their own, of which ranges go to one place
        hashes = np.concatenate([of["hash"][is_unit], mix(of["token"][where] ^ np.uint64(0xA5A5A5A5))]) >> np.uint64(32)
        order = np.argsort(hashes, kind="stable")
        rank = np.empty(len(keys) + 1, np.int32)
        rank[order], rank[-1] = np.arange(len(keys)), -1  # of -1, no key
        texts = _packed(self.doc_ids, self.held_out, sizes, np.concatenate(self.n_bytes), segments, _first_as_0(ids), rank[unit_key], rank[token_key], per_segment, segment_key)
        listed = _keys_packed(keys.take(pa.array(order)), counts[order])
        yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([pc.sum(pc.binary_length(keys)).as_py()], pa.int64()), pa.array([_small(np.diff(hashes[order].astype(np.int64), prepend=0))], pa.binary()), pa.array([listed], pa.binary()), pa.array([len(follow.near)], pa.int64()), pa.array([follow.packed()], pa.binary()), pa.array([texts], pa.binary())], names=["slice", "key_bytes", "hashes", "keys", "entries", "follow", "texts"])


#: What is kept of the texts of a slice: of each text, then the entries of all texts, then each entry's unit and token, then of each segment its size and what it followed.
_TEXTS = pa.schema([("doc_ids", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), *((c, pa.list_(pa.int64())) for c in ("sizes", "n_bytes", "segments")), *((c, pa.binary()) for c in ("ids", "unit_key", "token_key", "per_segment", "segment_key"))])


def _first_as_0(ids: np.ndarray) -> np.ndarray:
    """Numbers by first occurrence, each 0 where it first stands and one more elsewhere; ``_numbered`` gives them back."""
    first = ids > np.maximum.accumulate(np.append(-1, ids))[:-1]
    return np.where(first, 0, ids + 1).astype(np.int32)


def _numbered(x: np.ndarray) -> np.ndarray:
    return np.where(x == 0, np.cumsum(x == 0), x) - 1


def _planes(x: np.ndarray) -> bytes:
    """Numbers of four bytes, all their first bytes before all their second ones: the high ones then cost little."""
    return x.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _packed(*columns) -> bytes:
    arrays = []
    for x, f in zip(columns, _TEXTS, strict=True):
        arrays.append(pa.array([_planes(x)], pa.binary()) if f.type == pa.binary() else pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, f.type.value_type)))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _TEXTS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(pa.RecordBatch.from_arrays(arrays, schema=_TEXTS))
    return sink.getvalue().to_pybytes()


def _unpacked(texts: bytes) -> dict[str, pa.Array]:
    (batch,) = pa.ipc.open_stream(texts)
    whole = lambda x: pa.array(np.frombuffer(x.as_buffer(), np.uint8).reshape(4, -1).T.copy().view("<i4").ravel())
    return {f.name: whole(batch.column(f.name)[0]) if f.type == pa.binary() else batch.column(f.name).values for f in _TEXTS}


_SLICES = "slice long, key_bytes long, hashes binary, keys binary, entries long, follow binary, texts binary"


def _squeezed(x: bytes) -> bytes:
    return len(x).to_bytes(8, "little") + (pa.compress(x, "zstd", asbytes=True) if len(x) > 256 else x)


def _unsqueezed(x: bytes) -> pa.Buffer:
    size = int.from_bytes(x[:8], "little")
    return pa.decompress(x[8:], size, "zstd") if size > 256 else pa.py_buffer(x[8:])


def _bounds(keys: pa.Array) -> np.ndarray:
    """Where each of some byte strings begins in their buffer, and at the end where the last one ends."""
    of = np.int64 if pa.types.is_large_binary(keys.type) else np.int32
    return np.frombuffer(keys.buffers()[1], of)[keys.offset : keys.offset + len(keys) + 1] if len(keys) else np.zeros(1, of)


def _strings(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Byte strings that stand one behind the other, of so many bytes each."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _keys_packed(keys: pa.Array, counts: np.ndarray) -> bytes:
    """Keys of less than 256 bytes, and whole numbers for them."""
    bounds, data = _bounds(keys), keys.buffers()[2]
    sizes = np.diff(bounds).astype(np.uint8).tobytes()
    whole = data.slice(bounds[0], bounds[-1] - bounds[0]).to_pybytes() if data is not None else b""
    return len(keys).to_bytes(4, "little") + b"".join(len(x).to_bytes(4, "little") + x for x in (_squeezed(sizes), _squeezed(whole), _small(counts)))


def _keys_unpacked(x: bytes) -> tuple[pa.Array, np.ndarray]:
    n, at, parts = int.from_bytes(x[:4], "little"), 4, []
    for _ in range(3):
        size = int.from_bytes(x[at : at + 4], "little")
        parts.append(x[at + 4 : at + 4 + size])
        at += 4 + size
    bounds = np.zeros(n + 1, np.int64)
    np.cumsum(np.frombuffer(_unsqueezed(parts[0]), np.uint8), out=bounds[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(bounds), _unsqueezed(parts[1])]), _whole(parts[2])


def _split(ranges: int):
    """(range, slice, keys): a slice's keys by ``ranges`` ranges of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, hashes, listed in zip(*(batch.column(c).to_pylist() for c in ("slice", "hashes", "keys")), strict=True):
                keys, counts = _keys_unpacked(listed)
                of = np.cumsum(_whole(hashes)) * ranges >> 32
                starts = np.flatnonzero(np.diff(of, prepend=-1))
                ends = np.append(starts[1:], len(of))
                for i in range(0, len(starts), 1024):
                    parts = list(zip(starts[i : i + 1024].tolist(), ends[i : i + 1024].tolist(), strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(of[starts[i : i + 1024]]), pa.array([number] * len(parts)), pa.array([_keys_packed(keys.slice(x, y - x), counts[x:y]) for x, y in parts], pa.binary())], names=["range", "slice", "keys"])

    return run


_MET = pa.schema([("range", pa.int64()), ("keys", pa.binary()), ("slices", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("places", pa.binary()), ("size", pa.int64()), ("distinct", pa.int64()), ("unit_bytes", pa.int64())])
_MET_DDL = "range long, keys binary, slices array<long>, sizes array<long>, places binary, size long, distinct long, unit_bytes long"


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each range: its distinct keys with their counts, and for each slice the places of its keys among them.

    Rows come sorted by (range, slice). ``size`` and ``distinct`` are those of the tokens that occur in training, ``unit_bytes`` is of its units.
    """
    now, slices, held = None, [], []

    def made() -> pa.RecordBatch:
        encoded = pa.concat_arrays([k for k, _ in held]).dictionary_encode()
        places, keys = encoded.indices.to_numpy(), encoded.dictionary
        counts = np.bincount(places, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)
        unit = pc.binary_slice(keys.cast(pa.binary()), 0, 1).to_numpy(zero_copy_only=False) == b"u"
        known = ~unit & (counts > 0)
        unit_bytes = pc.binary_length(keys).to_numpy()[unit & (counts > 0)].sum()
        row = {"range": now, "keys": _keys_packed(keys, counts), "slices": list(slices), "sizes": [len(k) for k, _ in held], "places": _small(places), "size": int(counts[known].sum()), "distinct": int(known.sum()), "unit_bytes": int(unit_bytes)}
        return pa.RecordBatch.from_pylist([row], schema=_MET)

    for batch in batches:
        for of, number, listed in zip(*(batch.column(c).to_pylist() for c in ("range", "slice", "keys")), strict=True):
            if of != now:
                if held:
                    yield made()
                now, slices, held = of, [], []
            slices.append(number)
            held.append(_keys_unpacked(listed))
    if held:
        yield made()


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, now = TaskContext.get().partitionId() << 32, _Slice()
    for batch in batches:
        doc_ids, held_out = batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist()
        for words in text_words(batch.column("text")):
            if now.doc_ids and now.size + len(words.data) > SLICE_BYTES:
                yield from now.rows(number)
                number, now = number + 1, _Slice()
            now.add(words, doc_ids[words.first : words.last], held_out[words.first : words.last])
    if now.doc_ids:
        yield from now.rows(number)


# --- scores -------------------------------------------------------------------------------------------------------


def _valued(tables, weights: np.ndarray, refined: np.ndarray):
    """(slice, range, values): of a slice's keys in a range, in their order, each unit's log10 probability and each token's count."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(tables.value, weights, refined)
        for batch in batches:
            for row in batch.to_pylist():
                keys, counts = _keys_unpacked(row["keys"])
                units = pc.binary_slice(keys.cast(pa.binary()), 0, 1).to_numpy(zero_copy_only=False) == b"u"
                listed = [k[1:] for k in keys.filter(pa.array(units)).to_pylist()]
                parts = [model.log2(listed[i : i + STEP_UNITS]) for i in range(0, len(listed), STEP_UNITS)]
                value = np.zeros(len(keys), np.float32)
                value[units] = np.concatenate([*parts, np.zeros(0)]) * np.log10(2.0)
                parts = [_values_packed(units[x], value[x], counts[x]) for x in np.split(_whole(row["places"]), np.cumsum(row["sizes"])[:-1])]
                yield pa.RecordBatch.from_arrays([pa.array(row["slices"], pa.int64()), pa.array([row["range"]] * len(parts)), pa.array(parts, pa.binary())], names=["slice", "range", "values"])

    return score


def _values_packed(units: np.ndarray, value: np.ndarray, counts: np.ndarray) -> bytes:
    parts = _squeezed(np.packbits(units).tobytes()), _squeezed(value[units].tobytes()), _small(counts[~units])
    return len(units).to_bytes(4, "little") + b"".join(len(x).to_bytes(4, "little") + x for x in parts)


def _values_unpacked(x: bytes, total: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each key its log10 probability, and whether it is a token that occurs in training."""
    n, at, parts = int.from_bytes(x[:4], "little"), 4, []
    for _ in range(3):
        size = int.from_bytes(x[at : at + 4], "little")
        parts.append(x[at + 4 : at + 4 + size])
        at += 4 + size
    units = np.unpackbits(np.frombuffer(_unsqueezed(parts[0]), np.uint8), count=n).astype(bool)
    counts = _whole(parts[2])
    value, known = np.empty(n), np.zeros(n, np.int64)
    value[units] = np.frombuffer(_unsqueezed(parts[1]), np.float32)
    value[~units] = np.log10((counts + 0.5) / total)
    known[~units] = counts > 0
    return value, known


def _with_contexts(alone: np.ndarray, codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The log10 probability of segments, of those of their units ``alone``."""
    known, hit = (codes[0] & 3) > 0, codes[0] >> 2 > 0
    p = np.where(known, foreseen_chances(codes, weights), 0.0)
    rest = np.log10(1.0 - p) + alone
    return np.where(hit, np.logaddexp(np.log(np.where(hit, p, 1.0)), rest * np.log(10.0)) / np.log(10.0), rest)


_FOUND = pa.schema([
    ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
    ("base_score", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64()), ("bits_per_byte", pa.float64()),
])
_FOUND_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long, bits_per_byte double"


def _added(total: float, weights: np.ndarray):
    """Rows come sorted by slice: the values of its keys and what its segments followed by range, then its texts.

    ``total`` is what token counts are divided by, ``weights`` are those of contexts over units. A segment has the chance
    that it is foreseen, if it is the one, and the chance of its units in what is left.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, codes = [], []
        for batch in batches:
            for values, of_range, packed in zip(*(batch.column(c).to_pylist() for c in ("values", "codes", "texts")), strict=True):
                if values is not None:
                    held.append(_values_unpacked(values, total))
                if of_range is not None:
                    codes.append(_codes(of_range))
                if packed is None:
                    continue
                texts = _unpacked(packed)
                value, known = (np.append(np.concatenate(x), 0) for x in zip(*held, strict=True))  # no key, -1, has the value 0
                found = np.concatenate([*codes, np.zeros((3, 1), np.uint8)], 1)  # -1, no entry, is unknown
                held, codes = [], []
                unit_key, token_key, ids, sizes, n_bytes = (texts[c].to_numpy() for c in ("unit_key", "token_key", "ids", "sizes", "n_bytes"))
                ids = _numbered(ids)
                of_entry = ((token_key >= 0).astype(np.int64), known[token_key], value[token_key])
                sums = [np.add.reduceat(x[ids], np.cumsum(sizes) - sizes) for x in of_entry]
                segments, per_segment, segment_key = (texts[c].to_numpy() for c in ("segments", "per_segment", "segment_key"))
                alone = np.add.reduceat(value[unit_key][ids], np.cumsum(per_segment) - per_segment)
                sums.append(np.add.reduceat(_with_contexts(alone, found[:, segment_key], weights), np.cumsum(segments) - segments))
                yield pa.RecordBatch.from_arrays([texts["doc_ids"], texts["held_out"], *map(pa.array, sums), texts["n_bytes"], pa.array(-sums[3] / np.log10(2.0) / np.maximum(1, n_bytes))], schema=_FOUND)

    return add


def held_out_rows(doc_id: str, part: int = 5, rest: int = 1) -> Column:
    """Whether a text is not learned from: crc32 of the id's text leaves ``rest`` by ``part``. Null ids are not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % part == rest, F.lit(True))


def score_texts(docs: DataFrame) -> DataFrame:
    """The log10 probability of every whole text, by the mixed model and by token counts.

    (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte). Both learn from all texts
    that are not held out. Tokens are words, A-Z lower-cased, and an end for each text; ``base_score`` is the sum of
    log10((c + 0.5) / (N + 0.5 (V + 1))). In ``score`` a text that is learned from does not foresee its own segments, so
    that it compares with held-out ones.

    Null and empty texts are an end alone. A null doc_id is held out; repeated rows have a row each. Without any
    text to learn from, N and V are 0 and all predictions one half. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out_rows("doc_id").alias("held_out"), F.col("text").cast("string").alias("text"))
    slices = written(texts.mapInArrow(_sliced, _SLICES), "slices")
    ranges = 1 + (slices.agg(F.sum("key_bytes")).first()[0] or 0) // RANGE_BYTES
    parts = slices.select("slice", "hashes", "keys").mapInArrow(_split(ranges), "range long, slice long, keys binary")
    met = written(parts.repartition("range").sortWithinPartitions("range", "slice").mapInArrow(_met, _MET_DDL), "met")
    size, distinct, unit_bytes = met.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("size", "distinct", "unit_bytes"))).first()
    entries = slices.agg(F.sum("entries")).first()[0] or 0
    follow = slices.select("slice", "follow").mapInArrow(_split_follow(1 + entries // FOLLOW_ROWS), "range long, slice long, follow binary")
    contexts = written(follow.repartition("range").sortWithinPartitions("range", "slice").mapInArrow(_followed, "slice long, range long, codes binary, counts binary"), "contexts")
    weights = train_followed(contexts, entries)
    model = train(met, unit_bytes)
    shared = docs.sparkSession.sparkContext.broadcast(model.tables)
    total = size + 0.5 * (distinct + 1)
    values = met.mapInArrow(_valued(shared, model.weights, model.refined), "slice long, range long, values binary")
    rows = values.unionByName(contexts.select("slice", "range", "codes"), allowMissingColumns=True).unionByName(slices.select("slice", "texts"), allowMissingColumns=True).repartition("slice").sortWithinPartitions("slice", F.col("range").asc_nulls_last())
    found = written(rows.mapInArrow(_added(total, weights), _FOUND_DDL), "scored")
    removed(slices, met, contexts)
    return found.withColumn("train_tokens", F.lit(size).cast("long")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")
