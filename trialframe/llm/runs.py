"""Periodic runs of words, by a suffix automaton whose link tree's paths are recoloured as words are appended.

A run is a longest stretch of words with a smallest period q. In the tree of suffix links the path from the
state of a prefix to the root holds all suffixes of that prefix. Each path carries the place where its words
last ended. Appending the word at place r means access to the path of that prefix: its pieces, each with a last
end e of its own, are recoloured to r. A piece whose longest state has L words says that the L words up to
e and the L words up to r are equal, and no more before them; so the distance d = r - e is a period of the
d + L words up to r. With L >= d they hold a square, and with L >= 2d they reach the exponent asked here; they
are then extended to the right, which makes a run. A piece's end is the last one of its words, so d is the smallest
period.

All words of a text are known at once, so the link tree is whole before the first access and never cut
or linked but by its preferred paths. These are kept as stacks on its heavy paths: an access recolours the upper
part of each heavy path on its way, whose older pieces lie on top of the stack.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small_batches

#: A run has at least so many words, and so many periods.
LEAST_WORDS = 24
LEAST_PERIODS = 3


class Run(NamedTuple):
    start: int
    length: int
    period: int


class _Automaton:
    """The suffix automaton of a sequence: each state's longest length and suffix link, and each prefix's state."""

    def __init__(self, words: Sequence):
        self.length, self.link, self.prefix = [0], [-1], []
        length, link, following = self.length, self.link, [{}]
        last = 0
        for word in words:
            state = len(length)
            length.append(length[last] + 1)
            link.append(0)
            following.append({})
            at = last
            while at >= 0 and word not in following[at]:
                following[at][word] = state
                at = link[at]
            if at >= 0:
                to = following[at][word]
                if length[to] != length[at] + 1:
                    copy = len(length)
                    length.append(length[at] + 1)
                    link.append(link[to])
                    following.append(following[to].copy())
                    link[to] = link[state] = copy
                    while at >= 0 and following[at].get(word) == to:
                        following[at][word] = copy
                        at = link[at]
                else:
                    link[state] = to
            self.prefix.append(state)
            last = state

    def heavy_paths(self) -> tuple[list[int], list[int]]:
        """Each state's heavy path, by the state at its top, and that top's parent (-1 at the root)."""
        length, link = self.length, self.link
        order = sorted(range(1, len(length)), key=length.__getitem__)  # parents are shorter
        size, heavy = [1] * len(length), [-1] * len(length)
        for state in reversed(order):
            size[link[state]] += size[state]
        for state in order:
            up = link[state]
            if heavy[up] < 0 or size[state] > size[heavy[up]]:
                heavy[up] = state
        top = [0] * len(length)
        for state in order:
            up = link[state]
            top[state] = top[up] if heavy[up] == state else state
        return top, link


def _stretch_runs(words: Sequence) -> Iterator[Run]:
    """The runs of at least LEAST_PERIODS periods in ``words``, of any length."""
    automaton = _Automaton(words)
    length = automaton.length
    top, link = automaton.heavy_paths()
    #: On each heavy path, from its deepest coloured state up: (longest length of the piece, its last end).
    pieces: dict[int, list[tuple[int, int]]] = {}
    reached: dict[int, int] = {}  # the end of the last run of each period
    n = len(words)
    for r, state in enumerate(automaton.prefix):
        while state > 0:
            chain = top[state]
            here = length[state]
            stack = pieces.setdefault(chain, [])
            while stack:
                longest, e = stack[-1]
                shared, d = min(longest, here), r - e
                if shared >= (LEAST_PERIODS - 1) * d and r > reached.get(d, -1):
                    end = r + 1
                    while end < n and words[end] == words[end - d]:
                        end += 1
                    reached[d] = end - 1
                    start = r - d - shared + 1
                    yield Run(start, end - start, d)
                if longest > here:
                    break
                stack.pop()
            stack.append((here, r))
            state = link[chain]


def _stretches(words: Sequence, first: int = 0) -> Iterator[tuple[int, int]]:
    """Stretches (start, end) outside of which no word can be in a run.

    Each word of a run occurs LEAST_PERIODS times in it, so a word that is rarer in a stretch splits it.
    """
    todo = [(0, len(words))]
    while todo:
        start, end = todo.pop()
        part = words[start:end]
        counts = Counter(part)
        if min(counts.values(), default=LEAST_PERIODS) >= LEAST_PERIODS:
            if end - start >= LEAST_WORDS:
                yield start, end
            continue
        since = start
        for i, word in enumerate(part, start):
            if counts[word] < LEAST_PERIODS:
                if i - since >= LEAST_WORDS:
                    todo.append((since, i))
                since = i + 1
        if end - since >= LEAST_WORDS:
            todo.append((since, end))


def word_runs(words: Sequence) -> list[Run]:
    """All runs of at least LEAST_WORDS words and LEAST_PERIODS periods, by start and then period."""
    found = []
    if len(words) >= LEAST_WORDS:
        for start, end in _stretches(words):
            found += [Run(start + x.start, x.length, x.period) for x in _stretch_runs(words[start:end]) if x.length >= LEAST_WORDS]
    return sorted(found, key=lambda x: (x.start, x.period))


def repeated_places(runs: list[Run]) -> list[tuple[int, int]]:
    """The places (start, end) that runs hold after their first period, as apart stretches in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((x.start + x.period, x.start + x.length) for x in runs):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def collapsed(words: list, runs: list[Run]) -> list:
    """``words`` with each run's repetitions, all after its first period, left out."""
    kept, at = [], 0
    for start, end in repeated_places(runs):
        kept += words[at:start]
        at = end
    return kept + words[at:]


def with_period(words: list, doc_id: int | None) -> list:
    """The contract's test texts: for one document in ten the words from some place on are made periodic."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def _most_periods(runs: list[Run]) -> Run | None:
    best = None
    for x in runs:  # in order, so the first of equals stays
        if best is None or x.length * best.period > best.length * x.period:
            best = x
    return best


_FOUND = pa.schema([
    ("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()),
    ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("n_words", pa.int64()), ("n_dropped", pa.int64()),
])
_DDL = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long, n_dropped long"


def periodic_runs(docs: DataFrame, damaged: bool = False) -> DataFrame:
    """The runs of every document's whole text, as counts, the run of most periods, and hashes.

    (doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, n_words, n_dropped). A
    word is a longest stretch of other characters than space and 0x09-0x0D; the words of a run are equal to those one
    period on. ``collapsed_sha256`` is of the words without the repetitions, ``n_dropped`` of them. With
    ``damaged`` one document in ten is made periodic first, as ``with_period`` says.

    Null and empty texts have no words and no runs. A null doc_id stays null and is not made periodic; repeated
    rows have a row each. Other columns are not read. No row is shuffled. Time grows with the words of a text
    times their logarithm, whatever they are; what a text needs in memory grows with it.
    """
    small_batches(docs.sparkSession)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                if damaged:
                    words = with_period(words, doc_id)
                runs = word_runs(words)
                best = _most_periods(runs)
                listed = "".join(f"{x.start},{x.length},{x.period}\n" for x in runs)
                kept = collapsed(words, runs) if runs else words
                rows.append({
                    "doc_id": doc_id,
                    "n_runs": len(runs),
                    **({"start": best.start, "length": best.length, "period": best.period, "exponent_milli": 1000 * best.length // best.period} if best else {}),
                    "runs_sha256": hashlib.sha256(listed.encode()).hexdigest(),
                    "collapsed_sha256": hashlib.sha256(b" ".join(kept)).hexdigest(),
                    "n_words": len(words),
                    "n_dropped": len(words) - len(kept),
                })
            yield pa.RecordBatch.from_pylist(rows, schema=_FOUND)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(find, _DDL)


def run_places(docs: DataFrame) -> DataFrame:
    """One row for each run of each document: (doc_id, start, length, period), in words from 0."""
    small_batches(docs.sparkSession)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, places = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if text.is_valid:
                    for run in word_runs(text.as_buffer().to_pybytes().split()):
                        ids.append(doc_id)
                        places.append(run)
            columns = [pa.array([x[i] for x in places], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *columns], names=["doc_id", "start", "length", "period"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(find, "doc_id long, start long, length long, period long")
