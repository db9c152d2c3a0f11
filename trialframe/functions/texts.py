"""Python functions of columns in Arrow batches, for which a row that repeats is read once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Distinct rows, and characters of their texts, that a worker remembers at most for one function.
MOST_ROWS, MOST_CHARS = 50_000, 16 << 20
#: Functions of which a worker remembers rows.
MOST_FUNCTIONS = 16


def numbered(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct row, and each row's number among them."""
    number = np.zeros(len(columns[0]), np.int64)
    for column in columns:
        if column.null_count == len(column):
            continue
        found = pc.dictionary_encode(column, null_encoding="encode")
        number = number * len(found.dictionary) + found.indices.to_numpy(zero_copy_only=False)
        number = pc.dictionary_encode(pa.array(number)).indices.to_numpy().astype(np.int64)
    _, first = np.unique(number, return_index=True)
    return first, number


class Remembered:
    """``read`` of rows, with a bounded memory of what it gave: boilerplate repeats across protocols."""

    def __init__(self, read: Callable[..., Any], kind: pa.DataType):
        self.read, self.kind = read, kind
        self.clear()

    def clear(self) -> None:
        self.places: dict[tuple, int] = {}
        self.values = pa.array([], self.kind)
        self.chars = 0

    def __call__(self, columns: list[pa.Array]) -> pa.Array:
        first, number = numbered(columns)
        rows = [tuple(None if x != x else x for x in row) for row in zip(*(c.take(pa.array(first)).to_pylist() for c in columns), strict=True)]
        if len(self.places) > MOST_ROWS or self.chars > MOST_CHARS:
            self.clear()
        new = [row for row in dict.fromkeys(rows) if row not in self.places]
        if new:
            self.values = pa.concat_arrays([self.values, pa.array([self.read(*row) for row in new], self.kind)])
            for row in new:
                self.places[row] = len(self.places)
                self.chars += sum(len(x) for x in row if isinstance(x, str))
        places = np.fromiter((self.places[row] for row in rows), np.int64, len(rows))
        return self.values.take(pa.array(places[number]))


_remembered: dict[str, Remembered] = {}


def remembered(name: str, make: Callable[[], Callable[..., Any]], kind: pa.DataType) -> Remembered:
    """This worker's memory of the function ``name``, which ``make`` makes; it outlives a task."""
    if name not in _remembered:
        if len(_remembered) >= MOST_FUNCTIONS:
            _remembered.clear()
        _remembered[name] = Remembered(make(), kind)
    return _remembered[name]


def by_text(name: str, make: Callable[[], Callable[..., Any]], kind: pa.DataType, ddl: str, *columns: Column, apart: bool = False) -> Column:
    """The function that ``make`` makes, of ``columns``. ``name`` tells it from all others, its parameters included.

    Equal calls in a projection are made once; one that stands ``apart`` is not moved into what reads it.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield remembered(name, make, kind)(list(batch.flatten()))

    function = F.arrow_udf(run, ddl)
    return (function.asNondeterministic() if apart else function)(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)]))


def by_texts(name: str, make: Callable[[], Callable[..., Any]], kind: pa.DataType, ddl: str, rows: Column) -> Column:
    """``by_text`` of each element of an array of structs; it stands apart. No array, an array of nothing."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch), 0).to_numpy()
            found = remembered(name, make, kind)(list(batch.flatten().flatten()))
            yield pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), found)

    return F.arrow_udf(run, f"array<{ddl}>").asNondeterministic()(rows)
