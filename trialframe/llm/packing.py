"""Packing tokenized documents into windows by Karmarkar-Karp multiway differencing.

A document is cut at every multiple of the window size: full windows need no packing, what remains is one
piece shorter than a window. Pieces are dealt into groups of bounded size, and each group is divided by
differencing into windows of nearly equal load.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small_batches, written
from .words import Words, text_words, word_hashes

#: Windows that a group of pieces fills, and its pieces, each on average: differencing holds an array of as many
#: values as there are windows for each piece, some 20 MB at most.
GROUP_WINDOWS = 128
GROUP_PIECES = 8192
#: Words that a worker remembers the ids of, at some 30 bytes a word.
REMEMBERED = 3_000_000
#: Bytes of text that are looked up together.
BATCH_BYTES = 1 << 20

_PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


class TokenIds:
    """Ids of whole texts by a tokenizer that never joins what white space parts.

    Its ids of a text are then those of the words one after another, and each distinct word is encoded
    once: words are looked up by a 64-bit hash in sorted arrays, batch by batch. Texts that hold one of its
    special tokens are encoded whole. Ids must be below 65,536.
    """

    def __init__(self, path: str, end: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [x.content for x in added.values()]
        #: Whether it lower-cases anyway, so that words need not differ by case.
        self.lower = "Lowercase" in str(self.tokenizer.normalizer)
        self.end = end
        self._forget()

    def _forget(self) -> None:
        #: Sorted hashes with the places of their words, the latest last; each at most half the one before.
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []
        #: Where each word's ids begin, and the ids; filled up to ``words`` and ``starts[words]``.
        self.starts, self.ids, self.words = np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint16), 0

    def __call__(self, column: pa.Array) -> Iterator[np.ndarray]:
        for words in text_words(column, BATCH_BYTES):
            hashes, first, which = np.unique(word_hashes(words, self.lower), return_index=True, return_inverse=True)
            place = self._places(words, hashes, first)[which]
            start = self.starts[place]
            size = self.starts[place + 1] - start
            ends = np.cumsum(size)
            flat = self.ids[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)].astype("<u4")
            bounds = np.concatenate([[0], ends])[words.bounds]
            for row, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True), words.first):
                text = self._special(column, row, words, row - words.first)
                yield np.append(flat[a:b], np.uint32(self.end)) if text is None else np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, self.end], "<u4")

    def _special(self, column: pa.Array, row: int, words: Words, at: int) -> str | None:
        """A row's text if it holds a special token."""
        if words.marked is None:
            words.marked = np.zeros(words.last - words.first, bool)
            raw = words.data.tobytes()
            for token in self.special:
                found = raw.find(token.encode())
                while found >= 0:
                    words.marked[np.searchsorted(words.offsets, found, "right") - 1] = True
                    found = raw.find(token.encode(), found + 1)
        return column[row].as_py() if words.marked[at] else None

    def _places(self, words: Words, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        place = np.full(len(hashes), -1, np.int64)
        for keys, places in self.runs:
            if (open_ := np.flatnonzero(place < 0)).size:
                at = np.minimum(np.searchsorted(keys, hashes[open_]), len(keys) - 1)
                hit = keys[at] == hashes[open_]
                place[open_[hit]] = places[at[hit]]
        if not (new := np.flatnonzero(place < 0)).size:
            return place
        if self.words + len(new) > REMEMBERED and self.words:
            self._forget()
            return self._places(words, hashes, first)
        place[new] = self._learn([words.data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(words.starts[first[new]], words.ends[first[new]], strict=True)])
        self.runs.append((hashes[new], place[new]))
        while len(self.runs) > 1 and 2 * len(self.runs[-1][0]) > len(self.runs[-2][0]):
            keys, places = (np.concatenate(x) for x in zip(self.runs.pop(), self.runs.pop(), strict=True))
            order = np.argsort(keys)
            self.runs.append((keys[order], places[order]))
        return place

    def _learn(self, fresh: list[str]) -> np.ndarray:
        """Encodes words and returns their places.

        They are encoded as one text; each id belongs to the word in which it begins.
        """
        whole = [not any(x in w for x in self.special) for w in fresh]  # rows with the others are encoded whole
        fresh = [w if k else "" for w, k in zip(fresh, whole, strict=True)]
        encoded = self.tokenizer.encode(" ".join(fresh), add_special_tokens=False)
        found = np.array(encoded.ids, np.uint16)
        begins = np.cumsum([0, *(len(w) + 1 for w in fresh)])
        at = np.fromiter((a for a, _ in encoded.offsets), np.int64, len(found))
        sizes = np.diff(np.searchsorted(at, begins))
        while len(self.starts) < self.words + len(fresh) + 1:
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        begin = self.starts[self.words]
        while len(self.ids) < begin + sizes.sum():
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.starts[self.words + 1 : self.words + 1 + len(fresh)] = begin + np.cumsum(sizes)
        self.ids[begin : begin + sizes.sum()] = found
        places = np.arange(self.words, self.words + len(fresh))
        self.words += len(fresh)
        return places


_tokenizers: dict[tuple[str, int], TokenIds] = {}


def token_ids(path: str, end: int) -> TokenIds:
    """A worker's own ``TokenIds``, which later tasks in that worker use again."""
    if (path, end) not in _tokenizers:
        _tokenizers[path, end] = TokenIds(path, end)
    return _tokenizers[path, end]


def document_pieces(docs: DataFrame, tokenizer: str, end: int, capacity: int) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of each piece of each document; ``tokenizer`` is a path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = token_ids(tokenizer, end)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), ids_of(batch.column("text")), strict=True):
                raw = memoryview(ids.tobytes())
                rows += [(doc_id, at, min(capacity, len(ids) - at), zlib.crc32(raw[4 * at : 4 * (at + capacity)]), len(ids)) for at in range(0, len(ids), capacity)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _PIECES)


def differenced(sizes: list[int], ways: int) -> list[list[int]]:
    """The places of ``sizes`` in ``ways`` parts of nearly equal sums, by Karmarkar-Karp differencing.

    Each size begins as a partial partition of its own. The two with the largest differences are merged, the
    heaviest part of one with the lightest of the other, until one is left. Parts are joined by reference:
    a negative member refers to a pair of parts.
    """
    pairs: list[tuple[int, int]] = []
    heap: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    none = len(sizes)
    for i, size in enumerate(sizes):
        loads, parts = np.zeros(ways, np.int64), np.full(ways, none, np.int64)
        loads[0], parts[0] = size, i
        heap.append((-size, i, loads, parts))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, order, loads, parts = heapq.heappop(heap)
        _, _, more, others = heapq.heappop(heap)
        others = others[::-1]
        both = (parts != none) & (others != none)
        merged = np.where(parts == none, others, parts)
        if at := np.flatnonzero(both).tolist():
            merged[at] = np.arange(-len(pairs) - 1, -len(pairs) - 1 - len(at), -1)
            pairs += zip(parts[at].tolist(), others[at].tolist(), strict=True)
        loads = loads + more[::-1]
        by_load = np.argsort(-loads, kind="stable")
        loads, merged = loads[by_load], merged[by_load]
        loads -= loads[-1]
        heapq.heappush(heap, (-int(loads[0]), order, loads, merged))
    out = []
    for part in heap[0][3].tolist() if heap else []:
        members, stack = [], [part]
        while stack:
            x = stack.pop()
            if x < 0:
                stack += pairs[-x - 1]
            elif x != none:
                members.append(x)
        out.append(sorted(members))
    return out


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """The places of ``sizes`` in windows within ``capacity``; one window more whenever one would exceed it."""
    # two sizes over half of the capacity never share a window
    ways = max(1, -(-sum(sizes) // capacity), sum(2 * x > capacity for x in sizes))
    while True:
        parts = differenced(sizes, ways)
        if all(sum(sizes[i] for i in part) <= capacity for part in parts):
            return parts
        ways += 1


def pack(docs: DataFrame, tokenizer: str, end: int = 2, capacity: int = 4096) -> DataFrame:
    """The pieces of all documents and where they are packed.

    (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): the ids of a document are those of
    its text, then ``end``; ``start`` counts its ids before the piece, ``ids_crc32`` is the CRC of the
    piece's ids as little-endian 32-bit numbers, ``offset`` counts the ids before it in its sequence. No
    sequence exceeds ``capacity``.

    Null and empty texts are ``end`` alone. Repeated rows are documents of their own, as are rows with a
    null doc_id. Other columns are not read. Ids are made where the text is; only pieces are shuffled.
    """
    small_batches(docs.sparkSession)
    pieces = written(document_pieces(docs, tokenizer, end, capacity).withColumn("piece", F.monotonically_increasing_id()), "pieces")
    short = pieces.filter(F.col("length") < capacity)
    sums = short.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("ids"), F.count("*").alias("pieces")).first()
    groups = max(1, round(sums["ids"] / (GROUP_WINDOWS * capacity)), round(sums["pieces"] / GROUP_PIECES))

    def divide(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "piece"], ascending=[False, True], ignore_index=True)
        sizes = rows["length"].tolist()
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for window, members in enumerate(windows(sizes, capacity)):
            sequence[members] = 2 * ((int(key[0]) << 24) + window)
            offset[members] = np.cumsum([0, *(sizes[i] for i in members[:-1])])
        return rows.assign(sequence_id=sequence, offset=offset)[[*_NAMES, "sequence_id", "offset"]]

    packed = short.withColumn("group", F.pmod(F.xxhash64("piece"), F.lit(groups))).groupBy("group").applyInPandas(divide, f"{_PIECES}, sequence_id bigint, offset bigint")
    full = pieces.filter(F.col("length") == capacity).select(*_NAMES, (F.col("piece") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)


_NAMES = [x.split()[0] for x in _PIECES.split(", ")]


def sequences(docs: DataFrame, packed: DataFrame, tokenizer: str, end: int = 2) -> DataFrame:
    """(sequence_id, ids): the token windows themselves, for documents whose doc_id is unique."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = token_ids(tokenizer, end)
        for batch in batches:
            out = []
            for pieces, ids in zip(batch.column("pieces").to_pylist(), ids_of(batch.column("text")), strict=True):
                out += [(p["sequence_id"], p["offset"], ids[p["start"] : p["start"] + p["length"]].tolist()) for p in pieces]
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.int64()))], names=["sequence_id", "offset", "ids"])

    plan = packed.groupBy("doc_id").agg(F.collect_list(F.struct("sequence_id", "offset", "start", "length")).alias("pieces")).withColumnRenamed("doc_id", "of")
    texts = docs.select("doc_id", "text").join(plan, F.col("doc_id").eqNullSafe(F.col("of"))).select("text", "pieces")
    cuts = texts.mapInArrow(cut, "sequence_id bigint, offset bigint, ids array<bigint>")
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return cuts.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))
