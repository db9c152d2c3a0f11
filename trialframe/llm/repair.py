"""Conversation repair: the cheapest edits that make the roles alternate, by tables of whole blocks.

A repaired conversation has role initials ``(s?(ua)+)?``. An automaton of four states reads them, and each row is one
of a few symbols: the edits that it allows depend on its role's initial and its fault alone. So what the rest of a
conversation costs from each state is a vector of four numbers, which differ by ten at most; less its least number
it is one of a few dozen vectors. The table says for every such vector and every block of BLOCK symbols which vector
lies before the block and how much the least number grows (the Four Russians' method). A conversation is read from its
end by one lookup a block. The audit is then traced from its start: only there a block is expanded, backward
from the vector kept at its end, and of the cheapest edits the one whose letter comes first is taken. Each edit leads
to one state, so the audit is the least of all cheapest ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import small_batches, written

#: Costs of the edits, and what a truncated row adds unless it is deleted.
DELETE, INSERT, KEEP, REROLE = 2, 5, 0, 1
TRUNCATED = 5
#: Symbols of a block. The table has some dozen times 10 ** BLOCK places of two bytes each.
BLOCK = 4

#: States: at the start, after a system row, after a user row, after an assistant row.
_EXPECTS = "uuau"  # what a state may insert or rerole to
_AFTER = {"s": 1, "u": 2, "a": 3}
_ACCEPTS = (True, False, False, True)
#: Symbols: nothing (fills the first block), a row to delete, and rows by initial, whole and truncated.
NOTHING, MUST_DELETE = 0, 1
_INITIALS = "suax"  # x: any other
SYMBOLS = 2 + 2 * len(_INITIALS)


def row_symbol(initial: str, truncated: bool) -> int:
    at = _INITIALS.find(initial) if initial else -1
    return 2 + 2 * (at if at >= 0 else 3) + truncated


class Move(NamedTuple):
    letter: str
    cost: int
    to: int


def _row_moves(symbol: int, state: int) -> list[Move]:
    """The edits of a row from a state, by letter."""
    moves = [Move("D", DELETE, state)]
    if symbol >= 2:
        initial, more = _INITIALS[(symbol - 2) // 2], TRUNCATED * ((symbol - 2) % 2)
        if initial == _EXPECTS[state] or (initial == "s" and state == 0):
            moves.append(Move("K", KEEP + more, _AFTER[initial]))
        moves.append(Move("R", REROLE + more, _AFTER[_EXPECTS[state]]))
    return moves


def _with_inserts(costs: list[int]) -> tuple[int, ...]:
    """Costs from each state, where rows may be inserted first."""
    for _ in range(3):
        costs = [min(c, INSERT + costs[_AFTER[_EXPECTS[state]]]) for state, c in enumerate(costs)]
    return tuple(costs)


_FAR = 1 << 20
_AT_END = _with_inserts([0 if x else _FAR for x in _ACCEPTS])


def _before(symbol: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs before a row, from those after it."""
    if symbol == NOTHING:
        return after
    return _with_inserts([min(m.cost + after[m.to] for m in _row_moves(symbol, state)) for state in range(4)])


class Tables:
    """Vectors of costs less their least number, and what each block of symbols makes of them."""

    def __init__(self):
        self.vectors = [_AT_END]  # its least number is 0
        known = {_AT_END: 0}
        to, grown = [], []
        at = 0
        while at < len(self.vectors):
            for symbol in range(SYMBOLS):
                costs = _before(symbol, self.vectors[at])
                least = min(costs)
                vector = tuple(c - least for c in costs)
                if vector not in known:
                    known[vector] = len(self.vectors)
                    self.vectors.append(vector)
                to.append(known[vector])
                grown.append(least)
            at += 1
        one_to = np.array(to, np.int16).reshape(-1, SYMBOLS)
        one_grown = np.array(grown, np.int16).reshape(-1, SYMBOLS)
        self.to, self.grown = one_to, one_grown
        for _ in range(BLOCK - 1):  # one more symbol before the block
            self.to, self.grown = (
                one_to[self.to].transpose(0, 2, 1).reshape(len(self.vectors), -1),
                (self.grown[:, :, None] + one_grown[self.to]).transpose(0, 2, 1).reshape(len(self.vectors), -1),
            )

    @lru_cache(maxsize=1 << 16)  # noqa: B019  (one instance a worker)
    def expanded(self, block: tuple[int, ...], vector: int, state: int) -> tuple[str, int]:
        """The edits of a block from a state, where ``vector`` holds the costs behind it, and the state reached."""
        costs = [self.vectors[vector]]
        for symbol in reversed(block):
            costs.append(_before(symbol, costs[-1]))
        costs.reverse()
        out = []
        for i, symbol in enumerate(block):
            if symbol == NOTHING:
                continue
            while True:
                insert = Move("I", INSERT, _AFTER[_EXPECTS[state]])
                options = [m for m in _row_moves(symbol, state) if m.cost + costs[i + 1][m.to] == costs[i][state]]
                if insert.cost + costs[i][insert.to] == costs[i][state]:
                    options.append(insert)
                move = min(options)  # letters differ
                out.append(move.letter)
                state = move.to
                if move.letter != "I":
                    break
        return "".join(out), state


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def audit(symbols: bytes) -> tuple[int, str]:
    """The cost of the cheapest edits of a row of symbols, and their letters, the ASCII-least of all cheapest."""
    table = tables()
    places = np.zeros(-(-len(symbols) // BLOCK) * BLOCK, np.int64)
    places[len(places) - len(symbols) :] = np.frombuffer(symbols, np.uint8)
    blocks = places.reshape(-1, BLOCK)
    codes = blocks @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))
    behind = np.empty(len(codes), np.int16)
    vector = cost = 0
    for i in range(len(codes) - 1, -1, -1):
        behind[i] = vector
        code = codes[i]
        cost += int(table.grown[vector, code])
        vector = table.to[vector, code]
    cost += table.vectors[vector][0]
    state, out = 0, []
    for block, vector in zip(map(tuple, blocks.tolist()), behind.tolist(), strict=True):
        letters, state = table.expanded(block, vector, state)
        out.append(letters)
    while not _ACCEPTS[state]:
        out.append("I")
        state = _AFTER[_EXPECTS[state]]
    return cost, "".join(out)


# --- the frame -------------------------------------------------------------------------------------------------

_SPACES = " \t\n\x0b\x0c\r"


def damaged_turns(conversations: DataFrame) -> DataFrame:
    """The contract's test rows: ``conversations`` with faults by crc32 of ``conv_id:turn``, nulls as one space.

    (conv_id, turn, role, text, n): ``n`` is how often a row stands there, 0 for a row that is dropped.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), (F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20).alias("fault"))
    return rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def _trimmed(c: str) -> Column:
    return F.rtrim(F.col(c), F.lit(_SPACES))


class _Faults:
    """What is counted of one conversation while its rows come in order."""

    def __init__(self):
        self.symbols = bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = self.turn = None
        self.turns = 0
        self.initial = None

    def add(self, turn: int | None, initial: str, n: int, kind: int, again: bool) -> None:
        if turn is not None and turn != self.turn:
            self.first = turn if self.first is None else self.first
            self.turn = turn
            self.turns += 1
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.illegal += n - 1
        self.initial = initial
        if kind == 0:
            self.blank += n
            self.symbols += bytes([MUST_DELETE]) * n
            return
        fresh = not again
        self.duplicate += n - fresh
        if fresh:
            self.truncated += kind == 2
            self.symbols.append(row_symbol(initial, kind == 2))
        self.symbols += bytes([MUST_DELETE]) * (n - fresh)

    def row(self) -> tuple:
        cost, letters = audit(bytes(self.symbols))
        gaps = 0 if self.first is None else min(self.turn - self.first + 1 - self.turns, (1 << 63) - 1)
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, letters


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _in_order(rows: DataFrame, *more: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *more)


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, rows, now, schema = [], [], None, None

    def taken(to: int) -> pa.RecordBatch:
        columns = list(zip(*rows[:to], strict=True)) if to else [()] * 7
        arrays = [pa.array(ids[:to], schema.field("conv_id").type), *(pa.array(x, pa.int64()) for x in columns[:6]), pa.array(columns[6], pa.string())]
        del ids[:to], rows[:to]
        return pa.RecordBatch.from_arrays(arrays, names=["conv_id", *_COUNTS, "audit"])

    for batch in batches:
        schema = batch.schema
        for conv_id, turn, initial, n, kind, again in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "n", "kind", "again")), strict=True):
            if now is None or conv_id != ids[-1]:
                if now is not None:
                    rows.append(now.row())
                ids.append(conv_id)
                now = _Faults()
            if n:
                now.add(turn, initial, n, kind, again)
        if rows:
            yield taken(len(rows))
    if now is not None:
        rows.append(now.row())
        yield taken(len(rows))


class _Repair:
    """Applies an audit to rows as they come: each row gives the lines (edit, role, text) that it leads to."""

    def __init__(self, letters: str):
        self.letters, self.at, self.state = letters, 0, 0

    def _inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.letters[self.at : self.at + 1] == "I":
            yield "I", self._expected(), ""
            self._moved(_EXPECTS[self.state])

    def _expected(self) -> str:
        return "user" if _EXPECTS[self.state] == "u" else "assistant"

    def _moved(self, initial: str) -> None:
        self.at += 1
        self.state = _AFTER[initial]

    def lines(self, role: str, text: str, n: int) -> Iterator[tuple[str, str, str]]:
        for _ in range(n):
            yield from self._inserted()
            letter = self.letters[self.at]
            if letter == "D":
                self.at += 1
                yield "D", role, text
            elif letter == "K":
                yield "K", role, text
                self._moved(role[0])
            else:
                yield "R", self._expected(), text
                self._moved(_EXPECTS[self.state])

    def rest(self) -> Iterator[tuple[str, str, str]]:
        yield from self._inserted()


def _rows_with_audits(turns: DataFrame) -> DataFrame:
    """For each conversation one row with counts and audit, and behind it the conversation's rows in order.

    Rows that are the same in everything are one row with a count. Texts are moved once for that and once to stand
    in order; all else is done on rows that hold a digest in place of the text.
    """
    gone = F.col("n") <= 0
    packed = turns.select(
        "conv_id",
        F.when(~gone, F.col("turn")).alias("turn"),
        F.when(gone, "").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(gone, "").otherwise(F.coalesce("text", F.lit(" "))).alias("text"),
        F.greatest("n", F.lit(0)).alias("n"),
        gone.alias("gone"),
    )
    packed = packed.groupBy("conv_id", "turn", "role", "text", "gone").agg(F.sum("n").alias("n"))
    packed = written(packed.withColumn("digest", F.unhex(F.sha2("text", 256))), "turns")
    end = F.right(_trimmed("text"), F.lit(1))
    narrow = packed.select("conv_id", "turn", "role", "digest", "n", F.left("role", F.lit(1)).alias("initial"), F.when(end == "", 0).when(end.isin(".", "!", "?"), 1).otherwise(2).alias("kind"))
    # only what stands at more than one turn; a missing turn comes before all others
    key = ["conv_id", "role", "digest"]
    seen = narrow.filter("n > 0").groupBy(*key).agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.max(F.col("turn").isNull()).alias("unnumbered")).filter("lo < hi or (unnumbered and lo is not null)")
    seen = seen.select(*(F.col(c).alias(f"seen_{c}") for c in key), "lo", "unnumbered")
    same = F.col("conv_id").eqNullSafe(F.col("seen_conv_id")) & (F.col("role") == F.col("seen_role")) & (F.col("digest") == F.col("seen_digest"))
    again = F.coalesce(F.col("turn").isNotNull() & (F.col("unnumbered") | (F.col("turn") > F.col("lo"))), F.lit(False))
    faults = narrow.join(seen, same, "left").select("conv_id", "turn", "role", "digest", "initial", "n", "kind", again.alias("again"))
    id_type = turns.schema["conv_id"].dataType.simpleString()
    heads = _in_order(faults, "turn", "role", "digest").select("conv_id", "turn", "initial", "n", "kind", "again").mapInArrow(_audits, f"conv_id {id_type}, {', '.join(f'{c} long' for c in _COUNTS)}, audit string")
    both = heads.withColumn("place", F.lit(0)).unionByName(packed.filter("n > 0").select("conv_id", "turn", "role", "digest", "text", "n", F.lit(1).alias("place")), allowMissingColumns=True)
    return _in_order(both, "place", "turn", "role", "digest").drop("digest")


def repair_conversations(turns: DataFrame) -> DataFrame:
    """Each conversation of ``turns`` (conv_id, turn, role, text, n), with what is wrong in it and how it is mended.

    (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256). The rows of a conversation
    are taken by turn, those without one first; rows of one turn by role and then by the SHA-256 of their text. ``n`` is
    how often a row stands there; a conversation whose rows all have 0 is returned with zeros, an empty audit and the
    hash of the empty string. A null role or text is one space, a null conv_id a conversation of its own. Other
    columns are not read.

    The audit is a letter for each row, and the hash of a conversation's lines has to be taken in their order: so
    one task reads a conversation, row by row, and holds its audit and nothing else of it, however long it is.
    """
    small_batches(turns.sparkSession)
    id_type = turns.schema["conv_id"].dataType.simpleString()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, work, sha, empty = None, None, None, True
        out = []

        def add(lines) -> None:
            nonlocal empty
            for edit, role, text in lines:
                if edit != "D":
                    sha.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                    empty = False

        def close() -> None:
            add(work.rest())
            out.append({**head, "repaired_sha256": sha.hexdigest()})

        schema = None
        for batch in batches:
            if schema is None:
                schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), *((c, pa.int64()) for c in _COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
            for row in batch.to_pylist():
                if row["place"] == 0:
                    if head is not None:
                        close()
                    head = {c: row[c] for c in ("conv_id", *_COUNTS, "audit")}
                    work, sha, empty = _Repair(head["audit"]), hashlib.sha256(), True
                else:
                    add(work.lines(row["role"], row["text"], row["n"]))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out.clear()
        if head is not None:
            close()
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return _rows_with_audits(turns).mapInArrow(digests, f"conv_id {id_type}, {', '.join(f'{c} long' for c in _COUNTS)}, audit string, repaired_sha256 string")


def repaired_turns(turns: DataFrame) -> DataFrame:
    """The repaired conversations of ``turns`` line by line: (conv_id, place, edit, role, text).

    ``place`` counts a conversation's edits from 0; deleted rows are there with edit D. Rows as in ``repair_conversations``.
    """
    small_batches(turns.sparkSession)
    id_type = turns.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "place", "edit", "role", "text"]

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_id = work = None
        place, out, schema = 0, [], None

        def add(found) -> None:
            nonlocal place
            for edit, role, text in found:
                out.append(dict(zip(names, (conv_id, place, edit, role, text), strict=True)))
                place += 1

        for batch in batches:
            if schema is None:
                schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
            for row in batch.to_pylist():
                if row["place"] == 0:
                    if work is not None:
                        add(work.rest())
                    conv_id, work, place = row["conv_id"], _Repair(row["audit"]), 0
                else:
                    add(work.lines(row["role"], row["text"], row["n"]))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out.clear()
        if work is not None:
            add(work.rest())
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return _rows_with_audits(turns).mapInArrow(lines, f"conv_id {id_type}, place long, edit string, role string, text string")


#: The query in SQL: CRC-32 by its table of bytes, edits by a search over rows and states that keeps the cheapest audit.
REPAIR_SQL = """
with recursive
bits as (
  select b, list_reduce([b] || range(8), lambda c, i: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) as v
  from range(256) t(b)
),
crc_table as (select list(v::bigint order by b) as t from bits),
read as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k
  from conversations
),
faulty as (
  select r.*, xor(list_reduce([4294967295::bigint] || list_transform(string_split(k, ''), lambda x: ascii(x)::bigint),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % 20 as f
  from read r, crc_table
),
rows_after as (
  select conv_id, turn,
    case when f = 4 then 'user' else role end as role,
    case when f = 1 then '' when f = 2 then translate(text, '.!?', '') else text end as text
  from faulty, range(2) copies(c)
  where f <> 0 and (c = 0 or f = 3)
),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text)) as i from rows_after
),
marked as (
  select *, left(role, 1) as initial, right(rtrim(text, e' \\t\\n\\x0b\\x0c\\r'), 1) as last_char,
    row_number() over (partition by conv_id, role, text order by i) > 1 as again,
    lag(left(role, 1)) over (partition by conv_id order by i) as before
  from placed
),
kinds as (
  select *, case when last_char = '' then 'b' when again then 'd' when last_char not in ('.', '!', '?') then 't' else 'o' end as kind
  from marked
),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
    count(*) filter (where kind = 'b') as blank, count(*) filter (where kind = 'd') as duplicate,
    count(*) filter (where kind = 't') as truncated,
    count(*) filter (where before is not null and before || initial not in ('su', 'ua', 'au')) as illegal,
    count(*) as n
  from kinds group by conv_id
),
-- a step: insert rows first (none, one or two), then edit the row
edges(p, q, expects) as (values (0, 2, 'u'), (1, 2, 'u'), (2, 3, 'a'), (3, 2, 'u')),
inserts as (
  select p, p as q, '' as letters, 0 as cost, '' as made from edges
  union all select p, q, 'I', 5, expects from edges
  union all select a.p, b.q, 'II', 10, a.expects || b.expects from edges a join edges b on a.q = b.p
),
search as (
  select conv_id, 0::bigint as i, 0 as state, 0::bigint as cost, '' as letters, []::varchar[] as lines from counts
  union all
  select conv_id, i, state, cost, letters, lines from (
    select s.conv_id, s.i + 1 as i, m.state, s.cost + ins.cost + m.cost as cost, s.letters || ins.letters || m.letter as letters,
      s.lines || list_transform(list_filter(string_split(ins.made, ''), lambda x: x <> ''), lambda x: case when x = 'u' then 'user:' else 'assistant:' end)
        || case when m.letter = 'D' then [] when m.letter = 'K' then [k.role || ':' || k.text]
             when e.expects = 'u' then ['user:' || k.text] else ['assistant:' || k.text] end as lines,
      row_number() over (partition by s.conv_id, m.state order by s.cost + ins.cost + m.cost, s.letters || ins.letters || m.letter) as best
    from search s
    join kinds k on k.conv_id is not distinct from s.conv_id and k.i = s.i + 1
    join inserts ins on ins.p = s.state
    join edges e on e.p = ins.q
    cross join lateral (
      select 'D' as letter, 2 as cost, ins.q as state
      union all select 'K', case when k.kind = 't' then 5 else 0 end, case k.initial when 's' then 1 when 'u' then 2 else 3 end
        where k.kind in ('o', 't') and (k.initial = e.expects or (k.initial = 's' and ins.q = 0))
      union all select 'R', case when k.kind = 't' then 6 else 1 end, e.q where k.kind in ('o', 't')
    ) m
  ) where best = 1
),
finished as (
  select s.conv_id, s.cost + ins.cost as cost, s.letters || ins.letters as audit,
    s.lines || list_transform(list_filter(string_split(ins.made, ''), lambda x: x <> ''), lambda x: case when x = 'u' then 'user:' else 'assistant:' end) as lines,
    row_number() over (partition by s.conv_id order by s.cost + ins.cost, s.letters || ins.letters) as best
  from search s join counts c on c.conv_id is not distinct from s.conv_id and c.n = s.i
  join inserts ins on ins.p = s.state and ins.q in (0, 3)
)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
  coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(cost, 0)::bigint as cost,
  coalesce(audit, '') as audit, sha256(coalesce(array_to_string(lines, e'\\n'), '')) as repaired_sha256
from (select distinct conv_id from conversations) o
left join counts c on c.conv_id is not distinct from o.conv_id
left join finished f on f.conv_id is not distinct from o.conv_id and f.best = 1
"""
