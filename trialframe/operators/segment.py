"""Protocol text to statements and atomic fragments."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.columns import stable_id

_HEADING = re.compile(P.HEADING, re.IGNORECASE)
_BULLET = re.compile(r"(?:[-*•]\s+|\d+[.)]\s+)(.*)", re.DOTALL)
_THRESHOLD = re.compile("|".join(re.sub(r"\?P<\w+>", "?:", p) for p in (P.COMPARISON, P.RANGE_TO, P.RANGE_AND)) + "|;", re.IGNORECASE)
_SECTION_NUMBER = re.compile(r"\d+(?:\.\d+)+\s")
_FIELD = re.compile(P.LABELLED_FIELD, re.IGNORECASE)

_STATEMENTS = "array<struct<criterion_type:string, source:string, place:int, context:string, earlier:int, own:array<string>>>"
#: Characters of the protocols, one at least, that are read at once.
_CHARS = 1 << 18


def labelled_parts(text: str) -> list[str]:
    """A dense item's labelled fields, if it has three or more; what comes before the first is dropped."""
    if text.count(":") < 3:
        return [text]
    at = [m.start() for m in _FIELD.finditer(text)]
    if len(at) < 3:
        return [text]
    parts = (text[a:b].strip(" ,;.") for a, b in zip(at, [*at[1:], None], strict=True))
    return [x for x in parts if x] or [text]


def statements(text: str | None) -> list[tuple[str, str]]:
    """(criterion_type, source) of each statement of a protocol's eligibility text.

    Headings set the type; text before the first is ignored, and without any each line is an inclusion
    statement. Bullets begin statements; other lines continue the one before, unless they are headings of
    sections, end with a colon, or state a threshold where no statement is open.
    """
    lines = [x for x in (line.strip() for line in (text or "").replace("\r\n", "\n").split("\n")) if x]
    kinds = [(_HEADING.match(line), line) for line in lines]
    headed = any(h for h, _ in kinds)
    out: list[tuple[str, list[str]]] = []
    kind, reading, open_ = "inclusion", not headed, False
    for heading, line in kinds:
        if heading:
            kind, reading, open_ = heading[1].lower(), True, False
        elif reading and (bullet := _BULLET.fullmatch(line)):
            out += ((kind, [part]) for part in labelled_parts(bullet[1].strip()))
            open_ = True
        elif reading and not headed:
            out.append((kind, [line]))
            open_ = True
        elif reading and not open_ and _THRESHOLD.search(line):
            out.append((kind, [line]))
            open_ = True
        elif reading and line.endswith(":"):
            open_ = False
        elif reading and open_ and not _SECTION_NUMBER.match(line):
            out[-1][1].append(line)
    return [(a, " ".join(b).strip()) for a, b in out]


def _pieces(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts of a batch, about _CHARS at once: what is made of them takes many times their size."""
    first, held = 0, 0
    for at, size in enumerate(pc.utf8_length(texts).to_pylist()):
        held += size or 0
        if held >= _CHARS or at - first >= 1000:
            yield texts.slice(first, at + 1 - first).to_pylist()
            first, held = at + 1, 0
    if first < len(texts):
        yield texts.slice(first).to_pylist()


def _lists(sizes: list[int], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(sizes)], pa.int32()), values)


def _all_statements(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Each text's statements with their neighbours, their fragments, and how many came before these."""
    for batch in batches:
        for texts in _pieces(batch):
            sizes, kinds, sources, places, contexts, earlier, own, fragments = [], [], [], [], [], [], [], []
            for text in texts:
                found = statements(text)
                said = [source for _, source in found]
                before = 0
                for at, (kind, source) in enumerate(found):
                    parts = [x for x in map(str.strip, source.split(";")) if x] if ";" in source else [source] if source else []
                    kinds.append(kind)
                    sources.append(source)
                    places.append(at)
                    contexts.append("\n".join(filter(None, said[max(at - 1, 0) : at + 2])))
                    earlier.append(before)
                    own.append(len(parts))
                    fragments += parts
                    before += len(parts)
                sizes.append(len(found))
            columns = [pa.array(kinds, pa.string()), pa.array(sources, pa.string()), pa.array(places, pa.int32()), pa.array(contexts, pa.string()), pa.array(earlier, pa.int32()), _lists(own, pa.array(fragments, pa.string()))]
            yield _lists(sizes, pa.StructArray.from_arrays(columns, names=["criterion_type", "source", "place", "context", "earlier", "own"]))


def _found() -> Column:
    return F.arrow_udf(_all_statements, _STATEMENTS).asNondeterministic()(F.col("protocol_text"))  # so that it runs once, whatever reads it


def _statement_id(criterion_type: Column | str, place: Column | str, statement: Column | str) -> Column:
    return stable_id("statement", "protocol_id", "source_version", criterion_type, place, statement)


def with_items(protocols: DataFrame) -> DataFrame:
    """``protocols`` with ``items``, the array of what ``segment`` makes rows of, as far as criteria are made of it."""
    named = F.transform("found", lambda s: F.struct(s.alias("s"), _statement_id(s["criterion_type"], s["place"] + 1, s["source"]).alias("id")))
    own = lambda x: F.transform(
        x["s"]["own"],
        lambda source, i: F.struct(
            source.alias("source"),
            (x["s"]["earlier"] + i + 1).alias("item_no"),
            x["s"]["criterion_type"].alias("criterion_type"),
            x["id"].alias("parent_statement_id"),
            x["s"]["source"].alias("parent_statement"),
            x["s"]["context"].alias("surrounding_context"),
        ),
    )
    return protocols.withColumn("found", _found()).withColumn("items", F.flatten(F.transform(named, own))).drop("found", "protocol_text")


def segment(protocols: DataFrame) -> DataFrame:
    """Source items of ``protocols`` (protocol_id, source_version, protocol_text, ...).

    One row per fragment: protocol_id, source_version, criterion_type, source, source_id, parent_statement_id,
    parent_statement, parent_source_index, fragment_no, item_no, surrounding_context. Statements are split at
    semicolons. All of a protocol's work stays in its row until the rows are exploded; nothing is shuffled.
    """
    one = protocols.select("protocol_id", "source_version", _found().alias("found")).select("protocol_id", "source_version", F.explode("found").alias("s"))
    statement = one.select(
        "protocol_id",
        "source_version",
        F.col("s.criterion_type").alias("criterion_type"),
        F.col("s.source").alias("parent_statement"),
        (F.col("s.place") + 1).alias("parent_source_index"),
        F.col("s.context").alias("surrounding_context"),
        F.col("s.earlier").alias("earlier"),
        F.col("s.own").alias("own"),
    )
    parent = _statement_id("criterion_type", "parent_source_index", "parent_statement")
    items = statement.withColumn("parent_statement_id", parent).select("*", F.posexplode("own").alias("fragment", "source"))
    return items.select(
        "protocol_id",
        "source_version",
        "criterion_type",
        "source",
        F.col("parent_statement_id").alias("source_id"),
        "parent_statement_id",
        "parent_statement",
        "parent_source_index",
        (F.col("fragment") + 1).alias("fragment_no"),
        (F.col("earlier") + F.col("fragment") + 1).alias("item_no"),
        "surrounding_context",
    )


def unsegmented(protocols: DataFrame, items: DataFrame) -> DataFrame:
    """Protocols of which no fragment came: terminal failures."""
    return protocols.join(items.select("protocol_id").distinct(), "protocol_id", "left_anti").select("protocol_id", F.lit("no criteria segmented").alias("error"))
