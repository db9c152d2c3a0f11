"""Statements to structured criteria."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import language as L
from ..functions import patterns as P
from ..functions.literals import memo, parse_criterion, written_constraints
from ..functions.terms import Terminology
from ..functions.texts import by_text, by_texts

_PARSED = "struct<entity:string, comparator:string, value:string, unit:string, value_kind:string, lower_bound:double, lower_inclusive:boolean, upper_bound:double, upper_inclusive:boolean, negated:boolean, domain:string, temporal:string, repetition:string>"
_FIELDS = ("source", "entity", "comparator", "value", "unit", "lower_bound", "lower_inclusive", "upper_bound", "upper_inclusive")
_TYPES = {"lower_bound": "double", "upper_bound": "double", "lower_inclusive": "boolean", "upper_inclusive": "boolean"}
_WRITTEN = "array<struct<comparator:string, value:string, unit:string, entity:string, logical_operator:string>>"
_KINDS = {"string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}


def _struct(ddl: str) -> pa.DataType:
    return pa.struct([(name, _KINDS[kind]) for name, kind in (x.split(":") for x in ddl[ddl.index("struct<") + 7 :].rstrip(">").split(", "))])


def _parser(words: Terminology) -> Callable[[], Callable[..., dict[str, Any]]]:
    """Makes a function that parses a statement with its proposal, gives the entity its canonical name, and reads the rest of the text."""

    def make() -> Callable[..., dict[str, Any]]:
        name, domain = memo(words.canonical), L.domains(words.domains)

        def parse(source: str | None, *given: Any) -> dict[str, Any]:
            found = parse_criterion(source, *given)
            entity, text = name(found["entity"]), L.plain_spelling(source)
            return found | {"entity": entity, "domain": domain(entity, (source or "").strip(), found["compared"]), "temporal": L.temporal(text), "repetition": L.repetition(text)}

        return parse

    return make


def _constraints() -> Callable[[str | None], list[dict[str, Any]]]:
    return written_constraints


def constraints(source: Column | str) -> Column:
    """The comparisons that a text writes out in words, as an array of structs; texts that repeat are read once."""
    return by_text("written_constraints", _constraints, pa.list_(_struct(_WRITTEN)), _WRITTEN, C.col(source), apart=True)


def constraints_of_all(sources: Column) -> Column:
    """``constraints`` of each text of an array."""
    return by_texts("written_constraints", _constraints, pa.list_(_struct(_WRITTEN)), _WRITTEN, F.transform(sources, lambda x: F.struct(x.alias("c0"))))


def _given(of: Callable[[str], Column]) -> list[Column]:
    """What a statement's parser reads."""
    return [of(c).cast(_TYPES.get(c, "string")) for c in _FIELDS]


def _criterion(of: Callable[[str], Column], found: Column) -> dict[str, Column]:
    """The columns of a criterion but those that follow from them: of what was proposed, and of what its text was ``found`` to say."""
    domain = F.lower(C.strip(of("domain")))
    logic = F.lower(of("logical_operator"))
    return {
        "criterion_type": F.lower(F.coalesce(of("criterion_type"), F.lit("inclusion"))),
        "domain": F.when(domain.isin(*P.DOMAINS), domain).otherwise(found["domain"]),
        **{c: found[c] for c in ("entity", "comparator", "value", "unit", "value_kind", "lower_bound", "lower_inclusive", "upper_bound", "upper_inclusive", "negated")},
        "temporal": F.coalesce(C.blank_to_null(of("temporal")), found["temporal"]),
        "repetition": F.coalesce(C.blank_to_null(of("repetition")), found["repetition"]),
        "qualifier": C.blank_to_null(of("qualifier")),
        "logical_operator": F.when(logic.isin(*P.LOGIC), logic).otherwise("standalone"),
        "source": C.strip(F.coalesce(of("source"), F.lit(""))),
    }


def parse_all(words: Terminology, rows: Column) -> Column:
    """What the texts of an array of structs say, which have the columns that ``parse`` reads."""
    given = F.transform(rows, lambda r: F.struct(*[c.alias(f"c{i}") for i, c in enumerate(_given(lambda c: r[c]))]))
    return by_texts(f"parse {words.digest}", _parser(words), _struct(_PARSED), _PARSED, given)


def criterion(row: Column, found: Column) -> dict[str, Column]:
    """The columns that ``parse`` gives, but interval and relations, of a struct with those that it reads and of what its text says."""
    return _criterion(lambda c: row[c], found)


def parse(rows: DataFrame, terminology: Terminology | None = None) -> DataFrame:
    """``rows`` with the semantic columns of a criterion, parsed from ``source``.

    Proposed columns (entity, domain, comparator, value, unit, bounds, temporal, repetition, qualifier,
    logical_operator, criterion_type) fill what the text does not spell out; those that are absent are null. Other
    columns pass through. Nothing is shuffled, and a statement that repeats with its proposal is read once by a worker.
    """
    words = terminology or Terminology.of_session(rows.sparkSession)
    proposed = ("criterion_type", "domain", "temporal", "repetition", "qualifier", "logical_operator", *_FIELDS)
    for name in proposed:
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(_TYPES.get(name, "string")))
    kept = [c for c in rows.columns if c not in {*proposed, "negated", "value_kind", "interval", "relations"}]
    found = rows.select(*kept, *[F.col(c).alias(f"given_{c}") for c in proposed], by_text(f"parse {words.digest}", _parser(words), _struct(_PARSED), _PARSED, *_given(F.col)).alias("p"))
    out = found.select(*kept, *[x.alias(c) for c, x in _criterion(lambda c: F.col(f"given_{c}"), F.col("p")).items()])
    return out.withColumn("interval", C.interval_notation("lower_bound", "lower_inclusive", "upper_bound", "upper_inclusive")).withColumn("relations", C.criterion_relations())
