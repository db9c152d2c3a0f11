"""Criteria are made in their protocols' rows, and not moved."""

import pytest
from pyspark.sql import functions as F

from trialframe.operators.normalize import criteria, normalize
from trialframe.operators.segment import segment
from trialframe.plans.queries import queries

SF = "/root/testdata/sf0.001"
PROTOCOL = "protocol_id string, trial_id string, source_version string, source_uri string, source_retrieved_at string, protocol_hash string, protocol_text string"
TEXTS = {
    "a": "Inclusion Criteria\n* Age >= 18 years; ALT < 40 U/L\n* Pregnant or nursing\n* At least 2 prior visits\nExclusion Criteria\n* Pregnant or nursing\n* ALT < 40 U/L",
    "b": "Inclusion Criteria\n* ALT < 40 U/L\n* ALT < 40 U/L\n* No history of stroke; no history of stroke",
    "c": "Inclusion Criteria:\n",
    "d": None,
    "e": "\n".join(f"line {i % 7} of many" for i in range(300)),
}


@pytest.mark.parametrize(("name", "most"), [("criteria_rows", 2), ("criteria_with_proposals", 4), ("criteria_by_trial", 3)])
def test_only_lines_protocols_and_proposals_are_moved(spark, name, most):
    """Before, items, what was parsed of them and what was validated were each moved with all their texts."""
    plan = queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert 0 < len(moved) <= most
    assert not any("surrounding_context" in line or "criterion_id" in line for line in moved + [x for x in plan.splitlines() if "Sort [" in x])


def test_criteria_are_those_of_the_items(spark):
    protocols = spark.createDataFrame([(k, f" T{k} ", "v1", None, "2024-01-01", "sha256:1", text) for k, text in TEXTS.items()], PROTOCOL)
    proposals = spark.createDataFrame(
        [("a", 1, " ALT < 40 U/L", "ALT", "<", "40", 0.4), ("a", 2, "ALT < 40 U/L", "alt", "<", "40", 0.9), ("a", 3, "invented", "x", None, None, 0.5), ("a", 4, "At least 2 prior visits", "visits", ">=", "2", 0.7), ("b", 1, "No history of stroke", "stroke", None, None, None), ("z", 1, "ALT < 40 U/L", "x", None, None, None)],
        "protocol_id string, ord int, source string, entity string, comparator string, value string, extraction_confidence double",
    )
    found, same = criteria(proposals, protocols), normalize(proposals, segment(protocols), protocols)
    assert found.columns == same.columns
    rows = sorted(map(repr, found.collect()))
    assert rows == sorted(map(repr, same.collect()))
    got = {}
    for r in found.collect():
        got.setdefault((r.protocol_id, r.source), []).append(r)
    assert {k for k, _ in got} == {"a", "b", "e"} and ("a", "invented") not in got
    # the better of two equal proposals, in the last item's statement and of its type, at the first one's place
    (alt,) = got["a", "ALT < 40 U/L"]
    assert (alt.trial_id, alt.extraction_confidence, alt.criterion_type, alt.parent_statement, alt.atom_index, alt.parent_atom_count) == ("Ta", 0.9, "exclusion", "ALT < 40 U/L", 1, 1)
    # a sentence under both headings has one of each type, joined as it says
    both = got["a", "Pregnant or nursing"]
    assert sorted((r.criterion_type, r.atom_index, r.parent_atom_count, r.logical_operator) for r in both) == [("exclusion", 2, 2, "or"), ("inclusion", 1, 2, "or")]
    # what a proposal states is not written once more
    assert [r.comparator for r in got["a", "At least 2 prior visits"]] == [">="]
    assert len(got["b", "ALT < 40 U/L"]) == 1 and len(got["e", "line 3 of many"]) == 1 and sum(len(x) for k, x in got.items() if k[0] == "e") == 7
    assert len({r.criterion_id for x in got.values() for r in x}) == sum(map(len, got.values()))


def test_odd_proposals_keep_their_order(spark):
    """Many proposals of one sentence: duplicates take the first one's place, and atoms are numbered without gaps."""
    protocols = spark.createDataFrame([("a", None, "v1", None, None, None, "one sentence")], PROTOCOL)
    proposals = spark.range(200).select(F.lit("a").alias("protocol_id"), (200 - F.col("id")).cast("int").alias("ord"), F.lit("one sentence").alias("source"), F.concat(F.lit("E"), (F.col("id") % 50).cast("string")).alias("entity"), ((F.col("id") % 7) / 10).alias("extraction_confidence"))
    rows = sorted(criteria(proposals, protocols).collect(), key=lambda r: r.atom_index)
    assert [r.atom_index for r in rows] == list(range(1, 51)) and {r.parent_atom_count for r in rows} == {50} and {r.trial_id for r in rows} == {"a"}
    # ord 1 is id 199 with E49
    assert [r.entity.upper() for r in rows] == [f"E{i}" for i in range(49, -1, -1)]
    assert all(r.extraction_confidence == max((i % 7) / 10 for i in range(200) if f"E{i % 50}" == r.entity.upper()) for r in rows)
