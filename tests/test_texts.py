"""Functions of texts that repeat."""

import pyarrow as pa
import pyspark.sql.functions as F
import pytest

from trialframe.functions import columns as C
from trialframe.functions import language as L
from trialframe.functions import texts
from trialframe.functions.terms import DOMAIN_ALIASES
from trialframe.operators.parse import parse

SAYINGS = (
    "No history of stroke on two occasions", "Within the past 3 months before screening; over 2 years", "previous cancer, during treatment", "ANC \\>/= 1,500 at least 3 weeks", ">= grade 2 pain within 5 days",
    "prior  therapy", "Surgery or dialysis", "Not due to BMI", "HbA1c level < 7 %", "A vital sign ≥ 3", "", "   ", "Ärzte ohne Grenzen: never", "twice, three times", "more than 4 weeks",
)


def test_rows_that_repeat_are_read_once():
    calls = []
    read = texts.Remembered(lambda a, b: calls.append((a, b)) or {"x": f"{a}{b}"}, pa.struct([("x", pa.string())]))
    columns = [pa.array(["a", None, "a", "a", None]), pa.array([1.0, 2.0, 1.0, None, 2.0])]
    for _ in range(2):
        assert [r["x"] for r in read(columns).to_pylist()] == ["a1.0", "None2.0", "a1.0", "aNone", "None2.0"]
    assert len(calls) == 3
    assert read([pa.array([], pa.string()), pa.array([], pa.float64())]).to_pylist() == []


def test_what_is_remembered_is_bounded(monkeypatch):
    monkeypatch.setattr(texts, "MOST_ROWS", 10)
    read = texts.Remembered(lambda a: a, pa.string())
    for start in range(0, 100, 5):
        given = [f"t{x}" for x in range(start, start + 5)] * 2
        assert read([pa.array(given)]).to_pylist() == given
        assert len(read.places) <= 15 and len(read.values) == len(read.places)


def test_a_worker_parses_a_repeated_statement_once(spark):
    """9,000 rows of three statements: the workers' calls are counted."""
    from trialframe.operators import parse as module

    calls = spark.sparkContext.accumulator(0)
    plain = module._parser

    def counting(words):
        def make():
            read = plain(words)()
            return lambda *given: calls.add(1) or read(*given)

        return make

    module._parser = counting
    try:
        rows = spark.range(9000).select("id", F.concat(F.lit("counted once: Age >= "), (F.col("id") % 3 + 18).cast("string"), F.lit(" years")).alias("source")).repartition(4)
        found = parse(rows).groupBy("lower_bound").count().collect()
    finally:
        module._parser = plain
    assert {(r[0], r[1]) for r in found} == {(18.0, 3000), (19.0, 3000), (20.0, 3000)}
    assert calls.value <= 3 * 4


@pytest.mark.parametrize("aliases", [DOMAIN_ALIASES, {}])
def test_language_is_the_same_in_both(spark, aliases):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(SAYINGS)], "i int, source string")
    raw = C.strip("source")
    text = C.grade_last(C.operators(raw))
    said = [C.says("source", pattern).alias(name) for name, pattern in L.SAID.items()]
    found = rows.select(C.temporal(text).alias("t"), C.repetition(text).alias("r"), C.infer_domain(F.lit("x"), raw, F.col("i") % 2 == 0, aliases).alias("d"), F.struct(*said).alias("s")).orderBy("i").collect()
    domain = L.domains(aliases)
    for i, (x, row) in enumerate(zip(SAYINGS, found, strict=True)):
        spelled = L.plain_spelling(x)
        assert (L.temporal(spelled), L.repetition(spelled), domain("x", x.strip(), i % 2 == 0), L.said(x)) == (row["t"], row["r"], row["d"], row["s"].asDict()), x


def test_long_documents_are_segmented_in_pieces(monkeypatch):
    """A batch's texts are not made into statements all at once, and a row does not carry its whole document."""
    from trialframe.operators import segment as module

    monkeypatch.setattr(module, "_CHARS", 100)
    texts = ["\n".join(f"line {i} of {n}; more" for i in range(n)) for n in (40, 0, 3, 1)] + [None]
    found = list(module._all_statements(iter([pa.array(texts, pa.string())])))
    assert len(found) > 1
    rows = [row for part in found for row in part.to_pylist()]
    assert [len(row) for row in rows] == [40, 0, 3, 1, 0]
    assert rows[2][1] == {"criterion_type": "inclusion", "source": "line 1 of 3; more", "place": 1, "context": "\n".join(f"line {i} of 3; more" for i in range(3)), "earlier": 2, "own": ["line 1 of 3", "more"]}


def test_reconciling_moves_what_it_reads(spark):
    """Neither parents nor fields that no proposal has are grouped."""
    from trialframe.operators.normalize import reconcile
    from trialframe.operators.segment import segment

    items = segment(spark.createDataFrame([("a", "v1", "Age >= 18; BMI < 30\nNo stroke")], "protocol_id string, source_version string, protocol_text string"))
    proposals = spark.createDataFrame([("a", 1, " BMI < 30", "BMI"), ("a", 2, "invented", "x")], "protocol_id string, ord int, source string, entity string")
    found = reconcile(proposals, items)
    assert sorted((r["source"], r["phase"], r["entity"]) for r in found.collect()) == [("Age >= 18", 1, None), ("BMI < 30", 0, "BMI"), ("No stroke", 1, None)]
    grouped = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "collect_list" in line]
    assert grouped
    united = found._jdf.queryExecution().optimizedPlan().toString().split("Union")[-1]
    assert "surrounding_context" not in united.split("Generate")[0] and "upper_inclusive" not in united


def test_text_is_stripped_of_all_white_space(spark):
    """As before, and plain text without a search for 29 kinds of space."""
    from trialframe.functions import patterns as P

    given = ["", " ", "a", " a", "a ", "\u00a0a b\u2003", "é", "é ", "~!", "\x1f!", "a\u3000", "\x7f", "a\n", None, *(f"{x}y{x}" for x in P.SPACE)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, x string").select("i", C.strip("x").alias("x")).orderBy("i")
    assert [r["x"] for r in rows.collect()] == [x if x is None else x.strip() for x in given]
    assert "CASE WHEN" in rows._jdf.queryExecution().analyzed().toString()
