"""A model's answers to proposals: read under a declared schema, split into accepted and rejected rows.

An answer is the text that a model gave for one batch of source items. It should hold one JSON object with a list
``rows``; the object may stand in a code fence or among other words. Nothing is read by inference: fields have declared
types, and what breaks them is kept as it came, with the reason, instead of becoming a null or failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import model_json
from ..functions.terms import Terminology
from .normalize import normalize
from .validate import proposal_violations

#: The fields of a proposed row; each has to be there, and no other may be.
PROPOSAL_FIELDS = {
    "criterion_type": "string",
    "domain": "string",
    "entity": "string",
    "comparator": "string",
    "value": "string",
    "unit": "string",
    "negated": "boolean",
    "temporal": "string",
    "repetition": "string",
    "qualifier": "string",
    "logical_operator": "string",
    "lower_bound": "double",
    "lower_inclusive": "boolean",
    "upper_bound": "double",
    "upper_inclusive": "boolean",
    "extraction_confidence": "double",
    "source": "string",
}
_ROW = ", ".join(f"{name} {kind}" for name, kind in PROPOSAL_FIELDS.items()) + ", _corrupt_record string"
_WHOLE = "rows array<string>, _corrupt_record string"
_CORRUPT = {"columnNameOfCorruptRecord": "_corrupt_record", "mode": "PERMISSIVE"}
#: Fields whose JSON numbers and flags would pass as text.
_TEXT_ONLY = [name for name, kind in PROPOSAL_FIELDS.items() if kind == "string" and name != "value"]


def answer_faults() -> Column:
    """What is wrong with a whole answer, from its columns ``answer``, ``object``, ``object_keys`` and ``whole``; null if it can be read."""
    keys = F.col("object_keys")
    return (
        F.when(F.col("answer").isNull(), "no answer")
        .when(F.col("object").isNull(), "no JSON object")
        .when(F.try_parse_json("object").isNull() | keys.isNull(), "broken JSON")
        .when(~F.array_contains(keys, "rows"), "no rows")
        .when(F.size(F.array_except(keys, F.array(F.lit("rows")))) > 0, "unknown fields")
        .when(F.col("whole._corrupt_record").isNotNull() | F.col("whole.rows").isNull(), "rows are no list")
    )


def _with_row_faults(rows: DataFrame) -> DataFrame:
    """``rows`` with ``faults``: why a proposed row breaks its contract, by its shape, then its types, then its values.

    What is read of ``raw`` becomes columns first: each rule that named such a reading itself would read the text again.
    """
    declared = F.array(*map(F.lit, PROPOSAL_FIELDS))
    named = lambda what, names: F.transform(names, lambda x: F.concat(F.lit(f"{what}: "), x))
    is_text = lambda name: F.schema_of_variant(F.try_variant_get("variant", f"$.{name}", "variant")).isin("STRING", "VOID")
    # types are told of rows that have all declared fields
    not_text = F.array_compact(F.array(*[F.when(~F.coalesce(is_text(name), F.lit(True)), F.lit(name)) for name in _TEXT_ONLY]))
    unread = F.col("fault").isNotNull()
    rows = rows.withColumns({"keys": F.when(~unread, F.json_object_keys("raw")), "variant": F.when(~unread, F.try_parse_json("raw")), "values": proposal_violations()})
    rows = rows.withColumns({"missing": F.array_except(declared, "keys"), "unknown": F.array_except("keys", declared)})
    rows = rows.withColumn("shape", F.concat(named("missing", F.col("missing")), named("unknown", F.col("unknown"))))
    rows = rows.withColumn("typed", F.when(F.size("shape") == 0, F.when(F.col("row._corrupt_record").isNotNull(), F.array(F.lit("wrong types"))).otherwise(named("wrong type", not_text))))
    faults = (
        F.when(unread, F.array("fault"))
        .when(F.col("raw").isNull() | ~F.coalesce(F.col("raw").startswith("{"), F.lit(False)), F.array(F.lit("no object")))
        .when(F.col("keys").isNull(), F.array(F.lit("broken JSON")))
        .when(F.size("shape") > 0, F.col("shape"))
        .when(F.size("typed") > 0, F.col("typed"))
        .otherwise(named("against the contract", F.col("values")))
    )
    return rows.withColumn("faults", faults)


def read_answers(answers: DataFrame) -> DataFrame:
    """Every proposed row of ``answers`` (protocol_id, batch, answer), and every answer that cannot be read.

    (protocol_id, batch, place, ord, raw, faults, and the fields of a proposal). ``place`` counts an answer's rows from
    0 and is null for a whole answer that cannot be read, whose text is then in ``raw``. ``ord`` follows (batch, place).
    ``faults`` says what is wrong; rows without faults keep the contract. Where a batch was answered several times,
    by ``attempt`` if there is such a column, the first answer that can be read counts, and else each is returned.

    Null answers, empty texts and lists without rows are read as such: an empty list is a good answer that proposes
    nothing, and gives no row. Nothing is shuffled, but for the choice among attempts.
    """
    text = F.col("answer").cast("string")
    read = answers.withColumn("answer", text).withColumn("object", model_json("answer"))
    read = read.withColumns({"whole": F.from_json("object", _WHOLE, _CORRUPT), "object_keys": F.json_object_keys("object")}).withColumn("fault", answer_faults())
    if "attempt" in answers.columns:
        best = Window.partitionBy("protocol_id", "batch")
        read = read.withColumns({"good": F.min(F.when(F.col("fault").isNull(), F.col("attempt"))).over(best)}).filter("good is null or attempt = good")
    whole = F.array(F.struct(F.lit(None).cast("int").alias("pos"), F.col("answer").alias("col")))
    listed = F.transform("whole.rows", lambda x, at: F.struct(at.alias("pos"), x.alias("col")))
    rows = read.select("protocol_id", "batch", "fault", F.explode(F.when(F.col("fault").isNotNull(), whole).otherwise(listed)).alias("x"))
    rows = rows.select("protocol_id", "batch", "fault", F.col("x.pos").alias("place"), F.col("x.col").alias("raw"))
    rows = rows.withColumn("row", F.when(F.col("fault").isNull(), F.from_json("raw", _ROW, _CORRUPT)))
    rows = rows.select("protocol_id", "batch", "place", "raw", "fault", "row", *[F.col(f"row.{name}").alias(name) for name in PROPOSAL_FIELDS])
    order = F.shiftleft(F.col("batch").cast("long"), 32) + F.col("place")
    return _with_row_faults(rows).select("protocol_id", "batch", "place", order.alias("ord"), "raw", "faults", *PROPOSAL_FIELDS)


def accepted(rows: DataFrame) -> DataFrame:
    """Of ``read_answers`` the proposals that keep the contract, as ``normalize`` takes them."""
    return rows.filter(F.size("faults") == 0).drop("raw", "faults", "place", "batch")


def rejected(rows: DataFrame) -> DataFrame:
    """Of ``read_answers`` what is not taken: (protocol_id, batch, place, faults, raw)."""
    return rows.filter(F.size("faults") > 0).select("protocol_id", "batch", "place", "faults", "raw")


def criteria_of_answers(answers: DataFrame, items: DataFrame, protocols: DataFrame, terminology: Terminology | None = None) -> DataFrame:
    """Criteria of ``protocols`` from what a model answered about their ``items``.

    Items of answers that cannot be read, and of rejected rows, are not lost: literal parsing makes criteria of them.
    """
    return normalize(accepted(read_answers(answers)), items, protocols, terminology)
