"""Eligibility data rendered from the driver's tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One statement per line item. ``ord`` is its place in its trial, inclusion first; ``kind`` its template.
LINES = """
select *, case kind
    when 0 then lab || ' >= ' || q || ' mg/dL'
    when 1 then lab || ' ' || q || ' to ' || (q + 10) || ' mmol/L'
    when 2 then lab || ' < ' || q || ' % within ' || d || ' days'
    when 3 then 'No history of ' || lab || ' on two occasions'
    when 4 then lab || ' more than ' || q || ' weeks'
    else lab || ' > ' || q || ' mg/dL; ' || lab || ' <= ' || (q + 100) || ' mg/dL' end as statement
from (
  select l_orderkey as order_key, 'NCT' || lpad(cast(l_orderkey as string), 8, '0') as trial_id,
         l_partkey as part_key, l_linenumber as line_no, cast(l_partkey % 6 as int) as kind,
         'lab' || cast(l_partkey % 37 as string) as lab, cast(l_quantity as int) as q, l_linenumber * 7 as d,
         case when l_returnflag = 'R' then 'exclusion' else 'inclusion' end as criterion_type,
         l_linestatus as line_status, l_tax as tax,
         cast(row_number() over (partition by l_orderkey order by case when l_returnflag = 'R' then 1 else 0 end,
           l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus, l_shipdate) as int) as ord
  from {lineitem}) x
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LINES, lineitem=table(spark, sf_dir, "lineitem"))


def lines_sql(sql: str) -> str:
    """An oracle's SQL over ``lines``."""
    return f"with lines as ({LINES.replace('{lineitem}', 'lineitem')})\n{sql}"


def protocols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One protocol per order: headings and bullets."""
    bullet = F.struct("ord", "criterion_type", F.concat(F.lit("* "), "statement").alias("bullet"))
    listed = lines(spark, sf_dir).groupBy("trial_id").agg(F.array_sort(F.collect_list(bullet)).alias("all"))
    part = lambda kind, title: F.when(F.exists("all", lambda x: x["criterion_type"] == kind), F.concat(F.lit(f"{title} Criteria:\n"), F.array_join(F.transform(F.filter("all", lambda x: x["criterion_type"] == kind), lambda x: x["bullet"]), "\n")))
    text = F.concat_ws("\n", part("inclusion", "Inclusion"), part("exclusion", "Exclusion"))
    return listed.select("trial_id", F.col("trial_id").alias("protocol_id"), F.lit("v1").alias("source_version"), F.lit(None).cast("string").alias("source_uri"), F.lit("2024-01-01T00:00:00Z").alias("source_retrieved_at"), text.alias("protocol_text")).withColumn("protocol_hash", F.concat(F.lit("sha256:"), F.sha2("protocol_text", 256)))


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed atoms as they come before duplicates are dropped, three statements' worth to a parent."""
    rows = lines(spark, sf_dir)
    return rows.select(
        F.col("trial_id").alias("protocol_id"),
        F.concat(F.lit("p"), F.col("line_no") % 3).alias("parent_statement_id"),
        "criterion_type",
        F.lit("measurement").alias("domain"),
        F.upper("lab").alias("entity"),
        F.lit(">=").alias("comparator"),
        (F.col("q") % 5).cast("string").alias("value"),
        F.lit("mg/dL").alias("unit"),
        (F.col("q") % 5).cast("double").alias("lower_bound"),
        F.lit(True).alias("lower_inclusive"),
        F.lit(None).cast("double").alias("upper_bound"),
        F.lit(None).cast("boolean").alias("upper_inclusive"),
        F.lit(False).alias("negated"),
        *[F.lit(None).cast("string").alias(c) for c in ("temporal", "repetition", "qualifier")],
        F.lit("standalone").alias("logical_operator"),
        F.col("statement").alias("source"),
        F.lit("x").alias("interval"),
        F.round(1 - F.col("tax"), 2).alias("extraction_confidence"),
        F.lit(0).alias("phase"),
        F.lit(0).alias("item_no"),
        F.col("ord").cast("long").alias("seq"),
    )


#: Criteria of all statements, with what validation is to find: fields are lost or wrong by part key and quantity.
CHECKED = """
select trial_id, ord, kind, part_key, q, d, lab, line_status, statement,
  case when kind = 4 and q % 8 = 1 then 'other' else criterion_type end as criterion_type,
  case when part_key % 11 <> 0 then upper(lab) end as entity,
  case when kind = 0 and part_key % 7 <> 0 then '>=' when kind = 2 and part_key % 7 <> 0 then '<' when kind = 4 then '>=' when kind = 5 then '>' end as comparator,
  case kind when 3 then case when q % 8 = 2 then 'present' else 'absent' end when 4 then case when q % 8 <> 3 then cast(q as string) end when 1 then q || ' to ' || (q + 10) else cast(q as string) end as value,
  case when part_key % 5 <> 0 then case when kind in (0, 5) then 'mg/dL' when kind = 1 then 'mmol/L' when kind = 2 then '%' when kind = 4 then 'weeks' end end as unit,
  cast(case when kind = 0 and part_key % 7 <> 0 then q when kind = 1 then case q % 8 when 4 then null when 6 then q + 10 else q end when kind in (4, 5) then q end as double) as lower_bound,
  case when kind = 0 and part_key % 7 <> 0 or kind in (1, 4) then true when kind = 5 then false end as lower_inclusive,
  cast(case when kind = 2 and part_key % 7 <> 0 then q when kind = 1 then case q % 8 when 5 then null when 6 then q else q + 10 end when kind = 5 then q + 100 end as double) as upper_bound,
  case when kind = 2 and part_key % 7 <> 0 then false when kind in (1, 5) then true end as upper_inclusive,
  kind = 3 and part_key % 17 <> 0 or kind = 0 and part_key % 23 = 0 as negated,
  case kind when 2 then case when q % 8 <> 7 then 'within ' || d || ' days' end when 3 then 'history of' when 4 then 'more than ' || q || ' weeks' end as temporal,
  case when kind = 3 and part_key % 19 <> 0 then 'on two occasions' end as repetition,
  case when kind = 5 and part_key % 7 = 0 then 'and' else 'standalone' end as logical_operator,
  case when kind <> 5 or q % 8 <> 0 then statement end as source,
  case when kind = 4 and part_key % 5 = 0 or kind = 5 and part_key % 7 = 0 then 2 else 1 end as parent_atom_count,
  case when line_status = 'F' then 'accepted' else 'pending' end as human_review_status,
  case when part_key % 13 <> 0 then 'sha256:0' end as protocol_hash,
  round(1 - tax, 2) as extraction_confidence
from {lines}
"""


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(CHECKED, lines=lines(spark, sf_dir))
    return rows.withColumns({"criterion_id": F.concat("trial_id", F.lit("-"), "ord"), "protocol_id": F.col("trial_id"), "source_version": F.lit("v1"), "source_retrieved_at": F.lit("2024-01-01T00:00:00Z"), "qualifier": F.lit(None).cast("string")})


#: The codes that these criteria have, with e: for errors and w: for warnings.
CHECKED_SQL = f"""
, checked as ({CHECKED.replace("{lines}", "lines")}),
found as (
  select *, list_filter([
           case when part_key % 11 = 0 then 'e:ENTITY_MISSING' end,
           case when kind = 5 and q % 8 = 0 then 'e:SOURCE_MISSING' end,
           case when kind = 4 and q % 8 = 1 then 'e:CRITERION_TYPE_INVALID' end,
           case when kind = 4 and q % 8 = 3 then 'e:COMPARATOR_WITHOUT_VALUE' end,
           case when kind in (0, 2) and part_key % 7 = 0 then 'e:COMPARISON_NOT_STRUCTURED' end,
           case when kind = 1 and q % 8 = 6 then 'e:INTERVAL_REVERSED' end,
           case when kind = 1 and q % 8 = 4 then 'e:LOWER_INCLUSIVITY_WITHOUT_BOUND' end,
           case when kind = 1 and q % 8 = 5 then 'e:UPPER_INCLUSIVITY_WITHOUT_BOUND' end,
           case when kind = 3 and part_key % 17 = 0 then 'w:NEGATION_UNCAPTURED' end,
           case when kind = 3 and part_key % 17 <> 0 and q % 8 = 2 or kind = 0 and part_key % 23 = 0 and part_key % 7 = 0 then 'e:NEGATION_VALUE_CONFLICT' when kind = 0 and part_key % 23 = 0 then 'w:NEGATION_VALUE_CONFLICT' end,
           case when part_key % 5 = 0 and (kind = 0 and part_key % 7 <> 0 or kind = 5 and q % 8 <> 0) then 'e:UNIT_UNCAPTURED' end,
           case when kind = 2 and q % 8 = 7 then 'e:TEMPORAL_UNCAPTURED' end,
           case when kind = 3 and part_key % 19 = 0 then 'e:REPETITION_UNCAPTURED' end,
           case when kind = 4 and part_key % 5 = 0 then 'e:COMPOUND_SCOPE_MISSING' end,
           case when kind = 5 and q % 8 <> 0 and part_key % 7 <> 0 then 'w:POSSIBLE_UNSPLIT_COMPOUND' end], lambda x: x is not null) as marked
  from checked),
judged as (
  select *, extraction_confidence as conf, list_transform(marked, lambda x: substr(x, 3)) as codes, list_transform(list_filter(marked, lambda x: x[1] = 'e'), lambda x: substr(x, 3)) as errors, list_filter(marked, lambda x: x[1] = 'w') as warnings,
         list_concat(list_transform(list_filter(marked, lambda x: x[1] = 'e'), lambda x: substr(x, 3)), list_filter([
           case when line_status <> 'F' then 'HUMAN_REVIEW_REQUIRED' end,
           case when part_key % 13 = 0 then 'PROVENANCE_INCOMPLETE' end], lambda x: x is not null)) as blockers
  from found)
"""
