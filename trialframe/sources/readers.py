"""Landed files as tables: manifests, studies, protocol pages, jobs, libraries and review sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators.library import latest_snapshot, library_union, upgrade

_ENTRY = "struct<slot:int,cohort:string,trial_id:string,phase:string,title:string,enabled:boolean,status:string>"
STUDY_SCHEMA = (
    "protocolSection struct<identificationModule:struct<nctId:string>, statusModule:struct<lastUpdatePostDateStruct:struct<date:string>,"
    "studyFirstPostDateStruct:struct<date:string>>, eligibilityModule:struct<eligibilityCriteria:string>>"
)


_ITEM = "protocol_id:string,source_version:string,criterion_type:string,source:string,source_id:string,parent_statement_id:string,parent_statement:string,parent_source_index:int,fragment_no:int,item_no:int,surrounding_context:string"
_PROPOSED = "criterion_type:string,domain:string,entity:string,comparator:string,value:string,unit:string,negated:boolean,temporal:string,repetition:string,qualifier:string,logical_operator:string,lower_bound:double,lower_inclusive:boolean,upper_bound:double,upper_inclusive:boolean,extraction_confidence:double,source:string"
_CRITERION = (
    f"{_PROPOSED},criterion_id:string,row_id:string,parent_statement_id:string,parent_statement:string,parent_atom_count:int,atom_index:int,boolean_group_id:string,source_id:string,trial_id:string,protocol_id:string,"
    "source_version:string,source_uri:string,source_retrieved_at:string,protocol_hash:string,value_kind:string,interval:string,relations:array<string>,surrounding_context:string,human_review_status:string,"
    "validation_issues:array<struct<code:string,severity:string,field:string,message:string>>,export_ready:boolean,readiness_blockers:array<string>,reviewed_at:string"
)
#: The fields of a job's record.
JOB_SCHEMA = (
    "job_id string, trial_id string, input_mode string, status string, stage string, message string, progress int, created_at string, updated_at string, error string, "
    f"rows array<struct<{_CRITERION}>>, events array<struct<timestamp:string,stage:string,message:string>>, protocol_id string, source_version string, source_uri string, source_retrieved_at string, "
    f"protocol_hash string, protocol_text string, source_items array<struct<{_ITEM}>>, checkpoint_rows array<struct<{_PROPOSED}>>, completed_batches int"
)


def read_records(spark: SparkSession, path: str, schema: str, key: str, lines: bool = False) -> DataFrame:
    """JSON records under a declared schema: its columns, ``file``, ``fault`` and ``raw``.

    A file is one record or a list of them, or has one on each line. Nothing is inferred, so no file is read twice. A
    record that is broken, or a field of which has another type, has a fault and its text in ``raw``, and whatever
    fields could be read; so has one whose ``key`` is missing. Records of a list are judged one by one, and a list that
    is broken is one row. Nothing is left out but empty files: take the rows without a fault. Whether a record has a
    fault does not depend on which columns are asked for.
    """
    texts = spark.read.text(path, wholetext=not lines).select(C.strip("value").alias("text"), F.col("_metadata.file_path").alias("file")).filter("text <> ''")
    listed = F.when(F.col("text").startswith("["), F.from_json("text", "array<string>"))
    raw = texts.select("file", F.explode(F.coalesce(listed, F.array("text"))).alias("raw"))
    row = F.from_json("raw", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    read = raw.withColumn("row", row)
    broken = F.col("row").isNull() | F.col("row._corrupt_record").isNotNull() | ~F.col("raw").startswith("{")
    fault = F.when(broken, "unreadable").when(F.col(f"row.{key}").isNull(), F.lit(f"no {key}"))
    return read.select("row.*", "file", fault.alias("fault"), "raw").drop("_corrupt_record")


def record_faults(rows: DataFrame, key: str) -> DataFrame:
    """Of ``read_records`` what has a fault: (file, key, fault, raw)."""
    return rows.filter(F.col("fault").isNotNull()).select("file", F.col(key).alias("key"), "fault", "raw")


def manifest_entries(texts: DataFrame) -> DataFrame:
    """Entries (cohort_id, pos, slot, cohort, trial_id, phase, title, enabled, status) of manifest texts (value).

    A manifest is an object with ``trials`` or a bare array; an entry is an object or a bare id.
    """
    whole = C.strip("value")
    array = F.when(whole.startswith("["), whole).otherwise(F.get_json_object(whole, "$.trials"))
    cohort = F.when(~whole.startswith("["), F.get_json_object(whole, "$.cohort_id"))
    items = texts.select(cohort.alias("cohort_id"), F.posexplode(F.from_json(array, "array<string>")).alias("pos", "item"))
    entry = F.when(F.col("item").startswith("{"), F.from_json("item", _ENTRY[7:-1].replace(":", " ")))
    return items.withColumn("e", entry).select("cohort_id", "pos", "e.slot", "e.cohort", F.coalesce("e.trial_id", F.when(~F.col("item").startswith("{"), F.col("item"))).alias("trial_id"), "e.phase", "e.title", "e.enabled", "e.status")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return manifest_entries(spark.read.text(path, wholetext=True))


def study_rows(studies: DataFrame, *kept: str) -> DataFrame:
    """(trial_id, protocol_id, source_version, source_uri, protocol_text, protocol_hash, error) of study records, and the columns ``kept``."""
    ident = C.nct_id("protocolSection.identificationModule.nctId")
    status = "protocolSection.statusModule"
    text = C.blank_to_null("protocolSection.eligibilityModule.eligibilityCriteria")
    rows = studies.select(*kept, ident.alias("trial_id"), C.registry_version(f"{status}.lastUpdatePostDateStruct.date", f"{status}.studyFirstPostDateStruct.date").alias("source_version"), text.alias("protocol_text"))
    error = F.when(F.col("trial_id").isNull(), "bad registry id").when(F.col("protocol_text").isNull(), "no eligibility text")
    return rows.select("trial_id", F.col("trial_id").alias("protocol_id"), "source_version", F.concat(F.lit("https://clinicaltrials.gov/study/"), "trial_id").alias("source_uri"), "protocol_text", C.protocol_hash("protocol_text").alias("protocol_hash"), error.alias("error"), *kept)


def read_studies(spark: SparkSession, path: str) -> DataFrame:
    """``study_rows`` of landed study records, with their ``file``; one that cannot be read has an error and no fields."""
    rows = read_records(spark, path, STUDY_SCHEMA, "protocolSection")
    read = study_rows(rows, "file", "fault")
    return read.withColumn("error", F.coalesce(F.when(F.col("fault") == "unreadable", "unreadable record"), "error")).drop("fault")


def pasted_protocols(rows: DataFrame) -> DataFrame:
    """Protocols from (input_mode, trial_id, protocol_text, protocol_label): ids, versions and input errors."""
    ident = F.coalesce(C.blank_to_null(F.upper(F.col("trial_id"))), F.lit("MANUAL"))
    text = C.blank_to_null("protocol_text")
    mode = F.lower(F.coalesce("input_mode", F.lit("")))
    error = F.when(~mode.isin("manual", "nct", "pdf"), "unknown input mode").when((mode == "nct") & C.nct_id("trial_id").isNull(), "bad registry id").when((mode != "nct") & text.isNull(), "no protocol text")
    label = F.concat(ident, F.lit("-"), F.substring(F.sha2(text, 256), 1, 12))
    return rows.select(ident.alias("trial_id"), label.alias("protocol_id"), C.text_version(text).alias("source_version"), C.protocol_hash(text).alias("protocol_hash"), text.alias("protocol_text"), error.alias("error"))


#: Headings and furniture of protocol pages.
_NUMBERED_INCLUSION = r"(?im)^\s*\d+(?:\.\d+)+\s+Inclusion\s+criteria\s*$"
_KEY_INCLUSION = r"(?im)^\s*Key inclusion criteria\s*$"
_START = r"(?im)^\s*(?:\d+(?:\.\d+)+\s+)?(?:Key\s+)?Inclusion criteria\s*$"
_FURNITURE = r"(?i)Protocol Date:|^\s*Trial ID:|VV-TMF-|\|\s*of\s+Protocol\b|^\s*Page:?\s+\d+\s+of\s+\d+\s*$|^\s*(?:Confidential|(?:Status:\s*)?Final)\s*$"
_NUMBERED = r"^\s*\d+(?:\.\d+)+\s+\S"
PAGES = 8


def pages_to_eligibility(pages: DataFrame, count: int = PAGES) -> DataFrame:
    """(doc_id, protocol_text) from protocol pages (doc_id, page_no, text); null without a section.

    The section starts on the first page with a numbered heading, else with a key heading outside a table of
    contents, and covers ``count`` pages. Page furniture goes; the text ends at the first numbered heading after
    two of eligibility.
    """
    numbered, key = F.col("text").rlike(_NUMBERED_INCLUSION), F.col("text").rlike(_KEY_INCLUSION) & ~F.col("text").contains("......")
    starts = pages.groupBy("doc_id").agg(F.coalesce(F.min(F.when(numbered, F.col("page_no"))), F.min(F.when(key, F.col("page_no")))).alias("first"))
    near = pages.join(starts, "doc_id").filter(F.col("page_no").between(F.col("first"), F.col("first") + count - 1))
    # eight pages at most
    joined = near.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda p: p["text"]), "\n").alias("text"))
    start = F.regexp_instr("text", F.lit(_START))
    section = joined.withColumn("text", F.col("text").substr(F.greatest(start, F.lit(1)), F.length("text")))
    lines = F.filter(F.split("text", r"\r?\n"), lambda x: ~x.rlike(_FURNITURE))

    def step(state: Column, line: Column) -> Column:
        heading = line.rlike(_NUMBERED)
        eligible = heading & F.lower(line).rlike("inclusion criteria|exclusion criteria")
        done = state["done"] | (heading & ~eligible & (state["seen"] >= 2))
        kept = F.when(done, state["kept"]).otherwise(F.concat(state["kept"], F.array(line)))
        return F.struct(done.alias("done"), (state["seen"] + eligible.cast("int")).alias("seen"), kept.alias("kept"))

    begin = F.struct(F.lit(False).alias("done"), F.lit(0).alias("seen"), F.array().cast("array<string>").alias("kept"))
    found = section.select("doc_id", F.aggregate(lines, begin, step, lambda s: F.array_join(s["kept"], "\n")).alias("protocol_text"))
    return starts.select("doc_id").join(found, "doc_id", "left")


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Job records under their declared schema; those with a ``fault`` are there too, see ``read_records``."""
    return read_records(spark, path, JOB_SCHEMA, "job_id")


def job_children(jobs: DataFrame, name: str) -> DataFrame:
    """One row per element of a job's array (rows, source_items, checkpoint_rows or events), with job_id and ord."""
    return jobs.select("job_id", F.posexplode(name).alias("ord", "x")).select("job_id", "ord", "x.*")


def read_review_sheet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """The entries of one library file, a base library or a snapshot."""
    return spark.read.option("multiLine", True).json(path).select(F.explode("entries").alias("e")).select("e.*")


def read_whole_library(spark: SparkSession, folder: str, base: str) -> DataFrame:
    """The base library in the file ``base`` and the reviewed entries, in the present shape, with their origin."""
    return library_union(upgrade(read_entries(spark, base)), upgrade(read_library(spark, folder)))


def read_library(spark: SparkSession, folder: str) -> DataFrame:
    """The entries of the snapshot in ``folder`` that counts: current before legacy, then the last by name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).select("path").distinct()
    names = files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))
    chosen = names.join(latest_snapshot(names), "name").select("path").first()  # one name
    if chosen is None:
        return spark.createDataFrame([], "trial_id string, criterion_type string, entity string, source string")
    return read_entries(spark, chosen[0])
