"""The registered queries in DuckDB's SQL; texts are not parsed here, the numbers they were made of are read."""

from __future__ import annotations

from ..functions.patterns import SPACE as _SPACE
from .tables import CHECKED_SQL, lines_sql

_ENTRIES = """
with entries as (
  select o_orderkey as pos, o_orderpriority as cohort, o_orderkey % 20 = 0 as blank,
         case when o_orderkey % 20 <> 0 then 'NCT' || lpad((o_orderkey % 9000)::varchar, 8, '0') end as trial_id from orders)
"""
_USAGE = """
with usage as (
  select conv_id as run_id, turn as seq, role as model, length(text) as i, 2 * length(text) as o,
         case role when 'user' then 0.15 when 'assistant' then 2.5 else 0 end as pi, case role when 'user' then 0.6 when 'assistant' then 10 else 0 end as po
  from conversations),
priced as (select *, i * pi::double / 1e6 + o * po::double / 1e6 as cost from usage)
"""
_ATOMS = """
, a as (
  select trial_id as protocol_id, 'p' || (line_no % 3) as parent_statement_id, criterion_type, upper(lab) as entity, (q % 5)::varchar as value,
         round(1 - tax, 2) as conf, ord from lines),
ranked as (
  select *, row_number() over (partition by protocol_id, parent_statement_id, criterion_type, entity, value order by conf desc, ord) as n,
         min(ord) over (partition by protocol_id, parent_statement_id, criterion_type, entity, value) as first_seq from a)
"""
_FRAGMENTS = """
, f as (
  select trial_id, criterion_type, ord, 1 as fragment_no, case when kind = 5 then lab || ' > ' || q || ' mg/dL' else statement end as source, statement, kind from lines
  union all
  select trial_id, criterion_type, ord, 2, lab || ' <= ' || (q + 100) || ' mg/dL', statement, kind from lines where kind = 5)
"""


def _stable(prefix: str, *parts: str) -> str:
    texts = " || chr(31) || ".join(f"coalesce(case when {p}::varchar = '0' then '' else trim({p}::varchar) end, '')" for p in parts)
    return f"'{prefix}-' || substr(sha256({texts}), 1, 16)"


_REVIEW = """
, r as (
  select order_key as job_id, kind, part_key from lines),
reasons as (
  select job_id, 'JOB_NOT_COMPLETED' as reason from r where job_id % 53 = 0
  union select job_id, 'NOT_REVIEWED' from r where part_key % 41 = 0
  union select job_id, 'DOMAIN' from r where part_key % 43 = 0
  union select job_id, 'NOT_READY' from r where part_key % 41 = 0 or part_key % 47 = 0 and kind in (0, 5))
"""


def _retries(trial: str) -> str:
    return f"""
with g as (select {trial} as trial_id, count(*) filter (where event_type = 'error') as failures, bool_or(event_type = 'error' and event_id % 23 = 0) as terminal from events group by 1)
select trial_id, failures, case when failures = 0 then 'done' when terminal or failures > 2 then 'stop' else 'retry' end as next_action from g"""


def oracle_sql() -> dict[str, str]:
    return {
        "parse_thresholds": lines_sql("""
, p as (select *, case kind when 0 then '>=' when 2 then '<' when 5 then '>' end as sign from lines)
select trial_id, ord, case kind when 3 then lab || ' on two occasions' when 4 then statement else upper(lab) end as entity, sign as comparator, case kind when 1 then q || ' to ' || (q + 10) when 3 then 'absent' when 4 then 'present' else q::varchar end as value,
  case when kind in (0, 5) then 'mg/dL' when kind = 1 then 'mmol/L' when kind = 2 then '%' end as unit, case when kind = 1 then 'interval' when kind in (3, 4) then 'categorical' else 'numerical' end as value_kind,
  case when kind in (0, 1, 5) then q::double end as lower_bound, case when kind in (0, 1) then true when kind = 5 then false end as lower_inclusive, case kind when 1 then (q + 10)::double when 2 then q::double end as upper_bound,
  case kind when 1 then true when 2 then false end as upper_inclusive, case kind when 0 then '[' || q || ', +inf)' when 1 then '[' || q || ', ' || (q + 10) || ']' when 2 then '(-inf, ' || q || ')' when 5 then '(' || q || ', +inf)' end as interval,
  kind = 3 as negated, case kind when 2 then 'within ' || d || ' days' when 3 then 'history of' when 4 then 'more than ' || q || ' weeks' end as temporal from p"""),
        "parse_ranges": lines_sql("""
select trial_id, ord, upper(lab) as entity, case kind when 0 then '>=' when 2 then '<' when 4 then '<=' when 5 then '<=' end as comparator,
  case kind when 1 then q || ' to ' || (q + 10) when 3 then 'absent' when 4 then (q + 100)::varchar when 5 then (q + 100)::varchar else q::varchar end as value,
  case when kind in (0, 5) then 'mg/dL' when kind = 1 then 'mmol/L' when kind = 2 then '%' when kind = 4 then 'weeks' end as unit, case when kind in (1, 4) then 'interval' when kind = 3 then 'categorical' else 'numerical' end as value_kind,
  case kind when 0 then '[' || q || ', +inf)' when 1 then '[' || q || ', ' || (q + 10) || ']' when 2 then '(-inf, ' || q || ')' when 3 then '(' || (q + 1) || ', +inf)' when 4 then '(' || (q + 1) || ', ' || (q + 100) || ']' else '(-inf, ' || (q + 100) || ']' end as interval
from lines"""),
        "parse_negations": lines_sql("""
select trial_id, ord, kind = 3 as negated, case kind when 2 then 'within ' || d || ' days' when 3 then 'history of' when 4 then 'more than ' || q || ' weeks' end as temporal, case when kind = 3 then 'on two occasions' end as repetition,
  case when kind in (0, 2, 5) then 'measurement' when kind = 3 then 'condition' else 'observation' end as domain,
  case kind when 2 then 'HAS_VALUE,HAS_TEMPORAL' when 3 then 'HAS_NEGATION,HAS_TEMPORAL,HAS_MULTIPLIER' when 4 then 'HAS_TEMPORAL' else 'HAS_VALUE' end as relations from lines"""),
        "parse_statements": lines_sql(f"""{_FRAGMENTS}
, p as (
  select f.*, l.lab, l.q, l.d, case when f.kind = 0 then '>=' when f.kind = 2 then '<' when f.kind = 5 then case f.fragment_no when 1 then '>' else '<=' end end as sign, case when f.fragment_no = 2 then l.q + 100 else l.q end as v
  from f join lines l using (trial_id, ord))
select trial_id, ord, fragment_no, case kind when 3 then lab || ' on two occasions' when 4 then source else upper(lab) end as entity, sign as comparator,
  case kind when 1 then q || ' to ' || (q + 10) when 3 then 'absent' when 4 then 'present' else v::varchar end as value,
  case when kind in (0, 5) then 'mg/dL' when kind = 1 then 'mmol/L' when kind = 2 then '%' end as unit, case when kind = 1 then 'interval' when kind in (3, 4) then 'categorical' else 'numerical' end as value_kind,
  case when kind = 1 or sign in ('>=', '>') then q::double end as lower_bound, case when kind = 1 or sign = '>=' then true when sign = '>' then false end as lower_inclusive,
  case when kind = 1 then (q + 10)::double when sign in ('<', '<=') then v::double end as upper_bound, case when kind = 1 or sign = '<=' then true when sign = '<' then false end as upper_inclusive,
  case when kind = 1 then '[' || q || ', ' || (q + 10) || ']' when sign = '>=' then '[' || v || ', +inf)' when sign = '>' then '(' || v || ', +inf)' when sign = '<' then '(-inf, ' || v || ')' when sign = '<=' then '(-inf, ' || v || ']' end as interval,
  kind = 3 as negated, case kind when 2 then 'within ' || d || ' days' when 3 then 'history of' when 4 then 'more than ' || q || ' weeks' end as temporal,
  case kind when 1 then 'HAS_VALUE' when 2 then 'HAS_VALUE,HAS_TEMPORAL' when 3 then 'HAS_NEGATION,HAS_TEMPORAL,HAS_MULTIPLIER' when 4 then 'HAS_TEMPORAL' else 'HAS_VALUE' end as relations from p"""),
        "text_flags": lines_sql("""
select trial_id, ord, kind = 3 as negated, case kind when 2 then 'within ' || d || ' days' when 3 then 'history of' when 4 then 'more than ' || q || ' weeks' end as temporal,
  case when kind = 3 then 'on two occasions' end as repetition from lines"""),
        "written_constraints": lines_sql("""
select trial_id, ord, '>' as comparator, q::varchar as value, 'weeks' as unit, 'duration' as entity, 'standalone' as logical_operator from lines where kind = 4
union all select trial_id, -ord, '>=', q::varchar, null, case part_key % 3 when 0 then 'Patients with' when 1 then 'lesions' else 'new lesions' end, 'standalone' from lines"""),
        "operator_spelling": lines_sql("select trial_id, ord, statement as spelled, '>= ' || q || ' grade' as graded from lines"),
        "comparator_words": lines_sql("select trial_id, ord, ['>=', '<=', '>', '<', '<=', null][kind + 1] as sign from lines"),
        "number_columns": lines_sql("""
select trial_id, ord, '[' || q || ', ' || case when kind < 3 then q || '.5' else '+inf' end || ')' as interval, q * 12.0::double as upper, 'months' as unit,
  (1000 + q)::double as number, ('0.' || q)::double as confidence, 'x ULN' as tidy from lines"""),
        "segment_lines": f"""
with l as (select doc_id, trim(unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))), '{_SPACE}') as line from documents),
f as (select doc_id, trim(unnest(string_split(regexp_replace(line, '^(?:[-*•][{_SPACE}]+|[0-9]+[.)][{_SPACE}]+)', ''), ';')), '{_SPACE}') as part from l)
select doc_id as protocol_id, count(*) as fragments, sum(length(part))::bigint as chars from f where part <> '' group by doc_id""",
        "segment_fragments": lines_sql(f"""{_FRAGMENTS}
select trial_id as protocol_id, criterion_type, source, {_stable("statement", "trial_id", "'v1'", "criterion_type", "ord", "statement")} as source_id, ord as parent_source_index, fragment_no,
  row_number() over (partition by trial_id order by ord, fragment_no)::int as item_no from f"""),
        "statement_context": lines_sql("""
select trial_id as protocol_id, ord as parent_source_index, statement as parent_statement,
  concat_ws(chr(10), lag(statement) over w, statement, lead(statement) over w) as surrounding_context from lines window w as (partition by trial_id order by ord)"""),
        "unsegmented_protocols": "select o_orderkey as protocol_id, 'no criteria segmented' as error from orders where o_orderkey % 10 = 0",
        "canonical_entities": """
select p_partkey, lower(p_name) || case p_partkey % 3 when 0 then ' BMI' when 1 then ' (Blood Pressure)' else ' finding' end as canonical, upper('x' || p_partkey) as short from part""",
        "domain_inference": """
select p_partkey, case p_partkey % 8 when 0 then 'procedure' when 1 then 'drug' when 2 then 'device' when 3 then 'visit' when 4 then 'condition' when 5 then 'observation' when 6 then 'person'
  else case when p_partkey % 16 = 15 then 'measurement' else 'observation' end end as domain from part""",
        "criteria_by_trial": lines_sql(f"""{_FRAGMENTS}
, parents as (select trial_id, source, arg_max(ord, ord * 10 + fragment_no) as parent from f group by all),
atoms as (
  select distinct f.trial_id, f.source, f.criterion_type, p.parent from f join parents p using (trial_id, source)
  union all select distinct trial_id, source, 'written', parent from f join parents p using (trial_id, source) where kind = 4)
select trial_id, count(*) as criteria, count(*) as ids, count(distinct parent) as parents from atoms group by trial_id"""),
        "criteria_with_proposals": lines_sql(f"""{_FRAGMENTS}
, items as (select f.*, l.lab, l.q, l.d, row_number() over (partition by f.trial_id order by f.ord, f.fragment_no) as item_no from f join lines l using (trial_id, ord)),
texts as (
  select trial_id, source, any_value(kind) as kind, any_value(fragment_no) as fragment_no, any_value(lab) as lab, any_value(q) as q, min(item_no) as item_no, arg_max(criterion_type, item_no) as last_type, arg_min(criterion_type, item_no) as first_type,
         arg_max({_stable("statement", "trial_id", "'v1'", "criterion_type", "ord", "statement")}, item_no) as parent from items group by all),
given as (
  select trial_id, case when kind = 5 then lab || ' > ' || q || ' mg/dL' else statement end as source, ord as seq, null as qualifier, 0.9 as conf from lines where part_key % 4 <> 0
  union all select trial_id, case when kind = 5 then lab || ' > ' || q || ' mg/dL' else statement end, ord + 1000, 'again', 0.9 from lines where part_key % 4 <> 0 and part_key % 3 = 0
  union all select trial_id, case when kind = 5 then lab || ' > ' || q || ' mg/dL' else statement end, ord + 2000, null, 0.4 from lines where part_key % 4 <> 0 and part_key % 5 = 0),
rows_ as (
  select t.*, 'given' as made, t.last_type as type, 0 as phase, 0 as pos, seq, qualifier, conf from given join texts t using (trial_id, source)
  union all select *, 'written', first_type, 1, item_no, 0, 'deterministically parsed written comparison', 1.0 from texts where kind = 4
  union all select t.*, 'bare', i.criterion_type, 1, i.item_no, 1 << 30, null, 0.5 from items i join texts t using (trial_id, source) where not exists (select 1 from given g where g.trial_id = i.trial_id and g.source = i.source)),
counted as (select *, count(*) over (partition by trial_id, source) > 1 as many from rows_),
best as (
  select *, row_number() over (partition by trial_id, source, made, type, qualifier order by conf desc, phase, pos, seq) as n, min((phase, pos, seq)) over (partition by trial_id, source, made, type, qualifier) as place from counted),
atoms as (select *, row_number() over (partition by trial_id, parent order by place)::int as atom_index, count(*) over (partition by trial_id, parent)::int as parent_atom_count from best where n = 1)
select trial_id, source, {_stable("criterion", "trial_id", "'v1'", "parent", "atom_index")} as criterion_id, atom_index, parent_atom_count, type as criterion_type,
  case when made = 'written' then 'DURATION' when made = 'bare' and kind = 3 then lab || ' on two occasions' when made = 'bare' and kind = 4 then source else upper(lab) end as entity,
  case when made <> 'bare' or kind in (0, 2, 5) then 'measurement' when kind = 3 then 'condition' else 'observation' end as domain,
  case when kind = 0 then '>=' when kind = 2 then '<' when kind = 5 then case fragment_no when 1 then '>' else '<=' end when made = 'written' then '>' end as comparator,
  case when kind = 1 then q || ' to ' || (q + 10) when kind = 3 then 'absent' when kind = 4 and made <> 'written' then 'present' when fragment_no = 2 then (q + 100)::varchar else q::varchar end as value,
  qualifier, case when many or parent_atom_count > 1 then 'and' else 'standalone' end as logical_operator, conf::double as extraction_confidence, '' as codes, 'HUMAN_REVIEW_REQUIRED' as blockers from atoms"""),
        "reconcile_items": lines_sql(f"""{_FRAGMENTS}
, kinds as (select trial_id, source, arg_max(criterion_type, ord * 10 + fragment_no) as last_kind, arg_min(criterion_type, ord * 10 + fragment_no) as first_kind, max(kind) as kind from f group by all),
p as (select l.trial_id, l.statement as source, k.last_kind from lines l join kinds k on k.trial_id = l.trial_id and k.source = l.statement
  where part_key % 3 <> 0 and part_key % 4 <> 0)
select trial_id as protocol_id, phase::int as phase, criterion_type, count(*) as n, count(entity) as entities from (
  select trial_id, 0 as phase, last_kind as criterion_type, 'x' as entity from p
  union all select trial_id, 1, first_kind, 'x' from kinds where kind = 4
  union all select f.trial_id, 1, f.criterion_type, null from f where not exists (select 1 from p where p.trial_id = f.trial_id and p.source = f.source))
group by all"""),
        "proposal_contract": lines_sql(f"""{CHECKED_SQL}
select trial_id, ord, concat_ws(',', case when criterion_type = 'other' then 'criterion_type' end, case when ord % 2 <> 0 then 'domain' end, case when part_key % 11 = 0 then 'entity' end, case when part_key % 29 = 0 then 'comparator' end,
  case when part_key % 31 = 0 then 'negated' end, case when part_key % 37 = 0 then 'logical_operator' end, case when ord % 3 = 0 and conf * 2 > 1 then 'extraction_confidence' end, case when kind = 5 and q % 8 = 0 then 'source' end) as violations from judged"""),
        "dedup_signature": lines_sql(f"{_ATOMS} select protocol_id, parent_statement_id, criterion_type, entity, value, first_seq::bigint as first_seq, conf as extraction_confidence from ranked where n = 1"),
        "atom_reindex": lines_sql(f"""{_ATOMS}
, w as (select *, row_number() over (partition by protocol_id, parent_statement_id order by first_seq)::int as atom_index, count(*) over (partition by protocol_id, parent_statement_id) as parent_atom_count from ranked where n = 1)
select protocol_id, parent_statement_id, entity, value, criterion_type, atom_index, parent_atom_count, {_stable("criterion", "protocol_id", "'v1'", "parent_statement_id", "atom_index")} as criterion_id from w"""),
        "validation_issues": lines_sql(f"{CHECKED_SQL} select trial_id, ord, array_to_string(codes, ',') as codes from judged"),
        "readiness": lines_sql(f"{CHECKED_SQL} select trial_id, ord, len(blockers) = 0 as export_ready, array_to_string(blockers, ',') as blockers from judged"),
        "issue_histogram": lines_sql(f"""{CHECKED_SQL}
select substr(m, 3) as code, case m[1] when 'w' then 'warning' else 'error' end as severity, count(*) as n from (select unnest(marked) as m from judged) group by m"""),
        "quality_rollup": lines_sql(f"""{CHECKED_SQL}
select trial_id, grouping(trial_id)::int as overall, count(distinct trial_id) as trials, count(*) as criteria, count(*) filter (where criterion_type = 'inclusion') as inclusion,
  count(*) filter (where criterion_type = 'exclusion') as exclusion, count(*) filter (where len(errors) > 0) as with_errors, count(*) filter (where len(warnings) > 0) as with_warnings,
  round(avg(conf), 6) as mean_confidence from judged group by rollup (trial_id)"""),
        "trial_metrics": lines_sql(f"""{CHECKED_SQL}
select 'NCT' || lpad(o_orderkey::varchar, 8, '0') as trial_id, count(ord) as criteria, count(*) filter (where len(errors) > 0) as with_errors,
  round(avg(conf), 6) as mean_confidence from orders left join judged on trial_id = 'NCT' || lpad(o_orderkey::varchar, 8, '0') group by o_orderkey"""),
        "manifest_profile": f"""{_ENTRIES}
select cohort, count(*) as slots, count(trial_id) as active, count(*) - count(trial_id) as blank, count(distinct trial_id) as trials, count(trial_id) - count(distinct trial_id) as repeated from entries group by cohort""",
        "manifest_pending": f"""{_ENTRIES}
select trial_id, min(pos) as pos from entries where not blank and trial_id not in (select 'NCT' || lpad(o_orderkey::varchar, 8, '0') from orders where o_orderstatus = 'F') group by trial_id""",
        "calibration_subset": f"""{_ENTRIES}
select 'NCT' || lpad(o_orderkey::varchar, 8, '0') as trial_id from orders where o_orderkey % 100 in (40, 41)
  and not exists (select 1 from entries e where e.trial_id = 'NCT' || lpad(o_orderkey::varchar, 8, '0'))""",
        "study_projection": """
select case when o_orderkey % 50 <> 0 then 'NCT' || lpad(o_orderkey::varchar, 8, '0') end as trial_id,
  'ctgov-' || case when o_orderkey % 3 = 0 then strftime(o_orderdate, '%Y-%m-%d') when o_orderkey % 2 = 0 then '2020-01-01' else 'unknown-date' end as source_version,
  case when o_orderkey % 7 <> 0 then o_orderpriority end as protocol_text, case when o_orderkey % 7 <> 0 then 'sha256:' || sha256(o_orderpriority) end as protocol_hash,
  case when o_orderkey % 50 = 0 then 'bad registry id' when o_orderkey % 7 = 0 then 'no eligibility text' end as error from orders""",
        "provenance_ids": f"""
select doc_id, 'sha256:' || sha256(text) as hash, 'DOC-' || substr(sha256(text), 1, 12) as label, 'sha256-' || substr(sha256(text), 1, 16) as version,
  {_stable("statement", "doc_id", "source", "0", "null")} as stable_id from documents""",
        "retry_actions": _retries("user_id * 20 + event_id % 20"),
        "retry_actions_all": _retries("user_id"),
        "job_latest_status": "select user_id as job_id, arg_max(event_type, (ts, event_id)) as stage, count(*) as events from events group by user_id",
        "recent_jobs": """
select user_id as job_id, 'NCT' || lpad(user_id::varchar, 8, '0') as trial_id, 'P' || user_id as protocol_id, 'v1' as source_version, 'nct' as input_mode, arg_max(event_type, (ts, event_id)) as status, arg_max(event_type, (ts, event_id)) as stage,
  least(count(*), 100) as progress, min(ts) as created_at, max(ts) as updated_at, case when arg_max(event_type, (ts, event_id)) = 'error' then 'timeout' end as error from events group by user_id order by max(ts) desc, user_id limit 100""",
        "cost_summary": f"{_USAGE} select model, count(*) as calls, sum(i)::bigint as input_tokens, sum(o)::bigint as output_tokens, round(sum(cost), 6) as cost, sum(cost) >= 0.01 as warn from priced group by model",
        "cost_running_limit": f"""{_USAGE}
, r as (select run_id, seq, sum(cost) over (partition by run_id order by seq rows unbounded preceding) as spent from priced)
select run_id, min(seq) as seq, round(arg_min(spent, seq), 6) as spent from r where spent > 0.01 group by run_id""",
        "usage_batches": "select user_id as protocol_id, event_id as item_no, (row_number() over (partition by user_id order by event_id) - 1) // 20 as batch from events",
        "review_completeness": lines_sql("""
select order_key::varchar as job_id, count(*) as expected, count(*) filter (where part_key % 101 <> 0) as supplied,
  bool_and(part_key % 101 <> 0 and part_key % 97 <> 0) as complete from lines group by order_key"""),
        "id_set_check": lines_sql("select order_key::varchar as job_id, trial_id || '-' || ord as row_id, 'missing' as side from lines where part_key % 101 = 0"),
        "group_consistency": lines_sql("""
, p as (select trial_id as protocol_id, 'p' || (line_no % 3) as parent_statement_id, ord, row_number() over (partition by trial_id, line_no % 3 order by ord) as i from lines),
g as (select protocol_id, parent_statement_id, count(*) as n, bool_or(ord % 29 = 0) as bad_members from p group by all)
select protocol_id, parent_statement_id, n, bad_members, n > 1 and substr(protocol_id, 4)::bigint % 31 = 0 as bad_operator from g"""),
        "review_gate": lines_sql(f"{_REVIEW} select job_id, count(*) as applied from r where job_id not in (select job_id from reasons) group by job_id"),
        "review_rejects": lines_sql(f"{_REVIEW} select job_id, reason from reasons"),
        "library_upsert": lines_sql("""
, e as (select trial_id, statement as source, criterion_type, upper(lab) as entity, q::varchar as value, ord + 1000 * line_no as seq, part_key from lines),
both_ as (
  select trial_id, source, criterion_type, min(entity) as entity, 'old' as value, 0 as newer, 0 as seq from e where part_key % 2 = 0 group by all
  union all select distinct trial_id, source, criterion_type, entity, value, 1, seq from e where part_key % 3 = 0)
select trial_id, source, criterion_type, entity, value from both_ qualify row_number() over (partition by trial_id, source, criterion_type order by newer desc, seq desc) = 1"""),
        "library_union": lines_sql("select case when kind < 3 then 'immutable_base' else 'reviewed' end as library_source, criterion_type, count(*) as n from lines group by all"),
        "library_search": "select doc_id, lang from documents where contains(lower(concat_ws(' ', text, lang, source)), 'ere')",
        "validated_export": lines_sql(f"""{CHECKED_SQL}
select trial_id, ord, concat_ws(',', case when part_key % 29 = 0 then 'source_id' end, case when part_key % 31 = 0 then 'parent_statement' end, case when part_key % 37 = 0 then 'boolean_group_id' end, case when part_key % 41 = 0 then 'atom_index' end,
  case when ord % 2 <> 0 then 'domain' end, case when part_key % 43 = 0 then 'value_kind' end, case when part_key % 53 = 0 then 'relations' end, case when part_key % 47 = 0 then 'surrounding_context' end,
  case when ord % 3 = 0 then 'reviewed_at' end) as violations from judged where len(blockers) = 0"""),
        "legacy_upgrade": lines_sql("""
select trial_id || '-' || ord as row_id, trial_id || '-' || ord as criterion_id, trial_id || '-' || ord as parent_statement_id, 'legacy-unversioned' as source_version,
  case when line_status = 'F' then 'accepted' else 'pending' end as human_review_status, case when kind = 1 then 'interval' when kind in (2, 5) then 'numerical' else 'categorical' end as value_kind,
  case kind when 1 then '[' || q || ', ' || (q + 10) || ']' when 2 then '(-inf, ' || q || ')' when 5 then '(' || q || ', +inf)' end as interval, upper(lab) as term from lines"""),
        "natural_order": lines_sql("""
, s as (select *, case when part_key % 2 = 0 then upper(lab) else lab end || ' ' || case when part_key % 5 = 0 then '00' else '' end || q || ' mg' || case when part_key % 3 = 0 then '2' else '' end as shown from lines)
select trial_id, ord, shown, row_number() over (partition by trial_id order by (part_key % 37), q, case when part_key % 3 = 0 then 1 else 0 end, shown, ord)::int as place from s"""),
        "answer_intake": lines_sql("""
, told as (
  select trial_id, ord - 1 as place, part_key % 7 as odd, lab, q, statement,
    case part_key % 7 when 0 then 'against the contract: comparator' when 1 then 'missing: source' when 2 then 'unknown: note' when 3 then 'wrong types' when 4 then 'wrong type: unit' else '' end as faults
  from lines where order_key % 6 < 3)
select trial_id as protocol_id, place::int as place, place::bigint as ord, faults, lab as entity, case odd when 0 then '=>' else '>=' end as comparator, q::varchar as value,
  case odd when 4 then '5' else 'mg/dL' end as unit, case when odd <> 3 then false end as negated, q::double as lower_bound, case when odd <> 1 then statement end as source from told
union all select distinct trial_id, null, null, case order_key % 6 when 3 then 'broken JSON' when 4 then 'no JSON object' else 'unknown fields' end, null, null, null, null, null, null, null from lines where order_key % 6 >= 3"""),
        "interval_relations": lines_sql("""
, i as (select distinct trial_id, lab as entity, q as lo, d % 3 = 0 as lo_open, q + case kind when 0 then 100 else kind * 10 end as hi, d % 2 = 0 as hi_open from lines),
e as (select trial_id, entity, 2 * lo + lo_open::int as lo, 2 * hi + (not hi_open)::int as hi, (lo, lo_open, hi, hi_open) as k from i where lo < hi),
o as (
  select a.entity, case when a.k <= b.k then a.lo else b.lo end as lo, case when a.k <= b.k then a.hi else b.hi end as hi,
         case when a.k <= b.k then b.lo else a.lo end as lo2, case when a.k <= b.k then b.hi else a.hi end as hi2
  from e a join e b on a.entity = b.entity and a.trial_id < b.trial_id)
select entity, case when lo = lo2 and hi = hi2 then 'equal' when hi <= lo2 or hi2 <= lo then 'disjoint' when lo >= lo2 and hi <= hi2 then 'subset' when lo <= lo2 and hi >= hi2 then 'superset' else 'overlap' end as relation, count(*) as n
from o group by all"""),
    }
