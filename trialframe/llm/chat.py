"""Preference formatting of paired conversations, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a turn is rendered: HEAD with its role, its text, and END.
HEAD = "<|{}|>\n"
END = "<|end|>\n"


def _head(turn: Column) -> Column:
    before, after = HEAD.split("{}")
    return F.concat(F.lit(before), F.coalesce(turn["role"], F.lit("")), F.lit(after))


def _body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(END))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def _mask(turns: Column) -> Column:
    """Where the assistant speaks in the rendered turns: start:end of text and end mark, in code points."""

    def step(state: Column, turn: Column) -> Column:
        start = state["at"] + F.length(_head(turn))
        end = start + F.length(_body(turn))
        span = F.when(turn["role"].eqNullSafe("assistant"), F.array(F.concat_ws(":", start, end))).otherwise(F.array().cast("array<string>"))
        return F.struct(end.alias("at"), F.concat(state["spans"], span).alias("spans"))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    return F.aggregate(turns, empty, step, lambda s: F.array_join(s["spans"], ","))


def preference_pairs(turns: DataFrame) -> DataFrame:
    """(pair_id, prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask) of each pair.

    ``turns`` is (pair_id, side, turn, role, text), side 'chosen' or 'rejected'; turns are ordered by turn, role and
    text, null first. The longest common prefix of turns, equal in role and text, is rendered once as the
    prompt. The turns after it are each side's completion, whose mask says what is to be learned: the
    assistant's turns. Two equal conversations are all prompt.

    Pairs with one side only, and rows with a null pair_id, have no result. Null roles and texts are rendered as
    empty. Repeated rows are turns one by one. Other columns are not read.
    """
    turn = F.struct(F.col("turn").alias("turn"), F.col("role").alias("role"), F.col("text").alias("text"))
    side = lambda name: F.array_sort(F.collect_list(F.when(F.col("side") == name, turn))).alias(name)
    pairs = turns.filter("pair_id is not null").groupBy("pair_id").agg(side("chosen"), side("rejected")).filter("size(chosen) > 0 and size(rejected) > 0")
    shortest = F.least(F.size("chosen"), F.size("rejected"))
    same = F.zip_with(F.slice("chosen", F.lit(1), shortest), F.slice("rejected", F.lit(1), shortest), lambda a, b: a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))
    first = F.array_position(same, F.lit(False))
    pairs = pairs.withColumn("prompt_turns", F.when(first == 0, shortest.cast("long")).otherwise(first - 1))
    rest = lambda name: F.slice(name, (F.col("prompt_turns") + 1).cast("int"), F.size(name))
    return pairs.select(
        "pair_id",
        "prompt_turns",
        _rendered(F.slice("chosen", F.lit(1), F.col("prompt_turns").cast("int"))).alias("prompt"),
        _rendered(rest("chosen")).alias("chosen"),
        _rendered(rest("rejected")).alias("rejected"),
        _mask(rest("chosen")).alias("chosen_mask"),
        _mask(rest("rejected")).alias("rejected_mask"),
    )


def with_other_answers(turns: DataFrame) -> DataFrame:
    """Preference pairs (pair_id, side, turn, role, text) of conversations (conv_id, turn, role, text), one of each.

    Chosen is the conversation as it is. Rejected are its turns before the assistant's last one, and then the last
    answer of another conversation in its place: that of conversation 2 i + 1 for 2 i, and the other way round; an
    empty answer if there is none. Conversations in which the assistant has no turn with a number give no pair.
    """
    last = turns.filter("role = 'assistant' and turn is not null").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last")).select("conv_id", F.col("last.turn").alias("cut"), F.col("last.text").alias("answer"))
    chosen = turns.join(last.select("conv_id"), "conv_id").select(F.col("conv_id").alias("pair_id"), F.lit("chosen").alias("side"), "turn", "role", "text")
    before = turns.join(last.select("conv_id", "cut"), "conv_id").filter("turn < cut or turn is null").select(F.col("conv_id").alias("pair_id"), F.lit("rejected").alias("side"), "turn", "role", "text")
    other = last.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("pair_id"), "answer")
    answers = last.select(F.col("conv_id").alias("pair_id"), "cut").join(other, "pair_id", "left").select("pair_id", F.lit("rejected").alias("side"), F.col("cut").alias("turn"), F.lit("assistant").alias("role"), F.coalesce("answer", F.lit("")).alias("text"))
    return chosen.unionByName(before).unionByName(answers)


PREFERENCE_SQL = r"""
with lasts as (
  select conv_id, max((turn, text)) as l from conversations where role = 'assistant' and turn is not null and conv_id is not null group by conv_id),
cuts as (select conv_id, l[1] as cut, l[2] as answer from lasts),
paired as (
  select conv_id as pair_id, 0 as side, turn, role, text from conversations join cuts using (conv_id)
  union all select conv_id, 1, turn, role, text from conversations join cuts using (conv_id) where turn < cut or turn is null
  union all select c.conv_id, 1, c.cut, 'assistant', coalesce(o.answer, '') from cuts c left join cuts o on o.conv_id = xor(c.conv_id, 1)),
turns as (
  select pair_id, side, role, text,
         row_number() over (partition by pair_id, side order by turn nulls first, role nulls first, text nulls first) as pos,
         '<|' || coalesce(role, '') || '|>' || chr(10) as head, coalesce(text, '') || '<|end|>' || chr(10) as body
  from paired),
sizes as (
  select pair_id, max(pos) filter (where side = 0) as n0, max(pos) filter (where side = 1) as n1
  from turns group by pair_id having n0 is not null and n1 is not null),
prefixes as (
  select s.pair_id, coalesce(min(a.pos) filter (where a.role is distinct from b.role or a.text is distinct from b.text) - 1,
         min(least(n0, n1))) as prompt_turns
  from sizes s join turns a on a.pair_id = s.pair_id and a.side = 0
  left join turns b on b.pair_id = s.pair_id and b.side = 1 and b.pos = a.pos
  where a.pos <= least(n0, n1) group by s.pair_id),
placed as (
  select t.*, p.prompt_turns, coalesce(sum(length(head) + length(body)) over (
           partition by t.pair_id, side, t.pos > p.prompt_turns order by t.pos rows between unbounded preceding and 1 preceding), 0)::bigint as start
  from turns t join prefixes p using (pair_id))
select pair_id, prompt_turns::bigint as prompt_turns,
       coalesce(string_agg(head || body, '' order by pos) filter (where side = 0 and pos <= prompt_turns), '') as prompt,
       coalesce(string_agg(head || body, '' order by pos) filter (where side = 0 and pos > prompt_turns), '') as chosen,
       coalesce(string_agg(head || body, '' order by pos) filter (where side = 1 and pos > prompt_turns), '') as rejected,
       coalesce(string_agg((start + length(head)) || ':' || (start + length(head) + length(body)), ',' order by pos)
         filter (where side = 0 and pos > prompt_turns and role = 'assistant'), '') as chosen_mask,
       coalesce(string_agg((start + length(head)) || ':' || (start + length(head) + length(body)), ',' order by pos)
         filter (where side = 1 and pos > prompt_turns and role = 'assistant'), '') as rejected_mask
from placed group by pair_id, prompt_turns
"""
