"""Preference formatting of chosen and rejected conversations; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from declgraph.llm.common import pick, table

START, END = "<|im_start|>", "<|im_end|>\n"
TRAINED = "assistant"


def render(turn: str) -> str:
    """SQL that renders a struct of role and text."""
    return f"concat('{START}', {turn}.role, '\\n', {turn}.text, '{END}')"


def _completion(turns: str, at: str) -> tuple[str, str]:
    """SQL of the text of turns after the first `at`, and of the spans of it that are trained on: the contents of
    assistant turns with their end marks, as [start, end) in characters."""
    rest = f"slice({turns}, {at} + 1, greatest(size({turns}) - {at}, 0))"
    text = f"array_join(transform({rest}, t -> {render('t')}), '')"
    head = f"(length('{START}') + length(t.role) + 1)"
    whole = f"({head} + length(t.text) + length('{END}'))"
    # One pass: the running offset and the spans so far.
    zero = "named_struct('at', 0L, 'spans', cast(array() as array<struct<start:bigint,end:bigint>>))"
    step = f"named_struct('at', acc.at + {whole}, 'spans', if(t.role = '{TRAINED}', concat(acc.spans, array(named_struct('start', acc.at + {head}, 'end', acc.at + {whole}))), acc.spans))"
    return text, f"aggregate({rest}, {zero}, (acc, t) -> {step}, acc -> acc.spans)"


def format_pairs(pairs: DataFrame) -> DataFrame:
    """pairs(pair_id, chosen, rejected: array<struct<role, text>>) -> pair_id, n_prompt_turns, prompt, chosen, rejected,
    chosen_spans, rejected_spans.

    The prompt is the longest common prefix of turns that are equal in role and text, rendered once; the completions
    are what follows on either side, with the spans on which a loss may be taken. Null roles and texts count as empty,
    null conversations as ones without turns; equal conversations give empty completions.
    """
    rows = pick(pairs, "pair_id", "chosen", "rejected")
    whole = "transform(coalesce({0}, cast(array() as array<struct<role:string,text:string>>)), t -> named_struct('role', coalesce(t.role, ''), 'text', coalesce(t.text, '')))"
    rows = rows.select("pair_id", *(F.expr(whole.format(c)).alias(c) for c in ("chosen", "rejected")))
    differs = "array_position(zip_with(slice(chosen, 1, least(size(chosen), size(rejected))), slice(rejected, 1, least(size(chosen), size(rejected))), (a, b) -> a = b), false)"
    rows = rows.withColumn("n", F.expr(f"cast(if({differs} > 0, {differs} - 1, least(size(chosen), size(rejected))) as int)"))
    (chosen, chosen_spans), (rejected, rejected_spans) = _completion("chosen", "n"), _completion("rejected", "n")
    prompt = f"array_join(transform(slice(chosen, 1, n), t -> {render('t')}), '')"
    return rows.select("pair_id", F.col("n").alias("n_prompt_turns"), F.expr(prompt).alias("prompt"), F.expr(chosen).alias("chosen"), F.expr(rejected).alias("rejected"), F.expr(chosen_spans).alias("chosen_spans"), F.expr(rejected_spans).alias("rejected_spans"))


def conversations(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) -> conv_id, turns: in order of turn, nulls first, ties by role and text.

    A conversation's turns come together in one row, which holds them anyway; rows without conv_id belong to none.
    """
    rows = pick(turns, "conv_id", "turn", "role", "text").where("conv_id is not null")
    listed = F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63))).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    return rows.groupBy("conv_id").agg(listed.alias("turns")).select(F.col("conv_id").cast("long"), F.expr("transform(turns, t -> named_struct('role', t.role, 'text', t.text))").alias("turns"))


def pair_up(turns: DataFrame) -> DataFrame:
    """Pairs of neighbouring conversations: 2i is the chosen one of pair i, 2i + 1 the rejected one; one may be absent."""
    side = "if(pmod(conv_id, 2) = {0}, turns, null)"
    both = conversations(turns).groupBy(F.expr("cast(floor(conv_id / 2) as long)").alias("pair_id"))
    return both.agg(F.max_by(F.expr(side.format(0)), F.expr("if(pmod(conv_id, 2) = 0, 1, null)")).alias("chosen"), F.max_by(F.expr(side.format(1)), F.expr("if(pmod(conv_id, 2) = 1, 1, null)")).alias("rejected"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = format_pairs(pair_up(table(spark, sf_dir, "conversations")))
    flat = "array_join(transform({0}, s -> concat(s.start, '-', s.end)), ' ')"
    return found.select("pair_id", "n_prompt_turns", "prompt", "chosen", "rejected", *(F.expr(flat.format(c)).alias(c) for c in ("chosen_spans", "rejected_spans")))


OP1_SQL = r"""
with t as (select conv_id, row_number() over (partition by conv_id order by turn, coalesce(role, ''), coalesce(text, '')) as i,
                  coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
p as (select conv_id // 2 as pair_id, conv_id % 2 as side, i, role, text,
             '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) as shown, length('<|im_start|>' || role || chr(10)) as head from t),
ids as (select distinct pair_id from p),
n as (select pair_id, count(*) as n from (
        select a.pair_id, a.i, bool_and(a.role = b.role and a.text = b.text) over (partition by a.pair_id order by a.i) as same
        from p a join p b on a.pair_id = b.pair_id and a.i = b.i where a.side = 0 and b.side = 1) where same group by pair_id),
m as (select ids.pair_id, coalesce(n.n, 0) as n from ids left join n on ids.pair_id = n.pair_id),
o as (select p.*, m.n, coalesce(sum(length(shown)) over (partition by p.pair_id, side, p.i > m.n order by p.i rows between unbounded preceding and 1 preceding), 0) as pos
      from p join m on p.pair_id = m.pair_id)
select m.pair_id, cast(m.n as integer) as n_prompt_turns,
  coalesce(string_agg(o.shown, '' order by o.i) filter (where o.side = 0 and o.i <= o.n), '') as prompt,
  coalesce(string_agg(o.shown, '' order by o.i) filter (where o.side = 0 and o.i > o.n), '') as chosen,
  coalesce(string_agg(o.shown, '' order by o.i) filter (where o.side = 1 and o.i > o.n), '') as rejected,
  coalesce(string_agg(cast(pos + head as bigint) || '-' || cast(pos + length(shown) as bigint), ' ' order by o.i) filter (where o.side = 0 and o.i > o.n and role = 'assistant'), '') as chosen_spans,
  coalesce(string_agg(cast(pos + head as bigint) || '-' || cast(pos + length(shown) as bigint), ' ' order by o.i) filter (where o.side = 1 and o.i > o.n and role = 'assistant'), '') as rejected_spans
from m join o on m.pair_id = o.pair_id group by m.pair_id, m.n
"""
