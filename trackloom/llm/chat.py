"""Chat formatting with cumulative-snapshot collapse.

A chat that is logged again after every turn leaves conversations that are beginnings of longer ones. Each turn gets a
hash of the conversation up to and including it; a conversation whose last such hash occurs at an inner turn of another
one is a beginning of that and goes, by an anti-join on (number of turns, hash). Of equal conversations the one with the
smallest conv_id stays. What remains is rendered.

The rolling hash is the exclusive-or of 128 bits a turn that depend on position, role and text. It is taken by
conversation in two levels (stretches of `STRETCH` turn numbers, then the stretches), so that a conversation with a large
share of all rows is not one task's work. Prefix hashes are made distinct, with partial aggregation, before the join, so
that a beginning shared by very many conversations is one row there.

Defined results
* turns go by number (null first); ties by role, then text, nulls first. Repeated turns are turns.
* null conv_id: those rows are one conversation with a null id. Null role or text: differs from the empty string when
  compared and is rendered as empty.
* rendering: a row a conversation and stretch of turns, in order by `part`; parts joined end to end are the conversation.
* empty table: an empty result. Further columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, read_table

STRETCH = 256


def _turn_hash(salt: str) -> Column:
    return F.xxhash64(F.lit(salt), F.col("pos"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text"))


def numbered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, part, pos (from 1), role, text and the rolling hashes h1, h2 up to each turn."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("part", F.coalesce(F.floor(F.col("turn") / STRETCH), F.lit(-(1 << 62))))
    in_part = Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = rows.withColumn("n", F.row_number().over(in_part))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("c"))
    sizes = sizes.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0))).select(F.col("conv_id").alias("k"), F.col("part").alias("p"), "before")
    rows = rows.join(sizes, F.col("conv_id").eqNullSafe(F.col("k")) & (F.col("part") == F.col("p"))).withColumn("pos", F.col("before") + F.col("n")).drop("k", "p")
    running = Window.partitionBy("conv_id", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"t1": _turn_hash("a"), "t2": _turn_hash("b")})
    rows = rows.withColumns({"r1": F.bit_xor("t1").over(running), "r2": F.bit_xor("t2").over(running)})
    whole = rows.groupBy("conv_id", "part").agg(F.bit_xor("t1").alias("p1"), F.bit_xor("t2").alias("p2"))
    whole = whole.withColumns({"b1": F.coalesce(F.bit_xor("p1").over(before), F.lit(0)), "b2": F.coalesce(F.bit_xor("p2").over(before), F.lit(0))})
    whole = whole.select(F.col("conv_id").alias("k"), F.col("part").alias("p"), "b1", "b2")
    joined = rows.join(whole, F.col("conv_id").eqNullSafe(F.col("k")) & (F.col("part") == F.col("p")))
    return joined.select("conv_id", "part", "pos", "role", "text", F.col("r1").bitwiseXOR(F.col("b1")).alias("h1"), F.col("r2").bitwiseXOR(F.col("b2")).alias("h2"))


def maximal_conversations(numbered: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that are no beginning of a longer one and no later copy of an equal one."""
    ends = numbered.groupBy("conv_id").agg(F.max(F.struct("pos", "h1", "h2")).alias("e")).select("conv_id", F.col("e.pos").alias("n_turns"), "e.h1", "e.h2")
    inner = numbered.join(ends.select(F.col("conv_id").alias("k"), "n_turns"), F.col("conv_id").eqNullSafe(F.col("k"))).filter("pos < n_turns")
    inner = inner.select(F.col("pos").alias("n_turns"), "h1", "h2").distinct()
    first = ends.groupBy("n_turns", "h1", "h2").agg(F.min(F.struct(F.col("conv_id").isNull(), F.col("conv_id"))).alias("m"))
    first = first.select("n_turns", "h1", "h2", F.col("m.conv_id").alias("conv_id"))
    return first.join(inner, ["n_turns", "h1", "h2"], "left_anti").select("conv_id", "n_turns")


def render(numbered: DataFrame, chosen: DataFrame) -> DataFrame:
    """conv_id, part (from 0), n_turns (of the whole conversation), text: one row a conversation and stretch of turns."""
    empty = F.lit("")
    line = F.concat(F.lit("<|"), F.coalesce("role", empty), F.lit("|>\n"), F.coalesce("text", empty), F.lit("\n<|end|>\n"))
    turns = numbered.join(chosen.select(F.col("conv_id").alias("k"), "n_turns"), F.col("conv_id").eqNullSafe(F.col("k")))
    parts = turns.groupBy("conv_id", "part", "n_turns").agg(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))).alias("lines"))
    text = F.concat_ws("", F.transform("lines", lambda x: x["line"]))
    order = Window.partitionBy("conv_id").orderBy("part")
    return parts.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("part"), F.col("n_turns").cast("long").alias("n_turns"), text.alias("text"))


def format_chats(turns: DataFrame) -> DataFrame:
    numbered = cut_lineage(numbered_turns(turns))  # read three times
    return render(numbered, maximal_conversations(numbered))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(read_table(spark, sf_dir, "conversations"))


SQL = rf"""
with t as (
  select conv_id, role, text, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as pos,
    coalesce(floor(turn / {STRETCH}), -1e18) as part
  from conversations),
c as (
  select conv_id, count(*) as n_turns, list({{'r': role, 'x': text}} order by pos) as body from t group by conv_id),
p as (select distinct body[1:k] as body from (select body, unnest(range(1, n_turns)) as k from c)),
kept as (
  select min(conv_id) as conv_id, any_value(n_turns) as n_turns from c where not exists (select 1 from p where p.body = c.body) group by body)
select t.conv_id, (dense_rank() over (partition by t.conv_id order by t.part) - 1)::bigint as part, n_turns::bigint as n_turns,
  string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10), '' order by pos) as text
from t join kept on t.conv_id is not distinct from kept.conv_id
group by t.conv_id, t.part, n_turns
"""
