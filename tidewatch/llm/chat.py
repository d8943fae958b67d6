"""Chat formatting with collapse of cumulative snapshots, with SQL functions alone.

A logging service stores a conversation after every turn, so that earlier
snapshots are prefixes of later ones.  Each turn is hashed with its position; the
running XOR of these hashes is the hash of the turn prefix (two seeds, 128 bits).
A conversation whose whole hash is the hash of a shorter prefix of another one is
dropped by an anti-join, equal conversations keep the lowest id, and what remains
is rendered with role markers.

Edge cases: null roles and texts are empty strings; turns are ordered by turn
(nulls first), then role, then text, and repeated rows count as further turns.
Rows with a null conversation id are one conversation.  Markers that occur in a
text are broken up by a space, so that a text can't forge a turn.  Extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _turn(role: Column, text: Column) -> Column:
    safe = lambda c: F.replace(c, F.lit("<|im_"), F.lit("<| im_"))
    return F.concat(F.lit("<|im_start|>"), safe(role), F.lit("\n"), safe(text), F.lit("<|im_end|>\n"))


def turns(conversations: DataFrame) -> DataFrame:
    """Turns with their position ``i``, the prefix hashes ``h1`` and ``h2`` up to them, and the length ``n``."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    by = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("i", F.row_number().over(by))
    for k in (1, 2):
        rows = rows.withColumn(f"x{k}", F.xxhash64(F.lit(f"turn{k}"), "i", "role", "text"))
    upto = Window.partitionBy("conv_id").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select(
        "conv_id", "i", "role", "text", F.bit_xor("x1").over(upto).alias("h1"), F.bit_xor("x2").over(upto).alias("h2"), F.count("*").over(Window.partitionBy("conv_id")).cast("int").alias("n")
    )


def maximal(rows: DataFrame) -> DataFrame:
    """conv_id, n and ``copies`` of the conversations that prefix no longer one; one of equal ones."""
    prefixes = rows.where("i < n").select(F.col("i").alias("n"), "h1", "h2").distinct()
    whole = rows.where("i = n").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    return whole.join(prefixes, ["n", "h1", "h2"], "left_anti").select("conv_id", "n", "copies")


def render(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies and ``rendered`` of each maximal conversation."""
    rows = turns(conversations)
    kept = maximal(rows).withColumnRenamed("conv_id", "kept_id")
    chosen = rows.join(kept.drop("n"), F.col("conv_id").eqNullSafe(F.col("kept_id")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("i", _turn(F.col("role"), F.col("text")).alias("line")))), lambda x: x["line"])
    return chosen.groupBy("conv_id").agg(F.max("n").cast("long").alias("n_turns"), F.max("copies").alias("copies"), F.array_join(lines, "").alias("rendered"))


ORACLE = """
with t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as i,
         count(*) over (partition by conv_id) as n
  from conversations
), r as (
  select conv_id, i, n,
         string_agg('<|im_start|>' || replace(role, '<|im_', '<| im_') || chr(10) || replace(text, '<|im_', '<| im_') || '<|im_end|>' || chr(10), '')
           over (partition by conv_id order by i rows between unbounded preceding and current row) as rendered
  from t
), whole as (
  select rendered, min(conv_id) as conv_id, count(*) as copies, max(n) as n_turns from r where i = n group by rendered
)
select conv_id, n_turns, copies, rendered
from whole
where not exists (select 1 from r where r.i < r.n and r.rendered = whole.rendered)
"""
