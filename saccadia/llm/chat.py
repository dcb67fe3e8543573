"""Chat formatting: logged snapshots that a longer conversation continues collapse, the others become training text.

A turn's hash is keyed by its position; the hash of a prefix is the running XOR of its turns, so it rolls from turn to
turn. A conversation whose hash is that of a proper prefix of another one goes by an anti-join, and so do all but the
first of equal ones. Both sides hold each hash once, so a first turn that every conversation shares is one row. Everything
is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turn markers of the rendered text.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _turns(conversations: DataFrame) -> DataFrame:
    """Every turn with its position, the hashes of the prefix it ends, and the number of turns."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = rows.withColumn("position", F.row_number().over(order))
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for k in (1, 2):
        placed = placed.withColumn(f"h{k}", F.bit_xor(F.xxhash64(F.lit(k), "position", "role", "text")).over(running))
    return placed.withColumn("turns", F.count("*").over(Window.partitionBy("conv_id")))


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_copies) of the conversations that no longer one continues; of equal ones the smallest conv_id."""
    turns = _turns(conversations).select("conv_id", "position", "turns", "h1", "h2")
    whole = (turns.filter("position = turns").groupBy("position", "h1", "h2")
             .agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies")))
    prefixes = turns.filter("position < turns").select("position", "h1", "h2").distinct()
    return whole.join(prefixes, ["position", "h1", "h2"], "left_anti").select("conv_id", "n_copies")


def _rendered() -> Column:
    safe = lambda c: F.replace(c, F.lit("<|im_"), F.lit("<| im_"))
    return F.concat(F.lit(OPEN), safe(F.col("role")), F.lit("\n"), safe(F.col("text")), F.lit(CLOSE + "\n"))


def render(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, text) of every maximal conversation, its turns in order between markers.

    Turns are ordered by turn, role, text; repeated rows stay as turns. NULL roles and texts are empty, a NULL turn comes
    first, rows without conv_id are one conversation. Markers inside texts are broken up by a space. One conversation is
    one row of output, so its turns meet in one task, whose sort spills.
    """
    keep = maximal_conversations(conversations)
    turns = _turns(conversations).select(F.col("conv_id").alias("id"), "position", _rendered().alias("piece"))
    joined = turns.join(keep, turns["id"].eqNullSafe(keep["conv_id"]))
    return (joined.groupBy("id").agg(F.count("*").alias("n_turns"), F.first("n_copies").alias("n_copies"),
                                     F.sort_array(F.collect_list(F.struct("position", "piece"))).alias("pieces"))
            .select(F.col("id").alias("conv_id"), "n_turns", "n_copies", F.array_join("pieces.piece", "").alias("text")))


#: The same with plain strings instead of hashes.
SQL = f"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations),
p as (select *, row_number() over w as position, count(*) over (partition by conv_id) as turns,
  string_agg(role || chr(31) || text, chr(30)) over (partition by conv_id order by turn, role, text rows unbounded preceding) as prefix
  from t window w as (partition by conv_id order by turn, role, text)),
whole as (select prefix, min(conv_id) as conv_id, count(*) as n_copies from p where position = turns group by prefix),
keep as (select conv_id, n_copies from whole where prefix not in (select prefix from p where position < turns))
select p.conv_id, count(*) as n_turns, any_value(n_copies) as n_copies,
  string_agg('{OPEN}' || replace(role, '<|im_', '<| im_') || chr(10) || replace(text, '<|im_', '<| im_') || '{CLOSE}' || chr(10), '' order by position) as text
from p join keep on p.conv_id = keep.conv_id group by p.conv_id
"""
