"""Chat formatting after the collapse of cumulative snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, small, written

#: Marks of the rendered form, and what stands for them inside a text.
START, END = "<|im_start|>", "<|im_end|>"
SAFE_START, SAFE_END = "<|im_start |>", "<|im_end |>"
ROLE = "user"


def maximal_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns array of (turn, role, text)) of the conversations that are no proper prefix of a longer one; of equal ones the least conv_id."""
    each = turns.where(col(conv_col).isNotNull()).select(col(conv_col).alias("conv_id"), col(turn_col).alias("turn"), F.coalesce(col(role_col), F.lit(ROLE)).alias("role"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = each.select("conv_id", F.row_number().over(order).alias("k"), F.count("*").over(Window.partitionBy("conv_id")).alias("n"), "turn", "role", "text")
    # the hash after each turn rolls on from the one before: the turn's own, which its place goes into, is added to it
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rolled = [F.bit_xor(F.xxhash64(F.lit(seed), "k", F.length("role"), "role", "text")).over(so_far).alias(f"h{seed}") for seed in (1, 2)]
    prefixes = written(numbered.withColumns(dict(zip(("h1", "h2"), rolled, strict=True))).select("conv_id", "k", "n", "h1", "h2"), "chat-prefixes")
    key = ["k", "h1", "h2"]
    whole = prefixes.where("k = n").groupBy(*key).agg(F.min("conv_id").alias("conv_id"))
    kept = whole.join(prefixes.where("k < n").select(*key), key, "left_anti").select("conv_id")
    said = each.join(small(written(kept, "chat-kept"), 40), "conv_id", "left_semi")
    return said.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, n_turns, rendered) of each maximal conversation.

    A conversation's turns are ordered by turn (null first), role and text. Rolling 128-bit hashes over its turns
    stand for its prefixes; a conversation whose whole is a proper prefix of another is a snapshot and goes, and
    of conversations with the same turns the least conv_id stays. Only role and text are compared, not the turn's number.
    A null role counts as "user", a null text as empty; an empty text is a turn. Rows with a null conv_id belong to no
    conversation. Repeated rows are turns of their own. An empty table gives no rows. Other columns play no part; texts
    are rendered whole. Marks of the format inside a role or text get a space, so that they can't end a turn.
    """
    said = "concat({0!r}, {1}, chr(10), {2}, {3!r}, chr(10))"
    safe = "replace(replace({0}, '" + START + "', '" + SAFE_START + "'), '" + END + "', '" + SAFE_END + "')"
    one = said.format(START, safe.format("t.role"), safe.format("t.text"), END)
    whole = f"array_join(transform(turns, t -> {one}), '')"
    return maximal_conversations(turns, conv_col, turn_col, role_col, text_col).select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.expr(whole).alias("rendered"))


CHAT_SQL = f"""
WITH logged AS (
  SELECT conv_id, list({{'turn': turn, 'role': coalesce(role, '{ROLE}'), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, '{ROLE}'), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
prefixes AS (
  SELECT conv_id, len(turns) AS n, k, array_to_string(list_transform(turns[1:k], lambda t: length(t.role) || ':' || t.role || length(t.text) || ':' || t.text), '') AS said
  FROM logged, LATERAL (SELECT unnest(range(1, len(turns) + 1)) AS k)),
whole AS (SELECT conv_id, said FROM prefixes WHERE k = n),
kept AS (SELECT min(conv_id) AS conv_id FROM whole WHERE said NOT IN (SELECT said FROM prefixes WHERE k < n) GROUP BY said)
SELECT conv_id, len(turns)::BIGINT AS n_turns,
       array_to_string(list_transform(turns, lambda t: '{START}' || replace(replace(t.role, '{START}', '{SAFE_START}'), '{END}', '{SAFE_END}') || chr(10) || replace(replace(t.text, '{START}', '{SAFE_START}'), '{END}', '{SAFE_END}') || '{END}' || chr(10)), '') AS rendered
FROM logged JOIN kept USING (conv_id)
"""
