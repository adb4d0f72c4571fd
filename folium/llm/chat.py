"""Preference formatting of chat pairs, with DataFrame functions only.

A pair is a chosen and a rejected conversation. The turns that both begin with, compared by role and text, are the
prompt, rendered once; what follows on either side is its completion. Masks say which characters of a completion are
learned: the text and end mark of assistant turns, never headers or other roles' turns.

Defined results: null role and text read as empty; turns go by ``turn`` (null first), then role and text, and repeated rows are
turns of their own; a pair of which one conversation is missing has that side empty and ``status`` tells so; equal conversations
have two empty completions; a null ``conv_id`` is in no pair; an empty table gives no rows; other columns are ignored.
A conversation is a row of the result, so it has to fit in one, like a document's text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>\n"


def _rendered(turns: Column) -> Column:
    return F.concat_ws("", F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit(END))))


def _mask(turns: Column) -> Column:
    """``length:flag`` runs in characters, a header and a body for each turn."""
    head = lambda t: F.concat((F.length(t["role"]) + 5).cast("string"), F.lit(":0"))
    body = lambda t: F.concat((F.length(t["text"]) + len(END)).cast("string"), F.when(t["role"] == "assistant", F.lit(":1")).otherwise(F.lit(":0")))
    return F.concat_ws(" ", F.transform(turns, lambda t: F.concat_ws(" ", head(t), body(t))))


def _turn() -> Column:
    return F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def branched(conversations: DataFrame) -> DataFrame:
    """Pairs from plain ``conversations(conv_id, turn, role, text)``: ``pair_id, c, r``.

    The chosen side is a conversation as it is; the rejected one has its first ``id mod turns`` turns and goes on as its
    neighbour does behind as many (ids 2k and 2k + 1 are neighbours). Without a neighbour there is no rejected side.
    """
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("pair_id"), _turn().alias("x"))
    whole = rows.groupBy("pair_id").agg(F.sort_array(F.collect_list("x")).alias("c"))
    other = whole.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.col("c").alias("o"))
    joined = whole.join(other, "pair_id", "left").withColumn("j", F.pmod("pair_id", F.size("c")).cast("int"))
    r = F.when(F.col("o").isNull(), F.expr("slice(c, 1, 0)")).otherwise(F.concat(F.expr("slice(c, 1, j)"), F.expr("slice(o, j + 1, greatest(size(o) - j, 0))")))
    return joined.select("pair_id", "c", r.alias("r"))


def sides(turns: DataFrame) -> DataFrame:
    """``turns(pair_id, chosen boolean, turn, role, text)`` to ``pair_id, c, r``."""
    rows = turns.where("pair_id is not null").select("pair_id", "chosen", _turn().alias("x"))
    return rows.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.when(F.col("chosen"), F.col("x")))).alias("c"), F.sort_array(F.collect_list(F.when(~F.col("chosen"), F.col("x")))).alias("r"))


def preferences(pairs: DataFrame) -> DataFrame:
    """``pairs(pair_id, c, r)``, the turns of both sides in order, to one row per pair."""
    same = F.zip_with("c", "r", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)).cast("int"))
    shared = pairs.withColumn("first", F.array_position(same, 0)).withColumn("n", F.when(F.col("first") == 0, F.size("c")).otherwise(F.col("first") - 1).cast("int"))
    rest = lambda side: F.expr(f"slice({side}, n + 1, greatest(size({side}) - n, 0))")
    status = F.when(F.size("c") == 0, F.lit("no chosen")).when(F.size("r") == 0, F.lit("no rejected")).when(F.col("first") == 0, F.lit("equal")).otherwise(F.lit("pair"))
    cut = shared.select("pair_id", "n", F.expr("slice(c, 1, n)").alias("p"), rest("c").alias("c"), rest("r").alias("r"), status.alias("status"))
    return cut.select("pair_id", F.col("n").alias("prompt_turns"), _rendered(F.col("p")).alias("prompt"), _rendered(F.col("c")).alias("chosen"), _mask(F.col("c")).alias("chosen_mask"), _rendered(F.col("r")).alias("rejected"), _mask(F.col("r")).alias("rejected_mask"), "status")


ORACLE = """
WITH u AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k,
  count(*) OVER (PARTITION BY conv_id) AS len FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT DISTINCT conv_id, conv_id % len AS j FROM u WHERE xor(CAST(conv_id AS BIGINT), 1::BIGINT) IN (SELECT conv_id FROM u)),
t AS (SELECT conv_id AS pair_id, true AS side, role, text, k FROM u
  UNION ALL SELECT u.conv_id, false, role, text, k FROM u JOIN own USING (conv_id) WHERE k <= j
  UNION ALL SELECT own.conv_id, false, role, text, k FROM own JOIN u ON u.conv_id = xor(CAST(own.conv_id AS BIGINT), 1::BIGINT) WHERE k > j),
m AS (SELECT pair_id, k, count(*) = 2 AND count(DISTINCT role) = 1 AND count(DISTINCT text) = 1 AS same FROM t GROUP BY pair_id, k),
n AS (SELECT pair_id, coalesce(min(CASE WHEN NOT same THEN k END) - 1, max(k)) AS n, bool_and(same) AS equal FROM m GROUP BY pair_id),
w AS (SELECT t.*, n.n, equal, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown,
  (length(role) + 5) || ':0 ' || (length(text) + 8) || CASE WHEN role = 'assistant' THEN ':1' ELSE ':0' END AS mask FROM t JOIN n USING (pair_id))
SELECT pair_id, CAST(any_value(n) AS INTEGER) AS prompt_turns,
  coalesce(string_agg(shown, '' ORDER BY k) FILTER (side AND k <= n), '') AS prompt,
  coalesce(string_agg(shown, '' ORDER BY k) FILTER (side AND k > n), '') AS chosen,
  coalesce(string_agg(mask, ' ' ORDER BY k) FILTER (side AND k > n), '') AS chosen_mask,
  coalesce(string_agg(shown, '' ORDER BY k) FILTER (NOT side AND k > n), '') AS rejected,
  coalesce(string_agg(mask, ' ' ORDER BY k) FILTER (NOT side AND k > n), '') AS rejected_mask,
  CASE WHEN bool_and(side) THEN 'no rejected' WHEN any_value(equal) THEN 'equal' ELSE 'pair' END AS status
FROM w GROUP BY pair_id
"""
