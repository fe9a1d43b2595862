"""Preference formatting: one prompt, two masked completions.

The longest common prefix of turns of the chosen and the rejected conversation is rendered once as the prompt; what
follows in each is its completion. A mask lists the spans, in code points of prompt + completion, that a loss counts:
the assistant's texts with their end marks, in the completions only.

Defined results: null roles and texts are empty; equal conversations have empty completions; a conversation without
turns renders as nothing; marks inside texts are broken up, so a text can't open or close a turn; turns are ordered by
turn, role and text, nulls first, and repeated rows are repeated turns; rows without a conversation id are in none; an
empty table gives no rows. A conversation is one row of the result, so its turns are gathered; nothing larger is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def turns_of(rows: DataFrame) -> DataFrame:
    """conv_id, turns (array of role and text) from rows conv_id, turn, role, text."""
    clean = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    one = F.struct(F.col("turn").cast("long").alias("turn"), clean("role").alias("role"), clean("text").alias("text"))
    found = rows.where(F.col("conv_id").isNotNull()).groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(one), lambda a, b: F.when(_less(a, b), -1).when(_less(b, a), 1).otherwise(0)).alias("turns"))
    return found.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))


def _less(a: Column, b: Column) -> Column:
    """a before b by turn (null first), role, text."""
    first, second = (F.coalesce(x["turn"], F.lit(-(2**63))) for x in (a, b))
    return (first < second) | ((first == second) & ((a["role"] < b["role"]) | ((a["role"] == b["role"]) & (a["text"] < b["text"]))))


def _header(t: Column) -> Column:
    return F.concat(F.lit(OPEN), F.replace(t["role"], F.lit("<|"), F.lit("< |")), F.lit("\n"))


def _body(t: Column) -> Column:
    return F.concat(F.replace(t["text"], F.lit("<|"), F.lit("< |")), F.lit(CLOSE))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), _body(t), F.lit("\n"))), "")


def mask(turns: Column, start: Column) -> Column:
    """Spans start:end of the assistant's bodies, comma-joined."""
    begin = F.struct(start.cast("long").alias("at"), F.lit("").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        body = acc["at"] + F.char_length(_header(t))
        end = body + F.char_length(_body(t))
        span = F.concat(F.when(acc["spans"] == "", F.lit("")).otherwise(F.lit(",")), body.cast("string"), F.lit(":"), end.cast("string"))
        return F.struct((end + 1).cast("long").alias("at"), F.when(t["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, begin, step, lambda acc: acc["spans"])


def format_preferences(pairs: DataFrame) -> DataFrame:
    """pairs with chosen and rejected (arrays of role and text) -> other columns, n_prompt_turns, prompt, completions, masks."""
    a, b = F.col("chosen"), F.col("rejected")
    least = F.least(F.size(a), F.size(b))
    differs = F.filter(F.sequence(F.lit(1), F.greatest(least, F.lit(1))), lambda i: (i <= least) & ~F.get(a, i - 1).eqNullSafe(F.get(b, i - 1)))
    counted = pairs.withColumn("n_prompt_turns", F.coalesce(F.get(differs, F.lit(0)) - 1, least).cast("int"))
    n = F.col("n_prompt_turns")
    rest = lambda x: F.slice(x, n + 1, F.greatest(F.size(x) - n, F.lit(0)))
    shown = counted.withColumn("prompt", rendered(F.slice(a, F.lit(1), n)))
    after = F.char_length("prompt")
    kept = [c for c in pairs.columns if c not in ("chosen", "rejected")]
    return shown.select(*kept, "n_prompt_turns", "prompt", rendered(rest(a)).alias("chosen"), rendered(rest(b)).alias("rejected"), mask(rest(a), after).alias("chosen_mask"), mask(rest(b), after).alias("rejected_mask"))


def with_stale_reply(conversations: DataFrame) -> DataFrame:
    """conv_id, chosen, rejected: rejected answers last with the assistant's reply before, or else with the turn before, or else with nothing."""
    turns = F.col("turns")
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(turns), F.lit(1))), lambda i: F.get(turns, i - 1)["role"] == "assistant")
    found = conversations.withColumn("places", places).withColumn("last", F.when(F.size("places") > 0, F.element_at("places", -1)))
    last = F.col("last")
    before = F.when(F.size("places") > 1, F.get(F.col("places"), F.size("places") - 2)).otherwise(last - 1)
    reply = F.coalesce(F.get(turns, before - 1)["text"], F.lit(""))
    other = F.concat(F.slice(turns, F.lit(1), last - 1), F.array(F.struct(F.lit("assistant").alias("role"), reply.alias("text"))), F.slice(turns, last + 1, F.size(turns)))
    return found.select("conv_id", turns.alias("chosen"), F.when(last.isNull(), turns).otherwise(other).alias("rejected"))


def op1_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_preferences(with_stale_reply(turns_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


OP1_SQL = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
lasts AS (
  SELECT conv_id, count(*) AS n, max(p) FILTER (WHERE role = 'assistant') AS l FROM turns GROUP BY conv_id),
befores AS (
  SELECT x.conv_id, x.n, x.l, coalesce((SELECT max(p) FROM turns t WHERE t.conv_id = x.conv_id AND t.role = 'assistant' AND t.p < x.l), x.l - 1) AS b
  FROM lasts x),
sides AS (
  SELECT t.conv_id, t.p, t.role, t.text AS c, CASE WHEN t.p = x.l THEN coalesce(r.text, '') ELSE t.text END AS r, x.n
  FROM turns t JOIN befores x ON x.conv_id = t.conv_id LEFT JOIN turns r ON r.conv_id = x.conv_id AND r.p = x.b),
prefix AS (SELECT conv_id, coalesce(min(p) FILTER (WHERE c <> r) - 1, max(n)) AS k FROM sides GROUP BY conv_id),
parts AS (
  SELECT s.conv_id, s.p, s.role, f.k, '<|im_start|>' || replace(s.role, '<|', '< |') || chr(10) AS h,
         replace(s.c, '<|', '< |') || '<|im_end|>' AS c, replace(s.r, '<|', '< |') || '<|im_end|>' AS r
  FROM sides s JOIN prefix f ON f.conv_id = s.conv_id),
ends AS (
  SELECT *, sum(length(h) + length(c) + 1) OVER w - 1 AS ce, sum(length(h) + length(r) + 1) OVER w - 1 AS re
  FROM parts WINDOW w AS (PARTITION BY conv_id ORDER BY p))
SELECT conv_id, max(k)::INTEGER AS n_prompt_turns,
       coalesce(string_agg(h || c || chr(10), '' ORDER BY p) FILTER (WHERE p <= k), '') AS prompt,
       coalesce(string_agg(h || c || chr(10), '' ORDER BY p) FILTER (WHERE p > k), '') AS chosen,
       coalesce(string_agg(h || r || chr(10), '' ORDER BY p) FILTER (WHERE p > k), '') AS rejected,
       coalesce(string_agg((ce - length(c))::BIGINT || ':' || ce::BIGINT, ',' ORDER BY p) FILTER (WHERE p > k AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg((re - length(r))::BIGINT || ':' || re::BIGINT, ',' ORDER BY p) FILTER (WHERE p > k AND role = 'assistant'), '') AS rejected_mask
FROM ends GROUP BY conv_id
"""
