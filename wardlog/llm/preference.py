"""Preference pairs as one prompt and two masked completions (operator 5), DataFrame functions only.

A pair names a chosen and a rejected conversation. The turns that both begin with are rendered once as the
prompt; what follows is rendered per side as its completion, with the spans that are trained on: the texts of
the assistant's turns. Grouping is by conversation, so no group is larger than a conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardlog.llm.common import query, table

TRAINED_ROLES = ("assistant",)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): roles and texts in order; equal turn numbers are ordered by role and text."""
    clean = turns.where("conv_id is not null").select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return clean.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def _rendered(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE)))


def _spans(turns: Column) -> Column:
    """Start and length (code points) of each trained text in the rendered turns."""
    lead = lambda t: F.length(t["role"]) + len(OPEN) + 1
    whole = lambda t: lead(t) + F.length(t["text"]) + len(CLOSE)
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        span = F.struct((state["at"] + lead(t)).alias("start"), F.length(t["text"]).alias("length"))
        spans = F.when(t["role"].isin(*TRAINED_ROLES), F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((state["at"] + whole(t)).alias("at"), spans.alias("spans"))

    return F.aggregate(turns, nothing, step, lambda state: state["spans"])


def format_pairs(chosen: DataFrame, rejected: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per row of `pairs` (pair_id, chosen_id, rejected_id) whose conversations both exist.

    `chosen` and `rejected` hold turns (conv_id, turn, role, text). Columns: pair_id, prompt_turns, prompt, chosen,
    rejected, chosen_spans and rejected_spans (trained code points of the completions), distinct (the sides differ).
    Turns are compared by role and text; null ones count as empty. Turns without a conversation id belong
    to none. Equal sides are all prompt; a side that is a prefix of the other has an empty completion. Other
    columns are ignored; an empty table gives an empty result.
    """
    left = conversations(chosen).select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("c"))
    right = conversations(rejected).select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("r"))
    both = pairs.select("pair_id", "chosen_id", "rejected_id").join(left, "chosen_id").join(right, "rejected_id")
    same = F.zip_with("c", "r", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    split = both.select("pair_id", "c", "r", same.alias("same")).select(
        "pair_id", "c", "r", F.when(F.array_position("same", F.lit(False)) == 0, F.size("same")).otherwise(
            F.array_position("same", F.lit(False)) - 1).cast("int").alias("n"))
    rest = lambda side: F.slice(side, F.col("n") + 1, F.greatest(F.size(side) - F.col("n"), F.lit(0)))
    parts = split.select("pair_id", "n", F.slice("c", F.lit(1), F.col("n")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    text = lambda side: F.array_join(_rendered(F.col(side)), "")
    return parts.select(
        "pair_id", F.col("n").cast("bigint").alias("prompt_turns"), text("p").alias("prompt"), text("c").alias("chosen"),
        text("r").alias("rejected"), _spans(F.col("c")).alias("chosen_spans"), _spans(F.col("r")).alias("rejected_spans"),
        ((F.size("c") > 0) | (F.size("r") > 0)).alias("distinct"))


def with_swapped_reply(turns: DataFrame) -> DataFrame:
    """Each conversation with its last assistant turn answered by its neighbour's (ids 0 and 1, 2 and 3, ...).

    A plain source of rejected sides where a table holds single conversations: an answer to another question.
    Without a neighbour the answer is empty; conversations without an assistant turn stay as they are.
    """
    last = turns.where("role = 'assistant' and conv_id is not null").groupBy("conv_id").agg(
        F.max(F.struct("turn", "text")).alias("last"))
    answers = last.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("last.text").alias("other"))
    marks = last.select("conv_id", F.col("last.turn").alias("last_turn")).join(answers, "conv_id", "left")
    swap = (F.col("turn") == F.col("last_turn")) & (F.col("role") == "assistant")
    return turns.join(marks, "conv_id", "left").select(
        "conv_id", "turn", "role", F.when(swap, F.coalesce("other", F.lit(""))).otherwise(F.col("text")).alias("text"))


_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
last AS (
  SELECT conv_id, max(turn) AS last_turn, max_by(text, struct_pack(turn, text)) AS own FROM turns WHERE role = 'assistant' GROUP BY conv_id),
marks AS (SELECT a.conv_id, a.last_turn, coalesce(b.own, '') AS other FROM last a LEFT JOIN last b ON b.conv_id = xor(a.conv_id, 1)),
swapped AS (
  SELECT t.conv_id, turn, role, CASE WHEN turn = last_turn AND role = 'assistant' THEN other ELSE text END AS text
  FROM turns t LEFT JOIN marks m ON m.conv_id = t.conv_id),
c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM turns),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM swapped),
cut AS (
  SELECT c.conv_id, coalesce(min(c.k) FILTER (WHERE c.role <> r.role OR c.text <> r.text), max(c.k) + 1) AS k
  FROM c JOIN r ON r.conv_id = c.conv_id AND r.k = c.k GROUP BY c.conv_id),
sides AS (
  SELECT 'c' AS side, * FROM c UNION ALL SELECT 'r', * FROM r),
rendered AS (
  SELECT s.side, s.conv_id, s.k, s.k < cut.k AS shared, role, text,
    '{OPEN}' || role || chr(10) || text || '<|im_end|>' || chr(10) AS line
  FROM sides s JOIN cut ON cut.conv_id = s.conv_id),
placed AS (
  SELECT *, coalesce(sum(length(line)) OVER (PARTITION BY side, conv_id, shared ORDER BY k
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(role) + {len(OPEN) + 1} AS start FROM rendered),
joined AS (
  SELECT conv_id, count(*) FILTER (WHERE side = 'c' AND shared) AS prompt_turns,
    coalesce(string_agg(line, '' ORDER BY k) FILTER (WHERE side = 'c' AND shared), '') AS prompt,
    coalesce(string_agg(line, '' ORDER BY k) FILTER (WHERE side = 'c' AND NOT shared), '') AS chosen,
    coalesce(string_agg(line, '' ORDER BY k) FILTER (WHERE side = 'r' AND NOT shared), '') AS rejected,
    coalesce(list({{'start': CAST(start AS INTEGER), 'length': CAST(length(text) AS INTEGER)}} ORDER BY k)
      FILTER (WHERE side = 'c' AND NOT shared AND role = 'assistant'), []) AS cs,
    coalesce(list({{'start': CAST(start AS INTEGER), 'length': CAST(length(text) AS INTEGER)}} ORDER BY k)
      FILTER (WHERE side = 'r' AND NOT shared AND role = 'assistant'), []) AS rs,
    bool_or(NOT shared) AS "distinct"
  FROM placed GROUP BY conv_id)
SELECT conv_id AS pair_id, CAST(prompt_turns AS BIGINT) AS prompt_turns, prompt, chosen, rejected, "distinct",
  list_transform(cs, lambda x: CAST(x.start AS VARCHAR) || '+' || CAST(x.length AS VARCHAR)) AS chosen_spans,
  list_transform(rs, lambda x: CAST(x.start AS VARCHAR) || '+' || CAST(x.length AS VARCHAR)) AS rejected_spans
FROM joined"""


@query("op5_preference_pairs", _SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    pairs = turns.where("conv_id is not null").select(
        F.col("conv_id").alias("pair_id"), F.col("conv_id").alias("chosen_id"), F.col("conv_id").alias("rejected_id")).distinct()
    said = lambda spans: F.transform(spans, lambda x: F.concat(x["start"].cast("string"), F.lit("+"), x["length"].cast("string")))
    return format_pairs(turns, with_swapped_reply(turns), pairs).withColumns(
        {"chosen_spans": said("chosen_spans"), "rejected_spans": said("rejected_spans")})
