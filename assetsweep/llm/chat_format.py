"""Preference formatting of chat pairs.

A pair is a chosen and a rejected conversation.  The longest common prefix of their turns is rendered once
as the prompt; the turns after it are rendered as two completions, each with a mask: the spans (code
points, end exclusive) of assistant content with its end mark, which are trained on.  All else is masked.

Turns are rendered as ``<|im_start|>role\\ncontent<|im_end|>\\n``.  A ``<|`` inside a role or content
becomes ``< |``, so no text can forge a mark.

Plan: DataFrame functions only.  One shuffle gathers the turns of a conversation (equal rows are dropped
before it by the map side of ``collect_set``); prefix, rendering and masks are computed inside the row.
A conversation is one row of the result, so it must fit in one; nothing is gathered over conversations.

Defined cases: rows without a conv_id belong to no conversation; equal rows count once; turns are ordered
by turn (nulls first), role, text; a null role or text is empty; equal conversations give empty
completions; ``usable`` says that the completions differ and both have something to train on; an empty
table gives an empty result; only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"


def gather_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id and its sorted ``turns`` (turn, role, text)."""
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                   F.coalesce(F.col(text), F.lit("")).alias("text"))
    d = turns.select(F.col(conv_id).alias("conv_id"), one.alias("t")).where("conv_id is not null")
    return d.groupBy("conv_id").agg(F.sort_array(F.collect_set("t")).alias("turns"))


def cut_reply(gathered: DataFrame) -> DataFrame:
    """Pairs from single conversations: the rejected side ends with the first half of one of the replies.

    A hash of conv_id chooses the assistant turn, so the sides part anywhere in a conversation.  A conversation
    without an assistant turn is paired with itself.
    """
    replies = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == TRAINED, i + 1)), lambda i: i.isNotNull())
    draw = F.conv(F.substring(F.sha2(F.col("conv_id").cast("string"), 256), 1, 8), 16, 10).cast("long")
    d = gathered.withColumn("replies", replies)
    d = d.withColumn("last", F.get("replies", (draw % F.nullif(F.size("replies"), F.lit(0))).cast("int")))
    d = d.withColumn("reply", F.get("turns", F.col("last") - 1))
    words = F.split(F.col("reply.text"), " ")
    half = F.array_join(F.slice(words, 1, F.floor(F.size(words) / 2).cast("int")), " ")
    cut = F.struct(F.col("reply.turn").alias("turn"), F.col("reply.role").alias("role"), half.alias("text"))
    parted = F.concat(F.slice("turns", 1, F.col("last") - 1), F.array(cut))
    return d.select("conv_id", F.col("turns").alias("chosen"), F.when(F.col("last").isNull(), F.col("turns")).otherwise(parted).alias("rejected"))


def _safe(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def _head(t: Column) -> Column:
    return F.concat(F.lit(START), _safe(t["role"]), F.lit("\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _safe(t["text"]), F.lit(END + "\n"))), "")


def mask(turns: Column) -> Column:
    """Trained spans as ``start:end``, comma-joined."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a, t):
        start = a["at"] + F.length(_head(t))
        end = start + F.length(_safe(t["text"])) + len(END)
        span = F.concat_ws(":", start.cast("string"), end.cast("string"))
        return F.struct((end + 1).alias("at"),
                        F.when(t["role"] == TRAINED, F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))
    return F.aggregate(turns, begin, step, lambda a: F.array_join(a["out"], ","))


def format_pairs(pairs: DataFrame, pair_id: str = "conv_id") -> DataFrame:
    """``pairs`` has the sorted turns of both sides as arrays ``chosen`` and ``rejected``."""
    same = lambda i: ((F.get(F.col("chosen"), i)["role"] == F.get(F.col("rejected"), i)["role"])
                      & (F.get(F.col("chosen"), i)["text"] == F.get(F.col("rejected"), i)["text"]))
    shorter = F.least(F.size("chosen"), F.size("rejected"))
    at = F.when(shorter > 0, F.sequence(F.lit(0), shorter - 1)).otherwise(F.array().cast("array<int>"))
    d = pairs.withColumn("at", F.filter(at, lambda i: ~same(i)))
    d = d.withColumn("n_prompt_turns", F.coalesce(F.array_min("at"), shorter))
    rest = lambda side: F.slice(side, F.col("n_prompt_turns") + 1, F.greatest(F.lit(0), F.size(side) - F.col("n_prompt_turns")))
    d = d.withColumns({"c": rest("chosen"), "r": rest("rejected"), "p": F.slice("chosen", 1, F.col("n_prompt_turns"))})
    out = d.select(
        pair_id, F.col("n_prompt_turns").cast("long").alias("n_prompt_turns"), rendered(F.col("p")).alias("prompt"),
        rendered(F.col("c")).alias("chosen"), mask(F.col("c")).alias("chosen_mask"),
        rendered(F.col("r")).alias("rejected"), mask(F.col("r")).alias("rejected_mask"))
    return out.withColumn("usable", (F.col("chosen") != F.col("rejected")) & (F.col("chosen_mask") != "") & (F.col("rejected_mask") != ""))


# The same pairs for DuckDB, turn by turn.
SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL GROUP BY ALL
), c AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM t
), l AS (
  SELECT conv_id, list(i ORDER BY i) FILTER (role = 'assistant') AS replies FROM c GROUP BY conv_id
), x AS (
  SELECT conv_id, replies[1 + ('0x' || sha256(conv_id::VARCHAR)[1:8])::BIGINT % len(replies)] AS last FROM l
), sides AS (
  SELECT conv_id, 'c' AS side, i, role, text FROM c
  UNION ALL
  SELECT conv_id, 'r', i, role, CASE WHEN last IS NULL OR i < last THEN text ELSE
    array_to_string(string_split(text, ' ')[1:len(string_split(text, ' ')) // 2], ' ') END
  FROM c JOIN x USING (conv_id) WHERE last IS NULL OR i <= last
), cmp AS (
  SELECT conv_id, i, count(*) AS n, count(DISTINCT (role, text)) AS d FROM sides GROUP BY conv_id, i
), pre AS (
  SELECT conv_id, least(coalesce(min(i) FILTER (n < 2 OR d > 1) - 1, max(i)), max(i))::BIGINT AS k FROM cmp GROUP BY conv_id
), seg AS (
  SELECT b.conv_id, CASE WHEN i <= k THEN 'p' ELSE side END AS part, i, role,
         '<|im_start|>' || replace(role, '<|', '< |') || chr(10) AS head, replace(text, '<|', '< |') AS body
  FROM sides b JOIN pre USING (conv_id) WHERE i > k OR side = 'c'
), pos AS (
  SELECT *, head || body || '<|im_end|>' || chr(10) AS s,
         coalesce(sum(length(head) + length(body) + 11) OVER (PARTITION BY conv_id, part ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
           + length(head) AS a
  FROM seg
), o AS (
  SELECT conv_id, part, string_agg(s, '' ORDER BY i) AS s,
         coalesce(string_agg(a::BIGINT::VARCHAR || ':' || (a + length(body) + 10)::BIGINT::VARCHAR, ',' ORDER BY i) FILTER (role = 'assistant'), '') AS m
  FROM pos GROUP BY conv_id, part
)
SELECT pre.conv_id, k AS n_prompt_turns, coalesce(p.s, '') AS prompt, coalesce(c.s, '') AS chosen, coalesce(c.m, '') AS chosen_mask,
       coalesce(r.s, '') AS rejected, coalesce(r.m, '') AS rejected_mask,
       coalesce(c.s, '') <> coalesce(r.s, '') AND coalesce(c.m, '') <> '' AND coalesce(r.m, '') <> '' AS usable
FROM pre LEFT JOIN o p ON p.conv_id = pre.conv_id AND p.part = 'p'
LEFT JOIN o c ON c.conv_id = pre.conv_id AND c.part = 'c' LEFT JOIN o r ON r.conv_id = pre.conv_id AND r.part = 'r'
"""
