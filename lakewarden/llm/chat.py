"""Multi-party perspective rotation: each dialogue is rendered once for every participant, with that speaker as the assistant
and the others as named users, and with a mask that trains on the speaker's own words only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import quoted, table

NARRATOR = "system"
OWN_HEAD = "<|assistant|>\n"


def rotate(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", narrator: str = NARRATOR, turns_per_row: int | None = None,
) -> DataFrame:
    """One row for each conversation and participant (`perspective`): conv_col, perspective, part, rendered, n_turns, spans
    array<struct<start, end>> (the mask: the code points of rendered that are trained on, end exclusive), n_train_chars.

    A turn is rendered as "<|role name=NAME|>\\nTEXT<|end|>\\n", with the role assistant for the perspective's own turns (no
    name), user for the others, system for the narrator's, who is no participant. The mask covers TEXT<|end|> of own turns. A
    marker's "<|" inside a text or a name is written "<\\u200b|", and "|>" inside a name "|\\u200b>", so nothing can forge a turn.
    Dialogues are rendered whole, so part is 0. Only if turns_per_row is given is a dialogue cut after every so many turns, in
    order; part numbers the pieces, which hold nothing of those before.
    A null speaker is the participant "unknown"; a null text is empty; a null turn comes first; a null conversation is one
    conversation of its own. Ties in turn go by speaker, then text; repeated rows are kept. Very long texts are rendered whole. A
    conversation with the narrator only gives no rows, nor does an empty table. Other columns are ignored, whatever their names.
    """
    opener = lambda c: F.replace(c, F.lit("<|"), F.lit("<\u200b|"))
    name = F.replace(opener(F.col("who")), F.lit("|>"), F.lit("|\u200b>"))
    head = F.when(F.col("who") == narrator, F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user name="), name, F.lit("|>\n")))
    t = turns.select(
        F.col(quoted(conv_col)).alias("conv"), F.coalesce(F.col(quoted(turn_col)).cast("long"), F.lit(-1).cast("long")).alias("turn"),
        F.coalesce(F.col(quoted(speaker_col)).cast("string"), F.lit("unknown")).alias("who"), F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("text"),
    )
    t = t.withColumn("body", F.concat(opener(F.col("text")), F.lit("<|end|>"))).withColumn("head", head)
    order = ["turn", "who", "text"]
    part = F.lit(0) if turns_per_row is None else F.floor((F.row_number().over(Window.partitionBy("conv").orderBy(*order)) - 1) / turns_per_row)
    t = t.withColumn("part", part.cast("long"))
    # Where a turn starts if everyone is a user, and by how much a speaker's own earlier turns move it from their own side.
    before = Window.partitionBy("conv", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("conv", "part", "who").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    shift = F.lit(len(OWN_HEAD)) - F.length("head")
    size = lambda c: F.length(c).cast("long")
    at = F.coalesce(F.sum(size("head") + size("body") + 1).over(before), F.lit(0)) + F.coalesce(F.sum(shift.cast("long")).over(own), F.lit(0))
    t = t.withColumn("start", at + len(OWN_HEAD)).withColumn("stop", F.col("start") + size("body"))
    # Windows and dialogues are dealt by conversation once. A participant may be silent in a part.
    people = F.collect_set("who") if turns_per_row is None else F.first(F.col("everyone"))
    if turns_per_row is not None:
        t = t.withColumn("everyone", F.collect_set("who").over(Window.partitionBy("conv")))
    turn = F.struct("turn", "who", "text", "head", "body", "start", "stop")
    d = t.groupBy("conv", "part").agg(F.sort_array(F.collect_list(turn)).alias("turns"), people.alias("people"))
    d = d.withColumn("me", F.explode(F.filter("people", lambda x: x != narrator)))
    line = lambda x: F.concat(F.when(x["who"] == F.col("me"), F.lit(OWN_HEAD)).otherwise(x["head"]), x["body"], F.lit("\n"))
    mine = F.transform(F.filter("turns", lambda x: x["who"] == F.col("me")), lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("end")))
    d = d.withColumn("spans", mine)
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    rendered = F.array_join(F.transform("turns", line), "")
    return d.select(F.col("conv").alias(conv_col), F.col("me").alias("perspective"), "part", rendered.alias("rendered"), F.size("turns").cast("long").alias("n_turns"), "spans", n.alias("n_train_chars"))


def op2_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, whole, from each participant's side; the mask as text "start-end" of the trained spans."""
    r = rotate(table(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return r.select("conv_id", "perspective", "rendered", "n_turns", "n_train_chars", mask.alias("train_spans"))


OP2_SQL = rf"""
WITH t AS (SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS who, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, who AS perspective FROM t WHERE who <> '{NARRATOR}'),
x AS (SELECT t.conv_id, p.perspective, turn, who, text, who = perspective AS own,
    CASE WHEN who = perspective THEN '<|assistant|>' || chr(10) WHEN who = '{NARRATOR}' THEN '<|system|>' || chr(10)
      ELSE '<|user name=' || replace(replace(who, '<|', '<' || chr(8203) || '|'), '|>', '|' || chr(8203) || '>') || '|>' || chr(10) END AS head,
    replace(text, '<|', '<' || chr(8203) || '|') || '<|end|>' AS body FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
y AS (SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective ORDER BY turn, who, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS s FROM x)
SELECT conv_id, perspective, string_agg(head || body || chr(10), '' ORDER BY turn, who, text) AS rendered, count(*) AS n_turns,
  coalesce(sum(length(body)) FILTER (WHERE own), 0)::BIGINT AS n_train_chars,
  coalesce(string_agg(s::BIGINT || '-' || (s + length(body))::BIGINT, ',' ORDER BY turn, who, text) FILTER (WHERE own), '') AS train_spans
FROM y GROUP BY conv_id, perspective
"""
