"""Preference formatting: one prompt and two masked completions for each pair of conversations.

Only DataFrame functions. Turns of both sides meet by their number in one aggregation; the first number at which they differ ends
the common prefix. What comes before is rendered once as the prompt, the rest as the chosen and the rejected completion. A
conversation stays a row per turn, with the place of each piece in its part, so no conversation has to fit a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, AFTER_ROLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
LEARN = "assistant"
#: Parts, and the side that has their turns.
PARTS = {"prompt": "chosen", "chosen": "chosen", "rejected": "rejected"}
#: Turns whose pieces one window places; their totals are placed by a second.
BLOCK = 256


def _clean(c: Column) -> Column:
    """Markers inside a text or role lose their meaning."""
    return F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("< |"))


def format_pairs(turns: DataFrame) -> DataFrame:
    """turns: pair_id, side (``chosen`` or ``rejected``), turn, role, text. One row per rendered turn:

    pair_id, part (``prompt``, ``chosen``, ``rejected``), turn, role, piece, start and length (characters in its part), and
    loss_start and loss_length: what of the piece is learned, the text and end of assistant turns of completions, else nothing.

    Turns go by their number. Of rows that share pair, side and number the smallest (role, text) counts. Rows without pair_id or
    turn, or of another side, have no place and give nothing. A null role or text is empty, and equal to a null one on the other side. A
    side without turns leaves the other one a completion without prompt; equal sides are all prompt. An empty table gives no
    rows; other columns aren't read.
    """
    said = F.struct(_clean(F.col("role")).alias("role"), _clean(F.col("text")).alias("text"))
    rows = turns.select(F.col("pair_id").cast("long"), "side", F.col("turn").cast("long"), said.alias("said")).where("pair_id is not null and turn is not null and side in ('chosen', 'rejected')")
    # texts move once, to the block of turns they belong to; whatever follows keeps that partitioning and brings small tables to it
    keys = ["pair_id", "block"]
    met = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(0))).repartition(*keys).groupBy(*keys, "turn").agg(*(F.min(F.when(F.col("side") == s, F.col("said"))).alias(s) for s in ("chosen", "rejected")))
    met = met.withColumn("differs", ~F.col("chosen").eqNullSafe(F.col("rejected")))
    width = lambda side: (F.length(F.col(f"{side}.role")) + F.length(F.col(f"{side}.text")) + len(OPEN + AFTER_ROLE + CLOSE)).cast("long")
    small = met.select(*keys, "turn", "differs", width("chosen").alias("chosen"), width("rejected").alias("rejected"))
    # by block: its first turn that differs, and what its turns before and from there on add up to
    at = small.groupBy(*keys).agg(F.min(F.when(F.col("differs"), F.col("turn"))).alias("own"))
    ends = at.groupBy("pair_id").agg(F.min("own").alias("parts_at"))
    common = F.coalesce(F.col("turn") < F.col("parts_at"), F.lit(True))
    of = {p: F.coalesce(F.when(common == (p == "prompt"), F.col(c)), F.lit(0)) for p, c in PARTS.items()}
    blocks = small.join(ends, "pair_id").groupBy(*keys, "parts_at").agg(*(F.sum(w).alias(f"{p}_all") for p, w in of.items()))
    ahead = Window.partitionBy("pair_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*keys, "parts_at", *(F.coalesce(F.sum(f"{p}_all").over(ahead), F.lit(0)).alias(f"{p}_before") for p in PARTS))
    placed = met.withColumns({f"{c}_width": width(c) for c in ("chosen", "rejected")}).join(blocks, keys)
    inside = Window.partitionBy(*keys).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    own = {p: F.coalesce(F.when(common == (p == "prompt"), F.col(f"{c}_width")), F.lit(0)) for p, c in PARTS.items()}
    placed = placed.select("pair_id", "turn", "chosen", "rejected", common.alias("common"), *((F.col(f"{p}_before") + F.coalesce(F.sum(w).over(inside), F.lit(0))).alias(f"{p}_start") for p, w in own.items()))
    said_at = F.array(*(F.struct(F.lit(p).alias("part"), F.when(F.col("common") == (p == "prompt"), F.col(c)).alias("said"), F.col(f"{p}_start").alias("start")) for p, c in PARTS.items()))
    pieces = placed.select("pair_id", "turn", F.explode(F.filter(said_at, lambda x: x["said"].isNotNull())).alias("p")).select("pair_id", "turn", "p.part", "p.start", "p.said.role", "p.said.text")
    head = F.concat(F.lit(OPEN), F.col("role"), F.lit(AFTER_ROLE))
    pieces = pieces.select("pair_id", "part", "turn", "role", F.concat(head, F.col("text"), F.lit(CLOSE)).alias("piece"), F.length(head).cast("long").alias("head_length"), "start").withColumn("length", F.length("piece").cast("long"))
    learn = (F.col("part") != "prompt") & (F.col("role") == LEARN)
    return pieces.select(
        "pair_id", "part", "turn", "role", "piece", "start", "length",
        F.when(learn, F.col("head_length")).otherwise(F.lit(0)).alias("loss_start"), F.when(learn, F.col("length") - F.col("head_length")).otherwise(F.lit(0)).alias("loss_length"),
    )


def pair_answers(conversations: DataFrame) -> DataFrame:
    """Pairs whose sides share all but their end: turns of conversation i up to its last answer, and the same with the last answer of
    conversation i + 1 in its place, as pair i.

    An answer is a turn of an assistant; of several rows of the last one's number the largest text counts. Conversations without an
    answer, or whose successor has none, make no pair; nor do rows without conv_id or turn. Null texts are empty.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("pair_id"), F.col("turn").cast("long"), "role", "text").where("pair_id is not null and turn is not null")
    last = rows.where(F.col("role") == LEARN).groupBy("pair_id").agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("last"))
    other = last.select((F.col("pair_id") - 1).alias("pair_id"), F.col("last.text").alias("other"))
    pairs = last.select("pair_id", F.col("last.turn").alias("last_turn")).join(other, "pair_id")
    both = rows.join(pairs, "pair_id").where(F.col("turn") <= F.col("last_turn"))
    ends = F.col("turn") == F.col("last_turn")
    sides = F.array(F.struct(F.lit("chosen").alias("side"), F.col("role").alias("role"), F.col("text").alias("text")), F.struct(F.lit("rejected").alias("side"), F.when(ends, F.lit(LEARN)).otherwise(F.col("role")).alias("role"), F.when(ends, F.col("other")).otherwise(F.col("text")).alias("text")))
    return both.select("pair_id", "turn", F.explode(sides).alias("s")).select("pair_id", "s.side", "turn", "s.role", "s.text")


SQL = """
WITH r AS (SELECT CAST(conv_id AS BIGINT) AS pair_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
l AS (SELECT pair_id, max({'turn': turn, 'text': coalesce(text, '')}) AS last FROM r WHERE role = 'assistant' GROUP BY ALL),
v AS (SELECT r.*, l.last.turn AS last_turn, n.last.text AS other FROM r JOIN l USING (pair_id) JOIN l n ON n.pair_id = r.pair_id + 1 WHERE r.turn <= l.last.turn),
t AS (
  SELECT pair_id, true AS is_chosen, turn, {'role': replace(coalesce(role, ''), '<|', '< |'), 'text': replace(coalesce(text, ''), '<|', '< |')} AS said FROM v
  UNION ALL SELECT pair_id, false, turn, {'role': CASE WHEN turn = last_turn THEN 'assistant' ELSE replace(coalesce(role, ''), '<|', '< |') END,
    'text': replace(coalesce(CASE WHEN turn = last_turn THEN other ELSE text END, ''), '<|', '< |')} FROM v),
m AS (SELECT pair_id, turn, min(said) FILTER (is_chosen) AS c, min(said) FILTER (NOT is_chosen) AS r FROM t GROUP BY ALL),
e AS (SELECT pair_id, min(turn) AS parts_at FROM m WHERE c IS DISTINCT FROM r GROUP BY ALL),
b AS (SELECT m.*, coalesce(turn < parts_at, true) AS common FROM m LEFT JOIN e USING (pair_id)),
p AS (SELECT pair_id, 'prompt' AS part, turn, c AS s FROM b WHERE common
      UNION ALL SELECT pair_id, 'chosen', turn, c FROM b WHERE NOT common AND c IS NOT NULL
      UNION ALL SELECT pair_id, 'rejected', turn, r FROM b WHERE NOT common AND r IS NOT NULL),
q AS (SELECT pair_id, part, turn, s.role AS role, '<|im_start|>' || s.role || chr(10) AS head, s.text AS text FROM p),
w AS (SELECT pair_id, part, turn, role, head || text || '<|im_end|>' || chr(10) AS piece, length(head) AS h FROM q)
SELECT pair_id, part, turn, role, piece,
       CAST(coalesce(sum(length(piece)) OVER (PARTITION BY pair_id, part ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
       CAST(length(piece) AS BIGINT) AS length,
       CAST(CASE WHEN part <> 'prompt' AND role = 'assistant' THEN h ELSE 0 END AS BIGINT) AS loss_start,
       CAST(CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length(piece) - h ELSE 0 END AS BIGINT) AS loss_length
FROM w
"""
