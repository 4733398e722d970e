"""Perspective rotation of conversations with several parties, in DataFrame functions only.

For every participant the dialogue is rendered with that speaker as ``assistant``, everyone else as a
named ``user`` and system turns as ``system``; the mask covers what the chosen speaker says and the
mark that ends it. A rendering is cut into segments of at most ``segment_turns`` turns (their texts
joined are the whole), so a conversation of any length never meets in one row or task: turns are
numbered by buckets of the turn number, whose counts combine on the map side.

Defined cases: turns are ordered by turn number (nulls last), then speaker, then text; a null role is
the speaker ``unknown``; a null text is empty; a null conversation id is a conversation of its own; a
conversation with system turns only has no participant and gives no row; repeated rows are repeated
turns; control marks inside a text or a name are broken by a
space, and line ends inside a name become one. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT_TURNS = 512
BUCKET_TURNS = 256
SYSTEM = "system"
START, END = "<|im_start|>", "<|im_end|>"


def escaped(value: str | Column) -> Column:
    """A string in which nothing reads as a control mark."""
    return F.replace(F.col(value) if isinstance(value, str) else value, F.lit("<|im_"), F.lit("<| im_"))


def turns(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Messages with their position in the conversation, from 0."""
    body = escaped(F.coalesce(F.col(text), F.lit("")))
    rows = df.select(
        F.col(conv).alias("c"),
        F.col(turn).alias("t"),
        F.coalesce(F.col(role), F.lit("unknown")).alias("who"),
        body.alias("body"),
        F.floor(F.col(turn) / BUCKET_TURNS).alias("b"),
    )
    counts = rows.groupBy("c", "b").agg(F.count("*").alias("n"))
    before = Window.partitionBy("c").orderBy(F.col("b").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    counts = counts.select(
        F.col("c").alias("oc"), F.col("b").alias("ob"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off")
    )
    inside = Window.partitionBy("c", "b").orderBy(F.col("t").asc_nulls_last(), "who", "body")
    joined = rows.join(counts, rows["c"].eqNullSafe(counts["oc"]) & rows["b"].eqNullSafe(counts["ob"]))
    return joined.select("c", "who", "body", (F.col("off") + F.row_number().over(inside) - 1).alias("pos"))


def rotate(
    df: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    segment_turns: int = SEGMENT_TURNS,
) -> DataFrame:
    """One row per conversation, participant and segment: ``conv``, ``speaker``, ``segment``,
    ``n_turns``, ``text``, ``mask`` (spans of the text in code points, end exclusive, in order) and
    ``offset`` (where the segment's text begins in the whole rendering)."""
    said = turns(df, conv, turn, role, text)
    people = (
        df.select(F.col(conv).alias("pc"), F.coalesce(F.col(role), F.lit("unknown")).alias("me"))
        .where(F.col("me") != SYSTEM)
        .distinct()
    )
    mine = F.col("who") == F.col("me")
    name = (
        F.when(mine, F.lit("assistant"))
        .when(F.col("who") == SYSTEM, F.lit(SYSTEM))
        .otherwise(F.concat(F.lit("user name="), F.regexp_replace(escaped("who"), "[\\r\\n]+", " ")))
    )
    rows = said.join(people, said["c"].eqNullSafe(people["pc"])).select(
        "c",
        "me",
        F.floor(F.col("pos") / segment_turns).alias("seg"),
        "pos",
        mine.alias("mine"),
        F.concat(F.lit(START), name, F.lit("\n")).alias("head"),
        F.concat("body", F.lit(END)).alias("tail"),
    )
    size = F.length("head") + F.length("tail") + 1
    w = Window.partitionBy("c", "me", "seg").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("stop", F.sum(size).over(w))
    piece = F.struct(
        "pos",
        F.concat("head", "tail", F.lit("\n")).alias("piece"),
        F.when(
            F.col("mine"),
            F.struct(
                (F.col("stop") - F.length("tail") - 1).alias("a"), (F.col("stop") - 1).alias("b")
            ),
        ).alias("span"),
    )
    segments = placed.groupBy("c", "me", "seg").agg(
        F.array_sort(F.collect_list(piece)).alias("all"),
        F.count("*").alias("n_turns"),
        F.max("stop").alias("size"),
    )
    ahead = Window.partitionBy("c", "me").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    spans = F.filter(F.transform("all", lambda m: m["span"]), lambda s: s.isNotNull())
    return segments.select(
        F.col("c").alias(conv),
        F.col("me").alias("speaker"),
        F.col("seg").alias("segment"),
        "n_turns",
        F.array_join(F.transform("all", lambda m: m["piece"]), "").alias("text"),
        F.transform(spans, lambda s: F.struct(s["a"].alias("start"), s["b"].alias("end"))).alias("mask"),
        F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("offset"),
    )


#: The same rows in plain SQL, mask as text.
SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS who,
                  replace(coalesce(text, ''), '<|im_', '<| im_') AS body FROM conversations),
m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, who, body) - 1 AS pos FROM t),
p AS (SELECT DISTINCT conv_id, who AS me FROM t WHERE who <> 'system'),
r AS (SELECT m.conv_id, p.me, m.pos // {SEGMENT_TURNS} AS seg, m.pos, m.who = p.me AS mine,
             '{START}' || CASE WHEN m.who = p.me THEN 'assistant' WHEN m.who = 'system' THEN 'system'
                          ELSE 'user name=' || regexp_replace(replace(m.who, '<|im_', '<| im_'), '[\\r\\n]+', ' ', 'g') END || chr(10) AS head, m.body || '{END}' AS tail
      FROM m JOIN p ON m.conv_id IS NOT DISTINCT FROM p.conv_id),
s AS (SELECT *, sum(length(head) + length(tail) + 1) OVER (PARTITION BY conv_id, me, seg ORDER BY pos) AS stop FROM r),
g AS (SELECT conv_id, me AS speaker, seg, count(*) AS n_turns, max(stop) AS size,
             string_agg(head || tail || chr(10), '' ORDER BY pos) AS text,
             coalesce(string_agg(CAST(stop - length(tail) - 1 AS VARCHAR) || ':' || CAST(stop - 1 AS VARCHAR), ','
                      ORDER BY pos) FILTER (mine), '') AS mask
      FROM s GROUP BY 1, 2, 3)
SELECT conv_id, speaker, CAST(seg AS BIGINT) AS segment, CAST(n_turns AS BIGINT) AS n_turns, text, mask,
       CAST(coalesce(sum(size) OVER (PARTITION BY conv_id, speaker ORDER BY seg
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
FROM g"""
