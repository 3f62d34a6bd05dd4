"""Chat formatting with collapse of cumulative snapshots (operator 1).

Logs often hold a conversation many times, each snapshot a little longer. Turns are hashed and
the hashes folded along the conversation (two 64-bit lanes of exclusive or over hashes that
include the turn's place), so every turn carries the hash of the prefix that ends there. A
conversation whose last prefix hash is an inner prefix hash of another is an anti-join away from
being dropped; of equal conversations the least id stays. Hashes are grouped before they are
joined, so a first turn that a third of all conversations share is one row there. What remains is
rendered with one template.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarack.llm.common import table
from tamarack.operators.storage import broadcast_if_small, written

#: So many prefixes (four numbers each) are broadcast; more are joined by shuffles.
SMALL_ROWS = 400_000

TURN = "<|im_start|>{role}\n{text}<|im_end|>\n"


def prefix_hashes(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each turn: conv_id, place (from 1), role, text, and its rolling prefix hash p1, p2.

    Turns are in order of turn (nulls first), then role and text. Exact repeats of a row count once.
    Rows with a null conversation id are left out: they belong to no conversation.
    """
    rows = (
        turns.select(
            F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
            F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        ).where("conv_id is not null")
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    whole = F.struct(F.coalesce(F.col("turn").cast("string"), F.lit("")).alias("t"), "role", "text")
    once = rows.withColumn("_again", F.lag(whole).over(order).eqNullSafe(whole)).where("not _again")
    placed = once.withColumn("place", F.row_number().over(order))  # the same windows: one shuffle serves all
    rolling = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.select(
        "conv_id", "place", "role", "text",
        F.expr("bit_xor(xxhash64(place, role, text))").over(rolling).alias("p1"),
        F.expr("bit_xor(xxhash64(text, 'lane', place, role))").over(rolling).alias("p2"),
    )


def collapse_and_render(turns: DataFrame, template: str = TURN, **columns) -> DataFrame:
    """Maximal conversations, rendered: conv_id, n_turns, n_copies, n_collapsed, rendered.

    n_copies counts the equal conversations that conv_id (the least id) stands for, n_collapsed the
    conversations (copies included) that are a proper prefix of this one. Null roles and texts are
    empty strings. Extra columns are ignored; an empty table gives none.
    """
    prefixes = written(prefix_hashes(turns, **columns), "prefixes")
    ends = prefixes.groupBy("conv_id").agg(
        F.max("place").alias("n_turns"), F.max_by(F.struct("p1", "p2"), "place").alias("p")
    ).select("conv_id", "n_turns", "p.p1", "p.p2")
    whole = written(
        ends.groupBy("p1", "p2", "n_turns").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies")), "whole"
    )
    # inner prefixes of the conversations that stand for their copies
    inner = (
        prefixes.join(whole.select("conv_id", "n_turns"), "conv_id").where("place < n_turns").select("conv_id", "p1", "p2", "place")
    )
    inner, keys = inner.withColumnRenamed("place", "n_turns"), ["p1", "p2", "n_turns"]
    # the conversations that are an inner prefix of another: prefixes are grouped first, so that a turn with which very
    # many conversations begin is one row, and afterwards only the prefixes found are looked for in all of them
    found = written(inner.select(*keys).distinct().join(whole.select(*keys, "n_copies"), keys), "found")
    few = broadcast_if_small(found, SMALL_ROWS)
    maximal = whole.join(few, keys, "left_anti")
    swallowed = inner.join(few, keys).groupBy("conv_id").agg(F.sum("n_copies").alias("n_collapsed"))
    head, middle, tail = template.replace("{role}", "\0").replace("{text}", "\0").split("\0")
    rendered = (
        prefixes.join(maximal.select("conv_id"), "conv_id", "left_semi")
        .withColumn("line", F.concat(F.lit(head), "role", F.lit(middle), "text", F.lit(tail)))
        .groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "line"))).alias("lines"))
        .select("conv_id", F.concat_ws("", F.col("lines.line")).alias("rendered"))
    )
    return (
        maximal.select("conv_id", "n_turns", "n_copies").join(swallowed, "conv_id", "left").join(rendered, "conv_id")
        .select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "n_copies",
                F.coalesce("n_collapsed", F.lit(0)).alias("n_collapsed"), "rendered")
    )


def op1_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_and_render(table(spark, sf_dir, "conversations"))


#: Prefixes are compared as texts of whole turns, without hashes.
OP1_SQL = """
WITH rows AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM rows
), whole AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(1) || text || chr(2), '' ORDER BY place) AS body,
         string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY place) AS rendered
  FROM placed GROUP BY conv_id
), kept AS (
  SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_copies, body, any_value(rendered) AS rendered
  FROM whole GROUP BY body, n_turns
), prefixes AS (
  SELECT k.conv_id, p.place, (SELECT string_agg(q.role || chr(1) || q.text || chr(2), '' ORDER BY q.place)
                              FROM placed q WHERE q.conv_id = k.conv_id AND q.place <= p.place) AS body
  FROM kept k JOIN placed p ON p.conv_id = k.conv_id AND p.place < k.n_turns
)
SELECT k.conv_id, CAST(k.n_turns AS BIGINT) AS n_turns, CAST(k.n_copies AS BIGINT) AS n_copies,
       CAST(coalesce((SELECT sum(s.n_copies) FROM prefixes x JOIN kept s ON s.body = x.body
                      WHERE x.conv_id = k.conv_id), 0) AS BIGINT) AS n_collapsed,
       k.rendered
FROM kept k WHERE k.body NOT IN (SELECT body FROM prefixes)
"""
