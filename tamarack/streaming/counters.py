"""Counters of events by day and kind that merge: kept as a versioned table, summed up for any window.

A day's row holds how many events there were and a sketch of who caused them (HyperLogLog, Spark's own). Counts add and
sketches unite, so that batches in any order, and rows that come late, end in what one pass over all events gives; distinct
numbers of a window come from its days' sketches, with a relative error of about 1.04 / sqrt(2 ** LOG_K).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.operators.relational import MERGE_RULES
from tamarack.sources.snapshots import Keyed, Snapshots

#: Registers of a sketch as a power of two: an error of 1.6 %, 2 to 4 KB a row.
LOG_K = 12
RULES = {"n": "sum", "total": "sum", "who": "sketch"}
assert set(RULES.values()) <= set(MERGE_RULES)


def daily(events: DataFrame, at: str = "ts", kind: str = "event_type", who: str = "user_id", value: str = "value") -> DataFrame:
    """day, kind, n, total, who (a sketch) of events; a null ``who`` counts as an event of nobody."""
    return events.groupBy(F.to_date(at).alias("day"), F.col(kind).alias("kind")).agg(
        F.count("*").alias("n"), F.coalesce(F.sum(value), F.lit(0.0)).cast("double").alias("total"), F.hll_sketch_agg(F.col(who), F.lit(LOG_K)).alias("who")
    )


def over(days: DataFrame, first: str, last: str) -> DataFrame:
    """kind, n, total, distinct of the days from ``first`` to ``last``, both included."""
    return days.where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date"))).groupBy("kind").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.hll_sketch_estimate(F.hll_union_agg("who")).alias("distinct")
    )


class Counters:
    """Daily counters below ``root`` that a stream of events keeps up; for ``foreachBatch``."""

    def __init__(self, spark: SparkSession, root: str, stream: str = "events", buckets: int = 16):
        self.stream = stream
        self.store = Snapshots(spark, root, {"days": Keyed("day date, kind string, n long, total double, who binary, seq int", ("day", "kind"), buckets)})

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        """Take in a batch once, however often it comes."""
        self.store.upsert("days", daily(batch).withColumn("seq", F.lit(0)), RULES, batch=(self.stream, batch_id))

    def days(self, version: int | None = None) -> DataFrame:
        return self.store.read("days", version=version)
