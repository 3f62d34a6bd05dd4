"""Relational shapes: best child, fact assembly, stale selection, upsert, listings, rollups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_child(children: DataFrame, key: str, order: list[Column], columns: list[str]) -> DataFrame:
    """The first child of each key in ``order`` (ascending columns), by an aggregate, without a sort."""
    return children.groupBy(key).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("x")).select(key, "x.*")


def latest_by(rows: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The latest row of each key; of equal times the one with the greatest ``tie``."""
    w = Window.partitionBy(*keys).orderBy(F.desc(at), F.desc(tie))
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def with_children(parent: DataFrame, key: str, *children: DataFrame) -> DataFrame:
    """Parent rows with the columns of aggregated children, each with one row at most for a key."""
    for child in children:
        parent = parent.join(child, key, "left")
    return parent


def entity_view(parent: DataFrame, key: str, children: dict[str, tuple[DataFrame, list[str]]], most: int = 100) -> DataFrame:
    """Each parent row with a sorted array of the first ``most`` structs of each child, and how many there are (``n_`` and
    the child's name). What an array leaves out is in :func:`entity_rows`.

    A task keeps ``most`` rows of a key before the shuffle, so that a key with very many children is no unbounded group.
    """
    for name, (child, columns) in children.items():
        w = Window.partitionBy(key).orderBy(*columns)
        first = child.select(key, *columns).withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= most)
        rolled = first.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
        counted = child.groupBy(key).agg(F.count("*").alias(f"n_{name}"))
        parent = with_children(parent, key, rolled, counted).withColumns({name: F.coalesce(name, F.array()), f"n_{name}": F.coalesce(f"n_{name}", F.lit(0))})
    return parent


def entity_rows(key: str, children: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """The children of all entities, whole, in long form: key, child, row (as JSON)."""
    parts = [child.select(key, F.lit(name).alias("child"), F.to_json(F.struct(*columns)).alias("row")) for name, (child, columns) in children.items()]
    return reduce(DataFrame.unionByName, parts)


def stale(entities: DataFrame, audits: DataFrame, key: str, at: str, as_of: Column, days: int | None) -> DataFrame:
    """Entities without an audit in the last ``days`` before ``as_of``; all of them if days is None."""
    if days is None:
        return entities
    fresh = audits.where(F.col(at) > as_of - F.make_interval(days=F.lit(days)))
    return entities.join(fresh.select(key), key, "left_anti")


def without_open_work(entities: DataFrame, jobs: DataFrame, key: str) -> DataFrame:
    return entities.join(jobs.where(F.col("status").isin("queued", "running")), key, "left_anti")


def pruned(old: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """Rows of ``old`` whose key isn't kept."""
    return old.join(kept.select(key), key, "left_anti")


MERGE_RULES = {
    "excluded": lambda c, seq: F.max_by(c, seq),
    "coalesce_new": lambda c, seq: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))),
    "coalesce_old": lambda c, seq: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(seq))),
    "greatest": lambda c, seq: F.max(c),
    "least": lambda c, seq: F.min(c),
    "any": lambda c, seq: F.bool_or(c),
    "sum": lambda c, seq: F.sum(c),
    "sketch": lambda c, seq: F.hll_union_agg(c),
}


def upsert(old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, str], seq: str = "seq") -> DataFrame:
    """Rows of both by key, each column by its rule (see MERGE_RULES); ``seq`` orders arrivals, the old are first."""
    return merged(old.unionByName(new, allowMissingColumns=True), keys, rules, seq)


def merged(rows: DataFrame, keys: list[str], rules: dict[str, str], seq: str = "seq") -> DataFrame:
    """One row a key, each column by its rule; ``seq`` orders the rows of a key."""
    return rows.groupBy(*keys).agg(*(MERGE_RULES[rule](c, seq).alias(c) for c, rule in rules.items()), F.max(seq).alias(seq))


def check_report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations): how many rows each condition is false or null for, in one pass."""
    counted = df.agg(*(F.count_if(~F.coalesce(cond, F.lit(False))).alias(name) for name, cond in rules.items()))
    pairs = ", ".join(f"'{name}', `{name}`" for name in rules)
    return counted.selectExpr(f"stack({len(rules)}, {pairs}) as (rule, violations)")


def funnel(entities: DataFrame, audits: DataFrame, index: DataFrame, key: str = "business_id") -> DataFrame:
    """(stage, n) of a dataset: active entities, those in scope, those with an audit, those in the index."""
    active = entities.where("status = 'active'").agg(F.count("*").alias("a"), F.count_if("in_scope").alias("b"))
    parts = (
        active.selectExpr("stack(2, 'businesses', a, 'in_scope', b) AS (stage, n)"),
        audits.agg(F.count_distinct(key).alias("n")).select(F.lit("audited").alias("stage"), "n"),
        index.agg(F.count("*").alias("n")).select(F.lit("indexed").alias("stage"), "n"),
    )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def rollup_with_zeroes(rows: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """Counts by key for every known key, zero where there is none."""
    return known.join(rows.groupBy(key).agg(F.count("*").alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def top_per_group(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def transitions(timeline: DataFrame, key: str, at: str, status: str, tie: str) -> DataFrame:
    """Each row with the status before and after it."""
    w = Window.partitionBy(key).orderBy(at, tie)
    return timeline.withColumns({"from_status": F.lag(status).over(w), "to_status": F.lead(status).over(w)})
