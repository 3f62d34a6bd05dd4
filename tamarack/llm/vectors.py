"""Near-duplicate vectors by a robust-pruned flat graph (operator 8).

Equal unit vectors are one node. Nodes are dealt to overlapping shards, those of the centroids that
are nearest (k-means on a bounded sample); a shard that has more than ``MAX_SHARD`` nodes is dealt again, by
centroids of its own, so that tables of any size end in small ones. Each shard builds a flat graph: candidate neighbours of
a node are robustly pruned, and links go both ways. The shards' adjacency lists are united, and each
shard then runs a search for each of its nodes over the united lists: greedily from the medoid and
from the node itself, and, from whatever lies in range, on to all neighbours until nothing new is
in range. Links are verified by the cosine in double precision. A pair that shares several shards
is counted in the first alone, so links are counted without a row for each pair.

Only where dealing can't part a shard's vectors is it compared exactly, in pairs of blocks of bounded size, each its own
task. An audit compares drawn vectors, without their equal copies, with all others until ``LINKED`` vectors that have a
link are seen, or all vectors are drawn; while their mean recall is below the target, the shards overlap more, and where
that would cost more than to compare all vectors with each other, these are compared, in block pairs. Where a draw of
``MAX_AUDITED`` ends first, the recall is unproven: an error, unless the caller allows it.

Memory: the driver holds the sample of the first centroids (``SAMPLE_BYTES``) and these (``MAX_CENTROIDS``
vectors, 2 MB for 64 dimensions), and an audit's block; similarities are worked out for ``ROWS`` vectors at a
time (32 MB for ``MAX_CENTROIDS``), by the driver and by workers; a shard's search holds n * n similarities
of at most ``MAX_SHARD`` nodes (32 MB, and 8 MB of flags).
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarack.llm.common import table
from tamarack.operators.components import connected_components
from tamarack.operators.storage import drop, written

THRESHOLD = 0.95
SHARD = 800
MAX_SHARD = 2_048
MAX_CENTROIDS = 4_096
SAMPLE_PER_CENTROID = 24
SAMPLE_BYTES = 64 << 20
ROWS = 1_024
#: A shard of more than MAX_SHARD nodes is dealt again, at most so often; so many of its rows meet its centroids in one task.
LEVELS, SALT_ROWS = 6, 200_000
#: Parts of such a shard at most; no more than MAX_CENTROIDS.
PARTS = 1_024
OVERLAP = 2
CANDIDATES, DEGREE, ALPHA = 48, 20, 1.2
BEAM = 4
#: An audit draws about BLOCK vectors at a time until LINKED linked ones are seen, about MAX_AUDITED at most.
BLOCK, LINKED, MAX_AUDITED, TARGET = 4_096, 200, 65_536, 0.95
#: Different lengths of vectors in one table.
MOST_LENGTHS = 64
_PART = "node long, n long, m long, root long"


def units(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, unit: the vector at length one as little-endian doubles; null where it can't be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.column(1).to_pylist():
                unit = None
                if row and None not in row:
                    x = np.array(row, dtype=np.float64)
                    if np.isfinite(x).all() and x.any():
                        x = x / np.abs(x).max()
                        unit = (x / np.linalg.norm(x) + 0.0).astype("<f8").tobytes()
                out.append(unit)
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column(0), "unit": pa.array(out, pa.binary())})

    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return source.mapInArrow(run, "vec_id long, unit binary")


def _matrix(column) -> np.ndarray:
    return np.stack([np.frombuffer(u, dtype="<f8") for u in column])


def _nearest(rows: np.ndarray, centres: np.ndarray, m: int) -> np.ndarray:
    """The m nearest centres of each row, ascending numbers."""
    out = np.empty((len(rows), m), dtype=np.int64)
    for a in range(0, len(rows), ROWS):
        sims = rows[a : a + ROWS] @ centres.T
        out[a : a + ROWS] = np.argpartition(-sims, m - 1, axis=1)[:, :m] if m < len(centres) else np.arange(m)
    out.sort(axis=1)
    return out


def _means(rows: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k-means centres of unit rows, of which the first k are the seeds."""
    centres = rows[:k].copy()
    for _ in range(rounds):
        own = _nearest(rows, centres, 1)[:, 0]
        order = np.argsort(own, kind="stable")
        at = np.flatnonzero(np.r_[True, own[order][1:] != own[order][:-1]])
        sums = np.add.reduceat(rows[order], at)
        centres[own[order][at]] = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def centroids(nodes: DataFrame, count: int) -> np.ndarray:
    """k-means centres from at most SAMPLE_PER_CENTROID vectors for each and SAMPLE_BYTES in all, the least hashes."""
    k = max(1, min(MAX_CENTROIDS, -(-count // SHARD)))
    width = len(nodes.select("unit").first()["unit"])
    most = max(k, min(k * SAMPLE_PER_CENTROID, SAMPLE_BYTES // width))
    sample = nodes.orderBy(F.xxhash64("node", F.lit("centroids")), "node").limit(most).select("unit").collect()
    return _means(_matrix([r["unit"] for r in sample]), k)


_MEMBER = "shard long, node long, copies long, unit binary"


def deal(nodes: DataFrame, centres: np.ndarray, overlap: int) -> DataFrame:
    """A row for each node and shard: shard, shards (all of the node), node, copies, unit."""
    spread = nodes.sparkSession.sparkContext.broadcast(centres)  # MAX_CENTROIDS vectors at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                near = _nearest(_matrix(part.column(0).to_pylist()), spread.value, min(overlap, len(spread.value)))
                out = _members(near, *(part.column(i) for i in (1, 2, 0)))
                every = pa.array(np.repeat(near, near.shape[1], axis=0).tolist(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*out.columns, every], names=[*out.schema.names, "shards"])

    return nodes.select("unit", "node", "copies").mapInArrow(run, _MEMBER + ", shards array<long>")


def _members(shards: np.ndarray, node, copies, unit) -> pa.RecordBatch:
    at = pa.array(np.repeat(np.arange(len(shards)), shards.shape[1]))
    return pa.RecordBatch.from_arrays([pa.array(shards.reshape(-1)), node.take(at), copies.take(at), unit.take(at)], names=["shard", "node", "copies", "unit"])


def deal_again(members: DataFrame, large: DataFrame, overlap: int) -> DataFrame:
    """Members of shards (shard, n) that are too large, dealt by centroids of each shard's own.

    A shard's centroids come from a bounded sample of its rows, by their hashes. Rows meet them in tasks of about
    ``SALT_ROWS`` rows, which read the centroids first and then a batch after the other.
    """
    # twice as many as would fill shards: with few centroids one of them draws nearly all of a dense shard
    parts = F.least(F.lit(PARTS), F.ceil(2 * F.col("n") / SHARD)).cast("int")
    sized = members.join(large.select("shard", "n", parts.alias("k"), F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("salts")), "shard")
    share = F.least(F.lit(1.0), F.col("k") * SAMPLE_PER_CENTROID / F.col("n"))
    sampled = sized.where(F.pmod(F.xxhash64("node", "shard"), F.lit(1 << 30)) < share * (1 << 30)).select("shard", "k", "salts", "node", "unit")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.iloc[np.argsort(group["node"].to_numpy())]
        rows = _matrix(group["unit"])
        k = min(int(group["k"].iloc[0]), len(rows))
        seeds = np.random.default_rng(5).permutation(len(rows))
        first = group.iloc[:1]
        return pd.DataFrame({"shard": first["shard"], "salts": first["salts"], "centres": [_means(rows[seeds], k).tobytes()]})

    fitted = sampled.groupBy("shard").applyInPandas(fit, "shard long, salts int, centres binary")
    centres = fitted.select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(-1).cast("long").alias("node"), F.lit(0).cast("long").alias("copies"), F.col("centres").alias("unit"), F.lit(0).alias("kind"))
    rows = sized.select("shard", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), "node", "copies", "unit", F.lit(1).alias("kind"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (None, None)  # the shard that is being read, and its centroids
        for batch in batches:
            shard, kind = batch.column(0).to_numpy(), batch.column(5).to_numpy()
            cuts = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (kind[1:] == 0)])
            for a, b in zip(cuts, np.r_[cuts[1:], len(shard)]):
                own = int(shard[a])
                if kind[a] == 0:
                    held, a = (own, np.frombuffer(batch.column(4)[int(a)].as_py(), dtype="<f8")), a + 1
                for first in range(a, b, ROWS):
                    part = batch.slice(first, min(ROWS, b - first))
                    rows = _matrix(part.column(4).to_pylist())
                    if held[0] == own:
                        centres = held[1].reshape(-1, rows.shape[1])
                        near = _nearest(rows, centres, min(overlap, len(centres)))
                    else:  # none of its rows was drawn: it stays one part
                        near = np.zeros((len(rows), 1), dtype=np.int64)
                    yield _members((own + 1) * MAX_CENTROIDS + near, *(part.column(i) for i in (2, 3, 4)))

    dealt = rows.unionByName(centres).select("shard", "salt", "node", "copies", "unit", "kind")
    return dealt.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind").mapInArrow(run, _MEMBER)


def _dealt(nodes: DataFrame, count: int, overlap: int, exact: bool) -> tuple[DataFrame, DataFrame]:
    """Members of shards (shard, shards of the node, node, copies, unit), and the shards (shard, n) that stay too large."""
    now = written(deal(nodes, centroids(nodes, 1 if exact else count), 1 if exact else overlap), "members")
    for _ in range(0 if exact else LEVELS):
        large = written(now.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > MAX_SHARD), "large")
        if large.isEmpty():
            drop(large)
            break
        parts_of = written(deal_again(now, large, overlap), "members")
        again = parts_of.withColumn("parent", F.floor(F.col("shard") / MAX_CENTROIDS) - 1)
        # a shard of which one part has nearly all stays as it is
        parts = again.groupBy("parent", "shard").agg(F.count("*").alias("m")).join(large.withColumnRenamed("shard", "parent"), "parent")
        stuck = written(parts.where("m > 0.9 * n").select("parent").distinct(), "stuck")
        split = written(large.join(stuck, large["shard"] == stuck["parent"], "left_anti").select("shard"), "split")
        kept = now.select("shard", "node", "copies", "unit").join(split, "shard", "left_anti")
        fresh = again.join(stuck, "parent", "left_anti").select("shard", "node", "copies", "unit")
        parted = written(kept.unionByName(fresh), "members")
        done = split.isEmpty()
        for df in (large, stuck, split, parts_of, now):
            drop(df)
        every = parted.groupBy("node").agg(F.sort_array(F.collect_set("shard")).alias("shards"))
        now = written(parted.join(every, "node"), "members")
        drop(parted)
        if done:
            break
    sizes = written(now.groupBy("shard").agg(F.count("*").alias("n")), "sizes")
    return now, sizes if exact else sizes.where(F.col("n") > MAX_SHARD)


def _lists(column) -> np.ndarray:
    """Shards of each row, -1 where it has fewer than others."""
    rows = [np.asarray(s, dtype=np.int64) for s in column]
    out = np.full((len(rows), max(map(len, rows))), -1, dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _first_common(mine: np.ndarray, other: np.ndarray) -> np.ndarray:
    common = ((mine[:, :, None] == other[:, None, :]) & (mine >= 0)[:, :, None]).any(axis=2)
    return np.where(common, mine, np.iinfo(np.int64).max).min(axis=1) if len(mine) else np.empty(0)


def prune(x: np.ndarray) -> list[np.ndarray]:
    """Neighbours of each row: the nearest candidates, without those that a nearer one leads to."""
    n = len(x)
    width = min(CANDIDATES, n - 1)
    if width < 1:
        return [np.empty(0, dtype=np.int64)] * n
    near = np.empty((n, width), dtype=np.int64)
    gap = np.empty((n, width))
    for a in range(0, n, 512):
        sims = x[a : a + 512] @ x.T
        sims[np.arange(len(sims)), np.arange(a, a + len(sims))] = -2
        best = np.argpartition(-sims, width - 1, axis=1)[:, :width]
        own = np.take_along_axis(sims, best, axis=1)
        order = np.argsort(-own, axis=1, kind="stable")
        near[a : a + 512] = np.take_along_axis(best, order, axis=1)
        gap[a : a + 512] = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(own, order, axis=1)))
    open_, chosen, rows = np.ones((n, width), dtype=bool), np.zeros((n, width), dtype=bool), np.arange(n)
    for _ in range(min(DEGREE, width)):
        any_open = open_.any(axis=1)
        if not any_open.any():
            break
        first = open_.argmax(axis=1)
        r = rows[any_open]
        f = first[any_open]
        chosen[r, f] = True
        open_[r, f] = False
        star = x[near[r, f]]
        between = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("rd,rwd->rw", star, x[near[r]])))
        open_[r] &= ALPHA * between > gap[r]
    return [near[i][chosen[i]] for i in range(n)]


def build(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("node", ignore_index=True)
    nodes = group["node"].to_numpy()
    return pd.DataFrame({"node": nodes, "near": [nodes[k].tolist() for k in prune(_matrix(group["unit"]))]})


def _expand(starts: np.ndarray, targets: np.ndarray, q: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, neighbour) for all neighbours of each (query, node)."""
    size = starts[node + 1] - starts[node]
    at = np.repeat(starts[node] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
    return np.repeat(q, size), targets[at]


def range_search(x: np.ndarray, starts: np.ndarray, targets: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) of cosine >= threshold that the search over the graph finds, both ways."""
    n = len(x)
    seen, expanded, sims = np.zeros((n, n), dtype=bool), np.zeros((n, n), dtype=bool), np.full((n, n), -2.0, dtype=np.float64)
    medoid = int((x @ x.mean(axis=0)).argmax())
    every = np.arange(n)

    def visit(q: np.ndarray, node: np.ndarray) -> None:
        new = ~seen[q, node]
        q, node = q[new], node[new]
        pair = np.unique(q * n + node)
        q, node = pair // n, pair % n
        seen[q, node] = True
        for a in range(0, len(q), 200_000):
            part = slice(a, a + 200_000)
            sims[q[part], node[part]] = np.einsum("ij,ij->i", x[q[part]], x[node[part]])

    visit(np.r_[every, every], np.r_[every, np.full(n, medoid)])
    while True:  # greedily: expand the best of each query that haven't been
        waiting = np.where(expanded, -3.0, sims)
        best = np.argpartition(-sims, min(BEAM, n) - 1, axis=1)[:, : min(BEAM, n)]
        q, node = np.repeat(every, best.shape[1]), best.reshape(-1)
        todo = waiting[q, node] > -2
        if not todo.any():
            break
        q, node = q[todo], node[todo]
        expanded[q, node] = True
        visit(*_expand(starts, targets, q, node))
    while True:  # and outwards from all that lies in range
        q, node = np.nonzero((sims >= threshold) & ~expanded)
        if not len(q):
            break
        expanded[q, node] = True
        visit(*_expand(starts, targets, q, node))
    found = sims >= threshold
    found |= found.T
    np.fill_diagonal(found, False)
    return np.nonzero(found)


def _counted(nodes: np.ndarray, copies: np.ndarray, q: np.ndarray, node: np.ndarray, owned: np.ndarray) -> pd.DataFrame:
    """For each node the rows and nodes it links with in pairs this task owns, and the least node of its local component."""
    n = np.bincount(q[owned], weights=copies[node[owned]].astype(np.float64), minlength=len(nodes)).astype(np.int64)
    m = np.bincount(q[owned], minlength=len(nodes))
    label = nodes.copy()
    while len(q):
        before = label.copy()
        np.minimum.at(label, q, label[node])
        if (before == label).all():
            break
    return pd.DataFrame({"node": nodes, "n": n, "m": m, "root": label})


def search(group: pd.DataFrame, threshold: float) -> pd.DataFrame:
    group = group.sort_values("node", ignore_index=True)
    nodes, shard = group["node"].to_numpy(), int(group["shard"].iloc[0])
    source = np.repeat(np.arange(len(nodes)), group["near"].map(len))
    named = np.concatenate([np.asarray(k, dtype=np.int64) for k in group["near"]] or [np.empty(0, np.int64)])
    at = np.minimum(np.searchsorted(nodes, named), len(nodes) - 1)
    inside = nodes[at] == named
    a, b = np.r_[source[inside], at[inside]], np.r_[at[inside], source[inside]]
    links = np.unique(a * len(nodes) + b)
    a, b = links // len(nodes), links % len(nodes)
    starts = np.r_[0, np.cumsum(np.bincount(a, minlength=len(nodes)))]
    q, node = range_search(_matrix(group["unit"]), starts, b, threshold)
    shards = _lists(group["shards"])
    first = _first_common(shards[q], shards[node])
    return _counted(nodes, group["copies"].to_numpy(), q, node, first == shard)


def compare_blocks(group: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """All links between two blocks of a crowded shard, or within one."""
    shard, left, right = (int(group[c].iloc[0]) for c in ("shard", "left", "right"))
    group = group.drop_duplicates("node").sort_values("node", ignore_index=True)
    x, block = _matrix(group["unit"]), group["block"].to_numpy()
    rows, cols = np.flatnonzero(block == left), np.flatnonzero(block == right)
    q, node = np.nonzero(x[rows] @ x[cols].T >= threshold)
    q, node = rows[q], cols[node]
    if left == right:
        q, node = q[q != node], node[q != node]
    else:
        q, node = np.r_[q, node], np.r_[node, q]
    shards = _lists(group["shards"])
    first = np.empty(len(q), dtype=np.int64)
    for a in range(0, len(q), 500_000):
        first[a : a + 500_000] = _first_common(shards[q[a : a + 500_000]], shards[node[a : a + 500_000]])
    return _counted(group["node"].to_numpy(), group["copies"].to_numpy(), q, node, first == shard)


def linked(nodes: DataFrame, count: int, threshold: float = THRESHOLD, overlap: int = OVERLAP, exact: bool = False) -> DataFrame:
    """nodes: (unit, node, copies) -> a row or more for each node: node, n and m (rows and nodes linked), root (a node it reaches).

    ``exact`` compares all nodes with each other, as one crowded shard.
    """
    members, crowded = _dealt(nodes, count, overlap, exact)
    calm, some = members, not crowded.isEmpty()
    blocks = F.ceil(F.col("n") / (MAX_SHARD // 2)).cast("int")
    if some:
        calm = members.join(crowded, "shard", "left_anti")
    near = calm.groupBy("shard").applyInPandas(build, "node long, near array<long>")
    united = near.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    found = calm.join(united, "node").groupBy("shard").applyInPandas(lambda g: search(g, threshold), _PART)
    if some:
        dense = (
            members.join(crowded, "shard")
            .withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            .withColumns({"left": F.least("block", "other"), "right": F.greatest("block", "other")}).drop("n")
        )
        found = found.unionByName(
            dense.groupBy("shard", "left", "right").applyInPandas(lambda g: compare_blocks(g, threshold), _PART)
        )
    out = written(found, "linked")
    drop(members)
    return out


def audit(nodes: DataFrame, count: int, totals: DataFrame, threshold: float = THRESHOLD) -> tuple[float | None, int, int]:
    """Mean recall over linked vectors, counted against all nodes; how many of these were seen, and how many were drawn.

    Vectors are drawn by hash of the node, a block at a time. ``totals`` has (node, m) for the nodes
    linked, equal copies apart. Recall is None when no vector drawn has a link, and 1 when that were all.
    """
    every, drawn, recalls, first = 1 << 40, 0, [], 0
    step = -(-every * BLOCK // max(count, BLOCK))
    at = F.pmod(F.xxhash64("node", F.lit("audit")), F.lit(every))
    while first < every and len(recalls) < LINKED and drawn < MAX_AUDITED:
        within = (at >= first) & (at < first + step)
        first += step
        block = sorted(nodes.where(within).select("node", "unit").collect())
        if not block:
            continue
        drawn += len(block)
        ids = np.array([r["node"] for r in block])
        spread = nodes.sparkSession.sparkContext.broadcast((ids, _matrix([r["unit"] for r in block])))  # about BLOCK vectors

        def run(batches: Iterator[pa.RecordBatch], spread=spread) -> Iterator[pa.RecordBatch]:
            ids, queries = spread.value
            total = np.zeros(len(ids), dtype=np.int64)
            for batch in batches:
                for a in range(0, batch.num_rows, 512):
                    part = batch.slice(a, 512)
                    sims = _matrix(part.column(0).to_pylist()) @ queries.T
                    own = part.column(1).to_numpy()
                    place = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
                    same = np.flatnonzero(ids[place] == own)
                    sims[same, place[same]] = -2
                    total += (sims >= threshold).sum(axis=0)
            yield pa.RecordBatch.from_pydict({"node": ids, "m": total})

        counted = nodes.select("unit", "node").mapInArrow(run, "node long, m long").groupBy("node").agg(F.sum("m").alias("m")).where("m > 0")
        got = {r["node"]: r["m"] for r in totals.where(within).select("node", "m").collect()}
        recalls += [min(got.get(r["node"], 0), r["m"]) / r["m"] for r in counted.collect()]
        spread.destroy()
    return float(np.mean(recalls)) if recalls else 1.0 if drawn >= count else None, len(recalls), drawn


def near_duplicates(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    overlap: int = OVERLAP,
    target: float = TARGET,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    allow_unproven: bool = False,
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing and
    are their own component. Vectors link with those of their own length alone. Repeated rows are rows that link with
    each other; rows of one vec_id and different vectors are rows of their own, each with its links. A row with a null id
    has no links and a null component, and isn't kept. Other columns are ignored; an empty table gives none.

    The column ``recall`` repeats what the audit found (of several lengths the least), 1 where all vectors were compared.
    An audit has shown ``target`` on ``LINKED`` linked vectors or on all there are. Where it saw fewer among the
    ``MAX_AUDITED`` it may draw, RuntimeError gives the figures; with ``allow_unproven`` it is a warning, and recall is null
    where no vector drawn has a link.
    """
    rows = written(units(vectors, id_col, vector_col), "units")
    every = written(
        rows.where("unit is not null and vec_id is not null")
        .groupBy("unit").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")),
        "nodes",
    )
    # ids that several different vectors share would be one node: these get a number of their own
    apart, own = _told_apart(every)
    lengths = sorted(r[0] for r in every.select(F.length("unit")).distinct().limit(MOST_LENGTHS + 1).collect())
    if len(lengths) > MOST_LENGTHS:
        raise ValueError(f"vectors of more than {MOST_LENGTHS} lengths")
    out = rows.where("unit is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    recalls: list[float | None] = [1.0]
    for length in lengths:
        nodes = apart if len(lengths) == 1 else written(apart.where(F.length("unit") == length), "nodes")
        of_node, recall = _of_length(nodes, threshold, overlap, target, allow_unproven)
        named = rows.where("vec_id is not null").join(of_node, "unit")
        if own is not None:  # back to the ids: the least of a component's
            named = named.join(own.withColumnsRenamed({"node": "component_id", "vec_id": "least"}), "component_id", "left").withColumn("component_id", F.coalesce("least", "component_id"))
        out = out.unionByName(named.select("vec_id", "n_links", "component_id"))
        recalls.append(recall)
    known = [r for r in recalls if r is not None]
    worst = min(known) if len(known) == len(recalls) else None
    return out.withColumns(
        {"kept": F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)), "recall": F.lit(worst).cast("double")}
    )


def _told_apart(nodes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``nodes`` with a number of its own for each vector, and (node, vec_id), where an id has several vectors; else as they are.

    Numbers keep the order of ids, so that the least number of a component is of its least id.
    """
    shared = nodes.groupBy("node").agg(F.count("*").alias("c")).agg(F.max("c")).first()[0]
    if (shared or 1) == 1:
        return nodes, None
    # ids in ranges, each counted; a row's number is its place in its range behind those before
    parts = written(nodes.repartitionByRange("node", "unit").sortWithinPartitions("node", "unit").withColumn("part", F.spark_partition_id()), "ranges")
    sizes = {r["part"]: r["c"] for r in parts.groupBy("part").agg(F.count("*").alias("c")).collect()}
    before, total = {}, 0
    for part in sorted(sizes):
        before[part], total = total, total + sizes[part]
    starts = F.create_map(*[F.lit(x).cast("long") for p in before.items() for x in p])
    place = F.row_number().over(Window.partitionBy("part").orderBy("node", "unit"))
    numbered = written(parts.withColumn("number", F.element_at(starts, F.col("part").cast("long")) + place - 1), "numbered")
    return numbered.select("unit", F.col("number").alias("node"), "copies"), numbered.select(F.col("number").alias("node"), F.col("node").alias("vec_id"))


def _of_length(nodes: DataFrame, threshold: float, overlap: int, target: float, allow_unproven: bool) -> tuple[DataFrame, float | None]:
    """(unit, n_links, component_id) of nodes (unit, node, copies) whose vectors have one length, and the recall."""
    count = nodes.count()
    shards, exact, recall = -(-count // SHARD), False, 1.0
    while True:
        parts = linked(nodes, count, threshold, overlap, exact)
        totals = parts.groupBy("node").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
        if exact:
            break
        recall, seen, drawn = audit(nodes, count, totals, threshold)
        if recall is None or recall >= target:
            if seen < LINKED and drawn < count:
                what = f"recall rests on {seen} linked vectors among {drawn} drawn of {count}: {recall}"
                if not allow_unproven:
                    raise RuntimeError(f"{what}; allow_unproven=True takes it so")
                warnings.warn(what, RuntimeWarning, stacklevel=3)
            break
        overlap *= 2
        exact, recall = overlap * overlap > shards, 1.0  # crowded shards would cost more than all pairs
    component = connected_components(parts.where("node <> root").select(F.col("node").alias("src"), F.col("root").alias("dst")))
    return (
        nodes.join(totals, "node").join(component, "node", "left")
        .select("unit", (F.col("n") + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    ), recall


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
