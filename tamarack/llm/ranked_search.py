"""Ranked lexical search without random access (operator 13).

Two passes over the documents' side. The first counts: it reads every text once and writes, for each document, its number
of terms and which of the asked terms it holds how often; Spark sums up how many documents and terms there are and how
many documents hold each asked term. The second ranks: each task takes its documents as shards of bounded size, lays the
shard's postings out as a list for each term, highest impact first, and answers every query over it by NRA (R. Fagin, A.
Lotem and M. Naor, "Optimal aggregation algorithms for middleware", 2003): lists are read from their heads in growing
blocks; a document has as lower bound what was read of it, as upper bound what its unread lists may still add. Reading goes
on until no document outside can come in, not even by a tie, and all that can are known to the last point. A shard begins
with what the shards before it have reached. What tasks keep, ``k`` documents a query, is merged in two steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarack.llm.common import release, table
from tamarack.llm.terms import LOWER, HashSet, column_bytes, terms_of
from tamarack.operators.storage import drop, written

K = 50
#: Postings of a shard, 20 bytes each beside its sorting.
MOST_POSTINGS = 1_500_000
#: Terms of queries, and queries, that are broadcast at a time; more go in blocks, each a search of its own.
MOST_TERMS, MOST_QUERIES = 400_000, 20_000
#: Postings of each list that the first step of a search reads; each step reads as many as all before it.
FIRST_BLOCK = 64
PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Vocabulary(NamedTuple):
    """Terms by their hash: where the bytes of each stand in ``data``; ``first`` and ``many`` of a hash's terms."""

    hashes: HashSet
    first: np.ndarray
    many: np.ndarray
    data: np.ndarray
    start: np.ndarray
    length: np.ndarray

    @classmethod
    def of(cls, terms: list[str]) -> tuple[Vocabulary, dict[str, int]]:
        """The vocabulary of distinct ``terms``, and each term's number in it."""
        column = pa.array(terms, pa.string())
        data, ends = column_bytes(column)
        found = list(terms_of(column))
        hashes = np.concatenate([b.hash for b in found]) if found else np.empty(0, dtype=np.uint64)
        order = np.argsort(hashes, kind="stable")
        known, first, many = np.unique(hashes[order], return_index=True, return_counts=True)
        return cls(HashSet.of(known), first, many, data, ends[:-1][order], np.diff(ends)[order]), {terms[i]: n for n, i in enumerate(order.tolist())}

    def find(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are terms, and the terms' numbers; words of ``data`` are compared with them byte by byte."""
        at, place = self.hashes.find(hashes)
        words, numbers = [], []
        for more in range(int(self.many.max(initial=0))):  # terms of one hash; one, but for a collision
            open_ = np.flatnonzero(self.many[place] > more)
            own, term = at[open_], self.first[place[open_]] + more
            same = self.length[term] == length[own]
            own, term = own[same], term[same]
            if not len(own):
                continue
            wide = length[own]
            heads = np.cumsum(wide) - wide
            step = np.arange(int(wide.sum())) - np.repeat(heads, wide)
            equal = np.logical_and.reduceat(LOWER[data[np.repeat(start[own], wide) + step]] == self.data[np.repeat(self.start[term], wide) + step], heads)
            words.append(own[equal])
            numbers.append(term[equal])
        if not words:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        return np.concatenate(words), np.concatenate(numbers)


class Queries(NamedTuple):
    """A block of queries: their ids, and the numbers of the terms of each."""

    ids: list
    terms: list[np.ndarray]
    vocabulary: Vocabulary


def query_terms(queries: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(id, term) once each: the terms of all texts of an id. Null texts and texts without a term have none."""
    found = F.explode(F.regexp_extract_all(F.translate(F.col(text_col), _UPPER, _LOWER), F.lit(PATTERN), F.lit(0)))
    return queries.select(F.col(id_col).alias("id"), found.alias("term")).distinct()


def _collected(rows: DataFrame) -> Queries:
    """At most about MOST_TERMS rows of :func:`query_terms`."""
    got = rows.groupBy("id").agg(F.sort_array(F.collect_list("term")).alias("terms")).orderBy("id").toArrow()
    lists = got.column("terms").to_pylist()
    vocabulary, number = Vocabulary.of(sorted({t for terms in lists for t in terms}))
    return Queries(got.column("id").to_pylist(), [np.array([number[t] for t in terms]) for terms in lists], vocabulary)


def counted(docs: DataFrame, asked, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (terms of the text), terms (numbers of asked ones), tfs (how often), for texts with a term; narrow."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = asked.value.vocabulary
        size = max(1, len(vocabulary.start))
        for batch in batches:
            column, n = batch.column(1), np.zeros(batch.num_rows, dtype=np.int64)
            data, _ = column_bytes(column)
            keys, tfs, last = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)], -1
            for block in terms_of(column):
                if not len(block.row):
                    continue
                n += np.bincount(block.row, minlength=len(n))
                word, term = vocabulary.find(data, block.start, block.length, block.hash)
                key, tf = np.unique(block.row[word] * size + term, return_counts=True)
                if last == block.row[0] and len(keys) > 1:  # a text that goes on: put together with what there is of it
                    both, at = np.unique(np.concatenate([keys[-1], key]), return_inverse=True)
                    keys[-1], tfs[-1] = both, np.bincount(at, weights=np.concatenate([tfs[-1], tf])).astype(np.int64)
                else:
                    keys.append(key)
                    tfs.append(tf)
                last = block.row[-1]
            key, tf = np.concatenate(keys), np.concatenate(tfs)
            offsets = pa.array(np.searchsorted(key // size, np.arange(len(n) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in (key % size, tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *lists], names=["doc_id", "n", "terms", "tfs"]).filter(pa.array(n > 0))
        release()

    return source.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


class Weights(NamedTuple):
    """Of the corpus: documents with a term, all their terms, and the weight of each asked term."""

    documents: int
    terms: int
    weight: np.ndarray

    def impacts(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What a term that is ``tf`` times in a document of ``n`` terms adds for each point of its weight."""
        if 50 * int(n.max(initial=0)) * self.documents >= 1 << 63:
            n = n.astype(object)
        m = 50 + (50 * n * self.documents) // self.terms
        return ((1_000_000_000 * tf) // (1_000 * tf + 20 * m)).astype(np.int64)


class Shard(NamedTuple):
    """Postings of some documents: for each term a list, highest impact first, of documents (places in ``ids``)."""

    ids: np.ndarray
    null: np.ndarray
    begin: np.ndarray
    doc: np.ndarray
    impact: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, null: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, size: int) -> Shard:
        order = np.lexsort((-impact, term))
        return cls(ids, null, np.searchsorted(term[order], np.arange(size + 1)), doc[order], impact[order])


Top = tuple[np.ndarray, np.ndarray, np.ndarray]  # scores, ids, whether an id is null; best first
NOTHING: Top = (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=bool))


def best(top: Top, k: int) -> Top:
    """The first ``k`` by score, of equal ones those of the least ids, null last."""
    order = np.lexsort((top[1], top[2], -top[0]))[:k]
    return tuple(v[order] for v in top)


def nra(shard: Shard, terms: np.ndarray, weights: np.ndarray, k: int, least: int = 1, first_block: int = FIRST_BLOCK) -> Top:
    """The ``k`` best documents of the shard for a query, exact; those below ``least`` may be left out.

    ``terms`` and ``weights`` are the query's. ``lower`` holds what was read of each document, ``upper`` adds what the
    heads of its unread lists allow.
    """
    terms, weights = terms[weights > 0], weights[weights > 0]
    begin, size = shard.begin[terms], shard.begin[terms + 1] - shard.begin[terms]
    terms, weights, begin, size = terms[size > 0], weights[size > 0], begin[size > 0], size[size > 0]
    lower = np.zeros(len(shard.ids), dtype=np.int64)
    if not len(terms):
        return NOTHING
    read_doc, read_list = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    inside: np.ndarray | None = None  # once no other document can come in: which can
    depth, block = 0, first_block
    while True:
        upto = np.minimum(size, depth + block)
        lists = np.flatnonzero(size > depth)
        at = np.concatenate([np.arange(begin[j] + depth, begin[j] + upto[j]) for j in lists])
        of = np.repeat(lists, upto[lists] - depth)
        doc, gain = shard.doc[at], weights[of] * shard.impact[at]
        if inside is not None:
            kept = inside[doc]
            doc, of, gain = doc[kept], of[kept], gain[kept]
        np.add.at(lower, doc, gain)
        depth, block = depth + block, depth + block
        over = bool((size <= depth).all())
        # the last impact that was read bounds what a list has left
        left = np.where(size > depth, weights * shard.impact[begin + np.minimum(size, depth) - 1], 0)
        read_doc, read_list = np.concatenate([read_doc, doc]), np.concatenate([read_list, of])
        known = np.flatnonzero(lower >= max(1, least)) if inside is None else np.flatnonzero(inside)
        bar = max(least, 1)
        if len(known) >= k:
            bar = max(bar, int(np.partition(lower[known], len(known) - k)[len(known) - k]))
        if over:
            inside = lower >= bar
            break
        if inside is None and int(left.sum()) >= bar:
            continue  # a document of which nothing was read may still come in
        upper = lower + left.sum()
        np.subtract.at(upper, read_doc, left[read_list])
        inside = (upper >= bar) & (lower > 0 if inside is None else inside)
        if (upper[inside] == lower[inside]).all():
            break
        kept = inside[read_doc]
        read_doc, read_list = read_doc[kept], read_list[kept]
    found = np.flatnonzero(inside & (lower > 0))
    return best((lower[found], shard.ids[found], shard.null[found]), k)


def _ranked(forward: DataFrame, asked, weights: Weights, k: int, id_type: str, most_postings: int) -> DataFrame:
    """(part, id, doc_id, score): the best of each query among the documents of a task."""
    kind = forward.sparkSession.createDataFrame([], f"id {id_type}").toArrow().schema.field("id").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Queries = asked.value
        tops: dict[int, Top] = {}
        held: list[tuple] = []
        postings = 0

        def answer() -> None:
            ids, null, n, many, term, tf = (np.concatenate(v) for v in zip(*held))
            doc = np.repeat(np.arange(len(ids)), many)
            shard = Shard.of(ids, null, doc, term, weights.impacts(tf, n[doc]), len(weights.weight))
            for q, terms in enumerate(queries.terms):
                top = tops.get(q, NOTHING)
                found = nra(shard, terms, weights.weight[terms], k, int(top[0][k - 1]) if len(top[0]) >= k else 1)
                if len(found[0]):
                    tops[q] = best(tuple(np.concatenate(v) for v in zip(top, found)), k)

        for batch in batches:
            at = 0
            many = np.diff(batch.column(2).offsets.to_numpy())
            while at < batch.num_rows:
                room = np.searchsorted(np.cumsum(many[at:]), most_postings - postings, side="right")
                if not room and held:
                    answer()
                    held, postings = [], 0
                    continue
                to = at + max(1, int(room))
                part = batch.slice(at, to - at)
                numbers = [part.column(i).flatten().to_numpy().astype(np.int64) for i in (2, 3)]
                held.append((part.column(0).fill_null(0).to_numpy(), part.column(0).is_null().to_numpy(zero_copy_only=False), part.column(1).to_numpy(), many[at:to], *numbers))
                postings, at = postings + len(numbers[0]), to
        if held:
            answer()
        held = []
        for first in range(0, len(order := sorted(tops)), 1_000):
            part = order[first : first + 1_000]
            counts = [len(tops[q][0]) for q in part]
            scores, ids, null = (np.concatenate([tops[q][i] for q in part]) for i in range(3))
            own = pa.array([queries.ids[q] for q in part], kind).take(pa.array(np.repeat(np.arange(len(part)), counts)))
            yield pa.RecordBatch.from_arrays([own, pa.array(ids, mask=null), pa.array(scores)], names=["id", "doc_id", "score"])
        release()

    return forward.mapInArrow(run, f"id {id_type}, doc_id long, score long").withColumn("part", F.spark_partition_id())


def _search_block(docs: DataFrame, rows: DataFrame, k: int, id_type: str, most_postings: int) -> DataFrame:
    spark = docs.sparkSession
    asked = spark.sparkContext.broadcast(_collected(rows))  # bounded by MOST_TERMS and MOST_QUERIES
    forward = written(counted(docs, asked), "forward")
    total = forward.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    holders = np.zeros(len(asked.value.vocabulary.start), dtype=np.int64)
    # a row for each asked term
    got = forward.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow()
    holders[got.column("term").to_numpy()] = got.column("df").to_numpy()
    weight = [math.floor(1000 * math.log((2 * total["n"] + 2) / (2 * int(d) + 1))) for d in holders]
    weights = Weights(total["n"], total["l"], np.array(weight, dtype=np.int64))
    found = _ranked(forward, asked, weights, k, id_type, most_postings)
    # in two steps, so that no task gets what every task of the cluster has kept of a query
    groups = max(1, math.isqrt(len(forward.inputFiles())))
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    some = found.withColumn("rank", F.row_number().over(Window.partitionBy("id", F.pmod("part", F.lit(groups))).orderBy(*order))).where(F.col("rank") <= k)
    out = some.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where(F.col("rank") <= k)
    out = written(out.select("id", "rank", "doc_id", "score"), "ranked")
    drop(forward)
    return out


def search(
    docs: DataFrame, queries: DataFrame, k: int = K, item_col: str = "item_id", query_col: str = "text", most_terms: int = MOST_TERMS, most_queries: int = MOST_QUERIES,
    most_postings: int = MOST_POSTINGS,
) -> DataFrame:
    """The ``k`` best documents of each query: item id, rank (from 1), doc_id, score; fewer where fewer score above 0.

    All queries run over all documents and whole texts. Null and empty texts have no term: as queries they find nothing,
    as documents they aren't counted. Queries that share an id are one query with the terms of all; a null id is an id.
    Each row of ``docs`` is a document; of equal scores the least doc_id is first, null last, and rows of one doc_id have
    ranks of their own. Empty tables give no rows; other columns are ignored.
    """
    rows = written(query_terms(queries, item_col, query_col), "asked")
    size = rows.agg(F.count("*").alias("terms"), F.count_distinct(F.struct("id")).alias("queries")).first()
    id_type = rows.schema["id"].dataType.simpleString()
    blocks = max(math.ceil(size["terms"] / most_terms), math.ceil(size["queries"] / most_queries))
    out = docs.sparkSession.createDataFrame([], f"id {id_type}, rank int, doc_id long, score long")
    for b in range(blocks):
        own = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64(F.struct("id")), F.lit(blocks)) == b)
        found = _search_block(docs.select("doc_id", "text"), own, k, id_type, most_postings)
        out = found if b == 0 else out.unionByName(found)
    drop(rows)
    return out.withColumnRenamed("id", item_col)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = rf"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{PATTERN}')"
OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents WHERE text IS NOT NULL),
size AS (SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d WHERE len(t) > 0),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
held AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, size GROUP BY term, n_docs),
scores AS (
  SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM held JOIN weights USING (term) JOIN asked USING (term), size GROUP BY item_id, r, doc_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS INTEGER) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {K}
"""
