"""A search index at rest: postings by tier and term, read from the top until a query has its results.

Results are ordered by opportunity first. So documents are dealt to tiers of falling opportunity, each about ten times as
large as the one before, and a tier's documents all stand before the next one's. Postings lie by tier and by bucket of
their term, sorted by term within a file: a search reads of a tier the buckets of its terms alone, and goes on to the next
tier only with the queries that still lack results. A posting has what ordering needs, so documents themselves aren't read.

Kinds of terms: ``t`` stems of all the text, with their positions; ``g`` trigrams of the name; ``c`` the category.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarack.functions.text import normalize_text, trigrams
from tamarack.operators.search import CATEGORY_RANK, EMPTY_RANK, MIN_TRIGRAM, STOP_WORDS, light_stems
from tamarack.operators.storage import drop, written

#: Documents of the first tier; each further one has about ten times as many as those before it.
FIRST_TIER = 50_000
#: Take so many that a bucket's postings of the largest tier are some hundred MB.
BUCKETS = 16
#: Texts of so many words are grouped to terms without a shuffle.
ROW_WORDS = 64
#: So many asked terms are named in the filter of the scan; more are left to the join.
MOST_NAMED = 500
# Fixed values of the text rank: weight of a lexeme, sum of 1 / i ** 2, decay by distance and its reach.
WEIGHT, SQUARES, REACH = 0.1, 1.64493406685, 100


def query_words(text: Column, stems: Callable[[Column], Column] = light_stems) -> Column:
    """The distinct stems of a query, without stop words."""
    return F.array_distinct(stems(F.filter(F.split(normalize_text(text), " "), lambda w: (w != "") & ~w.isin(*STOP_WORDS))))


def text_rank(positions: Column) -> Column:
    """The rank of a document that holds all lexemes of a query, from the positions of each (an array of arrays).

    One lexeme ranks by how often it is there, each further time adding less; several by the nearness of every two of
    their places, put together as independent chances.
    """
    n = F.size(positions)
    once = F.aggregate(F.sequence(F.lit(1), F.size(positions[0])), F.lit(0.0), lambda a, j: a + F.lit(WEIGHT) / (j * j).cast("double")) / SQUARES
    missed = lambda d: F.log(1 - WEIGHT * F.sqrt(F.when(d > REACH, F.lit(1e-30)).otherwise(F.lit(1.0) / (1.005 + 0.05 * F.exp(d / 1.5 - 2)))))

    def pair(a: Column, b: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + F.aggregate(b, F.lit(0.0), lambda t, y: t + F.when(x == y, 0.0).otherwise(missed(F.abs(x - y)))))

    later = lambda i: F.slice(positions, i + 1, F.greatest(n - i, F.lit(0)))
    both = F.aggregate(
        F.sequence(F.lit(1), n - 1), F.lit(0.0), lambda s, i: s + F.aggregate(later(i), F.lit(0.0), lambda t, other: t + pair(F.element_at(positions, i), other))
    )
    return F.when(n == 1, once).otherwise(1 - F.exp(both))


class Index:
    """An index below ``root``: the least opportunity of each tier but the last, falling, and how many buckets."""

    def __init__(self, spark: SparkSession, root: str, bounds: tuple[float, ...], buckets: int, rows: int, id_type: str):
        self.spark, self.root, self.bounds, self.buckets, self.rows, self.id_type = spark, root, bounds, buckets, rows, id_type

    @property
    def tiers(self) -> range:
        return range(len(self.bounds) + 1)

    def bucket(self, kind: Column, term: Column) -> Column:
        return F.pmod(F.xxhash64(kind, term), F.lit(self.buckets)).cast("int")

    # the tables' files are listed once

    @cached_property
    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/postings")

    @cached_property
    def counts(self) -> DataFrame:
        """(kind, term, tier, n): documents of each term."""
        return self.spark.read.parquet(f"{self.root}/counts")

    @cached_property
    def documents(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/documents")


def open_index(spark: SparkSession, root: str) -> Index:
    """An index that :func:`build_index` wrote."""
    meta = json.loads(spark.read.text(f"{root}/meta").first()["value"])
    return Index(spark, root, tuple(meta["bounds"]), meta["buckets"], meta["rows"], meta["id_type"])


def build_index(entities: DataFrame, text: Column, root: str, stems: Callable[[Column], Column] = light_stems, first_tier: int = FIRST_TIER, buckets: int = BUCKETS, row_words: int = ROW_WORDS) -> Index:
    """Write the index of entities (id, name, category, opportunity, reviews, location_confidence) over ``text`` to ``root``.

    Entities without an opportunity aren't indexed. Documents of equal opportunity are of one tier.
    """
    spark = entities.sparkSession
    known = entities.where("opportunity IS NOT NULL AND NOT isnan(opportunity)")
    n = known.count()
    shares = [1 - first_tier * 10**t / n for t in range(20) if first_tier * 10**t < n]
    bounds = tuple(sorted(set(known.approxQuantile("opportunity", shares, 0.0001)), reverse=True)) if shares else ()
    index = Index(spark, root, bounds, buckets, n, known.schema["id"].dataType.simpleString())
    meta = json.dumps({"bounds": bounds, "buckets": buckets, "rows": n, "id_type": index.id_type})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.text(f"{root}/meta")
    if not n:
        return index
    tier = sum((F.when(F.col("opportunity") < b, 1).otherwise(0) for b in bounds), F.lit(0)).cast("int")
    fields = ("category", "opportunity", "reviews", "location_confidence")
    docs = known.select("id", *fields, tier.alias("tier"), trigrams(normalize_text(F.col("name"))).alias("grams"), F.split(normalize_text(text), " ").alias("words"))
    docs.select("id", *fields, "tier").write.partitionBy("tier").parquet(f"{root}/documents")
    kept = ("id", "tier", *fields, F.size("grams").alias("n_grams"))
    # stop words keep their place in the count of positions
    stemmed = F.arrays_zip(F.col("words").alias("word"), stems(F.col("words")).alias("term"))
    names = [c if isinstance(c, str) else "n_grams" for c in kept]
    # the words of a short text are grouped in its row, a square of few; those of long texts are shuffled
    short, long = docs.where(F.size("words") <= row_words), docs.where(F.size("words") > row_words)
    counted = F.filter(
        F.transform("w", lambda x, i: F.struct(x["word"].alias("word"), x["term"].alias("term"), (i + 1).alias("at"))), lambda x: (x["word"] != "") & ~x["word"].isin(*STOP_WORDS)
    )
    of_term = F.explode(F.transform(F.array_distinct("w.term"), lambda t: F.struct(t.alias("term"), F.transform(F.filter("w", lambda x: x["term"] == t), lambda x: x["at"]).alias("positions"))))
    in_row = short.select(*kept, stemmed.alias("w")).select(*names, counted.alias("w")).select(*names, of_term.alias("x")).select(*names, "x.term", "x.positions")
    tokens = long.select(*kept, F.posexplode(stemmed).alias("at", "w")).where((F.col("w.word") != "") & ~F.col("w.word").isin(*STOP_WORDS))
    shuffled = tokens.groupBy(*names, F.col("w.term").alias("term")).agg(F.sort_array(F.collect_list(F.col("at") + 1)).alias("positions"))
    placed = in_row.unionByName(shuffled).withColumn("kind", F.lit("t"))
    none = F.lit(None).cast("array<int>").alias("positions")
    grams = docs.select(*kept, F.lit("g").alias("kind"), none, F.explode("grams").alias("term"))
    categories = docs.where("category IS NOT NULL").select(*kept, F.lit("c").alias("kind"), none, F.col("category").alias("term"))
    every = placed.unionByName(grams).unionByName(categories).withColumn("bucket", index.bucket(F.col("kind"), F.col("term")))
    # a rebalance: the bucket of a term that very many documents hold is written by several tasks
    every.hint("rebalance", F.col("tier"), F.col("bucket")).sortWithinPartitions("tier", "bucket", "kind", "term").write.partitionBy("tier", "bucket").parquet(f"{root}/postings")
    index.postings.groupBy("kind", "term", "tier").agg(F.count("*").alias("n")).write.parquet(f"{root}/counts")
    return index


def _asked(queries: DataFrame, stems: Callable[[Column], Column]) -> DataFrame:
    """query_id, category, empty, and the terms that a query looks for by kind."""
    text = normalize_text(F.col("query"))
    return queries.select("query_id", "category", (text == "").alias("empty"), query_words(F.col("query"), stems).alias("tokens"), trigrams(text).alias("grams"))


def search(queries: DataFrame, index: Index, k: int, min_score: float = 45.0, min_location: float = 0.7, stems: Callable[[Column], Column] = light_stems) -> DataFrame:
    """The best ``k`` documents of each query (query_id, query, category): query_id, id, opportunity, reviews, relevance, rank.

    A document matches if it holds all stems of the query, or its name's trigrams overlap by 0.3, or the category is equal,
    or the query is empty, and if its score and its location's confidence reach the floors. Relevance is the greatest of
    the text rank (0.35 for an empty query), the overlap and 0.6 for the category. Order: opportunity, relevance, reviews
    (nulls last), id. A query of nothing but stop words isn't empty: it matches by name or category alone.
    """
    if not index.rows:
        return index.spark.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {index.id_type}, opportunity double, reviews int, relevance double, rank int")
    asked = written(_asked(queries, stems), "asked")
    wanted = _wanted(asked).select("kind", "term", index.bucket(F.col("kind"), F.col("term")).alias("b"))
    some = wanted.limit(MOST_NAMED + 1).collect()
    named = sorted({r["term"] for r in some}) if len(some) <= MOST_NAMED else None
    buckets = sorted({r["b"] for r in (some if named is not None else wanted.select("b").distinct().collect())})
    blank = not asked.where("empty").isEmpty()
    gate = (F.col("opportunity") >= min_score) & (F.col("location_confidence") >= min_location)
    found: list[DataFrame] = []
    open_ = asked
    for tier in index.tiers:
        if tier and index.bounds[tier - 1] < min_score:
            break  # what is left lies below the floor
        hits = written(_search_tier(open_, index, tier, buckets, named, k, gate, blank), "hits")
        found.append(hits)
        if tier + 1 == len(index.tiers):
            break
        counts = hits.groupBy("query_id").agg(F.count("*").alias("n"))
        # ``missing``: how many results a query lacks still; those of this tier stand before all later ones
        missing = F.coalesce("missing", F.lit(k)) if "missing" in open_.columns else F.lit(k)
        open_ = written(open_.join(counts, "query_id", "left").withColumn("missing", missing - F.coalesce("n", F.lit(0))).drop("n").where("missing > 0"), "open")
        if open_.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    w = Window.partitionBy("query_id").orderBy(F.desc("opportunity"), F.desc("relevance"), F.desc_nulls_last("reviews"), "id")
    ranked = written(out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), "results")
    for t in (asked, *found):
        drop(t)
    return ranked


def _wanted(asked: DataFrame) -> DataFrame:
    """(kind, term): what the queries look for, once each."""
    terms = F.concat(
        F.transform("tokens", lambda t: F.struct(F.lit("t").alias("kind"), t.alias("term"))), F.transform("grams", lambda t: F.struct(F.lit("g").alias("kind"), t.alias("term"))),
        F.when(F.col("category").isNotNull(), F.array(F.struct(F.lit("c").alias("kind"), F.col("category").alias("term")))).otherwise(F.array()),
    )
    return asked.select(F.explode(terms).alias("x")).select("x.*").distinct()


def _search_tier(asked: DataFrame, index: Index, tier: int, buckets: list[int], named: list[str] | None, k: int, gate: Column, blank: bool) -> DataFrame:
    """Of one tier the best ``k`` of each query. ``buckets`` hold all that is asked, ``named`` names it where it is little."""
    fields = ("category", "opportunity", "reviews")
    order = (F.desc("opportunity"), F.desc_nulls_last("reviews"), "id")
    held = index.postings.where((F.col("tier") == tier) & F.col("bucket").isin(buckets)).where(gate)
    if named is not None:
        held = held.where(F.col("term").isin(named))
    counts = index.counts.where(F.col("tier") == tier).join(_wanted(asked), ["kind", "term"], "left_semi").select("kind", "term", "n")
    of = lambda kind: held.where(F.col("kind") == kind)

    def rarest(kind: str, items: str, probes: Column) -> DataFrame:
        """(query_id, term) of a query's ``probes`` rarest items in this tier."""
        rows = asked.select("query_id", F.size(items).alias("size"), F.explode(items).alias("term")).join(counts.where(F.col("kind") == kind).select("term", "n"), "term", "left")
        own = rows.groupBy("query_id", "size").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term"))).alias("o"))
        return own.select("query_id", F.explode(F.slice("o", F.lit(1), probes)).alias("x")).select("query_id", F.col("x.term").alias("term"))

    def all_of(candidates: DataFrame, kind: str, items: str) -> DataFrame:
        """Candidates (query_id, id) with each of the query's items that they hold."""
        rows = candidates.join(asked.select("query_id", F.size(items).alias("size"), F.explode(items).alias("term")), "query_id")
        return rows.join(of(kind).select("term", "id", "positions", "n_grams", *fields), ["term", "id"])

    # a document with all stems of a query holds the rarest; the others are looked up for those that do
    first = rarest("t", "tokens", F.lit(1)).join(of("t").select("term", "id"), "term").select("query_id", "id")
    by_text = (
        all_of(first, "t", "tokens").groupBy("query_id", "id", "size", *fields).agg(F.collect_list(F.struct("term", "positions")).alias("p")).where(F.size("p") == F.col("size"))
        .select("query_id", "id", *fields, text_rank(F.transform(F.array_sort("p"), lambda x: x["positions"])).alias("relevance"))
    )
    # an overlap of 0.3 takes 0.3 of the query's trigrams at least, and so one of all but the rest
    probes = (F.col("size") - F.ceil(F.col("size") * MIN_TRIGRAM) + 1).cast("int")
    near = rarest("g", "grams", probes).join(of("g").select("term", "id"), "term").select("query_id", "id").distinct()
    by_name = (
        all_of(near, "g", "grams").groupBy("query_id", "id", "size", "n_grams", *fields).agg(F.count("*").alias("shared"))
        .select("query_id", "id", *fields, (F.col("shared") / (F.col("size") + F.col("n_grams") - F.col("shared"))).alias("relevance")).where(F.col("relevance") >= MIN_TRIGRAM)
    )
    # of a category, and of all documents for empty queries, the best k are all that can come into a result
    in_category = of("c").withColumn("r", F.row_number().over(Window.partitionBy("term").orderBy(*order))).where(F.col("r") <= k)
    by_category = asked.where("category IS NOT NULL").select("query_id", F.col("category").alias("term")).join(in_category.select("term", "id", *fields), "term").select("query_id", "id", *fields, F.lit(CATEGORY_RANK).alias("relevance"))
    hits = by_text.unionByName(by_name).unionByName(by_category)
    if blank:
        empty, top = asked.where("empty").select("query_id"), index.documents.where(F.col("tier") == tier).where(gate).orderBy(*order).limit(k).select("id", *fields)  # k rows
        hits = hits.unionByName(_with_each(empty, top, fields))
    same = hits.join(asked.select("query_id", F.col("category").alias("asked")), "query_id").withColumn("relevance", F.greatest("relevance", F.when(F.col("category") == F.col("asked"), CATEGORY_RANK)))
    best = same.groupBy("query_id", "id", "opportunity", "reviews").agg(F.max("relevance").alias("relevance"))
    w = Window.partitionBy("query_id").orderBy(F.desc("opportunity"), F.desc("relevance"), F.desc_nulls_last("reviews"), "id")
    return best.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def _with_each(queries: DataFrame, top: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Every query with the rows of ``top``, of which there are a page at most."""
    page = top.agg(F.collect_list(F.struct("id", *fields)).alias("page"))
    both = queries.withColumn("one", F.lit(1)).join(page.withColumn("one", F.lit(1)), "one")
    return both.select("query_id", F.explode("page").alias("d")).select("query_id", "d.*", F.lit(EMPTY_RANK).alias("relevance"))
