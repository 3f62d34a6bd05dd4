"""Toxicity by gradient-boosted trees over dense features (operator 7).

One Arrow pass turns each whole text into a few numbers: densities of lexicon hits, second-person
words near hits, capitals, punctuation, obfuscated tokens. The lexicon (at most ``LEXICON`` words
and word beginnings) is learned from labelled rows by chi-square and log-odds. The trees and an
isotonic calibration are Spark ML models, fitted on a bounded sample of labelled rows
(``SAMPLE`` of either label, drawn by hash of the id); rows of one fold calibrate, the others grow
the trees. Scoring is one more narrow pass in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tamarack.llm.common import release, table, without_gc
from tamarack.operators.storage import drop, written

SAMPLE = 4_000
LEXICON = 150
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
NEAR_TOKENS = 3
PREFIXES = (3, 4, 5, 6, 7)
#: Second-person words of common languages, fixed values.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deiner ihr euch tu te toi ton ta tes vous votre vos "
    "tú ti tuyo tuya vos usted ustedes vuestro".split()
)
#: Characters that stand for letters in disguised words, fixed values.
LEET = str.maketrans("013457@$!|", "oieastasil")
_NO_LETTERS = re.compile(r"[\W\d_]+")
_INSIDE = re.compile(r"[^\W\d_][\d@$!|*.#_-]+[^\W\d_]")
_ASCII = re.compile("[\0-\x7f]+")
FEATURES = (
    "log_tokens", "hit_density", "hits_log", "distinct_hits", "best_weight", "weight_sum", "hidden_hits",
    "near_second_person", "second_person", "capitals", "capital_tokens", "exclaim", "question", "symbols", "digits",
    "obfuscated", "mean_token", "repeats",
)


def cores(token: str) -> tuple[str, str]:
    """The letters of a lower-cased token, and those behind its disguise."""
    return _NO_LETTERS.sub("", token), _NO_LETTERS.sub("", token.translate(LEET))


def word_features(token: str) -> set[str]:
    """What the lexicon may hold of a token: the word, and the beginnings of longer words."""
    word = cores(token)[0]
    if len(word) < 3:
        return set()
    return {"w:" + word} | {"p:" + word[:k] for k in PREFIXES if len(word) > k}


class Reader:
    """Features of texts under one lexicon; remembers what it found of tokens, in two generations of ``limit`` each."""

    def __init__(self, lexicon: dict[str, float], limit: int = 40_000):
        self.lexicon, self.limit, self.young, self.elder = lexicon, limit, {}, {}

    def _hit(self, word: str) -> float:
        if len(word) < 3:
            return 0.0
        get, found = self.lexicon.get, self.lexicon.get("w:" + word, 0.0)
        for k in PREFIXES:
            if k > len(word):
                break
            found = max(found, get("p:" + word[:k], 0.0))
        return found

    def _token(self, token: str) -> tuple[float, bool, bool, bool] | None:
        """Weight of a hit, whether it was hidden, second person, obfuscated; None for a token with nothing of these."""
        if token.isalpha():  # nothing to take away, nothing disguised
            value = self._hit(token), False, token in SECOND_PERSON, False
        else:
            plain, behind = cores(token)
            weight, hidden = self._hit(plain), False
            if not weight and behind != plain:
                weight = self._hit(behind)
                hidden = weight > 0
            value = weight, hidden, plain in SECOND_PERSON, bool(_INSIDE.search(token))
        return value if any(value) else None

    def _known(self, counts: Counter) -> Iterator[tuple[str, int, tuple[float, bool, bool, bool]]]:
        """The tokens that count for something."""
        young, elder, missing = self.young, self.elder, self
        for token, times in counts.items():
            value = young.get(token, missing)
            if value is missing:
                value = elder.get(token, missing)
                if value is missing:
                    value = self._token(token)
                if len(token) <= 64:
                    if len(young) >= self.limit:
                        self.young, self.elder = young, elder = {}, young
                    young[token] = value
            if value is not None:
                yield token, times, value

    def features(self, text: str | None) -> list[float]:
        text = text or ""
        words = text.split()
        n = len(words)
        if not n:
            return [0.0] * len(FEATURES)
        tokens = text.lower().split()
        counts = Counter(tokens)
        hits, persons, weights, hidden, obfuscated = set(), set(), 0.0, 0, 0
        best, n_hits = 0.0, 0
        for token, times, value in self._known(counts):
            if value[0]:
                hits.add(token)
                n_hits += times
                weights += value[0] * times
                best = max(best, value[0])
                hidden += times * value[1]
            if value[2]:
                persons.add(token)
            if value[3]:
                obfuscated += times
        near, spoken = 0, sum(counts[t] for t in persons)
        if hits and persons:
            where = np.array([i for i, t in enumerate(tokens) if t in persons])
            at = np.array([i for i, t in enumerate(tokens) if t in hits])
            behind = np.searchsorted(where, at - NEAR_TOKENS)
            near = int((where[np.minimum(behind, len(where) - 1)] - at <= NEAR_TOKENS)[behind < len(where)].sum())
        data = np.bincount(np.frombuffer(text.encode(), dtype=np.uint8), minlength=256)
        size = max(1, int(data.sum()))
        upper = int(data[65:91].sum()) + (0 if text.isascii() else sum(map(str.isupper, _ASCII.sub("", text))))
        return [
            float(np.log1p(n)), n_hits / n, float(np.log1p(n_hits)), float(len(hits)), best, weights / n, hidden / n,
            near / n, spoken / n, upper / size, sum(map(str.isupper, words)) / n,
            data[33] / size, data[63] / size, int(data[[35, 36, 37, 38, 42, 64, 94, 124]].sum()) / size,
            int(data[48:58].sum()) / size, obfuscated / n, size / n, 1 - len(counts) / n,
        ]


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text falls into the held-out fold; null ids do not."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def training_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of labelled rows outside the held-out fold, one for each doc_id (1 wins)."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
    return usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))


def draw(known: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, toxic, weight): at most ``sample`` rows of either label, least hash first; weight undoes the drawing."""
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    parts = [
        known.where(F.col("toxic") == y)
        .orderBy(F.xxhash64("doc_id", F.lit("toxicity")), "doc_id")
        .limit(sample)
        .withColumn("weight", F.lit(max(1.0, sizes.get(y, 0) / sample)))
        for y in (0, 1)
    ]
    return written(parts[0].unionByName(parts[1]), "drawn")


def learn_lexicon(texts: DataFrame, size: int = LEXICON) -> dict[str, float]:
    """(text, toxic) rows to the words and beginnings that mark label 1, with their log-odds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list[int]] = {}
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own: set[str] = set()
                for token in set((text or "").lower().split()):
                    own |= word_features(token)
                for f in own:
                    found.setdefault(f, [0, 0])[y] += 1
            yield pa.RecordBatch.from_pydict(
                {"f": list(found), "neg": [v[0] for v in found.values()], "pos": [v[1] for v in found.values()]}
            )

    totals = texts.agg(F.count_if(F.col("toxic") == 1).alias("p"), F.count_if(F.col("toxic") == 0).alias("n")).first()
    if not totals["p"] or not totals["n"]:
        return {}
    p, n = float(totals["p"]), float(totals["n"])
    ranked = (
        texts.select("text", "toxic").mapInArrow(count, "f string, neg long, pos long")
        .groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .where("pos >= 3")
        .withColumn("odds", F.expr(f"ln((pos + 0.5) / {p + 1}) - ln((neg + 0.5) / {n + 1})"))
        .withColumn("chi", F.expr(f"pow(pos * {n} - neg * {p}, 2) / ((pos + neg) * ({p + n} - pos - neg + 1))"))
        .where("odds >= 2.5")
        .orderBy(F.desc("chi"), "f").limit(size)
    )
    return {r["f"]: r["odds"] for r in ranked.collect()}


def featured(docs: DataFrame, lexicon: dict[str, float], keep: list[str], text_col: str = "text") -> DataFrame:
    """row (a struct of the columns ``keep``) and vector (the numbers FEATURES of the whole text), narrow.

    Null and empty texts are all zero.
    """
    frozen = tuple(sorted(lexicon.items()))
    source = docs.select(F.struct(*(docs[c] for c in keep)).alias("row"), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(frozen)
        with without_gc():
            for batch in batches:
                for first in range(0, batch.num_rows, 1_000):
                    part = batch.slice(first, 1_000)
                    rows = np.array([reader.features(t.as_py()) for t in part.column(1)], dtype=np.float64).reshape(-1, len(FEATURES))
                    offsets = np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES)
                    vector = pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([part.column(0), vector], names=["row", "vector"])
        release()

    schema = StructType([source.schema["row"], StructField("vector", ArrayType(DoubleType()))])
    return source.mapInArrow(run, schema)


@lru_cache(maxsize=1)
def _reader(lexicon: tuple) -> Reader:
    return Reader(dict(lexicon))


def rated(docs: DataFrame, labels: DataFrame, keep: list[str], sample: int = SAMPLE, size: int = LEXICON, seed: int = 7) -> DataFrame:
    """row (a struct of the columns ``keep``) and score of every row of ``docs``: one narrow pass after the fit."""
    drawn = draw(training_labels(labels), sample)
    # the drawn ids number 2 * sample at most, so that they may be broadcast
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "doc_id")
    # of repeated ids the least text, null last
    once = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"), F.first("weight").alias("weight"))
    fitting = written(once, "fitting")
    lexicon = learn_lexicon(fitting.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) != 0), size)
    kinds = {r["toxic"] for r in fitting.select("toxic").distinct().collect()}
    marked = featured(docs, lexicon, keep).withColumn("vector", array_to_vector("vector"))
    if kinds != {0, 1}:
        flat = marked.withColumn("score", F.lit(0.0))
    else:
        known = featured(fitting, lexicon, ["doc_id", "toxic", "weight"]).select(
            array_to_vector("vector").alias("vector"), F.col("row.toxic").cast("double").alias("label"), "row.weight",
            F.pmod(F.xxhash64("row.doc_id"), F.lit(4)).alias("part"),
        )
        rows = written(known.repartition(4), "vectors")
        grow, calibrate = rows.where("part <> 0"), rows.where("part = 0")
        if min(grow.select("label").distinct().count(), calibrate.select("label").distinct().count()) < 2:
            grow = calibrate = rows
        trees = GBTClassifier(
            featuresCol="vector", labelCol="label", weightCol="weight", maxIter=25, maxDepth=4, stepSize=0.2,
            maxBins=32, minInstancesPerNode=2, seed=seed, subsamplingRate=1.0, cacheNodeIds=False,
        ).fit(grow)
        raw = lambda df: trees.transform(df).withColumn("raw", vector_to_array("probability")[1])
        isotonic = IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="weight", predictionCol="calibrated").fit(
            raw(calibrate).select("raw", "label", "weight")
        )
        drop(rows)
        # steps of the calibration are ties; a thousandth of the trees' own order breaks them
        flat = isotonic.transform(raw(marked)).withColumn(
            "score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.999 * F.col("calibrated") + 0.001 * F.col("raw")))
        )
    drop(drawn)
    drop(fitting)
    return flat.select("row", "score")


def score(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.7) for every row of ``docs``.

    Labels are learned from rows outside the held-out fold alone; of texts of one doc_id the least is learned from. Null
    and empty texts get the score of a text without any feature. Repeated rows and null ids give a row each. Without
    labels of both kinds every score is 0. Other columns are ignored; an empty table gives none. ``options`` are those
    of :func:`rated`.
    """
    flat = rated(docs.select("doc_id", "text"), labels, ["doc_id"], **options).select("row.doc_id", "score")
    return flat.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def filter_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose text isn't predicted toxic, with their columns, whatever their names.

    Each row goes or stays by its own text, also where doc_ids are null or repeated; null and empty texts stay
    unless a text without any feature is predicted toxic. An empty table gives none. No text is shuffled.
    """
    return rated(docs, labels, docs.columns, **options).where(F.col("score") < THRESHOLD).select("row.*")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
