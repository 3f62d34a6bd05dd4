"""Language identification by nearest centroids (operator 10).

A text becomes a hashed vector of byte trigrams of its lower-cased letters, damped term frequency
times inverse document frequency, of length one. Each language has several centroids, from
spherical k-means over its training vectors; a text takes the language of the centroid with the
greatest cosine, and is rejected where that centroid is further than texts of the language are that
show as many different trigrams. A text of m trigrams is at a cosine of about sqrt(m / (m + M)) from
its language, M being fitted for each; what training rows have of that, each measured without its own
share in the centroid, bounds what is asked of texts of about their length. No row of the held-out fold has a part in that.

The classifier is fitted on about ``sample`` labelled documents of each language, drawn by hash of
the id (the documented bound of the fit). Every whole text is then scored in one narrow Arrow pass; what
the pass carries is k vectors of 16 KB for each language, and more than ``MAX_LANGS`` of these are an error.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm.common import map_texts, release, table
from tamarack.operators.storage import written

DIMENSIONS = 4096
SAMPLE = 500
CENTROIDS = 3
MAX_LANGS = 1_000
#: A cluster of less than this share of its language's rows is odd texts, and joins its neighbours.
LEAST_CLUSTER = 0.05
FOLDS, HELD_OUT = 4, 2
SHARPNESS = 25.0
#: Training rows of about one length, from whose tail a cut is taken: one that RATE of a language's texts fall below, if the
#: tail beyond the lowest TAIL of rows goes on as it is (two bands at least). With fewer than FEW_ROWS in all a cut is half
#: the least and grows with the text up to ENOUGH_TRIGRAMS.
BAND_ROWS, TAIL, RATE, FEW_ROWS, ENOUGH_TRIGRAMS = 1_000, 0.05, 1e-6, 200, 400
UNDETERMINED = "und"
#: ASCII that is no letter becomes a space; bytes of other characters stay.
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def counts(text: str) -> np.ndarray:
    """Hashed counts of the byte trigrams of a text, without those of three spaces."""
    data = np.frombuffer(b" " + text.lower().encode().translate(_LETTERS) + b" ", dtype=np.uint8)
    out = np.zeros(DIMENSIONS, dtype=np.int64)
    for first in range(0, max(0, len(data) - 2), 1_000_000):  # bounded memory for a text of any length
        b = data[first : first + 1_000_002].astype(np.uint32)
        code = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))
        blank = (b[:-2] == 32) & (b[1:-1] == 32)
        code = (code >> np.uint32(16)) % np.uint32(DIMENSIONS)
        out += np.bincount(code[~blank], minlength=DIMENSIONS)
    return out


def vectors(texts: list, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of length one (or zero) for each text, and how many different trigrams each has."""
    rows = np.empty((len(texts), DIMENSIONS), dtype=np.float32)
    for i, text in enumerate(texts):
        rows[i] = np.log1p(counts(text or ""))
    distinct = np.count_nonzero(rows, axis=1)
    rows *= idf
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=rows, where=norms > 0), distinct


def held_out(id_col: str = "doc_id", folds: int = FOLDS, fold: int = HELD_OUT):
    """Whether crc32 of the id as text falls into the held-out fold; null ids do not."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def expected(distinct: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Cosine from its language that a text of so many different trigrams has."""
    return np.sqrt(distinct / np.maximum(distinct + half, 1e-9))


class Cuts:
    """Least share of the expected cosine by number of different trigrams, from training rows in bands of about one length."""

    def __init__(self, distinct: np.ndarray, share: np.ndarray):
        order = np.argsort(distinct, kind="stable")
        self.few = len(order) < FEW_ROWS
        bands = [order] if self.few else np.array_split(order, max(2, len(order) // BAND_ROWS))
        self.starts = np.array([distinct[b[0]] for b in bands if len(b)])
        if self.few:
            self.least = np.array([0.5 * min(1.0, max(0.0, share[b].min())) for b in bands if len(b)])
        else:
            self.least = np.array([self.tail(share[b]) for b in bands if len(b)])

    @staticmethod
    def tail(share: np.ndarray) -> float:
        """Where the logarithm's tail, exponential beyond its TAIL quantile, has RATE left."""
        low = -np.log(np.clip(share, 1e-6, 1.0))
        begin = np.quantile(low, 1 - TAIL)
        over = low[low > begin] - begin
        return float(np.exp(-(begin + (over.mean() if len(over) else 0.0) * np.log(TAIL / RATE))))

    def at(self, distinct: int) -> float:
        least = self.least[max(0, np.searchsorted(self.starts, distinct, side="right") - 1)]
        return float(least * min(1.0, distinct / ENOUGH_TRIGRAMS) if self.few else least)


class Model:
    """Centroids (m, DIMENSIONS) of languages ``langs`` with the half-way trigrams M of each and the cuts by length."""

    def __init__(self, langs: list[str], centroids: np.ndarray, half: np.ndarray, cuts: Cuts, idf: np.ndarray):
        self.langs, self.half, self.cuts, self.idf = np.array(langs, dtype=object), half, cuts, idf
        self.centroids = centroids.astype(np.float32)
        self.names = sorted(set(langs))
        self.starts = {lang: np.flatnonzero(self.langs == lang) for lang in self.names}

    def predict(self, texts: list) -> tuple[list, list, list, list]:
        """Languages, scores, cosines and rejections."""
        lang, score, cosine, rejected = [], [], [], []
        for first in range(0, len(texts), 512):
            part = texts[first : first + 512]
            known = [has_letter(t) for t in part]
            if not self.names:
                known = [False] * len(part)
            rows, distinct = vectors([t if k else "" for t, k in zip(part, known)], self.idf)
            for k, row, m in zip(known, rows @ self.centroids.T, distinct):
                if not k:
                    lang.append(UNDETERMINED), score.append(0.0), cosine.append(0.0), rejected.append(True)
                    continue
                best = np.array([row[self.starts[n]].max() for n in self.names], dtype=np.float64)
                win = int(best.argmax())
                weight = np.exp(SHARPNESS * (best - best[win]))
                lang.append(self.names[win])
                score.append(float(1 / weight.sum()))
                cosine.append(float(min(1.0, max(0.0, best[win]))))
                rejected.append(bool(best[win] < self.cuts.at(m) * expected(m, self.half[self.starts[self.names[win]][0]])))
        return lang, score, cosine, rejected


def _centroids(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, seeded by rows drawn in proportion to their distance from those drawn before; rows are in
    a fixed order. Clusters of few rows are dissolved at the end."""
    rng, order = np.random.default_rng(11), np.lexsort(rows[:, :4].T)
    rows = rows[order]

    def settled(centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(rounds):
            own = (rows @ centres.T).argmax(axis=1)
            sums = np.stack([rows[own == j].sum(axis=0) if (own == j).any() else centres[j] for j in range(len(centres))])
            norms = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = sums / np.where(norms > 0, norms, 1)
        return centres, np.bincount((rows @ centres.T).argmax(axis=1), minlength=len(centres))

    chosen = [rows[int(rng.integers(len(rows)))]]
    for _ in range(k - 1 if len(rows) >= 4 * k else 0):
        far = np.maximum(0, 1 - np.max(np.stack([rows @ c for c in chosen]), axis=0)) ** 2
        chosen.append(rows[int(rng.choice(len(rows), p=far / far.sum())) if far.sum() > 0 else 0])
    centres, sizes = settled(np.stack(chosen))
    if (large := sizes >= LEAST_CLUSTER * len(rows)).any() and not large.all():
        centres, _ = settled(centres[large])
    return centres


def fit(
    labelled: DataFrame,
    sample: int = SAMPLE,
    k: int = CENTROIDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> Model:
    """Fit on about ``sample`` rows of each language; rows of null language or text without a letter don't count."""
    usable = labelled.select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")
    ).where("lang is not null and text is not null and id is not null")
    sizes = usable.groupBy("lang").count().orderBy("lang").limit(MAX_LANGS + 1).collect()
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"there are more than {MAX_LANGS} languages; their centroids would not fit a worker")
    empty = Model([], np.zeros((0, DIMENSIONS)), np.zeros(0), Cuts(np.zeros(0), np.zeros(0)), np.ones(DIMENSIONS, dtype=np.float32))
    if not sizes:
        return empty
    parts = F.create_map(*[F.lit(x) for row in sizes for x in (row["lang"], min(1 << 20, -(-sample * (1 << 20) // row["count"])))])
    chosen = usable.where(F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 20)) < F.element_at(parts, F.col("lang")))

    def count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(t, lang) for t, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if has_letter(t)]
            yield pa.RecordBatch.from_pydict(
                {"lang": pa.array([r[1] for r in rows], pa.string()),
                 "counts": pa.array([np.log1p(counts(r[0])).astype("<f4").tobytes() for r in rows], pa.binary())}
            )

    # about 8 MB for each language, whatever the number of tasks that read the corpus
    drawn = written(chosen.select("text", "lang").mapInArrow(count_rows, "lang string, counts binary").repartition("lang"), "language")

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMENSIONS, dtype=np.int64), 0
        for batch in batches:
            for row in batch.column(0).to_pylist():
                total += np.frombuffer(row, dtype="<f4") > 0
                n += 1
        yield pa.RecordBatch.from_pydict({"n": [n], "df": [total.tobytes()]})

    parts = drawn.select("counts").mapInArrow(frequency, "n long, df binary").collect()
    n, df = sum(p["n"] for p in parts), sum((np.frombuffer(p["df"], dtype=np.int64) for p in parts), np.zeros(DIMENSIONS, np.int64))
    idf = np.log((n + 1) / (df + 0.5)).astype(np.float32)

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        rows = np.stack([np.frombuffer(c, dtype="<f4") for c in group["counts"]]) * idf
        rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
        centres = _centroids(rows, k)
        sims = rows @ centres.T
        own, every = sims.argmax(axis=1), np.arange(len(rows))
        for j in range(len(centres)):  # without a row's own share in its centroid
            others = rows[own == j].sum(axis=0) - rows[own == j]
            sims[every[own == j], j] = np.einsum("rd,rd->r", rows[own == j], others) / np.maximum(np.linalg.norm(others, axis=1), 1e-6)
        near, distinct = sims.max(axis=1), np.count_nonzero(rows, axis=1)
        return pd.DataFrame(
            {"lang": group["lang"].iloc[0], "centre": [c.astype("<f4").tobytes() for c in centres],
             "distinct": [distinct.tolist()] + [[]] * (len(centres) - 1), "near": [near.tolist()] + [[]] * (len(centres) - 1)}
        )

    found = drawn.groupBy("lang").applyInPandas(cluster, "lang string, centre binary, distinct array<int>, near array<double>").collect()
    if not found:
        return empty
    found.sort(key=lambda r: (r["lang"], bytes(r["centre"])))
    centres = np.stack([np.frombuffer(r["centre"], dtype="<f4") for r in found])
    rows = {r["lang"]: (np.array(r["distinct"], dtype=np.float64), np.array(r["near"])) for r in found if r["distinct"]}
    half = {lang: float(np.median(m * np.maximum(1 / np.maximum(near, 1e-3) ** 2 - 1, 0))) for lang, (m, near) in rows.items()}
    share = np.concatenate([near / np.maximum(expected(m, half[lang]), 1e-9) for lang, (m, near) in rows.items()])
    cuts = Cuts(np.concatenate([m for m, _ in rows.values()]), share)
    return Model([r["lang"] for r in found], centres, np.array([half[r["lang"]] for r in found]), cuts, idf)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, cosine, rejected for every row.

    Null texts and texts without a letter are ``und``, score 0, rejected; so is every text when the
    model has no language. A tie between languages goes to the first by name. Repeated rows and null ids give a row each;
    an empty table gives none; texts of any length are read whole; other columns are ignored.
    """
    spread = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_LANGS * CENTROIDS vectors of 16 KB

    def run(ids: list, texts: list) -> dict:
        lang, score, cosine, rejected = spread.value.predict(texts)
        return {
            "doc_id": ids,
            "held_out": [i is not None and zlib.crc32(str(i).encode()) % FOLDS == HELD_OUT for i in ids],
            "lang_pred": lang, "score": score, "cosine": cosine, "rejected": rejected,
        }

    schema = "doc_id long, held_out boolean, lang_pred string, score double, cosine double, rejected boolean"
    return map_texts(docs, run, schema, id_col, text_col)


def fit_and_identify(docs: DataFrame, sample: int = SAMPLE, k: int = CENTROIDS) -> DataFrame:
    """Fit on the rows of ``docs`` outside the held-out fold that have a language, then identify all rows."""
    return identify(docs, fit(docs.where(~held_out()), sample, k))


def filter_languages(docs: DataFrame, sample: int = SAMPLE, k: int = CENTROIDS) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their columns, whatever their names; narrow.

    Null and empty texts and texts without a letter go. Each row goes or stays by its own text, also where doc_ids are
    null or repeated; a tie between languages goes to the first by name and rejects nothing. Without any labelled row all
    rows go; an empty table gives none.
    """
    model = fit(docs.where(~held_out()), sample, k)
    spread = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rejected = spread.value.predict(batch.column(at).to_pylist())[3]
            yield batch.filter(pa.array([not r for r in rejected]))
        release()

    return docs.mapInArrow(run, docs.schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit_and_identify(table(spark, sf_dir, "documents"))
