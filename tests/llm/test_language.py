import base64
import zlib

import numpy as np

from tamarack.llm import language as L
from tamarack.llm.common import table


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = {r.doc_id: r for r in L.op10_language_id(spark, "/root/testdata/sf0.01").collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert set(got) == set(truth)
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in set(held)) for i in truth)
    right = np.mean([got[i].lang_pred == truth[i] for i in held])
    assert right > 0.97, right
    assert all(0 <= r.score <= 1 for r in got.values())
    assert not any(r.rejected for r in got.values())


def test_cases(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat sat on the mat", "en"), ("der hund und die katze", "de")] * 20)]
    rows += [(100, None, "en"), (101, "123 !", None), (102, "", "en"), (None, "the mat", None), (103, "the", None), (103, "the", None)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    got = L.fit_and_identify(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3
    assert by[103].lang_pred == by[None].lang_pred == "en" and not by[None].held_out
    kept = L.filter_languages(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(by) - {100, 101, 102}
    assert {r.lang_pred for r in L.fit_and_identify(docs.where("lang is null")).collect()} == {"und"}
    assert L.fit_and_identify(docs.limit(0)).count() == 0


def test_counts_of_a_long_text():
    once, many = L.counts("abc déf "), L.counts("abc déf " * 300_000)
    assert set(np.flatnonzero(once)) <= set(np.flatnonzero(many)) and many.sum() > 250_000 * once.sum()


def test_far_text_is_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    alien = spark.createDataFrame([(-5, "".join(chr(0x4E00 + (i * 37) % 20000) for i in range(3000)), None)], docs.schema)
    got = L.fit_and_identify(docs.unionByName(alien)).where("rejected").collect()
    assert [r.doc_id for r in got] == [-5]


def test_unlearned_texts_are_rejected_and_held_out_ones_of_every_length_kept(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = L.fit(docs.where(~L.held_out()))
    held = [r.text for r in docs.where(L.held_out()).collect() if L.has_letter(r.text)]
    distinct = [np.count_nonzero(L.counts(t)) for t in held]
    assert min(distinct) < 60 and max(distinct) > 600
    assert not any(model.predict(held)[3])
    rng = np.random.default_rng(0)
    finnish = "Suomen kieli kuuluu uralilaisten kielten ryhmään ja sitä puhutaan pääasiassa Suomessa. Kesällä ihmiset matkustavat mökeilleen järvien rannoille, missä he kalastavat, saunovat ja nauttivat valoisista öistä ystävien kanssa."
    alien = [
        base64.b64encode(rng.bytes(3000)).decode(),
        " ".join("".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), rng.integers(3, 9))) for _ in range(700)),
        finnish,
        finnish[:60],
        "Привет, как дела?",
    ]
    assert model.predict(alien)[3] == [True] * len(alien)


def test_cuts_are_taken_by_length(monkeypatch):
    monkeypatch.setattr(L, "BAND_ROWS", 200)
    low = np.exp(-np.r_[np.zeros(190), np.linspace(0.02, 0.2, 10)])  # a mean of 0.11 beyond the quantile
    cuts = L.Cuts(np.r_[np.full(200, 50.0), np.full(200, 500.0)], np.r_[low**2, low])
    assert cuts.at(5) == cuts.at(499) < cuts.at(500) == cuts.at(9000)
    begin = np.quantile(-np.log(low), 0.95)
    assert abs(-np.log(cuts.at(500)) - (begin + (np.linspace(0.02, 0.2, 10) - begin).mean() * np.log(0.05 / 1e-6))) < 1e-9
    few = L.Cuts(np.full(10, 50.0), np.full(10, 0.8))
    assert few.at(400) == 0.4 and round(few.at(40), 6) == 0.04


def plain_counts(text):
    """Hashed trigrams of bytes, one after the other."""
    data = b" " + "".join(c if ord(c) >= 128 or c.isalpha() else " " for c in text.lower()).encode() + b" "
    out = [0] * L.DIMENSIONS
    for a, b, c in zip(data, data[1:], data[2:]):
        if not (a == b == 32):
            code = (a * 0x9E3779B1 & 0xFFFFFFFF) ^ (b * 0x85EBCA6B & 0xFFFFFFFF) ^ (c * 0xC2B2AE35 & 0xFFFFFFFF)
            out[(code >> 16) % L.DIMENSIONS] += 1
    return np.array(out)


def test_against_plain_vectors_centroids_and_scores(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").limit(260)
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(docs.where(~L.held_out()), sample=1 << 20)  # every training row is drawn
    train = [(t, lang) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2 and lang is not None and t is not None and any(map(str.isalpha, t))]
    logs = [np.log1p(plain_counts(t)) for t, _ in train]
    df = sum((v > 0).astype(int) for v in logs)
    idf = np.log((len(logs) + 1) / (df + 0.5))
    assert np.abs(model.idf - idf).max() < 1e-5
    unit = lambda v: v * idf / max(np.linalg.norm(v * idf), 1e-12)
    known = {}
    for v, (_, lang) in zip(logs, train):
        known.setdefault(lang, []).append(unit(v))
    for lang, own in known.items():  # each centroid is the mean, at length one, of the rows that are nearest to it
        centres = model.centroids[[i for i, x in enumerate(model.langs) if x == lang]].astype(float)
        near = [int(np.argmax(centres @ v)) for v in own]
        for j, centre in enumerate(centres):
            mean = sum(v for v, n in zip(own, near) if n == j)
            assert near.count(j) >= L.LEAST_CLUSTER * len(own) and abs(centre @ mean / np.linalg.norm(mean) - 1) < 1e-4
    got = {r.doc_id: r for r in L.identify(docs, model).collect()}
    names = sorted(known)
    for i, text, _ in rows:
        if not text or not any(map(str.isalpha, text)):
            assert got[i].lang_pred == "und" and got[i].score == 0
            continue
        v = unit(np.log1p(plain_counts(text)))
        best = [max(float(c @ v) for c, x in zip(model.centroids.astype(float), model.langs) if x == n) for n in names]
        scores = np.exp(25 * (np.array(best) - max(best)))
        assert got[i].lang_pred == names[int(np.argmax(best))] and abs(got[i].score - 1 / scores.sum()) < 1e-3 and abs(got[i].cosine - max(best)) < 1e-4


def test_a_tie_goes_to_the_first_language_and_long_texts_are_whole(spark):
    rows = [(i, "abc def ghi", lang) for i, lang in enumerate(["b", "a"] * 30)] + [(900, "x" * 10 + " abc def ghi" * 200_000, None)]
    got = {r.doc_id: r for r in L.fit_and_identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert {got[i].lang_pred for i in range(60)} == {"a"} and abs(got[0].score - 0.5) < 1e-3 and got[900].lang_pred == "a"
