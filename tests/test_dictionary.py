"""Many terms at once, against the expressions that ask for one after the other."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tamarack.operators import classify, dictionary

TAXONOMY = [("dental", ["clinica dental", "dentista", "dental"]), ("law", ["abogado", "bufete", "notaria"]), ("food", ["bar", "bar de tapas", "tapas", "casa de comidas"]), ("odd", ["tapas", "a b"])]


def terms(spark, taxonomy):
    flat = [(i, t, c) for i, (t, c) in enumerate((t, c) for c, ts in taxonomy for t in ts)]
    return spark.createDataFrame(flat, "place long, term string, category string")


@pytest.mark.parametrize("most_bytes", [1 << 20, 300])
def test_as_the_expressions(spark, most_bytes):
    rnd = random.Random(2)
    words = "clinica dental dentista Bar de tapas casa comidas abogado a b barra x Bufete.".split()
    rows = [(i, rnd.choice([None, "", " ".join(rnd.choices(words, k=rnd.randrange(1, 4)))]), rnd.choice([None, " ".join(rnd.choices(words, k=rnd.randrange(1, 6)))])) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, kind string, name string")
    got = dictionary.classify_rows(df, F.col("kind"), F.col("name"), terms(spark, TAXONOMY), most_bytes=most_bytes)
    assert got.columns == ["id", "kind", "name", "classified"]
    want = df.select("id", classify.classify(F.col("kind"), F.col("name"), TAXONOMY).alias("c"))
    assert {r.id: tuple(r.classified) for r in got.collect()} == {r.id: tuple(r.c) for r in want.collect()}
    assert {r.classified.category for r in got.collect()} >= {"dental", "law", "food", "odd", "other"}


def test_no_terms_and_no_rows(spark):
    df = spark.createDataFrame([(1, "bar")], "id long, name string")
    none = terms(spark, TAXONOMY).limit(0)
    assert [r.m for r in dictionary.longest_matches(df, ["name"], none, "m").collect()] == [[None]]
    assert dictionary.longest_matches(df.limit(0), ["name"], terms(spark, TAXONOMY), "m").collect() == []


@pytest.mark.parametrize("most_bytes", [1 << 20, 120])
def test_terms_of_one_place_go_by_their_letters(spark, most_bytes):
    """Eight letters that differ in the last alone have one number of their first seven and a half."""
    known = spark.createDataFrame([(7, t, "c") for t in ("edtiones", "edtioner", "edtionet")], "place long, term string, category string")
    df = spark.createDataFrame([(1, "x edtiones edtionet edtioner"), (2, "edtionet edtiones")], "id long, text string")
    got = {r.id: r.m[0].term for r in dictionary.longest_matches(df, ["text"], known, "m", most_bytes).collect()}
    assert got == {1: "edtioner", 2: "edtiones"}


def test_time_does_not_follow_the_number_of_terms(spark):
    rnd = random.Random(1)
    make = lambda n: spark.createDataFrame([(i, "".join(rnd.choices("abcdefghij", k=9)), "c") for i in range(n)], "place long, term string, category string")
    text = " ".join("".join(rnd.choices("abcdefghij", k=9)) for _ in range(60))
    df = spark.range(0, 4_000, 1, 2).select("id", F.lit(text).alias("text"))
    taken = []
    for n in (100, 100_000):
        known = make(n).cache()
        known.count()
        run = lambda: dictionary.longest_matches(df, ["text"], known, "m").write.format("noop").mode("overwrite").save()
        run()
        begin = time.perf_counter()
        run()
        taken.append(time.perf_counter() - begin)
        known.unpersist()
    assert taken[1] < 6 * taken[0] + 3  # a thousand times the terms
