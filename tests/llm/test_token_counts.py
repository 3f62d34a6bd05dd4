import random
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tamarack.llm.common import table, tokenizer_path
from tamarack.llm.token_counts import MODEL, count_spliced, count_tokens, load

SP, STABLE = load(tokenizer_path(MODEL))


def test_boundaries_are_proven_stable():
    assert STABLE


@pytest.mark.parametrize("chunk,overlap", [(40, 8), (64, 3), (200, 50)])
def test_spliced_counts_equal_whole_ones(spark, sf_dir, chunk, overlap):
    for row in table(spark, sf_dir, "documents").limit(60).collect():
        assert count_spliced(SP, row.text, chunk, overlap) == len(SP.encode(row.text))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n▁é.<s>\U0001f600", max_size=200), st.integers(5, 40), st.integers(1, 12))
def test_spliced_counts_on_odd_texts(text, chunk, overlap):
    assert count_spliced(SP, text, chunk, overlap) == len(SP.encode(text))


@pytest.mark.parametrize(
    "text", ["hello world " + "<é" * 80000, "data " + "Zm9vYmFy+/" * 20000, "▁" + "<é" * 80000, "a ▁" + "<é" * 80000]
)
def test_blobs_beyond_a_chunk(text):
    assert count_spliced(SP, text) == len(SP.encode(text))


def test_random_blobs_with_the_default_chunk():
    rng = random.Random(3)
    for alphabet in ("ab<é▁ ", "<é▁", string.ascii_letters + "+/", "0123456789 "):
        words = ["".join(rng.choices(alphabet, k=rng.choice([3, 10, 90_000]))) for _ in range(12)]
        text = " ".join(words)
        assert count_spliced(SP, text) == len(SP.encode(text))


def test_the_shortest_failing_text():
    assert count_spliced(SP, "<<<<<▁<éé😀", 5, 1) == len(SP.encode("<<<<<▁<éé😀"))


def test_query_over_the_whole_table_and_planted_blobs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    blobs = [(-1, "hello world " + "<é" * 80000), (-2, "data " + "Zm9vYmFy+/" * 20000), (-3, "x " * 100_000)]
    docs = docs.unionByName(spark.createDataFrame(blobs, docs.schema))
    want = {r.doc_id: (len((r.text or "").encode()), len(SP.encode(r.text or ""))) for r in docs.collect()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in count_tokens(docs).collect()}
    assert got == want


def test_no_boundary_widens_to_the_whole():
    for text in ("a" * 5000, " " * 3000, "x" * 1000 + " " + "y" * 1000):
        assert count_spliced(SP, text, 100, 10) == len(SP.encode(text))


def test_defined_results(spark):
    rows = [(1, None, 1), (1, None, 2), (2, "", 3), (None, "a b", 4), (3, "x y z " * 3000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(count_tokens(docs, limit=10).collect(), key=str)
    want = len(SP.encode("x y z " * 3000))
    assert sorted(map(tuple, got), key=str) == sorted(
        [(1, 0, 0, False), (1, 0, 0, False), (2, 0, 0, False), (None, 3, 2, False), (3, 18000, want, True)], key=str
    )
    assert count_tokens(docs.limit(0)).count() == 0
