import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tamarack.llm import terms as words
from tamarack.llm.ranked_search import Shard, Vocabulary, nra, search

LOWER = str.maketrans({c: chr(ord(c) + 32) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def plain_terms(text):
    return [t.translate(LOWER) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def plain_search(docs, items, k=50):
    """Every document's score for every item, and the best of them."""
    held = [(i, Counter(plain_terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    total, length = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked, out = {}, []
    for i, t in items:
        asked.setdefault(i, set()).update(plain_terms(t))
    for item, own in asked.items():
        scores = []
        for i, c, n in held:
            m = 50 + 50 * n * total // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def corpus(n, seed=0):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Älter", "ümlaut", "日本", "a" * 40]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    texts = [" ".join(rnd.choices(vocabulary, weights, k=rnd.choice([1, 5, 30, 200]))) for _ in range(n)]
    return [(i, rnd.choice(texts[: n // 4]) if rnd.random() < 0.3 else t.title() if rnd.random() < 0.2 else t) for i, t in enumerate(texts)]


ITEMS = [(1, "w0 w1 W5 w59"), (2, "ümlaut, 日本! w3"), (3, "nothing here"), (4, None), (5, ""), (6, "w0"), (1, "w7-w8"), (None, "w2 " + "a" * 40), (7, " ".join(f"w{i}" for i in range(60)))]
ODD = [(None, "w5 w59"), (None, "w5 w59"), (3, "w5 w59"), (3, "w5 w59"), (900, None), (901, ""), (902, "- . -")]


@pytest.mark.parametrize("options", [{}, {"most_postings": 100}, {"most_terms": 20}, {"k": 3}, {"most_queries": 2, "k": 1_000}])
def test_against_plain(spark, options):
    docs = corpus(300) + ODD
    table = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, score string").repartition(5)
    found = search(table, spark.createDataFrame(ITEMS, "item_id long, text string"), **options)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_search(docs, ITEMS, options.get("k", 50))


def test_empty_tables_and_other_ids(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "two three")], "doc_id int, text string")
    items = spark.createDataFrame([("a", "ONE three"), ("b", "two")], "item_id string, text string")
    assert search(docs.limit(0), items).collect() == [] and search(docs, items.limit(0)).collect() == []
    assert sorted(map(tuple, search(docs, items).collect())) == plain_search([(1, "one two"), (2, "two three")], [("a", "one three"), ("b", "two")])
    assert search(docs.withColumn("text", docs.text.substr(1, 0)), items).collect() == []


def test_a_long_text(spark, monkeypatch):
    text = "w1 " * 600_000 + "w2 w3"
    docs = [(1, text), (2, "w2 w1"), (3, "w9")]
    assert len(text) > words.BLOCK_BYTES
    items = [(1, "w1 w2"), (2, "w3 w9")]
    found = search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_search(docs, items)


@pytest.mark.parametrize("seed", range(6))
def test_nra_gives_what_all_scores_give(seed):
    rng = np.random.default_rng(seed)
    docs, size = 400, 12
    ids = rng.permutation(docs).astype(np.int64)
    held = [(d, t) for d in range(docs) for t in range(size) if rng.random() < 0.9 / (t + 1) ** 0.5]
    doc, term = (np.array(v) for v in zip(*held))
    impact = rng.integers(1, 6 if seed % 2 else 1_000, len(doc))  # many ties, or few
    shard = Shard.of(ids, np.zeros(docs, dtype=bool), doc, term, impact, size)
    for _ in range(10):
        terms = rng.permutation(size)[: rng.integers(1, size)]
        weights = rng.integers(0, 9, len(terms))
        scores = {d: sum(int(w) * int(impact[np.flatnonzero((doc == d) & (term == t))].sum()) for t, w in zip(terms, weights)) for d in range(docs)}
        order = sorted((-s, int(ids[d])) for d, s in scores.items() if s > 0)
        for k, block in ((1, 2), (7, 3), (50, 16), (1_000, 64)):
            for least in (1, -order[min(k, len(order)) - 1][0] if order else 1):
                top = nra(shard, terms, weights, k, least, block)
                want = [x for x in order if -x[0] >= least][:k]
                assert [(-int(s), int(i)) for s, i in zip(top[0], top[1])] == want


def test_terms_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(words, "word_hashes", lambda data, starts, lengths: (lengths % 2).astype(np.uint64))
    vocabulary, number = Vocabulary.of(["one", "two", "four", "three"])
    column = pa.array(["two four nine ONE", None, "seven three"])
    data, _ = words.column_bytes(column)
    (block,) = words.terms_of(column)
    at, term = vocabulary.find(data, block.start, block.length, block.hash)
    names = {v: k for k, v in number.items()}
    assert sorted((int(a), names[int(t)]) for a, t in zip(at, term)) == [(0, "two"), (1, "four"), (3, "one"), (5, "three")]
