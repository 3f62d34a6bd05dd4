import re

import numpy as np
import pyarrow as pa
import pytest

from tamarack.llm import terms
from tamarack.llm.decontamination import benchmark_windows, decontaminate, overlaps

LOWER = str.maketrans({c: chr(ord(c) + 32) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def plain_words(text):
    return [(m.group(), m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))]


def plain_overlap(text, items, n=10):
    """n_words, n_hit, items, spans of a text by comparing every window with every item's."""
    words, hit, ids, ranges = plain_words(text), set(), set(), []
    for item, own in items:
        own = [w for w, _, _ in plain_words(own)]
        wide = min(n, len(own))
        windows = {tuple(own[i : i + wide]) for i in range(len(own) - wide + 1)} if wide else set()
        for i in range(len(words) - wide + 1 if wide else 0):
            if tuple(w for w, _, _ in words[i : i + wide]) in windows:
                hit.update(range(i, i + wide))
                ranges.append((i, i + wide))
                ids.update({str(item)} if item is not None else ())
    spans = []
    for a, b in sorted(ranges):
        if spans and a < spans[-1][1]:
            spans[-1][1] = max(b, spans[-1][1])
        else:
            spans.append([a, b])
    return len(words), len(hit), sorted(ids), [(words[a][1], words[b - 1][2]) for a, b in spans]


ITEMS = [
    (1, "Alpha beta, gamma delta: épsilon zeta eta theta iota kappa lambda mu"),
    (2, "short ITEM"),
    (3, ""),
    (4, None),
    (10, "beta gamma delta épsilon zeta eta theta iota kappa lambda"),
    (None, "nobody owns these three"),
    (2, "of one id both"),
]
TEXTS = [
    (1, "x ALPHA beta gamma delta  épsilon\nzeta eta theta iota kappa lambda mu. Tail"),
    (1, "x ALPHA beta gamma delta  épsilon\nzeta eta theta iota kappa lambda mu. Tail"),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa"),
    (3, "日本 Short...item, short item"),
    (4, None),
    (5, ""),
    (None, "nobody owns these THREE and of one id both"),
    (7, "..."),
    (8, "short alpha beta gamma delta épsilon zeta eta theta iota kappa short item"),
    (9, "shorts item"),
]


@pytest.mark.parametrize("most_bytes", [32 << 20, 0])
def test_against_plain(spark, most_bytes):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3)
    found = overlaps(docs, spark.createDataFrame(ITEMS, "item_id long, text string"), most_bytes=most_bytes).collect()
    got = sorted(((r.doc_id, r.text, r.overlap.n_words, r.overlap.n_hit, list(r.overlap["items"]), [tuple(s) for s in r.overlap.spans]) for r in found), key=repr)
    assert got == sorted(((i, t, *plain_overlap(t, ITEMS)) for i, t in TEXTS), key=repr)
    assert sum(g[3] > 0 for g in got) == 5


@pytest.mark.parametrize("most_bytes", [32 << 20, 0])
def test_removal_and_clashing_names(spark, most_bytes):
    docs = spark.createDataFrame([(i, t, i, "k") for i, t in TEXTS], "doc_id long, text string, overlap long, KEY string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    cut = {(r.doc_id, r.text) for r in decontaminate(docs, items, most_bytes=most_bytes).collect()}
    assert (1, "x . Tail") in cut and (3, "日本 , ") in cut and (8, "short  ") in cut and (9, "shorts item") in cut and (4, None) in cut
    left = decontaminate(docs, items, remove="documents", most_bytes=most_bytes)
    assert left.columns == docs.columns and left.dtypes == docs.dtypes
    assert sorted((r.doc_id, r.text) for r in left.collect() if r.doc_id is not None) == [(2, TEXTS[2][1]), (4, None), (5, ""), (7, "..."), (9, "shorts item")]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(TEXTS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert overlaps(docs.limit(0), items).collect() == []
    assert {r.overlap.n_hit for r in overlaps(docs, items.limit(0)).collect()} == {0}
    assert {r.overlap.n_hit for r in overlaps(docs, items.limit(0), most_bytes=-1).collect()} == {0}
    with pytest.raises(ValueError):
        decontaminate(docs, items, remove="half")


def test_a_long_text_is_read_across_blocks(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    long = ("filler " * 149_790) + passage + " end " + "filler " * 200_000 + passage.upper()
    assert len(long) > 2 * terms.BLOCK_BYTES
    items = spark.createDataFrame([(7, passage)], "item_id long, text string")
    docs = spark.createDataFrame([(k, " " * k + long) for k in (0, 9, 18, 40)], "doc_id long, text string")  # the edge within the passage and behind it
    for row in overlaps(docs, items).collect():
        assert row.overlap.n_hit == 24 and len(row.overlap.spans) == 2 and row.overlap["items"] == ["7"]
        a, b = row.overlap.spans[1]
        assert row.text[a:b] == passage.upper() and row.overlap.n_words == 149_790 + 12 + 1 + 200_000 + 12


def test_words_of_blocks():
    texts = ["One two", None, "", "ü-3x", "a" * 50 + " b", "   "] * 3
    got = [(int(r), int(p)) for block in terms.terms_of(pa.array(texts), 16) for r, p in zip(block.row, block.place)]
    assert got == [(i, k) for i, t in enumerate(texts) for k in range(len(plain_words(t)))]
    data, _ = terms.column_bytes(pa.array(texts))
    for block in terms.terms_of(pa.array(texts), 16):
        text, begins = terms.joined(data, block.start, block.length)
        words = [text[b : b + n].tobytes().decode() for b, n in zip(begins, block.length)]
        assert words == [plain_words(texts[r])[p][0] for r, p in zip(block.row, block.place)]


def test_hash_set_holds_what_it_was_given():
    rng = np.random.default_rng(3)
    some = rng.integers(0, 2**63, 1_000).astype(np.uint64)
    at, place = terms.HashSet.of(some[:500]).find(some)
    assert sorted(at.tolist()) == list(range(500)) and (np.unique(some[:500])[place] == some[at]).all()


def test_windows_of_items(spark):
    rows = benchmark_windows(spark.createDataFrame(ITEMS, "item_id long, text string")).collect()
    assert {(r.length, bytes(r.window).decode(), r.item) for r in rows} >= {(2, "short item", "2"), (4, "of one id both", "2"), (4, "nobody owns these three", None)}
    assert sum(r.item == "1" for r in rows) == 3
