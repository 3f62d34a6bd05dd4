import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tamarack.llm.common import table
from tamarack.llm.simhash import deduplicate, fingerprint, near_duplicates, op3_simhash, trie_pairs
from tests_llm_plain import brute_components, plain_fingerprint


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbBÉé \t\x0b\x1c  ", max_size=60))
def test_fingerprint(text):
    assert fingerprint(text) == plain_fingerprint(text)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**16 - 1), max_size=60), st.sets(st.integers(0, 63), max_size=40), st.integers(0, 2))
def test_trie_pairs(far, near, budget):
    rows = sorted([(1, v) for v in far] + [(2, v) for v in near])
    group, value = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.uint32)
    left, right = trie_pairs(group, value, 16, budget)
    got = {tuple(sorted(p)) for p in zip(left.tolist(), right.tolist())}
    assert len(got) == len(left)
    assert got == {
        (i, j)
        for i in range(len(rows))
        for j in range(i + 1, len(rows))
        if rows[i][0] == rows[j][0] and (rows[i][1] ^ rows[j][1]).bit_count() <= budget
    }


def test_query_against_all_pairs(spark, sf_dir):
    docs = {r.doc_id: plain_fingerprint(r.text) for r in table(spark, sf_dir, "documents").collect()}
    want = brute_components(docs)
    for r in op3_simhash(spark, sf_dir).collect():
        assert (r.fingerprint, r.component_id) == (f"{docs[r.doc_id]:016x}", want[r.doc_id])


def test_hot_subtrees_lose_no_link(spark):
    import random

    from tamarack.llm.simhash import near_links

    rng = random.Random(3)
    base, values = rng.getrandbits(64), set()
    for _ in range(120):
        v = base
        for _ in range(rng.randint(0, 4)):
            v ^= 1 << rng.randint(0, 63)
        values.add(v)
    prints = {i: v for i, v in enumerate(sorted(values))}
    signed = [(v - (1 << 64) if v >> 63 else v, i) for i, v in prints.items()]
    from tamarack.operators.components import connected_components

    links = near_links(spark.createDataFrame(signed, "fp long, node long"), hot=2)
    got = {i: i for i in prints} | {r.node: r.component for r in connected_components(links).collect()}
    assert got == brute_components(prints)


def test_cases(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(4, None), (3, ""), (7, long), (9, long.upper()), (9, long.upper()), (None, long), (8, "one two"), (None, "alone now")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")
    got = {(r.doc_id, r.fingerprint): r.component_id for r in near_duplicates(docs).collect()}
    assert {k[0]: v for k, v in got.items() if k[0]} == {4: 3, 3: 3, 7: 7, 9: 7, 8: 8}
    assert sorted(v for k, v in got.items() if k[0] is None and v) == [7]
    assert near_duplicates(docs.limit(0)).count() == 0
    assert sorted(str(r.doc_id) for r in deduplicate(docs).collect()) == ["3", "7", "8", "None", "None"]


def test_deduplicate_repeats_ties_and_clashing_names(spark):
    rows = [(1, "a b c d", 1), (1, "a b c d", 1), (2, "a b c d", 2), (3, "p q r s", 3), (3, "other words here now", 4), (None, "a b c d", 5), (4, None, 6), (5, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").withColumnsRenamed({"n": "stays"})
    for name in ("fp", "node", "component_id"):
        docs = docs.withColumn(name, docs["stays"])
    first = deduplicate(docs).collect()
    assert deduplicate(docs).columns == docs.columns
    assert sorted(str(r.doc_id) for r in first) == ["1", "3", "4", "None"]
    # the same row of a repeated id each time, however the rows lie
    again = deduplicate(docs.repartition(3, "stays")).collect()
    assert sorted(map(str, first)) == sorted(map(str, again))
