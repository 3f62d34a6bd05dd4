import zlib
from array import array
from collections import defaultdict

from tokenizers import Tokenizer

from tamarack.llm.common import table, tokenizer_path
from hypothesis import given, settings
from hypothesis import strategies as st

from tamarack.llm.packing import RANKS, TOKENIZER, load, op5_packing, pack

LIBRARY = Tokenizer.from_file(tokenizer_path(TOKENIZER))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x24F), st.sampled_from("ab cé\n\t\u2014\u2019\xa0\x85ß1²٣日本\U0001f600'")), max_size=60))
def test_ids_are_the_librarys(text):
    (got,) = load(tokenizer_path(TOKENIZER), tokenizer_path(RANKS))([text])
    assert list(memoryview(got).cast("I")) == LIBRARY.encode(text, add_special_tokens=False).ids


def verify(docs, rows, longest=2048, partitions=None):
    want = sorted((array("I", [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 1]).tobytes()) for _, t in docs)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    ids_of = defaultdict(list)
    for d, t in docs:
        ids_of[d].append(array("I", [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 1]).tobytes())
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(ids_of)
    for d, pieces in by_doc.items():
        if len(ids_of[d]) == 1:
            ids, at = ids_of[d][0], 0
            for r in sorted(pieces, key=lambda r: r.start):
                assert r.start == at and r.length > 0 and r.doc_tokens == len(ids) // 4
                assert r.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + r.length)])
                at += r.length
            assert 4 * at == len(ids)
        else:
            assert sum(r.length for r in pieces) == sum(len(i) // 4 for i in ids_of[d])
    padded = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= longest
        padded += 0 if at & (at - 1) == 0 else longest - at
        assert len({r.tier for r in pieces}) == 1 and at <= pieces[0].tier
    assert len(want) == len(docs)
    return padded, by_seq


def test_query_on_small_tables(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    padded, by_seq = verify(docs, op5_packing(spark, sf_dir).collect())
    assert padded < 2048 * 4
    steps = defaultdict(int)
    for pieces in by_seq.values():
        steps[pieces[0].step_group] += pieces[0].tier
    assert max(steps.values()) <= 65_536 + 2048


def test_cases(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "x"), (3, "x"), (4, "a  b \n c  <|endoftext|>  d"), (5, "word " * 9000)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, start int")
    got = pack(docs.coalesce(1)).collect()
    padded, _ = verify(rows, got)
    assert padded < 2048
    assert pack(docs.limit(0)).count() == 0
