import hashlib
import random

import tiktoken
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tamarack.llm.bpe import LONG_WORD, PATTERN, RANKS, decode_ids, encode_documents, load, op4_byte_bpe, round_trip_digests
from tamarack.llm.common import table, tokenizer_path

BPE = load(tokenizer_path(RANKS))
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=BPE.ranks, special_tokens={})
SHA = lambda b: hashlib.sha256(b).hexdigest()


def ids(text):
    return [int(i) for i in BPE.encode([text])[0].split(b",") if i]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab c\n\t '’stéß1٣  \U0001f600日本llve.,!?<|endoftext|>", max_size=80))
def test_ids_are_the_librarys(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)


def test_long_words_and_runs():
    rng = random.Random(1)
    for text in ["a" * 3000, " ".join("".join(rng.choices("ethanosé", k=rng.choice([5, 300, 900]))) for _ in range(60)), " " * 900, "hello" * 100, "".join(rng.choice("ethanos") for _ in range(2000)), "x  \n "]:
        assert ids(text) == LIBRARY.encode_ordinary(text)
    word = b"".join(rng.choice([b"th", b"e", b"an", b"\xc3\xa9"]) for _ in range(LONG_WORD // 3))
    assert BPE._encode_long(word) == BPE._encode_words([word])[0]


def test_query_against_library(spark, sf_dir):
    got = {r.doc_id: tuple(r)[1:] for r in op4_byte_bpe(spark, sf_dir).collect()}
    for row in table(spark, sf_dir, "documents").collect():
        want = LIBRARY.encode_ordinary(row.text)
        assert got[row.doc_id] == (len(want), SHA(",".join(map(str, want)).encode()), SHA(row.text.encode()))


def test_round_trip_and_cases(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "a  b é", "x"), (3, "z", "y"), (3, "z", "y")], "doc_id long, text string, ids string")
    encoded = encode_documents(docs)
    back = sorted((str(r.doc_id), bytes(r.bytes)) for r in decode_ids(encoded).collect())
    assert back == [("1", b""), ("2", b""), ("3", b"z"), ("3", b"z"), ("None", "a  b é".encode())]
    digests = {r.doc_id: r for r in round_trip_digests(docs).collect()}
    assert digests[1].n_tokens == 0 and digests[1].ids_sha256 == digests[2].decoded_sha256 == SHA(b"")
    assert round_trip_digests(docs.limit(0)).count() == 0
