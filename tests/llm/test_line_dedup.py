import random

import duckdb
import numpy as np
import pyarrow as pa

from tamarack.llm import line_dedup as L
from tamarack.llm.common import table
from tamarack.llm.words import words_of
from tests_llm_plain import brute_lines as brute


def test_random_lines(spark, monkeypatch):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(60)] + ["É", "the", "THE", "a\x1cb"]
    bases = [[rng.choice(vocab) for _ in range(rng.randint(1, 14))] for _ in range(25)]
    docs = []
    for i in range(120):
        lines = []
        for _ in range(rng.randint(0, 5)):
            line = list(rng.choice(bases))
            for _ in range(rng.randint(0, 2)):
                line[rng.randrange(len(line))] = rng.choice(vocab)
            lines.append(rng.choice([" ", "  ", "\t"]).join(line))
        docs.append((i, "\n".join(lines)))
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n int")
    for hot in (64, 3):
        monkeypatch.setattr(L, "HOT_COUNT", hot)
        got = {r.doc_id: (r.text, r._n_lines, r._n_removed) for r in L.dedup_lines(df).collect()}
        assert got == brute(docs)


def test_one_word_and_one_passage_on_half_of_the_lines(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"b{i}" for i in range(20)]
    docs = []
    for i in range(150):
        line = list(base)
        for _ in range(rng.randint(0, 4)):
            line[rng.randrange(20)] = f"v{rng.randrange(40)}"
        docs.append((i // 3, " ".join(line) + "\n" + " ".join(["common", *rng.choices(["x", "y", "z", "w"], k=rng.randint(1, 9))])))
    merged = {}
    for i, text in docs:
        merged[i] = merged[i] + "\n" + text if i in merged else text
    df = spark.createDataFrame(list(merged.items()), "doc_id long, text string")
    want = brute(list(merged.items()))
    for hot in (5, 100_000):
        monkeypatch.setattr(L, "HOT_COUNT", hot)
        assert {r.doc_id: (r.text, r._n_lines, r._n_removed) for r in L.dedup_lines(df).collect()} == want


def test_words_as_arrays():
    rng = random.Random(2)
    for _ in range(60):
        texts = [None if rng.random() < 0.1 else "".join(rng.choices("aAbÉ \n\t\r\x0b\x1cxyzw0123456789", k=rng.choice([0, 1, 9, 300]))) for _ in range(8)]
        column = pa.array(["pad", *texts], pa.string()).slice(1)
        got = [
            (int(rows[w.text_of_line[k]]), int(w.pos_of_line[k]), w.hash[w.line == k].tolist())
            for rows, w in words_of(column, rng.choice([1, 9, 1 << 20])) for k in range(len(w.text_of_line))
        ]
        want = [(i, p, x.lower().split()) for i, t in enumerate(texts) for p, x in enumerate((t or "").encode().split(b"\n")) if x.split()]
        assert [(i, p, len(h)) for i, p, h in got] == [(i, p, len(x)) for i, p, x in want]
        seen = {(x, h) for (_, _, hs), (_, _, xs) in zip(got, want) for h, x in zip(hs, xs)}
        assert len({x for x, _ in seen}) == len({h for _, h in seen}) == len(seen)


def test_clashing_names_ties_and_folded_sketches(spark):
    docs = spark.createDataFrame([(1, "a b c", 1), (2, "a b c", 2), (2, "a b c", 2), (2, "x y", 3)], "doc_id long, text string, cut int")
    for name in ("_cut", "_id", "_hash", "text_hash", "pos", "words", "_n_lines"):
        docs = docs.withColumn(name, docs["cut"])
    out = L.dedup_lines(docs)
    assert sorted((r.doc_id, r.text, r._hash) for r in out.collect()) == [(1, "a b c", 1), (2, "", 2), (2, "", 2), (2, "x y", 3)]
    level = np.zeros(1 << 14, dtype=np.uint8)
    level[[0, 1, 4096, 9000, 9001]] = [1, 1, 1, 3, 40]
    small = L._folded(level)
    assert len(small) == 1 << 10 and small[0] >= 2 and small[256] == 1 and small[562] >= 40


def test_query_against_brute_force_and_sql(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in L.op2_line_dedup(spark, sf_dir).collect()}
    assert got == brute(docs)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    assert {r[0]: tuple(r[1:]) for r in con.execute(L.OP2_SQL).fetchall()} == got


def test_cases(spark):
    long = " ".join(f"x{i}" for i in range(5000))
    rows = [(1, "a b c\n\nd"), (2, None), (3, ""), (None, "a b c"), (4, "A  b c\nnew line\n" + long), (4, "A  b c\nnew line\n" + long), (5, long + " y"), (6, "d")]
    docs = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id long, text string, pos string, _n int")
    got = sorted(((r.doc_id, r.text, r._n_lines, r._n_removed) for r in L.dedup_lines(docs).collect()), key=str)
    assert got == sorted(
        [(1, "a b c\n\nd", 3, 0), (2, None, 0, 0), (3, "", 1, 0), (None, "a b c", 1, 0), (4, "new line\n" + long, 3, 1),
         (4, "new line\n" + long, 3, 1), (5, "", 1, 1), (6, "", 1, 1)],
        key=str,
    )
    assert L.dedup_lines(docs.limit(0)).count() == 0
